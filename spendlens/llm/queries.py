"""One query per operator over its whole table, and their SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    curriculum,
    decontaminate,
    language_id,
    lexical_search,
    ngram_join,
    periodic,
    recompression,
    role_repair,
    rule_quality,
    suffix_dedup,
    toxicity,
    vector_graph,
)

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_read(spark, sf_dir, "documents"), bpe.vocabulary(_bpe_path()))
    return bpe_digests(coded)


def bpe_digests(coded: DataFrame) -> DataFrame:
    """The contract's digests of (doc_id, ids, decoded)."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = language_id.is_held_out()
    model = language_id.fit(docs, ~held)
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    items = decontaminate.item_list("matches")
    n_hit = decontaminate.hit_words("matches")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.format_chats(_read(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    return toxicity.score(docs, chain).withColumn("toxic", toxicity.is_positive(chain, "toxic"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), rule_quality.is_held_out()
    model = rule_quality.fit(docs, _read(spark, sf_dir, "labels"), ~held)
    scored = rule_quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.assign(_read(spark, sf_dir, "documents"))
    first = F.round(F.get("plays", F.lit(0))["position"], 9)
    return plan.select(
        "doc_id", "size", "source_size", "target", curriculum.words_taken().alias("taken"), first.alias("first_position")
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("__h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = periodic.periodic_runs(docs, replay_col="__h")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        periodic.strongest_run("runs").alias("top"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        *[F.col("top")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("(1000 * top.length) div top.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_recompression": op3_recompression,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_role_repair": op6_role_repair,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_rule_quality": op9_rule_quality,
    "op10_vector_graph": op10_vector_graph,
    "op11_lexical_search": op11_lexical_search,
    "op12_curriculum": op12_curriculum,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op11_lexical_search": f"""
with words as (select doc_id, unnest({_TERMS}) as term from documents),
postings as (select doc_id, term, count(*) as tf from words group by all),
lengths as (select doc_id, sum(tf)::bigint as n from postings group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w
  from postings cross join totals group by term, docs),
factors as (select doc_id, 100 - 90 + (90 * n * docs) // terms as m from lengths cross join totals),
wanted as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from wanted join weights using (term) join postings using (term) join factors using (doc_id) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scores where score > 0)
select item_id, r::int as rank, doc_id, score from ranked where r <= 10""",
    "op12_curriculum": """
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    md5('42|' || coalesce(doc_id::varchar, 'null')) as key from documents),
per as (select source, sum(size)::bigint as have,
    ((row_number() over (order by source nulls last) - 1) % 3)::int as kind from sized group by source),
massed as (select *, case kind when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as mass, 3 * have as cap from per),
rounds as (
  select 0 as i, (select sum(have) from massed)::double / (select sum(mass) from massed) as level
  union all
  select i + 1, ((select sum(have) from massed) - coalesce((select sum(cap) from massed where mass * level > cap), 0))::double
    / (select sum(mass) from massed where not mass * level > cap) from rounds
  where i < (select count(*) from massed) and exists (select 1 from massed where not mass * level > cap)),
targets as (select source, have, kind, mass, least(mass * (select max(level) from rounds), cap::double) as target from massed),
placed as (select doc_id, size, have, kind, mass, target,
    (sum(size) over (partition by sized.source order by key, doc_id rows unbounded preceding) - size)::bigint as x
  from sized join targets on sized.source is not distinct from targets.source),
taken as (select *, greatest(0, least(size, round(target)::bigint - x)) + greatest(0, least(size, round(target)::bigint - x - have))
    + greatest(0, least(size, round(target)::bigint - x - 2 * have)) as words, x / target * mass as y from placed)
select doc_id, size, have as source_size, target, words::bigint as taken,
  case when words > 0 then round(least(1.0, case kind
    when 0 then 2.0 * y / (7.0 + sqrt(49.0 + 2.0 * -4.0 * y))
    when 1 then 2.0 * y / (1.0 + sqrt(1.0 + 2.0 * 2.0 * y))
    else 2.0 * y / (1.0 + sqrt(1.0 + 0.0 * y)) end), 9) end as first_position
from taken""",
}
