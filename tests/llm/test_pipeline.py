"""Each stage on small tables against brute force, and the whole against stage results."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_cuts
from tests.llm.test_suffix_dedup import texts
from tests.llm.util import DOCS, ODD_TEXTS, docs_frame


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_characters(spark):
    cases = ["aé".encode(), "é".encode()[:1] + b"x", b"x" + "日".encode()[1:], "a�b".encode(), b"", b"a\xc3"]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    got = [r.t for r in frame.select("i", pipeline.whole_characters(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == ["aé", "x", "x", "a�b", "", "a"]


def test_stages_on_odd_rows(spark):
    docs = docs_frame(spark, texts()).withColumn("kept", F.lit("extra")).withColumn("score", F.lit(1))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.columns == docs.columns
        out.collect()
        stage(spark, docs.limit(0), SF_SMALL).collect()


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in left.items() if any(c.isalpha() for c in t or "")}
    ids = sorted(left)
    groups = brute_groups([left[i] for i in ids])
    ids = [i for k, i in enumerate(ids) if groups[k][2] == k]
    cuts = brute_cuts([left[i] for i in ids])
    left = {i: re.sub("�", "", c[3].decode("utf-8", "ignore")) for i, c in zip(ids, cuts)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hits = brute_hits([left[i] for i in ids], items)
    want = [i for i, (n, h, _) in zip(ids, hits) if not (h and 20 * h >= n)]
    got = {r.doc_id: r.decoded_sha256 for r in pipeline.run(spark, SF_SMALL).collect()}
    assert sorted(got) == want
    import hashlib

    assert all(got[i] == hashlib.sha256(left[i].encode()).hexdigest() for i in want)


def test_rows_that_share_an_id_are_judged_apart(spark):
    copy, own = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, copy), (2, copy), (2, own), (2, own), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in pipeline.one_of_each_group(spark, docs, SF_SMALL).collect()), key=str)
    assert kept == sorted([(1, copy), (2, own), (2, own), (3, None), (3, "")], key=str)


def test_odd_texts_survive_the_last_stage(spark):
    assert pipeline.tokenized(spark, docs_frame(spark, ODD_TEXTS), SF_SMALL).count() == len(ODD_TEXTS)
