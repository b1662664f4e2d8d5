from pyspark.sql import functions as F

from spendlens.llm import queries, rule_quality, toxicity
from tests.conftest import SF_CHECK
from tests.llm.util import ODD_TEXTS, docs_frame

SF_BENCH = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = queries.op9_rule_quality(spark, SF_CHECK).join(labels, "doc_id")
    right, n = got.where("held_out").agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 40 and right / n > 0.93
    assert got.where("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0


def test_rules_are_what_the_trees_and_the_columns_say(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_quality.fit(docs, labels, F.lit(True), trees=5, depth=3)
    assert model["rules"] and all(1 <= len(r) <= 3 for r, _ in model["rules"])
    table = rule_quality.statistics(docs)
    import math

    for r in table.withColumn("score", rule_quality.score_column(model)).limit(50).collect():
        z = model["intercept"] + sum(w for rule, w in model["rules"] if all((r[f"s_{s}"] > at) == above for s, above, at in rule))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-12


def test_statistics_by_hand(spark):
    docs = docs_frame(spark, ["Aa aa! B7 ##x\n", None, ""])
    rows = {r.doc_id: r for r in rule_quality.statistics(docs).collect()}
    r = rows[0]
    assert (r.s_capitals, r.s_word_repeats, r.s_symbol_words) == (2 / 6, 0.0, 0.25)
    assert all(rows[1][f"s_{s}"] == rows[2][f"s_{s}"] == 0 for s in rule_quality.STATISTICS)


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet(f"{SF_BENCH}/labels.parquet")
    docs = spark.read.parquet(f"{SF_BENCH}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    named = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, named.where(~held), ["low_quality", "toxic"])
    got = toxicity.score(docs, chain).join(labels, "doc_id").where(held).select("toxic", toxicity.is_positive(chain, "toxic").cast("int").alias("p"))
    hit, said, true = got.agg(F.sum(F.col("toxic") * F.col("p")), F.sum("p"), F.sum("toxic")).first()
    assert true > 100 and hit / said > 0.75 and hit / true > 0.6


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else (i // 2) % 2) for i in range(len(ODD_TEXTS))] * 2, "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, ODD_TEXTS).withColumn("quality", F.lit("clash")).withColumn("__x", F.lit(1))
    model = rule_quality.fit(docs, labels, F.lit(True))
    assert rule_quality.score(docs, model).count() == len(ODD_TEXTS)
    chain = toxicity.fit(docs, labels, ["quality", "toxic"])
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.p_toxic <= 1 for r in rows)
    none = labels.limit(0)
    assert rule_quality.score(docs, rule_quality.fit(docs, none, F.lit(True))).first().score == 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none, ["toxic"])).collect() == []


def test_chain_forward_pass_by_hand(spark):
    """Every probability again in plain Python: the text's words, then the categories before."""
    import math

    import numpy as np

    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    named = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, named, ["low_quality", "toxic"])
    assert any(chain["models"][1]["earlier"] != 0)
    for r in toxicity.score(docs, chain, keep=("doc_id", "text")).limit(60).collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        bag, _ = toxicity.hashed_words(data, np.array([0, len(data)]), chain["buckets"])
        p = []
        for m in chain["models"]:
            z = m["bias"] + sum(m["words"][b] for b in bag) + sum(w * x for w, x in zip(m["earlier"], p))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert abs(r.p_low_quality - p[0]) < 1e-9 and abs(r.p_toxic - p[1]) < 1e-9


def test_one_fit_lowers_the_penalised_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    n, buckets = 400, 50
    bags = [np.unique(rng.integers(0, buckets, 12)).astype(np.int32) for _ in range(n)]
    bounds, bag = np.append(0, np.cumsum([len(b) for b in bags])), np.concatenate(bags)
    y = np.array([float(3 in b) for b in bags])
    earlier = rng.random((n, 1))
    model = toxicity._fit_one(bag, bounds, earlier, y, buckets)

    def loss(words, w, bias):
        p = toxicity.probability({"words": words, "earlier": w, "bias": bias}, bag, bounds, earlier)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + toxicity.PENALTY / 2 * ((words**2).sum() + (w**2).sum() + bias**2)

    best = loss(model["words"], model["earlier"], model["bias"])
    assert best < 0.25 * loss(np.zeros(buckets), np.zeros(1), 0.0) and model["words"].argmax() == 3
    said = toxicity.probability(model, bag, bounds, earlier) > 0.5  # the steps end before the optimum, but past this
    assert (said == (y > 0)).all()


def test_rare_toxic_words_have_weight(spark):
    """A word of 8 toxic texts in 3,000: a share of the texts below any floor that grows with them."""
    import random

    rnd = random.Random(9)
    texts, toxic = [], []
    for i in range(3000):
        w = [f"w{rnd.randrange(300)}" for _ in range(20)]
        bad = "oftenbad" if i % 20 == 0 else "rarebad" if i < 160 and i % 20 == 10 else None
        texts.append(" ".join(w + [bad] * bool(bad)))
        toxic.append(int(bad is not None))
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ["toxic"])
    new = docs_frame(spark, ["w1 w2 w3 rarebad w4", "w1 w2 w3 w4 w5"])
    rare, clean = (r.p_toxic for r in toxicity.score(new, chain).orderBy("doc_id").collect())
    assert rare > 3 * clean
    repeated = toxicity.score(docs.limit(5).unionAll(docs.limit(5)), chain).collect()
    assert len(repeated) == 10 and len({(r.doc_id, r.p_toxic) for r in repeated}) == 5
