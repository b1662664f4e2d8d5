from pyspark.sql import functions as F

from spendlens.llm import language_id, queries
from tests.conftest import SF_CHECK
from tests.llm.util import ODD_TEXTS, docs_frame


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = queries.op4_language_id(spark, SF_CHECK).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def test_odd_texts(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    odd = docs_frame(spark, ODD_TEXTS).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    for i, t in enumerate(ODD_TEXTS):
        letter = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not letter)
        assert 0 <= got[i].score <= 1
    assert language_id.predict(docs_frame(spark, []), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = docs_frame(spark, ["some words"])
    model = language_id.fit(docs, F.lit(False))
    assert [tuple(r) for r in language_id.predict(docs, model).collect()] == [(0, "und", 0.0)]
