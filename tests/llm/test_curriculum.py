import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from spendlens.llm import curriculum, queries
from tests.conftest import SF_CHECK
from tests.llm.util import DOCS, ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(have, mass, cap):
    """Targets by sharing the excess again until no source is above its cap."""
    total, capped = sum(have), {}
    while True:
        free = [i for i in range(len(have)) if i not in capped]
        left = total - sum(capped.values())
        weight = sum(mass[i] for i in free)
        want = {i: left * mass[i] / weight for i in free}
        over = [i for i in free if want[i] > cap * have[i]]
        if not over:
            return [capped.get(i, want.get(i)) for i in range(len(have))]
        capped |= {i: cap * have[i] for i in over}


def plain(rows, mass=(5.0, 2.0, 1.0), cap=3):
    """{(doc_id, source): (size, source size, target, taken)} by one running sum per source."""
    by = {}
    for i, text, source in rows:
        by.setdefault(source, []).append((hashlib.md5(f"42|{'null' if i is None else i}".encode()).hexdigest(), i, len(WORD.findall(text or ""))))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    have = [sum(r[2] for r in by[s]) for s in names]
    want = shares(have, [mass[k % 3] for k in range(len(names))], cap) if sum(have) else [0.0] * len(have)
    out = {}
    for name, n, target in zip(names, have, want):
        x = 0
        for _, i, size in sorted(by[name], key=lambda r: (r[0], str(r[1]), r[2])):
            taken = sum(max(0, min(size, round(target) - x - k * n)) for k in range(cap))
            out[i, name] = (size, n, target, taken)
            x += size
    return out


def compare(got, want, id_of=lambda r: (r.doc_id, r.source)):
    assert len(got) == len(want)
    for r in got:
        size, have, target, taken = want[id_of(r)]
        assert (r["size"], r.source_size, r.taken) == (size, have, taken)
        assert r.target == pytest.approx(target)


def _plan(docs, **settings):
    return curriculum.assign(docs, keep=("doc_id", "source"), **settings).withColumn("taken", curriculum.words_taken())


def test_query_equals_running_sums(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "source")
    want = plain([tuple(r) for r in docs.collect()])
    source = {i: s for i, s in want}
    got = queries.op12_curriculum(spark, SF_CHECK).collect()
    compare(got, want, lambda r: (r.doc_id, source[r.doc_id]))
    taken = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        taken.setdefault((source[r.doc_id], r.target), []).append(r.taken)
    assert all(abs(sum(v) - target) <= 0.5 for (_, target), v in taken.items())
    assert got == queries.op12_curriculum(spark, SF_CHECK).collect()


def test_small_sources_are_capped_and_slices_agree(spark):
    rows = [(i, "w " * (i % 7), ["b", "a", None, "C", "", "é"][min(i % 11, 5)] if i < 90 else "a") for i in range(400)]
    rows += [(1000, "one two", "tiny"), (1001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain(rows)
    assert any(t == 3 * n > 0 for _, n, t, _ in want.values())
    for settings in ({}, {"slice_rows": 3}):
        got = _plan(docs.repartition(5), **settings).collect()
        compare(got, want)
    plays = sorted((r.doc_id, r.plays) for r in _plan(docs).collect())
    assert plays == sorted((r.doc_id, r.plays) for r in _plan(docs.repartition(7), slice_rows=9).collect())


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    early, late = ((0.0, 2.0), (0.5, 2.0), (0.5 + 1e-9, 0.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))
    order = curriculum.training_order(_plan(docs, schedules=(early, late)), ("source", "doc_id")).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert max(r.position for r in order if r.source == "a") <= 0.5 + 1e-6
    half = sum(r.words for r in order if r.source == "b" and r.position < 0.5)
    assert half == pytest.approx(sum(r.words for r in order if r.source == "b") / 4, rel=0.01)
    assert sum(r.words for r in order) == 20_000
    doubled = curriculum.assign(docs, ((((0.0, 1.0), (1.0, 1.0))), ((0.0, 0.0), (1.0, 0.0))), keep=("doc_id", "source"))
    by = {r.source: r for r in doubled.groupBy("source").agg(F.max("target").alias("t"), F.max(F.size("plays")).alias("n")).collect()}
    assert (by["a"].t, by["a"].n, by["b"].t, by["b"].n) == (20_000, 2, 0, 0)


@pytest.mark.parametrize("schedule", [((0.0, 1.0),), ((0.1, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 1.0), (0.0, 1.0), (1.0, 1.0))])
def test_bad_schedules(schedule):
    with pytest.raises(ValueError):
        curriculum.integrals(schedule)


def test_odd_rows(spark):
    rows = [(None if i == 6 else i // 3, t, "en", [None, "s", "t"][i % 3], None) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as plays", "1 as size", "2 as __size")
    got = _plan(docs).collect()
    assert len(got) == len(rows)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault((r.source, r.target, r.source_size), []).append((r["size"], r.taken))
    for (_, target, have), pairs in by_source.items():
        assert sum(s for s, _ in pairs) == have and abs(sum(t for _, t in pairs) - target) <= 0.5
    assert _plan(docs.limit(0)).collect() == []
    blank = _plan(docs.where("trim(text) = '' or text is null")).collect()
    assert blank and all((r["size"], r.target, r.taken, r.plays) == (0, 0.0, 0, []) for r in blank)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF_CHECK}/documents.parquet')")
    want = con.execute(queries.ORACLE["op12_curriculum"]).df()
    got = queries.op12_curriculum(spark, SF_CHECK).toPandas()[list(want.columns)]
    want, got = (d.sort_values("doc_id").reset_index(drop=True) for d in (want, got))
    assert want.equals(got.astype(want.dtypes.to_dict()))
