import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import periodic, queries
from tests.conftest import SF_CHECK
from tests.llm.util import ODD_TEXTS, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, h=None):
    """(runs, collapsed text) by comparing every word at every lag."""
    words = WORD.findall(text or "")
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = periodic.brute_force_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone), n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8).flatmap(lambda w: st.integers(1, 9).map(lambda k: w * k)), max_size=5))
def test_runs_of_repeated_pieces(pieces):
    words = [w for piece in pieces for w in piece]
    ids = np.array(words, np.int64)
    got = periodic.chunk_runs(ids, np.array([0, len(ids)]))
    assert [tuple(r[1:]) for r in got.T.tolist()] == periodic.brute_force_runs(words)


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_runs_in_random_words(letters):
    rng = random.Random(letters)
    for _ in range(20):
        words = [rng.randrange(letters) for _ in range(rng.randrange(400))]
        at, p = rng.randrange(len(words) + 1), rng.randrange(1, 40)
        words[at:at] = [rng.randrange(letters) for _ in range(p)] * rng.randrange(3, 7)
        got = periodic.chunk_runs(np.array(words), np.array([0, len(words)]))
        assert [tuple(r[1:]) for r in got.T.tolist()] == periodic.brute_force_runs(words)


def test_segments_are_stable_and_hold_every_run():
    rng = random.Random(5)
    for _ in range(30):
        words = np.array([min(rng.randrange(60), rng.randrange(60)) for _ in range(300)] + [7, 8] * 5)
        lo, hi = periodic.frequent_segments(words, np.array([0, 100, 100, len(words)]))
        for a, b in zip(lo, hi):
            assert b - a >= 6 and np.unique(words[a:b], return_counts=True)[1].min() >= 4
            assert not (a < 100 < b)
        for s, n, _ in periodic.brute_force_runs(words[100:].tolist()):
            assert any(a <= 100 + s and 100 + s + n <= b for a, b in zip(lo, hi))


def test_very_long_runs_take_few_comparisons():
    x = np.zeros(200_000, np.int64)
    assert periodic.segment_runs(x) == [(0, len(x), 1)]
    x = np.tile(np.arange(50), 4000)
    assert periodic.segment_runs(x) == [(0, len(x), 50)]
    assert periodic.segment_runs(np.random.default_rng(1).permutation(50_000)) == []


def _check(row, text, h):
    runs, collapsed, n = plain(text, h)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = periodic.strongest(runs) or (None, None, None)
    assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *top)
    assert row.exponent_milli == (1000 * top[1] // top[2] if runs else None)
    assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert row.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF_CHECK).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        if d.text is not None and len(d.text) > 20_000:
            continue
        _check(got[d.doc_id], d.text, zlib.crc32(str(d.doc_id).encode()))
        some += got[d.doc_id].n_runs > 0
    assert some > 20


def test_odd_rows(spark, tmp_path):
    texts = ODD_TEXTS + ["x y " * 30 + "end", "a\tb\x0bc " * 9, "a b " * 7, "x y " * 30 + "end"]
    docs = docs_frame(spark, texts).unionAll(spark.createDataFrame([(None, "b " * 8, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.selectExpr("*", "'clash' as runs", "1 as `__text`", "2 as collapsed")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is None:
            _check(r, "b " * 8, None)
        else:
            _check(r, texts[r.doc_id], zlib.crc32(str(r.doc_id).encode()))
    made = periodic.periodic_runs(docs, keep=("doc_id", "source")).columns
    assert made == ["doc_id", "source", "n_words", "runs", "collapsed"]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, repeats=1)
