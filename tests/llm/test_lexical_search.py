import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from spendlens.llm import lexical_search as ls
from spendlens.llm import queries
from tests.conftest import SF_SMALL
from tests.llm.util import ODD_TEXTS, docs_frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=10):
    """Every document scored against every item: [(item number, rank, doc_id, score)]."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_all) // total
            w = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in b}
            score = sum(w[t] * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in w)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[1], r[3], str(r[2])))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert in_order(queries.op11_lexical_search(spark, SF_SMALL).collect()) == in_order(plain(docs, items))


def _random(rng, n, vocabulary=30):
    return [" ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(rng.randrange(25))) for _ in range(n)]


def test_small_shards_and_blocks_of_queries(spark):
    rng = random.Random(3)
    texts = _random(rng, 300) + ["w1 w2 w3"] * 40
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    items = list(enumerate(_random(rng, 90) + ["w1", "w2 w3 nothing", "nothing"]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = in_order(plain(list(zip(ids, texts)), items))
    for settings in ({}, {"shard_postings": 100}, {"block_bytes": 2000}):
        assert in_order(ls.top_documents(docs, bench, **settings).collect()) == want, settings
    top = ls.top_documents(docs, bench, 3).collect()
    assert in_order(top) == in_order(plain(list(zip(ids, texts)), items, 3))


def test_odd_rows(spark):
    texts = ODD_TEXTS + ["The THE the", "É é", "a1_b2", "the the the"]
    rows = [(None if i == 4 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as rank", "2 as query")
    items = [("q-1", "THE a word"), ("q-1", "THE a word"), ("q-1", "é b2"), (None, "x"), ("n", None), ("e", ""), ("p", "?!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = plain(rows, list(dict.fromkeys(items)))
    assert in_order(ls.top_documents(docs, bench).collect()) == in_order(want)
    assert ls.top_documents(docs.limit(0), bench).collect() == []
    assert ls.top_documents(docs, bench.limit(0)).collect() == []
    assert ls.top_documents(docs_frame(spark, [None, "", "?"]), bench).collect() == []


def test_sparse_table_and_pruning():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 3000, 40
    doc, term = np.nonzero(rng.random((n_docs, n_terms)) < rng.random(n_terms) * 0.3)
    impact = rng.integers(1, 1000, len(doc)) * (1 + 20 * (doc < 12))  # a few documents stand out
    shard = ls.Shard(doc, term, impact, n_docs, n_terms)
    for _ in range(200):
        t = rng.integers(n_terms)
        lo, hi = sorted(rng.integers(shard.bounds[t], shard.bounds[t + 1] + 1, 2))
        if lo < hi:
            got = shard.maxima(np.array([lo]), np.array([hi]))[0]
            assert lo <= got < hi and shard.impact[got] == shard.impact[lo:hi].max()
    words = pa.array([f"t{i}" for i in range(n_terms)])
    block = ls.Queries(pa.array([0]), pa.array([" ".join(words.to_pylist())]))
    best = ls.Best(1, 5)
    ids = np.arange(n_docs)
    scored = ls.search(shard, ids, np.zeros(n_docs, bool), block, 0, 1, best)
    totals = np.bincount(doc, impact, n_docs)
    assert best.id.tolist() == np.lexsort((ids, -totals))[:5].tolist()
    assert scored < n_docs / 10  # the rest is never scored
