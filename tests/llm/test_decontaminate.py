import gc
import random
import re
import weakref

from pyspark.sql import functions as F

from spendlens.llm import decontaminate, queries
from tests.conftest import SF_SMALL
from tests.llm.util import ODD_TEXTS, docs_frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def compute(spark, docs, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(docs, bench, **more)
    rows = found.select("doc_id", "n_words", decontaminate.hit_words("matches").alias("h"), decontaminate.item_list("matches").alias("i"))
    return {r.doc_id: (r.n_words, r.h, sorted(map(int, r.i))) for r in rows.collect()}


def cases():
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["Ünï", "É"]
    long = [" ".join(rnd.choice(vocabulary) for _ in range(40)) for _ in range(6)]
    items = list(enumerate(long)) + [(10, "only Three words"), (11, None), (12, "..."), (13, "solo"), (14, long[0]), (15, "a a a a a a a a a a a a a a a")]
    texts = list(ODD_TEXTS) + ["a " * 40, "only three WORDS, solo", "x " + long[2].upper().replace("Ï", "ï").replace("Ü", "Ü") + " y"]
    for _ in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
        src = rnd.choice(long).split()
        a = rnd.randint(0, 30)
        w += src[a : a + rnd.randint(8, 25)]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(w))
    return texts, items


def test_equals_brute_force(spark):
    texts, items = cases()
    want = brute(texts, items)
    docs = docs_frame(spark, texts).withColumn("matches", F.lit("clash")).withColumn("item_id", F.lit(1))
    for more in ({}, {"block_bytes": 300}):
        got = compute(spark, docs, items, **more)
        assert [got[i] for i in range(len(texts))] == want


def test_longest_match_and_location(spark):
    item = " ".join(f"t{k}" for k in range(20))
    docs = docs_frame(spark, ["x y " + " ".join(f"t{k}" for k in range(2, 19)) + " z"])
    found = decontaminate.find_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in found.matches] == [("7", 2, 2, 17)]


def test_empty_tables(spark):
    assert compute(spark, docs_frame(spark, []), [(1, "a b")]) == {}
    assert compute(spark, docs_frame(spark, ["a b"]), []) == {0: (2, 0, [])}


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = brute([d.text for d in docs], items)
    got = {r.doc_id: r for r in queries.op5_decontaminate(spark, SF_SMALL).collect()}
    for d, (n, h, i) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, h, len(i))
        assert r.contaminated == (h > 0 and 20 * h >= n)


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    alive, most, made = weakref.WeakSet(), [], decontaminate.TestIndex.__init__

    def tracked(self, *a):
        gc.collect()
        most.append(len(alive))
        made(self, *a)
        alive.add(self)

    monkeypatch.setattr(decontaminate.TestIndex, "__init__", tracked)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in items] * 2, "doc_id long, text string")
    found = decontaminate.find_matches(docs, benchmark, block_bytes=1000).collect()
    assert len(most) > 2 and max(most) == 0
    assert sorted((r.doc_id, [m.item_id for m in r.matches]) for r in found) == sorted((i, [str(i)]) for i, _ in items * 2)


def test_ids_of_any_kind(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = docs_frame(spark, [words, "none of it"])
    benchmark = spark.createDataFrame([("q-1", words), ("q-10", words[:-4]), (None, words)], "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.find_matches(docs, benchmark).collect()}
    assert sorted({m.item_id for m in found[0].matches}) == ["q-1", "q-10"] and found[1].matches == []
