import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spendlens.llm import queries, recompression
from tests.conftest import SF_SMALL
from tests.llm.util import ODD_TEXTS, docs_frame


def brute(texts, window=13):
    seen, out = set(), []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        gone = set()
        for i, r in enumerate(runs):
            if r in seen:
                gone |= set(range(i, i + window))
        seen.update(runs)
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


def texts():
    rnd = random.Random(8)
    out = list(ODD_TEXTS)
    for vocabulary in (2, 5, 60):
        passages = [[f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(10, 80))] for _ in range(6)]
        for _ in range(60):
            w = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(0, 20))]
            for _ in range(rnd.randint(0, 3)):
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) // 2)
                w += p[a : a + rnd.randint(8, 60)] + [f"u{rnd.random()}"]
            out.append(rnd.choice([" ", "\n", "  "]).join(w))
    return out + out[-4:] + ["x " * 13, "x " * 12, "y " + "x " * 30]


def test_equals_brute_force(spark):
    t = texts()
    docs = docs_frame(spark, t).withColumn("kept", F.lit("clash")).repartition(4)
    for batch in (3000, 1 << 22):
        rows = {r.doc_id: r for r in recompression.remove_repeats(docs, batch_bytes=batch).collect()}
        assert len(rows) == len(t)
        for i, (n, removed, kept) in enumerate(brute(t)):
            r = rows[i]
            assert (r.n_words, sum(s.end - s.start for s in r.spans), bytes(r.kept)) == (n, removed, kept), i


def test_equal_windows_have_equal_owners():
    rnd = np.random.RandomState(0)
    window = rnd.randint(0, 6, 13).astype(np.uint64)
    finder, keys = recompression.WordFinder(13, 4), set()
    for _ in range(60):
        a, z = rnd.randint(0, 9, 2)
        words = np.concatenate([rnd.randint(0, 6, a), window, rnd.randint(0, 6, z)]).astype(np.uint64)
        key, _ = finder._owners(words, np.array([0, len(words)]), len(words) - 12)
        keys.add(int(key[a]))
    assert len(keys) == 1


def test_empty_table(spark):
    assert recompression.remove_repeats(docs_frame(spark, [])).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op3_recompression(spark, SF_SMALL).collect()}
    for d, (n, removed, kept) in zip(docs, brute([d.text for d in docs])):
        r = got[d.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept).hexdigest())
