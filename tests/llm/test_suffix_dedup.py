import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from spendlens.llm import _repeats, queries, suffix_dedup
from tests.conftest import SF_SMALL
from tests.llm.util import ODD_TEXTS, docs_frame


def brute(texts, window=50):
    """(removed, spans, kept) of texts in id order."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        strings = [b[i : i + window] for i in range(len(b) - window + 1)]
        gone = bytearray(len(b))
        for i, s in enumerate(strings):
            if s in seen:
                gone[i : i + window] = b"\1" * window
        seen.update(strings)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, kept))
    return out


def texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(8)]
    out = list(ODD_TEXTS)
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts += [p[a : a + rnd.randint(30, 200)], word()]
        out.append(" ".join(parts))
    return out + out[-5:] + ["ab" * 200, "x" + "ab" * 100, "a" * 49, "a" * 50, "a\0" * 60, "\0" * 90, "\0" * 70]


def check(rows, want, ids):
    assert len(rows) == len(ids)
    by = {r.doc_id: r for r in rows}
    for i, (n, removed, spans, kept) in zip(ids, want):
        r = by[i]
        assert bytes(r.kept) == kept and r.n_bytes == n
        assert sum(s.end - s.start for s in r.spans) == removed and len(r.spans) == spans


def test_equals_brute_force(spark):
    t = texts()
    docs = docs_frame(spark, t).withColumn("kept", F.lit("clash")).withColumn("g", F.lit(1)).repartition(4)
    for batch in (2000, 1 << 23):
        check(suffix_dedup.remove_repeats(docs, batch_bytes=batch).collect(), brute(t), range(len(t)))


def test_rows_without_or_with_equal_ids(spark):
    same = "one passage that is long enough to count as a window of fifty bytes"
    docs = spark.createDataFrame([(5, same), (5, same), (None, same), (3, "x"), (9, same)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.kept)) for r in rows) == [
        (False, 3, 1),
        (False, 5, len(same)),
        (False, 5, len(same)),
        (False, 9, 0),
        (True, 0, 0),
    ]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs_frame(spark, [])).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, SF_SMALL).collect()}
    for d, (n, removed, spans, kept) in zip(docs, brute([d.text for d in docs])):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_messages_grow_with_the_batches():
    counts = {n: _repeats.slice_count(n, 200) for n in (1, 50, 200, 7_500, 25_000_000)}
    assert counts == {1: 1, 50: 50, 200: 200, 7_500: 200, 25_000_000: 390_625}
    for n in (1, 2, 3, 200, 390_625):
        bounds = _repeats.slice_bounds(n)
        assert len(bounds) == n - 1 and (np.diff(bounds.astype(object)) > 0).all()
        if n > 1:
            width = (1 << 64) // n + 1
            assert int(bounds[0]) == width and 0 < (1 << 64) - int(bounds[-1]) <= width


def test_more_batches_and_buckets_than_slices_and_ranges(spark, monkeypatch):
    """Slices fewer than batches, ranges dealt by anchor, and the join without broadcast."""
    t = texts()
    docs = docs_frame(spark, t).repartition(3)
    monkeypatch.setattr(suffix_dedup, "MAX_RANGES", 3)
    monkeypatch.setattr(_repeats, "BROADCAST_ROWS", -1)
    assert sum(len(x or "") for x in t) / 1500 > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    check(suffix_dedup.remove_repeats(docs, batch_bytes=1500).collect(), brute(t), range(len(t)))
