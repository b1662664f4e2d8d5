"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed character pairs and triples per language with Spark; the smoothed
log-probability matrix (buckets x languages, a fixed small size) is broadcast, and texts
are scored in NumPy by gathering matrix rows and summing them per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import bounded_batches, code_points, column_bytes, lower_letters, row_chunks, with_text_columns

BUCKETS = 1 << 15
MAX_TRAIN_DOCS = 20_000
ORDERS = (2, 3)


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """For each order the bucket of the n-gram at every character (``buckets``: none
    starts there), the row bounds in characters, and whether each row holds a letter."""
    cp, pos = code_points(data)
    low = lower_letters()[cp].astype(np.uint32)
    bounds = np.searchsorted(pos, offsets)
    letters = np.concatenate([[0], np.cumsum(low > 0)])
    has_letter = letters[bounds[1:]] > letters[bounds[:-1]]
    left = np.zeros(len(low), np.int64)  # characters from here to the end of the row
    left[:] = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(low))
    out = []
    h = low * np.uint32(0x9E3779B1)
    for k in range(1, max(ORDERS)):
        nxt = np.zeros_like(low)
        nxt[:-k] = low[k:]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + nxt * np.uint32(0xC2B2AE35)
        if k + 1 in ORDERS:
            g = h ^ (h >> np.uint32(16))
            g = (g * np.uint32(0x7FEB352D)) >> np.uint32(32 - int(buckets).bit_length() + 1)
            out.append(np.where(left > k, g, np.uint32(buckets)))
    return out, bounds, has_letter


def fit(
    docs: DataFrame,
    train: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    max_docs: int = MAX_TRAIN_DOCS,
    alpha: float = 0.5,
) -> dict:
    """Learn {"langs": sorted values, "logp": (buckets + 1, langs) float32, "prior"}.

    Rows where ``train`` holds and text and language are given are used; beyond
    ``max_docs`` of them a sample chosen by a hash of the id (about ``max_docs`` rows).
    What reaches the driver is at most buckets x languages counts.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    bounded_batches(docs)
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * max_docs / total))

    def count(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            sums = np.zeros((len(names), buckets + 1), np.int64)
            for lo, hi in row_chunks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                if not len(part):
                    continue
                grams, bounds, _ = _grams(part, offsets[lo : hi + 1] - offsets[lo], buckets)
                row = np.repeat(code[lo:hi], np.diff(bounds))
                for g in grams:
                    flat = row * (buckets + 1) + g
                    sums += np.bincount(flat, minlength=sums.size).reshape(sums.shape)
            n_docs = np.bincount(code, minlength=len(names))
            sums[:, buckets] = n_docs  # the last column carries the documents per language
            which, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[which].tolist(), pa.string()), pa.array(bucket, pa.int32()), pa.array(sums[which, bucket], pa.int64())],
                ["lang", "bucket", "n"],
            )

    counts = (
        rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    table = np.zeros((buckets + 1, len(langs)))
    for lang, bucket, n in zip(counts.column("lang").to_pylist(), counts.column("bucket").to_numpy(), counts.column("n").to_numpy()):
        table[bucket, at[lang]] = n
    prior = np.log(np.maximum(table[buckets], 1)) - np.log(max(1.0, table[buckets].sum()))
    grams = table[:buckets] + alpha
    logp = np.zeros((buckets + 1, len(langs)), np.float32)
    logp[:buckets] = np.log(grams) - np.log(grams.sum(axis=0, keepdims=True)) if langs else 0
    return {"langs": langs, "logp": logp, "prior": prior, "buckets": buckets}


def score_chunk(data: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language or -1, its posterior probability) of each text."""
    n, langs = len(offsets) - 1, len(model["langs"])
    best, score = np.full(n, -1), np.zeros(n)
    if not langs or not len(data):
        return best, score
    grams, bounds, has_letter = _grams(data, offsets, model["buckets"])
    total = np.zeros((n, langs))
    full = np.nonzero(np.diff(bounds) > 0)[0]
    for g in grams:
        total[full] += np.add.reduceat(model["logp"][g], bounds[full], axis=0, dtype=np.float64)
    total += model["prior"]
    top = total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p = p[np.arange(n), top] / p.sum(axis=1)
    best[has_letter], score[has_letter] = top[has_letter], p[has_letter]
    return best, score


def predict(
    docs: DataFrame,
    model: dict,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns of ``keep``, lang_pred and score for every row, from the text alone.

    A null, empty or letterless text gives ``und`` with score 0, as does a model that
    learned no language; ties go to the alphabetically first language. Repeated rows give
    repeated rows. Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column):
        model = shared.value
        names = [*model["langs"], "und"]
        data, offsets = column_bytes(column)
        best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo, hi in row_chunks(offsets):
            b, s = score_chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model)
            best.append(b)
            score.append(s)
        lang = pa.array(names, pa.string()).take(pa.array(np.concatenate(best) % len(names), pa.int64()))
        return [lang, pa.array(np.concatenate(score))]

    return with_text_columns(docs, text_col, keep, [(names[0], "string"), (names[1], "double")], run)


def is_held_out(id_col: str = "doc_id") -> Column:
    """The rows whose crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
