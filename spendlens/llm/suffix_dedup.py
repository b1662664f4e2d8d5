"""Suffix-array dedup of byte strings across documents.

Suffixes are taken at content-determined anchors (in every 50-byte window the 24-byte
string with the smallest hash), range-partitioned by sampled splitters of their leading
tokens, and sorted within their bucket by multikey quicksort. The splitters are bounded in
number; past that, a range is dealt by a hash of the anchor into several buckets. Neither
divides suffixes with equal leading tokens, so what is equal across a boundary is nothing;
equal windows are neighbours in one bucket, where the smallest id decides which ones go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import column_bytes, mix
from ._repeats import (
    BATCH_BYTES,
    Runs,
    kept_column,
    mark_repeats,
    multikey_groups,
    owned_runs,
    span_column,
    text_bytes,
    valid_windows,
)

WINDOW = 50
LEAD = 24  # bytes of an anchor's leading tokens
SEGMENT = 1 << 18  # windows handled at once
SAMPLES_PER_BUCKET = 16
MAX_RANGES = 4096  # of leading tokens; beyond, a range is dealt by anchor into several buckets
SAMPLE_BYTES = 64 << 20  # text that splitters are drawn from, about, and 1/64 of it at most

_PLACE = np.uint64((1 << 28) - 1)


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every position, by doubling."""
    h, size, mult = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    total, done = None, 0
    n = len(data) - length + 1
    rest = length
    powers = []
    while True:
        if rest & 1:
            powers.append((h, size, mult))
        rest >>= 1
        if not rest:
            break
        h = h[:-size] * np.uint64(mult) + h[size:]
        size, mult = size * 2, mult * mult & 0xFFFFFFFFFFFFFFFF
    for h, size, mult in powers:
        part = h[done : done + n]
        total = part if total is None else total * np.uint64(mult) + part
        done += size
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


class ByteFinder:
    """Units are bytes; see ``_repeats``."""

    dtype = np.dtype(np.uint8)

    def __init__(self, window: int, splitters: list[bytes], names=("n_bytes", "spans", "kept"), parts: int = 1):
        self.fields = list(zip(names, ("bigint", "array<struct<start:bigint,end:bigint>>", "binary")))
        self.window = window
        self.lead = min(LEAD, window)
        self.splitters, self.parts = splitters, parts

    def units(self, data, offsets):
        return data, offsets

    def runs(self, data: np.ndarray, bounds: np.ndarray) -> Runs:
        out = [[], [], [], []]
        last = len(data) - self.window + 1
        for a in range(0, last, SEGMENT):
            b = min(last, a + SEGMENT)
            h = string_hashes(data[a : b + self.window - 1], self.lead)
            place = np.arange(len(h), dtype=np.uint64)
            best = sliding_min((h & ~_PLACE) | place, self.window - self.lead + 1)
            first, count, owner = owned_runs((best & _PLACE).astype(np.int64), valid_windows(bounds, self.window, a, b))
            for x, y in zip(out, (h[owner], owner + a, first + a, count)):
                x.append(y)
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        return Runs(*[np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)])

    def route(self, data, anchor, key):
        lead = data[anchor[:, None] + np.arange(self.lead)]
        at = np.searchsorted(np.array(self.splitters, f"S{self.lead}"), np.ascontiguousarray(lead).view(f"S{self.lead}").ravel(), "right")
        return at * self.parts + (mix(key) % np.uint64(self.parts)).astype(np.int64)

    def group(self, data, starts):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        tokens = np.zeros(len(data) + 1, np.uint64)
        for k in range(8):
            tokens <<= np.uint64(8)
            tokens |= padded[k : k + len(tokens)]
        whole, rest = divmod(self.window, 8)
        return multikey_groups(tokens, starts, [(8 * k, 0) for k in range(whole)] + [(8 * whole, 64 - 8 * rest)] * bool(rest))

    def result(self, data, offsets, bounds, removed):
        return [pa.array(np.diff(offsets), pa.int64()), span_column(bounds, removed), kept_column(data, bounds, removed)]


def sampled_splitters(docs: DataFrame, text_col: str, window: int, buckets: int, total: int) -> list[bytes]:
    """Leading tokens that part the anchors into about ``buckets`` even ranges, from a sample
    of at most a few anchors per bucket; ``total``: bytes of all texts."""
    if buckets < 2:
        return []
    finder, want = ByteFinder(window, []), buckets * SAMPLES_PER_BUCKET
    some = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where(F.octet_length("text") >= window)
    part = some.where(F.pmod(F.xxhash64("text"), F.lit(max(64, total // SAMPLE_BYTES))) == 0)

    def leads(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            found = finder.runs(data, offsets)
            order = np.argsort(found.key)[: max(1, want // 8)]
            at = found.anchor[order]
            lead = np.ascontiguousarray(data[at[:, None] + np.arange(finder.lead)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lead.view(f"S{finder.lead}").ravel().tolist(), pa.binary()), pa.array(found.key[order].view(np.int64))], ["lead", "key"]
            )

    rows = part.mapInArrow(leads, "lead binary, key long").orderBy("key").limit(want).toArrow()
    leads_found = sorted(x + b"\0" * (finder.lead - len(x)) for x in rows.column("lead").to_pylist())
    cuts = {leads_found[len(leads_found) * k // buckets] for k in range(1, buckets)} if leads_found else set()
    return sorted(cuts)


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    batch_bytes: int = BATCH_BYTES,
    names: tuple[str, str, str] = ("n_bytes", "spans", "kept"),
) -> DataFrame:
    """The columns of ``keep``, n_bytes, spans (maximal removed runs) and kept (bytes left).

    A byte goes when a ``window``-byte string that covers it also starts in a row with a
    smaller id, judged on the input. Null texts are empty; texts shorter than the window
    stay; rows without id count as later than all others; rows with one id never count
    against each other; repeated rows give repeated rows, extra columns are passed only
    where ``keep`` names them. Very long texts are handled in segments.
    """
    total = text_bytes(docs, text_col)
    buckets = max(1, -(-3 * total // (2 * batch_bytes)))
    ranges = min(buckets, MAX_RANGES)
    finder = ByteFinder(window, sampled_splitters(docs, text_col, window, ranges, total), names, -(-buckets // ranges))
    return mark_repeats(docs, finder, id_col=id_col, text_col=text_col, keep=keep, batch_bytes=batch_bytes)
