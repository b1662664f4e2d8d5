"""Spark plumbing shared by the two substring-dedup operators.

Both look for windows (fixed-length runs of units: bytes or words) that also start in a
row with a smaller id. A *finder* says what the units are, which content-determined
anchor owns each window, where a record is sent and how windows are grouped by content.

1. Rows are dealt into batches of a few MB by a hash of the text; the one shuffle of the
   texts, reused by steps 2, 4 and 6.
2. Each batch sends the distinct fingerprints of its anchors, once per batch (pre-aggregated,
   so a passage found everywhere costs one entry per batch), in slices of the hash range.
3. Each slice tells each batch, as a bitmap, which fingerprints other batches hold too.
4. Each batch sends a record for every anchor that is shared: the units its windows span.
   Equal records of a batch travel once, with the list of their places.
5. Records meet by content; equal windows are grouped exactly and the smallest id of each
   group decides which places are repeats.
6. Each batch merges the repeat spans into its texts.

Nothing but row counts and (for one finder) a bounded number of splitters reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ._bytes import binary_array, bounded_batches, column_bytes, ragged, row_chunks, span_hashes

BATCH_BYTES = 4 << 20
BLOCK_RECORDS = 1 << 14  # records whose units are laid out at once
SLICE_BATCHES = 64  # batches whose fingerprints one slice holds, at most
BROADCAST_ROWS = 1_000_000  # of two longs each
NO_ID = np.iinfo(np.int64).max  # rows without id count as later than all others


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


def _release() -> None:
    """Give the memory that earlier groups and stages have freed back to the system: Spark
    uses its Python workers again, and what each of them holds adds up on an executor."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def _rows(table: pa.Table):
    """(ids, bytes, offsets, order) of a batch in a reproducible row order: by id, rows of
    one id by the hash of their text."""
    ids = table.column("__id").combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy()
    data, offsets = column_bytes(table.column("__text"))
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((_text_hashes(data, offsets), ids))
    lengths = np.diff(offsets)[order]
    texts = [data[offsets[r] : offsets[r + 1]] for r in order.tolist()]
    return ids[order], np.concatenate([data[:0], *texts]), np.concatenate([[0], np.cumsum(lengths)]), order


def _text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, hi in row_chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        out[lo:hi] = span_hashes(data[offsets[lo] : offsets[hi]], at[:-1], at[1:])
    return out


def _blob(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _joined(column, dtype) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return parts, (np.concatenate(parts) if parts else np.zeros(0, dtype))


def _distinct_records(units: np.ndarray, first: np.ndarray, count: np.ndarray, window: int):
    """(one index per distinct record, number of the distinct record of each)."""
    width = window - 1 + count
    n, longest = len(first), int(width.max()) if len(first) else 0
    size = longest * units.dtype.itemsize
    rows = np.zeros((n, size + 2), np.uint8)  # its units, then its number of windows
    for a in range(0, n, BLOCK_RECORDS):
        wide = width[a : a + BLOCK_RECORDS]
        body = np.zeros((len(wide), longest), units.dtype)
        body[np.arange(longest) < wide[:, None]] = units[ragged(first[a : a + BLOCK_RECORDS], wide)]
        rows[a : a + BLOCK_RECORDS, :size] = body.view(np.uint8).reshape(len(wide), size)
    rows[:, size], rows[:, size + 1] = count & 255, (count >> 8) + 1
    _, pick, of = np.unique(rows.view(f"V{size + 2}").ravel(), return_index=True, return_inverse=True)
    return pick, of


def _local_copies(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (sorted by id) whose whole text an earlier row with a smaller id of the batch has."""
    raw, at = data.tobytes(), offsets.tolist()
    h = np.array([hashlib.blake2b(raw[a:z], digest_size=16).hexdigest() for a, z in zip(at, at[1:])] or [""])[: len(ids)]
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return ids > ids[first][of]


def _shared_slices(table):
    """Step 3: for each batch's sorted fingerprints, a bit for those of several batches."""
    _release()
    parts, values = _joined(table.column("keys"), np.uint64)
    values = np.sort(values)  # a batch holds a fingerprint once
    several = np.unique(values[1:][values[1:] == values[:-1]])
    bits = []
    for p in parts:
        at = np.minimum(np.searchsorted(several, p), max(len(several) - 1, 0))
        bits.append(np.packbits(several[at] == p if len(several) else np.zeros(len(p), bool)).tobytes())
    return pa.table({"g": table.column("g"), "b": table.column("b"), "bits": pa.array(bits, pa.binary())})


def slice_count(batches: int, partitions: int) -> int:
    """Slices of the hash range: as many as shuffle partitions, so that the messages of the
    batches grow with their number and not its square; more only where a slice would hold the
    fingerprints of over ``SLICE_BATCHES`` batches."""
    return max(1, min(batches, max(partitions, -(-batches // SLICE_BATCHES))))


def slice_bounds(count: int) -> np.ndarray:
    """First hash of each slice but the first."""
    if count < 2:
        return np.zeros(0, np.uint64)
    return np.arange(1, count, dtype=np.uint64) * np.uint64((1 << 64) // count + 1)


def dealt(docs: DataFrame, id_col: str, text_col: str, keep, batch_bytes: int) -> tuple[DataFrame, int]:
    """(rows with their batch number ``__g``, number of batches).

    Equal texts meet in one batch, where only one of them need be looked at. Texts whose
    copies fill more than a batch, of which there are fewer than batches, are spread by id.
    """
    text = F.col(f"`{text_col}`").cast("string")
    weights = docs.select(F.xxhash64(text).alias("__h"), F.octet_length(text).alias("n")).groupBy("__h").agg(F.sum("n").alias("n"))
    weights = checkpointed(weights)
    n = max(1, -(-(weights.agg(F.sum("n")).first()[0] or 0) // batch_bytes))
    large = weights.where(F.col("n") > batch_bytes).select("__h", F.ceil(F.col("n") / batch_bytes).cast("long").alias("__parts"))
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__h"), *[F.col(f"`{c}`") for c in keep]
    ).join(large, "__h", "left")
    part = F.pmod(F.xxhash64("__id"), F.coalesce("__parts", F.lit(1)))
    g = F.pmod(F.xxhash64("__h", part), F.lit(n)).cast("int").alias("__g")
    return rows.select(g, "__id", "__text", *[F.col(f"`{c}`") for c in keep]), n


def mark_repeats(docs: DataFrame, finder, *, id_col: str, text_col: str, keep=(), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The columns of ``keep`` and what ``finder.result`` makes of each row's repeats."""
    bounded_batches(docs)
    keep = [c for c in keep]
    base, n = dealt(docs, id_col, text_col, keep, batch_bytes)
    n_slices = slice_count(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def slices(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys, slice_bounds(n_slices))

    def fingerprints(key, table):
        _release()
        _, data, offsets, _ = _rows(table)
        found = finder.runs(*finder.units(data, offsets)[:2])
        keys = np.unique(found.key)
        parts = np.split(keys, slices(keys))
        full = [k for k, p in enumerate(parts) if len(p)]
        return pa.table(
            {
                "b": pa.array(full, pa.int32()),
                "g": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "keys": pa.array([parts[k].tobytes() for k in full], pa.binary()),
            }
        )

    def records(key, table, replies):
        _release()
        ids, data, offsets, _ = _rows(table)
        units, bounds = finder.units(data, offsets)[:2]
        found = finder.runs(units, bounds)
        keys, inverse = np.unique(found.key, return_inverse=True)
        parts = np.split(np.arange(len(keys)), slices(keys))
        shared = np.zeros(len(keys), bool)
        for b, bits in zip(replies.column("b").to_pylist(), replies.column("bits").to_pylist()):
            shared[parts[b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(parts[b])).astype(bool)
        row = np.searchsorted(bounds, found.first, "right") - 1
        if len(keys):  # and those of several ids within the batch
            own = ids[row]
            low, high = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(low, inverse, own)
            np.maximum.at(high, inverse, own)
            shared |= low < high
        copies = _local_copies(ids, data, offsets)  # go as a whole, in step 6
        use = np.nonzero(shared[inverse] & ~copies[row])[0] if len(keys) else np.zeros(0, np.int64)
        first, count, row, anchor = found.first[use], found.count[use], row[use], found.anchor[use]
        # equal records of the batch become one, with the places where it stands
        pick, of = _distinct_records(units, first, count, finder.window)
        width = finder.window - 1 + count
        to = finder.route(units, anchor[pick], found.key[use][pick]) if len(pick) else np.zeros(0, np.int64)
        rank = np.empty(len(pick), np.int64)
        by_route = np.argsort(to, kind="stable")
        rank[by_route] = np.arange(len(pick))
        place = np.lexsort((ids[row], rank[of])) if len(use) else np.zeros(0, np.int64)  # places by record, smallest id first
        n_places = np.bincount(rank[of], minlength=len(pick))
        place_end = np.cumsum(n_places)
        out = {k: [] for k in ("c", "g", "count", "units", "size", "n_places", "id", "row", "start")}
        dest, begin = np.unique(to[by_route], return_index=True)
        for c, a, z in zip(dest.tolist(), begin.tolist(), np.append(begin[1:], len(pick)).tolist()):
            chosen = pick[by_route[a:z]]
            at = place[place_end[a] - n_places[a] : place_end[z - 1]]
            body = units[ragged(first[chosen], width[chosen])]
            out["c"].append(c)
            out["g"].append(key[0].as_py())
            out["count"].append(count[chosen].astype(np.uint16).tobytes())
            out["units"].append(pa.compress(body.tobytes(), codec="zstd", asbytes=True))
            out["size"].append(body.nbytes)
            out["n_places"].append(n_places[a:z].astype(np.uint32).tobytes())
            out["id"].append(ids[row[at]].tobytes())
            out["row"].append(row[at].astype(np.uint32).tobytes())
            out["start"].append((first[at] - bounds[row[at]]).astype(np.uint32).tobytes())
        kinds = {"c": pa.int32(), "g": pa.int32(), "size": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def compare(table):
        """Step 5, for all records of one destination."""
        _release()
        sources = table.column("g").to_pylist()
        counts, count = _joined(table.column("count"), np.uint16)
        raw = [pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(table.column("units").to_pylist(), table.column("size").to_pylist())]
        units = np.frombuffer(b"".join(raw), finder.dtype)
        del raw
        _, n_places = _joined(table.column("n_places"), np.uint32)
        _, ids = _joined(table.column("id"), np.int64)
        rows, row = _joined(table.column("row"), np.uint32)
        _, start = _joined(table.column("start"), np.uint32)
        count, n_places = count.astype(np.int64), n_places.astype(np.int64)
        begin = np.cumsum(count + finder.window - 1) - (count + finder.window - 1)
        least = ids[np.cumsum(n_places) - n_places]  # smallest id of each record
        pick, of = _distinct_records(units, begin, count, finder.window)
        lowest = np.full(len(pick), NO_ID)
        np.minimum.at(lowest, of, least)
        windows = ragged(begin[pick], count[pick])
        order, group = finder.group(units, windows)
        low = np.full(int(group[-1]) + 1 if len(group) else 0, NO_ID)
        np.minimum.at(low, group, np.repeat(lowest, count[pick])[order])
        window_low = np.empty(len(windows), np.int64)
        window_low[order] = low[group]
        # each place: every window of it whose group has a smaller id
        first_window = (np.cumsum(count[pick]) - count[pick])[of]
        record = np.repeat(np.arange(len(count)), n_places)
        w = ragged(first_window[record], count[record])
        place = np.repeat(np.arange(len(record)), count[record])
        repeat = window_low[w] < ids[place]
        lane = (w - first_window[record][place])[repeat]
        place = place[repeat]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (lane[1:] != lane[:-1] + 1)
        head = np.nonzero(new)[0]
        tail = np.append(head[1:], len(place)) - 1
        at = place[head]
        a = start[at].astype(np.int64) + lane[head] if len(head) else np.zeros(0, np.int64)
        z = start[at].astype(np.int64) + lane[tail] + finder.window if len(head) else a
        source = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[at]
        out = {k: [] for k in ("g", "row", "a", "z")}
        cut = np.searchsorted(source, np.arange(len(rows) + 1))
        for k, g in enumerate(sources):
            if cut[k] < cut[k + 1]:
                s = slice(cut[k], cut[k + 1])
                out["g"].append(g)
                for name, blob in zip(("row", "a", "z"), _blob(row[at[s]], a[s].astype(np.uint32), z[s].astype(np.uint32))):
                    out[name].append(blob)
        return pa.table({k: pa.array(v, pa.int32() if k == "g" else pa.binary()) for k, v in out.items()})

    def finish(key, table, spans):
        _release()
        ids, data, offsets, order = _rows(table)
        units, bounds, *more = finder.units(data, offsets)
        _, row = _joined(spans.column("row"), np.uint32)
        _, a = _joined(spans.column("a"), np.uint32)
        _, z = _joined(spans.column("z"), np.uint32)
        change = np.zeros(len(units) + 1, np.int32)
        np.add.at(change, bounds[row] + a, 1)
        np.add.at(change, bounds[row] + z, -1)
        removed = np.cumsum(change[:-1], out=change[:-1]) > 0
        copies = _local_copies(ids, data, offsets)
        removed |= np.repeat(copies & (np.diff(bounds) >= finder.window), np.diff(bounds))
        made = finder.result(data, offsets, bounds, removed, *more)
        kept = [table.column(c).take(pa.array(order)) for c in keep]
        return pa.Table.from_arrays([*kept, *made], [*keep, *[name for name, _ in finder.fields]])

    batches = base.groupBy("__g")
    sent = batches.applyInArrow(fingerprints, "b int, g int, keys binary")
    replies = sent.groupBy("b").applyInArrow(_shared_slices, "g int, b int, bits binary")
    found = batches.cogroup(replies.groupBy("g")).applyInArrow(
        records, "c int, g int, count binary, units binary, size int, n_places binary, id binary, row binary, start binary"
    )
    spans = found.groupBy("c").applyInArrow(compare, "g int, row binary, a binary, z binary")
    ddl = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {t}" for n, t in finder.fields])
    return batches.cogroup(spans.groupBy("g")).applyInArrow(finish, ddl)


class Runs:
    """Consecutive windows with one owner: fingerprint of the anchor, its position, first
    window and number of windows."""

    def __init__(self, key, anchor, first, count):
        self.key, self.anchor, self.first, self.count = key, anchor, first, count


def owned_runs(owner: np.ndarray, valid: np.ndarray):
    """(first window, number, owner) of each maximal run of valid windows with one owner."""
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    new = valid.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    stop = valid.copy()
    stop[:-1] &= (owner[1:] != owner[:-1]) | ~valid[1:]
    first, last = np.nonzero(new)[0], np.nonzero(stop)[0]
    return first, last - first + 1, owner[first]


def valid_windows(bounds: np.ndarray, window: int, a: int, b: int) -> np.ndarray:
    """Which windows starting in [a, b) end within their row."""
    ok = np.ones(b - a, bool)
    for d in range(1, window):  # the last starts of a row reach into the next
        at = bounds[1:] - d
        at = at[(at >= a) & (at < b)]
        ok[at - a] = False
    return ok


def span_column(bounds: np.ndarray, removed: np.ndarray) -> pa.Array:
    """Maximal removed runs of each row, as list<struct<start, end>>."""
    n = len(removed)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    inside = np.append(removed, False)
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    a, z = np.nonzero(start)[0], np.nonzero(stop)[0]
    row = np.searchsorted(bounds, a, "right") - 1
    base = bounds[row]
    struct = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(z - base, pa.int64())], ["start", "end"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(bounds) - 1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def kept_column(data: np.ndarray, bounds: np.ndarray, removed: np.ndarray) -> pa.Array:
    total = np.concatenate([[0], np.cumsum(~removed)])
    return binary_array(data[~removed], total[bounds])


def multikey_groups(tokens: np.ndarray, starts: np.ndarray, shifts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of strings given as token sequences: string s has the tokens
    ``tokens[s + offset] >> shift``. Each round splits every group of still-equal strings on
    its next token; strings alone in their group are done. Returns (order, group of each in
    that order); equal strings share a group."""
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    live = order.copy()
    for offset, shift in shifts:
        if not len(live):
            break
        token = tokens[starts[order[live]] + offset] >> np.uint64(shift)
        sort = np.lexsort((token, group[live]))
        order[live] = order[live[sort]]
        token, was = token[sort], group[live]
        split = np.ones(len(live), bool)
        split[1:] = (token[1:] != token[:-1]) | (was[1:] != was[:-1])
        group[live] = live[np.maximum.accumulate(np.where(split, np.arange(len(live)), 0))]
        alone = split & np.append(split[1:], True)
        live = live[~alone]
    return order, np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else group
