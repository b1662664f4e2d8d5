"""Benchmark decontamination with suffix arrays over the training texts.

Each shard of documents (an Arrow batch part) gets a suffix array over its words: the
positions that can start a benchmark passage, sorted by their next words. Every test
suffix is binary-searched in it, which gives all verbatim occurrences and, by joining
consecutive ones, the longest match and its location. Documents are read once and not
shuffled; the test items travel as broadcast blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ._bytes import column_bytes, row_chunks, span_hashes, with_text_columns

WINDOW = 13
BLOCK_BYTES = 32 << 20

MATCHES = "array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"

_code = np.arange(256)
_is_upper = (_code >= 65) & (_code <= 90)
_is_word = (_code >= 128) | ((_code >= 48) & (_code <= 57)) | _is_upper | ((_code >= 97) & (_code <= 122))
_lower = np.where(_is_upper, _code + 32, _code).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every lower-cased word, offsets of the rows into them). Words are runs
    of ASCII letters and digits and non-ASCII characters; only A-Z is lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    starts, ends = np.nonzero(start)[0], np.nonzero(stop)[0]
    return span_hashes(_lower[data], starts, ends), np.searchsorted(starts, offsets)


class TestIndex:
    """Distinct windows of a block of test items, as sortable keys of word numbers."""

    __test__ = False

    def __init__(self, item_ids: pa.Array, hashes: np.ndarray, bounds: np.ndarray, window: int):
        self.window, self.item_ids = window, item_ids
        self.vocab = np.unique(hashes)
        number = (np.searchsorted(self.vocab, hashes) + 1).astype(np.uint32)  # 0: not a test word
        sizes = np.diff(bounds)
        take = np.minimum(sizes, window)  # words of one window of each item
        n_windows = np.where(sizes > 0, sizes - take + 1, 0)
        self.item = np.repeat(np.arange(len(sizes)), n_windows)
        self.word = np.concatenate([np.arange(k) for k in n_windows] or [np.zeros(0, int)])
        self.length = take[self.item]
        at = bounds[self.item] + self.word
        column = np.arange(window)
        index = np.minimum(at[:, None] + column, max(len(number) - 1, 0))
        valid = column < self.length[:, None]
        rows = number[index] if len(number) else np.zeros((0, window), np.uint32)
        low, high = np.where(valid, rows, 0), np.where(valid, rows, 0xFFFFFFFF)
        distinct, self.key = np.unique(_keys(low.astype(np.uint32)), return_inverse=True)
        first = np.unique(self.key, return_index=True)[1]
        self.low, self.high = distinct, _keys(high.astype(np.uint32))[first]
        self.key_length = self.length[first]
        order = np.argsort(self.key, kind="stable")  # windows by key
        self.by_key = order
        self.key_bounds = np.searchsorted(self.key[order], np.arange(len(distinct) + 1))
        self.shortest = int(self.length.min()) if len(self.length) else 0


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort in the same order."""
    width = rows.shape[1] * 4
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{width}").ravel()


def chunk_matches(data: np.ndarray, offsets: np.ndarray, index: TestIndex):
    """(words per row, then for every longest match its row, item number, first word in the
    document, first word in the item, length), ordered by row."""
    hashes, bounds = words(data, offsets)
    none = np.zeros(0, np.int64)
    n_words = np.diff(bounds)
    if not len(hashes) or not len(index.low):
        return n_words, none, none, none, none, none
    at = np.minimum(np.searchsorted(index.vocab, hashes), len(index.vocab) - 1)
    number = np.where(index.vocab[at] == hashes, at + 1, 0).astype(np.uint32)
    # words from each position to the next foreign word or the end of its row
    stops = np.union1d(np.nonzero(number == 0)[0], bounds[1:])
    run = stops[np.searchsorted(stops, np.arange(len(number)), "left")] - np.arange(len(number))
    at_bound = np.isin(np.arange(len(number)), bounds[1:]) & (number > 0)
    if at_bound.any():  # a row's first word is also the bound of the row before
        where = np.nonzero(at_bound)[0]
        run[where] = stops[np.searchsorted(stops, where, "right")] - where
    start = np.nonzero((run >= index.shortest) & (number > 0))[0]
    if not len(start):
        return n_words, none, none, none, none, none
    column = np.arange(index.window)
    rows = np.where(column < run[start][:, None], number[np.minimum(start[:, None] + column, len(number) - 1)], 0)
    keys = _keys(rows)
    suffix = np.argsort(keys, kind="stable")  # the shard's suffix array, to the depth of a window
    keys = keys[suffix]
    lo, hi = np.searchsorted(keys, index.low, "left"), np.searchsorted(keys, index.high, "right")
    found = np.nonzero(hi > lo)[0]
    if not len(found):
        return n_words, none, none, none, none, none
    reps = hi[found] - lo[found]
    key = np.repeat(found, reps)
    pos = start[suffix[np.concatenate([np.arange(a, b) for a, b in zip(lo[found], hi[found])])]]
    n_tests = index.key_bounds[key + 1] - index.key_bounds[key]
    pos = np.repeat(pos, n_tests)
    test = np.concatenate([index.by_key[a:b] for a, b in zip(index.key_bounds[key], index.key_bounds[key + 1])])
    row = np.searchsorted(bounds, pos, "right") - 1
    item, word, length = index.item[test], index.word[test], index.length[test]
    order = np.lexsort((pos, pos - word, item, row))  # consecutive windows make one match
    row, item, word, length, pos = row[order], item[order], word[order], length[order], pos[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (pos[1:] != pos[:-1] + 1) | (word[1:] != word[:-1] + 1)
    head = np.nonzero(new)[0]
    size = length[head] + np.diff(np.append(head, len(row))) - 1
    return n_words, row[head], item[head], pos[head] - bounds[row[head]], word[head], size


def test_blocks(benchmark: DataFrame, *, id_col="item_id", text_col="text", window=WINDOW, block_bytes=BLOCK_BYTES):
    """The test items as indexes of about ``block_bytes`` of text each, and whether it is the
    last; one block at a time is read to the driver, so its memory does not grow with the table."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    items = items.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toArrow()
        hashes, bounds = words(*column_bytes(part.column("text")))
        ids = part.column("id").combine_chunks()
        yield TestIndex(ids if isinstance(ids, pa.Array) else pa.array([], pa.string()), hashes, bounds, window), k == n - 1


test_blocks.__test__ = False


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str] = ("n_words", "matches"),
) -> DataFrame:
    """The columns of ``keep``, n_words and matches of every row.

    A match is a longest common run of words of the document and an item, of at least
    ``window`` words, or of the whole item where the item is shorter. A null or empty text
    has no words; items that are null, without words or without id match nothing; an empty
    benchmark leaves every list empty. Items with equal texts match each for itself. Rows
    repeat as in the input; extra columns are not read. Beyond ``block_bytes`` of test text
    the documents pass several blocks in turn, and are written with their matches after each
    but the last, so that one block is held at a time.
    """
    spark = docs.sparkSession
    frame = docs
    k = 0
    for block, last in test_blocks(benchmark, window=window, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(block)
        del block

        def run(column, shared=shared):
            index = shared.value
            data, offsets = column_bytes(column)
            counts, lists, rows_of = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for lo, hi in row_chunks(offsets):
                n_words, row, item, doc_word, item_word, size = chunk_matches(
                    data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], index
                )
                counts.append(n_words)
                rows_of.append(np.bincount(row, minlength=hi - lo))
                lists.append(np.stack([item, doc_word, item_word, size]) if len(row) else np.zeros((4, 0), np.int64))
            flat = np.concatenate(lists, axis=1) if lists else np.zeros((4, 0), np.int64)
            struct = pa.StructArray.from_arrays(
                [index.item_ids.take(pa.array(flat[0])).cast(pa.string())] + [pa.array(flat[i].astype(np.int32), pa.int32()) for i in (1, 2, 3)],
                ["item_id", "doc_word", "item_word", "n_words"],
            )
            ends = np.concatenate([[0], np.cumsum(np.concatenate(rows_of))])
            return [pa.array(np.concatenate(counts), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)]

        made = [("__n", "bigint"), (f"__m{k}", MATCHES)]
        have = [c for c in (f"__m{i}" for i in range(k))]
        columns = [c for c in dict.fromkeys([*keep, *([] if last else [text_col])])]
        frame = with_text_columns(frame, text_col, [*columns, *have], made, run)
        if not last:
            frame = checkpointed(frame.drop("__n"))
            shared.destroy()
        k += 1
    lists = [F.col(f"__m{i}") for i in range(k)]
    return frame.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__n").alias(names[0]), (F.concat(*lists) if len(lists) > 1 else lists[0]).alias(names[1])
    )


def hit_words(matches: Column | str) -> Column:
    """Words of the document inside any match (matches may overlap)."""
    spans = F.array_sort(
        F.transform(matches, lambda m: F.struct(m["doc_word"].cast("long").alias("a"), (m["doc_word"] + m["n_words"]).cast("long").alias("b")))
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["reach"]))).alias("n"),
            F.greatest(acc["reach"], s["b"]).alias("reach"),
        ),
        lambda acc: acc["n"],
    )


def item_list(matches: Column | str) -> Column:
    """Distinct items of the matches, ascending."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)
