"""Similarity join of texts by the Jaccard index of their word n-grams.

Candidates come from bands of MinHash values. Candidate pairs compare their MinHash values
a few at a time, and a pair is dropped once the posterior probability that its similarity
reaches the threshold, given the matches so far (uniform prior), falls below a tolerance.
What is left is verified exactly on the n-gram sets.

Texts with equal n-gram sets form a class that takes part once. Pairs are never emitted:
candidates meet in blocks of bounded size, where the pairs that share a band are compared;
a pair of blocks returns link counts and, for the groups, one edge per text to the smallest
text it is connected to there.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ._bytes import bounded_batches, column_bytes, mix, ragged, row_chunks, span_hashes
from ._graph import connected_components

N_GRAM = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 256  # texts of one block; two blocks meet in a task
HOME_ROUNDS = 2
BLOCK_BYTES = 8 << 20  # and bytes of one block, about
TASK_BYTES = 2 << 20  # bytes of text that a task takes at once, about; one pair of blocks at least

_code = np.arange(256)
_is_space = (_code == 32) | ((_code >= 9) & (_code <= 13))
_lower = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of every white-space separated word, row offsets into them)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_is_space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    starts, ends = np.nonzero(start)[0], np.nonzero(stop)[0]
    return span_hashes(_lower[data] if lower else data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of every row, row offsets). A text of fewer words, but
    not none, has its whole word sequence as its one n-gram."""
    words, _, _, bounds = word_hashes(data, offsets, lower=True)
    size = np.diff(bounds)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    left = bounds[1:][row] - np.arange(len(words))  # words from here to the row's end
    h = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(words)], np.uint64(0))
    use = (left >= n) | ((size[row] < n) & (left == size[row]))
    h, row = mix(h)[use], row[use]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return s[:count].astype(np.uint32), s[count:].astype(np.uint32) | np.uint32(1)


def min_hashes(sets: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) uint32 MinHash values; rows must not be empty."""
    out = np.empty((len(bounds) - 1, count), np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    for k, (a, b) in enumerate(zip(*_seeds(count))):
        out[:, k] = np.minimum.reduceat((low ^ a) * b, bounds[:-1])
    return out


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) uint64 values; those of different bands differ."""
    values = signs.astype(np.uint64).reshape(len(signs), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return key


def set_ids(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit names of each row's set."""
    a = np.add.reduceat(mix(sets + np.uint64(1)), bounds[:-1])
    b = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0xD6E8FEB86659FD93)), bounds[:-1])
    return a.view(np.int64), mix(b).view(np.int64)


def sketches(docs: DataFrame, *, id_col: str, text_col: str, n_gram: int, bands: int, rows: int) -> DataFrame:
    """(id, h, size, s1, s2, bands array<long>) of every row with an id and at least one word;
    h is a hash of the text, which tells rows that share an id apart, size its bytes."""
    bounded_batches(docs)
    text = F.col(f"`{text_col}`").cast("string")
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"))
    frame = frame.where(F.col("id").isNotNull() & (F.octet_length("text") > 0))

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in row_chunks(offsets):
                sets, bounds = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n_gram)
                full = np.nonzero(np.diff(bounds) > 0)[0]
                if not len(full):
                    continue
                bounds = np.append(bounds[full], len(sets))
                key = band_keys(min_hashes(sets, bounds, bands * rows), bands, rows)
                s1, s2 = set_ids(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(full)),
                        batch.column(2).slice(lo, hi - lo).take(pa.array(full)),
                        batch.column(3).slice(lo, hi - lo).take(pa.array(full)),
                        pa.array(s1),
                        pa.array(s2),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(full) + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64))
                        ),
                    ],
                    ["id", "h", "size", "s1", "s2", "bands"],
                )

    return frame.mapInArrow(run, "id long, h long, size int, s1 long, s2 long, bands array<long>")


def least_matches(count: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches a pair must have by then to go on).

    With a uniform prior and m matches in n the similarity has a Beta(m + 1, n - m + 1)
    posterior; its chance to reach t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, count + 1, step):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def band_pairs(keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs left[i], right[j] that share a band value; i < j within one block."""
    share = np.zeros((len(left), len(right)), bool)
    for band in keys.T:
        share |= band[left][:, None] == band[right]
    return np.nonzero(np.triu(share, 1) if left is right else share)


def block_links(sets, bounds, signs, keys, left, right, rules, threshold: Fraction) -> np.ndarray:
    """(left, right) boolean matrix of the pairs that share a band and reach the threshold."""
    i, j = band_pairs(keys, left, right)
    matches, done = np.zeros(len(i), np.int32), 0
    for n, least in rules:
        matches += (signs[left[i], done:n] == signs[right[j], done:n]).sum(axis=1, dtype=np.int32)
        done = n
        go = matches >= least
        i, j, matches = i[go], j[go], matches[go]
        if not len(i):
            break
    linked = np.zeros((len(left), len(right)), bool)
    if not len(i):
        return linked
    # exact sizes of the intersections, over the n-grams that several texts have
    rows = np.unique(np.concatenate([left[i], right[j]]))
    size = np.diff(bounds)
    values = sets[ragged(bounds[rows], size[rows])]
    owner = np.repeat(np.arange(len(rows)), size[rows])
    _, of, n_of = np.unique(values, return_inverse=True, return_counts=True)
    common = n_of[of] > 1
    number = np.cumsum(n_of > 1) - 1
    of, owner = number[of[common]], owner[common]
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order]
    a, b = np.searchsorted(rows, left[i]), np.searchsorted(rows, right[j])
    inter = np.zeros(len(i), np.int64)
    last, width = int(of[-1]) + 1 if len(of) else 0, 4096
    for at in range(0, last, width):
        lo, hi = np.searchsorted(of, [at, at + width])
        block = np.zeros((len(rows), min(width, last - at)), np.float32)
        block[owner[lo:hi], of[lo:hi] - at] = 1
        if len(i) * 4 > len(rows) ** 2:
            inter += (block @ block.T)[a, b].astype(np.int64)
        else:
            for k in range(0, len(i), 2048):
                inter[k : k + 2048] += (block[a[k : k + 2048]] * block[b[k : k + 2048]]).sum(axis=1).astype(np.int64)
    union = size[left[i]] + size[right[j]] - inter
    hit = inter * threshold.denominator >= union * threshold.numerator
    linked[i[hit], j[hit]] = True
    return linked


def _smallest_reached(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id connected to each node of a symmetric matrix."""
    low = ids.copy()
    a, b = np.nonzero(linked)
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        if (new == low).all():
            break
        low = new
    return low


def candidate_blocks(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Where texts meet that share a band value: (s1, rep, copies, size, block) of every text
    that shares one, and the pairs of blocks (lo, hi), lo <= hi, that hold such texts.

    A text's home is the most frequent of its band values, then, ``HOME_ROUNDS`` times, the
    greatest home among the texts it shares a value with: a group of near copies gets one home,
    a long chain many. A home of more than ``block`` texts (or ``BLOCK_BYTES``) is split by
    hash. Two blocks meet only where a text of the one shares a value with a text of the other,
    so a chain of texts, each like the next, meets link by link. Every text has one block: a
    pair meets once.
    """
    keys = classes.select("s1", F.explode("bands").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(keys.join(often, "key"))
    homes = shared.groupBy("s1").agg(F.max(F.struct("n", "key")).alias("home"))
    for _ in range(HOME_ROUNDS):
        known = shared.select("s1", "key").join(homes, "s1")
        best = known.groupBy("key").agg(F.max("home").alias("home"))
        homes = checkpointed(shared.select("s1", "key").join(best, "key").groupBy("s1").agg(F.max("home").alias("home")))
    homes = homes.select("s1", F.col("home.key").alias("home")).join(classes.select("s1", "rep", "copies", "size"), "s1")
    parts = homes.groupBy("home").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    parts = parts.select("home", F.ceil(F.greatest(F.col("m") / block, F.col("bytes") / BLOCK_BYTES)).cast("long").alias("nb"))
    part = F.pmod(F.xxhash64("s1"), F.greatest("nb", F.lit(1)))
    members = homes.join(parts, "home").select("s1", "rep", "copies", "size", F.xxhash64("home", part).alias("block"))
    members = checkpointed(members)
    stand = checkpointed(shared.join(members.select("s1", "block"), "s1").select("key", "block").distinct())
    across = stand.select("key", F.col("block").alias("lo")).join(stand.select("key", F.col("block").alias("hi")), "key").where("lo < hi")
    within = members.groupBy("block").agg(F.count("*").alias("m")).where("m > 1").select(F.col("block").alias("lo"), F.col("block").alias("hi"))
    return members, checkpointed(across.select("lo", "hi").distinct().unionAll(within))


def similar_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_gram: int = N_GRAM,
    threshold: Fraction = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    with_text_hash: bool = False,
) -> DataFrame:
    """(id, class_id, n_links, component_id, kept) of every row, one row for each.

    class_id: smallest id with the same n-gram set. n_links: other rows whose similarity
    reaches the threshold, copies included. component_id: smallest id reached over links.
    kept: the row has the smallest id of its component (and, where that id has several texts
    there, the text of the smallest hash). Words are lower-cased (A-Z) runs of
    non-space. Null, empty and blank texts, and rows without id, link with nothing and stay
    (their ids are their own class and component). Rows that share an id count each for
    itself, by its own text: a row may be kept where another of the same id is not. Sets are
    told apart by a 64-bit hash. Extra columns are not read. ``with_text_hash`` adds
    ``text_hash``, by which such rows can be found again.
    """
    count = bands * rows
    found = checkpointed(sketches(docs, id_col=id_col, text_col=text_col, n_gram=n_gram, bands=bands, rows=rows))
    classes = checkpointed(
        found.groupBy("s1", "s2").agg(
            F.min(F.struct("id", "h")).alias("first"),
            F.count("*").alias("copies"),
            F.max("size").cast("long").alias("size"),
            F.min_by("bands", "id").alias("bands"),
        )
    ).withColumn("rep", F.col("first.id"))
    # A class is known by s1 from here on.
    members, pairs = candidate_blocks(classes, block)
    total = members.join(pairs.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block")), "block").agg(F.sum("size")).first()[0]
    tasks = max(1, -(-(total or 0) // TASK_BYTES))
    sent = members.join(pairs.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi")))), "block")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text"))
    met = (
        sent.join(texts, "rep")
        .withColumn("t", F.pmod(F.xxhash64("lo", "hi"), F.lit(tasks)).cast("int"))
        .select("t", "lo", "hi", "block", "s1", "copies", "text")
    )
    rules = least_matches(count, STEP, float(threshold), tolerance)

    def verify(table):
        data, offsets = column_bytes(table.column("text"))
        sets, bounds = shingles(data, offsets, n_gram)
        lo, hi, own, s1, copies = (table.column(x).to_numpy() for x in ("lo", "hi", "block", "s1", "copies"))
        full = np.nonzero(np.diff(bounds) > 0)[0]  # none is empty, unless rows share an id
        bounds = np.append(bounds[full], len(sets))
        good = set_ids(sets, bounds)[0] == s1[full] if len(full) else np.zeros(0, bool)
        signs = min_hashes(sets, bounds, count) if len(full) else np.zeros((0, count), np.uint32)
        keys = band_keys(signs, bands, rows)
        lo, hi, own, s1, copies = (x[full] for x in (lo, hi, own, s1, copies))
        order = np.lexsort((s1, hi, lo))
        order = order[good[order]]
        key = np.stack([lo, hi])[:, order]
        cut = np.append(0, np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1) if len(order) else np.zeros(0, int)
        out = [[], [], []]
        for a, z in zip(cut, np.append(cut[1:], len(order))):
            rows_ = order[a:z]
            once = np.append(True, s1[rows_[1:]] != s1[rows_[:-1]])  # a repeated row stands for its class once
            rows_ = rows_[once]
            if lo[rows_[0]] == hi[rows_[0]]:
                linked = block_links(sets, bounds, signs, keys, rows_, rows_, rules, threshold)
                linked |= linked.T
            else:
                first = own[rows_] == lo[rows_]
                left, right = rows_[first], rows_[~first]
                part = block_links(sets, bounds, signs, keys, left, right, rules, threshold)
                rows_ = np.concatenate([left, right])
                linked = np.zeros((len(rows_), len(rows_)), bool)
                linked[: len(left), len(left) :] = part
                linked |= linked.T
            n = linked @ copies[rows_]
            has = np.nonzero(n)[0]
            out[0].append(s1[rows_][has])
            out[1].append(n[has])
            out[2].append(_smallest_reached(linked, s1[rows_])[has])
        none = [np.zeros(0, np.int64)]
        return pa.table({k: pa.array(np.concatenate(v or none), pa.int64()) for k, v in zip(("u", "n", "v"), out)})

    links = checkpointed(met.groupBy("t").applyInArrow(verify, "u long, n long, v long"))
    joined = connected_components(links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("s1")).agg(F.sum("n").alias("n"))
    per_class = checkpointed(
        classes.select("s1", "s2", "first", "copies")
        .join(counts, "s1", "left")
        .join(joined.select(F.col("u").alias("s1"), F.col("v").alias("c")), "s1", "left")
        .select(
            "s1",
            "s2",
            "first",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("c", "s1").alias("c"),
        )
    )
    least = per_class.groupBy("c").agg(F.min("first").alias("least"))
    per_class = per_class.join(least, "c").select("s1", "s2", F.col("first.id").alias("class_id"), "n_links", "least")
    of_rows = found.select("id", "h", "s1", "s2").distinct().join(per_class, ["s1", "s2"]).drop("s1", "s2")
    text = F.col(f"`{text_col}`").cast("string")
    rows_in = docs.select(F.col(f"`{id_col}`"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"))
    out = rows_in.join(of_rows, ["id", "h"], "left")
    chosen = F.struct("id", "h") == F.col("least")
    return out.select(
        F.col(f"`{id_col}`"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least.id", "id").alias("component_id"),
        F.coalesce(chosen, F.lit(True)).alias("kept"),
        *([F.col("h").alias("text_hash")] if with_text_hash else []),
    )
