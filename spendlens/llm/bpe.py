"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Texts are split into pre-tokens with array operations on code points. The distinct
pre-tokens of a chunk form one linked list of symbols; a bucket per merge rank holds the
list positions whose pair has that rank, a three-level bitmap finds the next non-empty
rank, and entries that are stale when popped are skipped. A pre-token therefore costs
O(length) bucket entries however long it is.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import (
    LETTER,
    NUMBER,
    OTHER,
    SPACE,
    binary_array,
    bounded_batches,
    char_classes,
    code_points,
    column_bytes,
    ragged,
    row_chunks,
    span_hashes,
)

NONE = np.int32(2**31 - 1)
CACHE_TOKENS = 400_000
ENCODE_BYTES = 3 << 19  # distinct pre-tokens of so much text share one queue
LONG = 512  # longer pre-tokens are encoded each for itself

# Endings that the split pattern takes together with their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a rank file (base64 token, rank)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    return [ranks[i] for i in range(len(ranks))]


class RankQueue:
    """Set of ranks with find-first-set: three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def push(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> int:
        """Smallest rank, removed; -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = word & (word - 1)
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank


class Vocabulary:
    """Arrays made once from the tokens; small and fixed, so it is broadcast."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.digest = hashlib.sha256(b"\n".join(tokens)).hexdigest()
        self.size = len(tokens)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, rank in ids.items():
            for k in range(1, len(t)):
                left, right = ids.get(t[:k]), ids.get(t[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(2**62))
        self.pair_ranks = np.append(np.array([pairs[int(k)] for k in keys], np.int32), NONE)
        # Where no pair that holds token r ranks at or below r, merging r never opens a
        # smaller rank, and its whole bucket can be merged at once.
        least = np.full(self.size, NONE)
        np.minimum.at(least, keys >> 32, self.pair_ranks[:-1])
        np.minimum.at(least, keys & 0xFFFFFFFF, self.pair_ranks[:-1])
        self.at_once = (least > np.arange(self.size)).tolist()
        whole = span_hashes(self.data, self.starts, self.starts + self.lengths)
        order = np.argsort(whole)
        self.hash_keys, self.hash_ids = whole[order], order.astype(np.int32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; id -1 is no symbol and makes a negative key."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.pair_keys.searchsorted(key)  # the last key is larger than any pair
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def whole_tokens(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Id of each pre-token that is itself a token, else -1."""
        at = np.minimum(np.searchsorted(self.hash_keys, hashes), self.size - 1)
        ids = self.hash_ids[at]
        return np.where((self.hash_keys[at] == hashes) & (self.lengths[ids] == lengths), ids, -1)


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the matches of the split pattern start, over all rows."""
    cp, pos = code_points(data)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = char_classes()[cp]
    first = np.zeros(n + 1, bool)  # first character of a row
    first[np.searchsorted(pos, offsets)] = True
    change = first[:n].copy()
    change[1:] |= cls[1:] != cls[:-1]
    run = np.nonzero(change)[0]
    end = np.append(run[1:], n)
    kind = cls[run]
    is_space = kind == SPACE
    closes = first[end]  # the run ends its row
    follows_space = np.zeros(len(run), bool)
    follows_space[1:] = is_space[:-1] & ~closes[:-1] & (cp[end[:-1] - 1] == 32)
    start = np.zeros(n + 1, bool)
    start[run[is_space | ~follows_space]] = True
    start[end[is_space & ~closes] - 1] = True
    # A lone apostrophe that opens a match takes a known ending with it.
    lone = np.nonzero((kind == OTHER) & (end - run == 1) & ~follows_space & ~closes & (cp[run] == 39))[0]
    lone = lone[kind[lone + 1] == LETTER] if len(lone) else lone
    if len(lone):
        s, e = run[lone + 1], end[lone + 1]
        c1, c2 = cp[s], np.where(e - s > 1, cp[np.minimum(s + 1, n - 1)], 0)
        takes = np.zeros(len(lone), np.int64)
        for ending in CONTRACTIONS:
            hit = c1 == ord(ending[0])
            if len(ending) == 2:
                hit &= c2 == ord(ending[1])
            takes[hit] = len(ending)
        s, e, takes = s[takes > 0], e[takes > 0], takes[takes > 0]
        start[s] = False
        start[(s + takes)[s + takes < e]] = True
    return pos[np.nonzero(start[:n])[0]]


def merge_all(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each byte range, concatenated, and how many each has."""
    lengths = ends - starts
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    tok = np.empty(n + 1, np.int32)
    tok[:n] = vocab.byte_id[data[ragged(starts, lengths)]]
    tok[n] = -1
    word = np.repeat(np.arange(len(starts)), lengths)
    bounds = np.cumsum(lengths)
    nxt = np.arange(1, n + 2)
    nxt[bounds[lengths > 0] - 1] = n
    prv = np.arange(-1, n)
    prv[(bounds - lengths)[lengths > 0]] = n
    rank = np.full(n + 1, NONE, np.int32)
    rank[:n] = vocab.pair_rank(tok[:n], tok[nxt[:n]])
    alive = np.ones(n, bool)

    entry = np.nonzero(rank[:n] < NONE)[0]
    entry = entry[np.argsort(rank[entry], kind="stable")]
    ranks, begin = np.unique(rank[entry], return_index=True)
    buckets: dict[int, list[np.ndarray]] = {}
    queue = RankQueue(vocab.size)
    stop = np.append(begin[1:], len(entry))
    for r, a, b in zip(ranks.tolist(), begin.tolist(), stop.tolist()):
        buckets[r] = [entry[a:b]]
        queue.push(r)
    while (r := queue.pop()) >= 0:
        parts = buckets.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[rank[at] == r]  # skip stale entries
        if not len(at):
            continue
        if not vocab.at_once[r]:
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            if not lead.all():
                buckets[r] = [at[~lead]]
                queue.push(r)
                at = at[lead]
        right = nxt[at]
        if len(at) > 1:
            chained = right[:-1] == at[1:]
            if chained.any():  # x x x: take every second pair of a chain, from its left
                head = np.append(True, ~chained)
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0]
                right = nxt[at]
        after = nxt[right]
        tok[at] = r
        alive[right] = False
        rank[right] = NONE
        nxt[at] = after
        prv[after] = at
        prv[n] = n
        before = prv[at]
        new = np.concatenate([at, before])  # pairs to the right and left of each merge
        new_rank = vocab.pair_rank(tok[new], tok[np.concatenate([after, at])])
        rank[new] = new_rank
        rank[n] = NONE
        keep = new_rank < NONE
        if not keep.any():
            continue
        new, new_rank = new[keep], new_rank[keep]
        order = np.lexsort((new, new_rank))
        new, new_rank = new[order], new_rank[order]
        once = np.append(True, new[1:] != new[:-1])  # neighbours that both merged
        new, new_rank = new[once], new_rank[once]
        cut = np.append(0, np.nonzero(new_rank[1:] != new_rank[:-1])[0] + 1).tolist()
        values = new_rank[cut].tolist()
        cut.append(len(new))
        for i, value in enumerate(values):
            if value in buckets:
                buckets[value].append(new[cut[i] : cut[i + 1]])
            else:
                buckets[value] = [new[cut[i] : cut[i + 1]]]
                queue.push(value)
    return tok[:n][alive], np.bincount(word[alive], minlength=len(starts))


class _Cache:
    """Encoded pre-tokens of this worker, by hash; emptied when full."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE_TOKENS:
            self.clear()
        if len(keys) > CACHE_TOKENS:
            return
        starts = np.cumsum(counts) - counts + len(self.ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.counts = np.insert(self.counts, at, counts)
        self.ids = np.concatenate([self.ids, ids])


_CACHES: dict[str, _Cache] = {}


def encode_chunk(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, int64 row offsets into them) for rows of UTF-8 bytes.

    Equal pre-tokens are found by a 64-bit hash within one worker's bounded cache, so a
    wrong match has a chance below 1e-8 per cache filling; pre-tokens over ``LONG`` bytes
    never share an entry.
    """
    cache = _CACHES.setdefault(vocab.digest, _Cache())
    starts = pre_token_starts(data, offsets)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    rows = np.searchsorted(starts, offsets)
    lengths = ends - starts
    short = lengths <= LONG
    keys = span_hashes(data, starts, ends)
    distinct, pick, inverse = np.unique(keys[short], return_index=True, return_inverse=True)
    pick = np.nonzero(short)[0][pick]
    known = cache.find(distinct)
    new = np.nonzero(known < 0)[0]
    whole = vocab.whole_tokens(distinct[new], lengths[pick[new]])
    todo = pick[new][whole < 0]
    ids, counts = merge_all(data, starts[todo], ends[todo], vocab)
    new_counts = np.ones(len(new), np.int64)
    new_counts[whole < 0] = counts
    new_starts = np.cumsum(new_counts) - new_counts
    new_ids = np.empty(int(new_counts.sum()), np.int32)
    new_ids[new_starts[whole >= 0]] = whole[whole >= 0]
    new_ids[ragged(new_starts[whole < 0], counts)] = ids
    big = np.nonzero(~short)[0]
    big_ids, big_counts = merge_all(data, starts[big], ends[big], vocab)

    # ids of every pre-token: from the cache, newly made, or long
    pool = np.concatenate([cache.ids, new_ids, big_ids])
    d_start, d_count = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    old = known >= 0
    d_start[old], d_count[old] = cache.starts[known[old]], cache.counts[known[old]]
    d_start[new], d_count[new] = new_starts + len(cache.ids), new_counts
    t_start, t_count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    t_start[short], t_count[short] = d_start[inverse], d_count[inverse]
    t_start[big] = np.cumsum(big_counts) - big_counts + len(cache.ids) + len(new_ids)
    t_count[big] = big_counts
    cache.add(distinct[new], new_counts, new_ids)
    total = np.concatenate([[0], np.cumsum(t_count)])
    return pool[ragged(t_start, t_count)], total[rows]


def decode_chunk(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of rows of token ids."""
    lengths = vocab.lengths[ids]
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return vocab.data[ragged(vocab.starts[ids], lengths)], total[offsets]


def encode_decode(docs: DataFrame, vocab: Vocabulary, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, decoded binary): each text's token ids, and those ids decoded.

    No special tokens. A null or empty text gives no ids and empty bytes. Repeated rows
    give repeated rows; extra columns are not read. No shuffle: each batch stands alone.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in row_chunks(offsets, ENCODE_BYTES):
                ids, rows = encode_chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], vocab)
                back, at = decode_chunk(ids, rows, vocab)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32())),
                        binary_array(back, at),
                    ],
                    [id_col, "ids", "decoded"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, ids array<int>, decoded binary")


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file; read on the driver, shipped as a broadcast of fixed size."""
    return Vocabulary(load_ranks(path))
