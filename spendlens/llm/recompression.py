"""Substring dedup of word sequences by recompression.

Rounds of recompression parse every text: runs of equal symbols become one symbol, then
neighbouring symbols whose coins differ (left, right) become one. A symbol's name is a hash
of what it is made of, so equal substrings get equal names in all tasks and texts without
an exchange of name tables, and Spark only has to bring equal names together. Each symbol
carries the words that determined it; where these lie inside a window, the window holds the
symbol wherever it stands. The highest such symbol owns the window: names that several
texts share reveal the candidates, whose words are then compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import binary_array, mix, ragged
from ._repeats import BATCH_BYTES, Runs, mark_repeats, multikey_groups, owned_runs, span_column, text_bytes, valid_windows
from .ngram_join import word_hashes

WINDOW = 13
ROUNDS = 2  # a third rarely leaves a symbol that fits a window with all that determined it
SEGMENT = 1 << 18  # windows handled at once

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PLACE = np.uint64((1 << 24) - 1)


class Symbols:
    """A parse: name, first word, end, and the words [low, high) that determine each symbol."""

    def __init__(self, name, start, end, low, high):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def take(self, first, last, name, low, high):
        return Symbols(name, self.start[first], self.end[last], low, high)


def neighbours(s: Symbols, left_edge: np.ndarray, right_edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low of the symbol before, high of the symbol after); beyond a text's end nothing is
    known, so a symbol that looks there belongs to no window."""
    before, after = np.empty_like(s.low), np.empty_like(s.high)
    before[1:], after[:-1] = s.low[:-1], s.high[1:]
    before[left_edge[s.start]] = np.iinfo(np.int64).min // 2
    after[right_edge[s.end]] = np.iinfo(np.int64).max // 2
    return before, after


def recompress(words: np.ndarray, bounds: np.ndarray, rounds: int) -> list[Symbols]:
    """The parses of all rounds, from the words up. ``bounds``: where texts start and end."""
    n = len(words)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    edge[[0, n]] = True
    at = np.arange(n, dtype=np.int64)
    parses = [Symbols(words, at, at + 1, at, at + 1)]
    for r in range(1, rounds + 1):
        s = parses[-1]
        # runs of one name; whether a run ends depends on the symbol beside it
        new = np.ones(len(s.name), bool)
        new[1:] = (s.name[1:] != s.name[:-1]) | edge[s.start[1:]]
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(s.name)) - 1
        before, after = neighbours(s, edge, edge)
        size = last - first + 1
        base = s.name[first]
        name = np.where(size > 1, mix(base * _K1 + size.astype(np.uint64) * _K2 + np.uint64(r)), base)
        s = s.take(first, last, name, np.minimum(before[first], s.low[first]), np.maximum(after[last], s.high[last]))
        # pairs (left coin, right coin); a symbol left alone depends on its neighbours' coins
        right = (mix(s.name * _K3 + np.uint64(r)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(s.name), bool)  # with the next
        joins[:-1] = ~right[:-1] & right[1:] & ~edge[s.end[:-1]]
        head = np.ones(len(s.name), bool)
        head[1:] = ~joins[:-1]
        first = np.nonzero(head)[0]
        last = first + joins[first]
        before, after = neighbours(s, edge, edge)
        pair = last > first
        name = np.where(pair, mix(s.name[first] * _K2 + mix(s.name[last]) * _K1 + np.uint64(r)), s.name[first])
        low = np.where(pair | ~right[first], s.low[first], np.minimum(s.low[first], before[first]))
        high = np.where(pair | right[last], s.high[last], np.maximum(s.high[last], after[last]))
        parses.append(s.take(first, last, name, low, high))
    return parses


class WordFinder:
    """Units are words, by hash; see ``_repeats``."""

    dtype = np.dtype(np.uint64)

    def __init__(self, window: int, tasks: int, names=("n_words", "spans", "kept")):
        self.window, self.tasks = window, tasks
        self.fields = list(zip(names, ("bigint", "array<struct<start:bigint,end:bigint>>", "binary")))

    def units(self, data, offsets):
        hashes, starts, ends, bounds = word_hashes(data, offsets, lower=False)
        return hashes, bounds, starts, ends

    def runs(self, words: np.ndarray, bounds: np.ndarray) -> Runs:
        out = [[], [], [], []]
        last = len(words) - self.window + 1
        for a in range(0, last, SEGMENT):
            b = min(last, a + SEGMENT)
            part = words[a : b + self.window - 1]
            inner = bounds[(bounds >= a) & (bounds <= a + len(part))] - a
            key, owner = self._owners(part, inner, b - a)
            first, count, own = owned_runs(owner, valid_windows(bounds, self.window, a, b))
            for x, y in zip(out, (key[first], own % len(part) + a, first + a, count)):
                x.append(y)
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        return Runs(*[np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)])

    def _owners(self, words: np.ndarray, bounds: np.ndarray, n: int):
        """For each of the first n windows: the key of its owner (its level, name and the words
        that determine it) and a number of the owner, equal for neighbours with one owner."""
        prefix = np.zeros(len(words) + 1, np.uint64)
        key, owner = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        power = np.full(len(words) + 1, _K1)
        power[0] = 1
        power = np.cumprod(power)
        prefix[1:] = np.cumsum(mix(words) * power[:-1])
        inverse = np.full(len(words) + 1, np.uint64(pow(int(_K1), -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        for level, s in reversed(list(enumerate(recompress(words, bounds, ROUNDS)))):
            open_ = owner < 0
            if not open_.any():
                break
            fits = np.nonzero((s.high - s.low <= self.window) & (s.low >= 0) & (s.high <= len(words)))[0]
            # of these, the ones that lie in a window still without owner
            total = np.concatenate([[0], np.cumsum(open_)])
            first, last = np.clip(s.high[fits] - self.window, 0, n), np.clip(s.low[fits] + 1, 0, n)
            fits = fits[total[last] > total[first]]
            low, high = s.low[fits], s.high[fits]
            inside = (prefix[high] - prefix[low]) * inverse[low]
            name = mix(inside + s.name[fits] * _K2 + mix((s.start[fits] - low).astype(np.uint64) * _K3 + np.uint64(level)))
            rank = (name & ~_PLACE) | fits.astype(np.uint64)  # smallest name, then leftmost
            best = np.full(n, np.iinfo(np.uint64).max)
            for t in range(self.window):  # windows that start t words before the symbol's first word
                use = (high - low + t <= self.window) & (low - t >= 0) & (low - t < n)
                at = low[use] - t  # where symbols share a first word, the last of them stands for all
                best[at] = np.minimum(best[at], rank[use])
            got = open_ & (best < np.iinfo(np.uint64).max)
            place = (best[got] & _PLACE).astype(np.int64)
            names = np.zeros(len(s.name), np.uint64)
            names[fits] = name
            key[got], owner[got] = names[place], level * len(words) + s.start[place]
        return key, owner

    def route(self, words, anchor, key):
        return (mix(key) % np.uint64(self.tasks)).astype(np.int64)

    def group(self, words, starts):
        return multikey_groups(words, starts, [(k, 0) for k in range(self.window)])

    def result(self, data, offsets, bounds, removed, starts, ends):
        kept = np.nonzero(~removed)[0]
        size = ends[kept] - starts[kept] + 1
        body = data[np.minimum(ragged(starts[kept], size), max(len(data) - 1, 0))]
        stop = np.cumsum(size)
        body[stop - 1] = 32  # a space after every word
        total = np.concatenate([[0], stop])
        before = np.concatenate([[0], np.cumsum(~removed)])[bounds]
        rows = total[before]  # byte offsets of the rows, each with a last space too many
        full = np.diff(before) > 0
        drop = np.zeros(len(body), bool)
        drop[rows[1:][full] - 1] = True
        rows = rows - np.concatenate([[0], np.cumsum(full)])
        return [pa.array(np.diff(bounds), pa.int64()), span_column(bounds, removed), binary_array(body[~drop], rows)]


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    batch_bytes: int = BATCH_BYTES,
    names: tuple[str, str, str] = ("n_words", "spans", "kept"),
) -> DataFrame:
    """The columns of ``keep``, n_words, spans (maximal removed runs of words) and kept (the
    words left, joined by one space, UTF-8).

    A word goes when a run of ``window`` words that covers it also starts in a row with a
    smaller id, judged on the input. Words are runs of non-space, unchanged. Null and blank
    texts have no words; rows without id count as later than all others; rows with one id
    never count against each other; repeated rows give repeated rows. Very long texts are
    handled in segments. Words are told apart by 64-bit hashes.
    """
    tasks = max(1, -(-3 * text_bytes(docs, text_col) // (2 * batch_bytes)))
    return mark_repeats(docs, WordFinder(window, tasks, names), id_col=id_col, text_col=text_col, keep=keep, batch_bytes=batch_bytes)
