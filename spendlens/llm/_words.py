"""Words of Arrow text columns as spans and as exact small numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._bytes import binary_array, ragged

_code = np.arange(256)
#: Bytes that separate words: blank and the ASCII controls 9 to 13.
IS_SPACE = (_code == 32) | ((_code >= 9) & (_code <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end of every word, row offsets into the words); ``inside`` tells for each
    byte whether it belongs to a word. Words do not cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = np.zeros(n + 1, bool)
    stop[1:n] = inside[:-1] & (~inside[1:] | edge[1:n])
    stop[n] = inside[-1]
    starts, ends = np.nonzero(start)[0], np.nonzero(stop)[0]
    return starts, ends, np.searchsorted(starts, offsets)


def word_dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of every word, the distinct words): equal words, and only they, share a number."""
    lengths = ends - starts
    column = binary_array(data[ragged(starts, lengths)], np.append(0, np.cumsum(lengths)), pa.large_binary())
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def joined_words(data, starts, ends, bounds) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of every row's words joined by one blank."""
    lengths = ends - starts + 1
    at = ragged(starts, lengths)
    stop = np.cumsum(lengths)
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    blank = stop - 1
    out[blank] = 32
    last = bounds[1:][np.diff(bounds) > 0] - 1  # the last word of each row has no blank after it
    keep = np.ones(len(out), bool)
    keep[blank[last]] = False
    size = np.append(0, stop)
    ends_at = size[bounds]
    before = np.append(0, np.cumsum(np.diff(bounds) > 0))
    return out[keep], ends_at - before
