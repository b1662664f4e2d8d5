"""NumPy helpers on Arrow text columns, shared by the operators of this subpackage.

Text is handled as UTF-8 bytes in the Arrow buffers; no per-row Python strings. All
helpers work on chunks of whole rows of a few MB, so memory per task stays bounded by
the chunk (or by one text, where a single text is longer).
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch between Spark and its Python workers. Spark's own
#: 10,000 rows would be tens of MB of text, held by the JVM and the worker at once.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch limits to those for texts; smaller ones stay."""
    conf = df.sparkSession.conf
    for key, limit in ARROW_LIMITS.items():
        number, unit = re.match(r"(-?\d+)\s*([kmg]?)", conf.get(key).lower()).groups()
        now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if now <= 0 or now > limit:
            conf.set(key, str(limit))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes each, and at least one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(total, dtype=np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (new array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and its inverse modulo 2**64 for i < n; arrays of usual chunk size are kept."""
    have = _POWERS.get(mult)
    if have is not None and len(have[0]) >= n:
        return have
    size = max(n, CHUNK_BYTES + 1)
    out = []
    for base in (mult, pow(mult, -1, 1 << 64)):
        a = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            m = min(done, size - done)
            a[done : done + m] = a[:m] * np.uint64(step)
            done += m
            step = step * step & _MASK
        out.append(a)
    if size <= 4 * CHUNK_BYTES:
        _POWERS[mult] = (out[0], out[1])
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int = _MULT) -> np.ndarray:
    """64-bit hash of each byte range, from one prefix sum over the chunk."""
    power, inverse = _powers(len(data) + 1, mult)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of well-formed UTF-8."""
    lead = np.nonzero((data & 0xC0) != 0x80)[0]
    cp = data[lead].astype(np.int32)
    wide = np.nonzero(cp >= 0xC0)[0]
    if len(wide):
        n = len(data)
        first = cp[wide]
        pos = lead[wide]

        def cont(k):
            return (data[np.minimum(pos + k, n - 1)] & 0x3F).astype(np.int32)

        two = ((first & 0x1F) << 6) | cont(1)
        three = ((first & 0x0F) << 12) | (cont(1) << 6) | cont(2)
        four = ((first & 0x07) << 18) | (cont(1) << 12) | (cont(2) << 6) | cont(3)
        cp[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return cp, lead


_TABLES: dict[str, np.ndarray] = {}
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space, other."""
    if "class" not in _TABLES:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
            elif kind == "Z":
                table[c] = SPACE
        table[[9, 10, 11, 12, 13, 0x85]] = SPACE
        _TABLES["class"] = table
    return _TABLES["class"]


def lower_letters() -> np.ndarray:
    """Lower-case code point of every letter; 0 for all other characters."""
    if "lower" not in _TABLES:
        classes = char_classes()
        table = np.zeros(len(classes), np.int32)
        for c in np.nonzero(classes == LETTER)[0]:
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
        _TABLES["lower"] = table
    return _TABLES["lower"]


def binary_array(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """Arrow binary (or ``kind``) array over bytes and offsets."""
    kind = kind or pa.binary()
    wide = kind in (pa.large_binary(), pa.large_string())
    offs = np.ascontiguousarray(offsets, np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def with_text_columns(docs: DataFrame, text_col: str, keep, fields: list[tuple[str, str]], func) -> DataFrame:
    """The columns of ``keep`` and new ``fields`` (name, type) that ``func`` makes from each
    Arrow batch's text column (a list of arrays). One pass over the rows, no shuffle."""
    bounded_batches(docs)
    keep = list(keep)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    ddl = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {t}" for n, t in fields])
    names = [*keep, *[n for n, _ in fields]]

    def run(batches):
        for batch in batches:
            made = func(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names)

    return frame.mapInArrow(run, ddl)
