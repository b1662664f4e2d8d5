"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. Each model sees the hashed words of a
text and the probabilities of the categories before it; it is trained on out-of-fold
probabilities, so it meets there what it will meet on new texts. Training uses a bounded
sample, whose hashed words fit in the driver; scoring is one pass over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import column_bytes, row_chunks, with_text_columns
from .decontaminate import words
from .rule_quality import labelled_sample

BUCKETS = 1 << 16
FOLDS = 3
MAX_TRAIN_DOCS = 12_000
MIN_DOCS = 2  # words of fewer training texts count for nothing, whatever the number of texts
STEPS, RATE, PENALTY = 300, 0.03, 1e-3


def hashed_words(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word buckets of every row, row offsets into them)."""
    hashes, bounds = words(data, offsets)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    both = np.unique(row * buckets + (hashes % np.uint64(buckets)).astype(np.int64))
    return (both % buckets).astype(np.int32), np.searchsorted(both, np.arange(n + 1) * buckets)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values, in their order: the same wherever the row stands in a batch."""
    n = len(bounds) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(bounds)), values, n)


def probability(model: dict, bag: np.ndarray, bounds: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    z = _sums(model["words"][bag], bounds) + earlier @ model["earlier"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_one(bag: np.ndarray, bounds: np.ndarray, earlier: np.ndarray, y: np.ndarray, buckets: int) -> dict:
    """Penalised logistic regression by Adam steps over the whole sample. With one label
    value (or no rows) the model is that value (0)."""
    model = {"words": np.zeros(buckets), "earlier": np.zeros(earlier.shape[1]), "bias": 0.0}
    if not len(y) or y.min() == y.max():
        model["bias"] = 30.0 if len(y) and y[0] > 0 else -30.0
        return model
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    used, at = np.unique(bag, return_inverse=True)
    k = earlier.shape[1]
    w = np.zeros(len(used) + k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = _sums(w[at], bounds) + earlier @ w[len(used) : len(used) + k] + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(at, off[row], len(used)), earlier.T @ off, [off.sum()]]) / len(y) + PENALTY * w
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model["words"][used] = w[: len(used)]
    model["earlier"], model["bias"] = w[len(used) : len(used) + k], float(w[-1])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = MAX_TRAIN_DOCS,
    folds: int = FOLDS,
    buckets: int = BUCKETS,
    min_docs: int = MIN_DOCS,
) -> dict:
    """Learn the chain over 0/1 columns ``categories`` of ``labels``, in their order, from at
    most about ``max_docs`` labelled documents. Labels with a null are left out; a category
    with one value gets that value. A word has a weight if ``min_docs`` of these documents hold
    it, a fixed number; the penalty keeps the weights of rare words small."""
    rows = labelled_sample(docs.select(id_col, text_col), labels, F.lit(True), categories, id_col, max_docs)
    fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col(id_col).cast("string")).cast("binary")), F.lit(folds)).cast("int")
    rows = rows.select(text_col, fold.alias("__fold"), *[F.col(c).cast("double") for c in categories])

    def run(column):
        data, offsets = column_bytes(column)
        out = []
        for lo, hi in row_chunks(offsets):
            bag, bounds = hashed_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets)
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bag)))
        return [pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))]

    table = with_text_columns(rows, text_col, ("__fold", *categories), [("__bag", "array<int>")], run).toArrow()
    bags = table.column("__bag").combine_chunks()
    bag, sizes = bags.flatten().to_numpy(), bags.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(bag, minlength=buckets)[bag] >= min_docs
    bag, row = bag[often], row[often]
    which = table.column("__fold").to_numpy()
    earlier, models = np.zeros((len(sizes), 0)), []

    def part(chosen: np.ndarray):
        number = np.cumsum(chosen) - 1
        take = chosen[row]
        return bag[take], np.searchsorted(number[row[take]], np.arange(int(chosen.sum()) + 1)), earlier[chosen]

    cuts = []
    for category in categories:
        y = table.column(category).to_numpy()
        models.append(_fit_one(*part(np.ones(len(y), bool)), y, buckets))
        p = np.zeros(len(y))  # out of fold, for the models to come and for the threshold
        for f in range(folds):
            held = which == f
            if held.any():
                p[held] = probability(_fit_one(*part(~held), y[~held], buckets), *part(held))
        cuts.append(best_cut(p, y))
        earlier = np.column_stack([earlier, p])
    return {"categories": categories, "models": models, "cuts": cuts, "buckets": buckets}


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which calling 1 has the best F1 on out-of-fold predictions."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # only between different values
    return float(p[order][f1.argmax()])


def score(docs: DataFrame, chain: dict, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and a probability ``p_<category>`` for every row. Null and
    empty texts are scored as texts without words; repeated rows repeat. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(column):
        chain = shared.value
        data, offsets = column_bytes(column)
        out = [np.zeros((0, len(chain["models"])))]
        for lo, hi in row_chunks(offsets):
            bag, bounds = hashed_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], chain["buckets"])
            p = np.zeros((hi - lo, 0))
            for model in chain["models"]:
                p = np.column_stack([p, probability(model, bag, bounds, p)])
            out.append(p)
        return [pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T]

    return with_text_columns(docs, text_col, keep, [(f"p_{c}", "double") for c in chain["categories"]], run)


def is_positive(chain: dict, category: str) -> Column:
    """Whether a scored row reaches the chain's threshold for a category."""
    return F.col(f"p_{category}") >= chain["cuts"][chain["categories"].index(category)]
