"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees of a small forest give conjunctive rules (paths of threshold tests); a lasso logistic
regression weighs them and drops most. What is left is compiled into one Spark column
expression, so scoring needs only the statistics of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ._bytes import column_bytes, row_chunks, with_text_columns
from .ngram_join import word_hashes

MAX_TRAIN_DOCS = 20_000
TREES, DEPTH, LASSO = 15, 4, 0.002

STATISTICS = (
    "log_bytes",
    "log_words",
    "word_length",
    "letters",
    "capitals",
    "digits",
    "spaces",
    "stops",
    "symbols",
    "line_breaks",
    "distinct_words",
    "top_word",
    "word_repeats",
    "symbol_words",
)

_code = np.arange(256)
_upper = (_code >= 65) & (_code <= 90)
_letter = _upper | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
_digit = (_code >= 48) & (_code <= 57)
_space = (_code == 32) | ((_code >= 9) & (_code <= 13))
_stop = np.isin(_code, [33, 44, 46, 63])  # ! , . ?
_symbol = ~(_letter | _digit | _space | _stop)
_classes = np.stack([_letter, _upper, _digit, _space, _stop, _symbol, _code == 10]).astype(np.uint8)


def chunk_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, statistics) of UTF-8 texts; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    size = np.diff(offsets)
    words, starts, ends, bounds = word_hashes(data, offsets, lower=True)
    n_words = np.diff(bounds)

    def share(x, of):
        return x / np.maximum(of, 1)

    def sums(flags, at):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    letters, upper, digits, spaces, stops, symbols, lines = (sums(c[data], offsets) for c in _classes)
    row = np.repeat(np.arange(n), n_words)
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    head = np.nonzero(new)[0]
    often = np.zeros(n, np.int64)
    np.maximum.at(often, r[head], np.diff(np.append(head, len(w))))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    symbol_total = np.concatenate([[0], np.cumsum(_symbol[data])])
    with_symbol = symbol_total[ends] > symbol_total[starts]
    columns = (
        np.log1p(size),
        np.log1p(n_words),
        share(size - spaces, n_words),
        share(letters, size),
        share(upper, letters),
        share(digits, size),
        share(spaces, size),
        share(stops, n_words),
        share(symbols, size),
        share(lines, n_words),
        share(sums(new, np.searchsorted(r, np.arange(n + 1))), n_words),
        share(often, n_words),
        share(sums(again, bounds), n_words),
        share(sums(with_symbol, bounds), n_words),
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


def statistics(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and one double per statistic (prefixed ``s_``); null is empty."""

    def run(column):
        data, offsets = column_bytes(column)
        parts = [
            chunk_statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_chunks(offsets)
        ]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return [pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS))]

    return with_text_columns(docs, text_col, keep, [(f"s_{s}", "double") for s in STATISTICS], run)


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above the threshold, threshold), all to hold


def tree_rules(model) -> list[Rule]:
    """The paths from each root to each other node, as rules in a plain form, without repeats."""
    found: dict[Rule, None] = {}

    def walk(node, path):
        if path:
            bounds = {}
            for name, above, at in path:  # repeated tests of one statistic: the narrower holds
                old = bounds.get((name, above))
                bounds[name, above] = at if old is None else (max if above else min)(old, at)
            found[tuple(sorted((name, above, at) for (name, above), at in bounds.items()))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
        walk(node.leftChild(), [*path, (name, False, at)])
        walk(node.rightChild(), [*path, (name, True, at)])

    for tree in model.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


def rule_column(rule: Rule) -> Column:
    tests = [F.col(f"s_{name}") > at if above else F.col(f"s_{name}") <= at for name, above, at in rule]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def score_column(model: dict) -> Column:
    """Probability of label 1, from the statistics' columns."""
    z = F.lit(float(model["intercept"]))
    for rule, weight in model["rules"]:
        z = z + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column, columns: list[str], id_col: str, max_docs: int) -> DataFrame:
    """The documents of at most about ``max_docs`` labelled rows that ``use`` allows, with the
    label ``columns``. The sampled labels are few, so they are broadcast. Of several labels for
    one id the greatest counts, column by column."""
    some = labels.where(use & F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(c).alias(c) for c in columns])
    for c in columns:
        some = some.where(F.col(c).isNotNull())
    total = some.count()
    if total > max_docs:
        some = some.where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * max_docs / total))
    clean = docs.select(*[c for c in docs.columns if c not in columns])
    return clean.join(F.broadcast(some), id_col)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = MAX_TRAIN_DOCS,
    trees: int = TREES,
    depth: int = DEPTH,
    lasso: float = LASSO,
) -> dict:
    """Learn {"rules": [(rule, weight)], "intercept"} from labelled rows that ``use`` allows,
    at most about ``max_docs`` of them. With one label value only, that value is the answer;
    with no labelled rows the score is one half."""
    rows = labelled_sample(docs.select(id_col, text_col), labels, use, [label_col], id_col, max_docs)
    table = checkpointed(statistics(rows, text_col=text_col, keep=(label_col,)).withColumn("label", F.col(label_col).cast("double")))
    seen = {r.label: r.n for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return {"rules": [], "intercept": 0.0 if not seen else (20.0 if next(iter(seen)) > 0.5 else -20.0)}
    data = VectorAssembler(inputCols=[f"s_{s}" for s in STATISTICS], outputCol="features").transform(table).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=5, featureSubsetStrategy="0.5").fit(data)
    rules = tree_rules(forest)
    if not rules:
        rate = seen.get(1.0, 0) / sum(seen.values())
        return {"rules": [], "intercept": float(np.log(rate / (1 - rate)))}
    held = table.select("label", *[rule_column(rule).cast("double").alias(f"r{k}") for k, rule in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(held)
    weights = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100).fit(checkpointed(held.select("features", "label")))
    kept = [(rule, w) for rule, w in zip(rules, weights.coefficients.toArray()) if w]
    return {"rules": kept, "intercept": weights.intercept}


def score(docs: DataFrame, model: dict, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and score (0 to 1) of every row. Null and empty texts have
    statistics of zero and a score like any other; repeated rows repeat."""
    table = statistics(docs, text_col=text_col, keep=keep)
    return table.select(*[F.col(f"`{c}`") for c in keep], score_column(model).alias("score"))


def is_held_out(id_col: str = "doc_id") -> Column:
    """The rows whose crc32 of the id as text is 0 modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
