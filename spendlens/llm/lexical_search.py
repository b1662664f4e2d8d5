"""Ranked lexical search with range-maximum sparse tables over posting lists.

Statistics of the query terms are counted over all documents first. Then every task cuts its
documents into shards, and a shard holds, for each query term, the documents with the term
and the term's impact in them, with a sparse table that answers which of any stretch of that
list has the greatest impact. A query is answered best-first over document intervals: the
bound of an interval is the sum of its terms' greatest impacts there; the interval with the
greatest bound is split at the document that holds the greatest of them, which is scored
exactly, and the two parts are bounded anew. Once no interval can beat the k-th best score,
the shard is done; scores carry over from shard to shard of a task. A few of the best
intervals of many queries are split at a time, in NumPy. Tasks return their k best per query,
and a window keeps the k best of all.

Scores are 64-bit integers, so results do not depend on the order of sums or partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bytes import bounded_batches, column_bytes, ragged, row_chunks
from ._words import word_dictionary, word_spans

TOP = 10
BLOCK_BYTES = 8 << 20  # text of the queries that are broadcast at a time
SHARD_POSTINGS = 400_000  # postings of one shard, about
GROUP = 64  # queries that are searched together
WIDTH = 8  # intervals of a query that are split at a time, at first

_code = np.arange(256)
_is_upper = (_code >= 65) & (_code <= 90)
IS_TERM = (_code >= 128) | ((_code >= 48) & (_code <= 57)) | _is_upper | ((_code >= 97) & (_code <= 122))
_lower = np.where(_is_upper, _code + 32, _code).astype(np.uint8)


def term_weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Share of its length that counts against a document of ``n`` terms, in hundredths."""
    return 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)


def impacts(weight: np.ndarray, tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences of a term add to a document's score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * factor))


def chunk_terms(data: np.ndarray, offsets: np.ndarray, vocabulary: pa.Array):
    """(terms per row, then row, vocabulary number and occurrences of every query term)."""
    data = _lower[data]
    starts, ends, bounds = word_spans(data, offsets, IS_TERM[data])
    size = np.diff(bounds)
    ids, words = word_dictionary(data, starts, ends)
    number = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    number = number[ids] if len(ids) else np.zeros(0, np.int64)
    known = number >= 0
    key = np.repeat(np.arange(len(size)), size)[known] * np.int64(max(1, len(vocabulary))) + number[known]
    key, tf = np.unique(key, return_counts=True)
    row, term = np.divmod(key, np.int64(max(1, len(vocabulary))))
    return size, row, term, tf


class Queries:
    """A block of queries: ids, vocabulary (sorted distinct terms) and the terms of each."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        data, offsets = column_bytes(texts)
        data = _lower[data]
        starts, ends, bounds = word_spans(data, offsets, IS_TERM[data])
        numbers, words = word_dictionary(data, starts, ends)
        self.ids, self.vocabulary = ids, words
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        pairs = np.unique(row * np.int64(max(1, len(words))) + numbers)
        row, self.terms = np.divmod(pairs, np.int64(max(1, len(words))))
        self.bounds = np.searchsorted(row, np.arange(len(ids) + 1))


class Shard:
    """Posting lists of some documents, in document order, with sparse tables of their maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.key = term[order] * np.int64(n_docs) + self.doc
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        longest = int(np.diff(self.bounds).max()) if n_terms else 0
        n = len(doc)
        self.log = np.zeros(longest + 2, np.int8)  # floor of the binary logarithm
        for j in range(1, longest.bit_length()):
            self.log[1 << j :] = j
        self.best = np.empty((max(1, longest.bit_length()), n), np.int32)
        self.best[0] = np.arange(n)
        for j in range(1, len(self.best)):
            half = 1 << (j - 1)
            self.best[j] = self.best[j - 1]
            a, b = self.best[j - 1, : n - half], self.best[j - 1, half:]
            self.best[j, : n - half] = np.where(self.impact[a] >= self.impact[b], a, b)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the greatest impacts of the non-empty stretches [lo, hi) of a list."""
        level = self.log[hi - lo]
        a, b = self.best[level, lo], self.best[level, hi - (1 << level.astype(np.int64))]
        return np.where(self.impact[a] >= self.impact[b], a, b)


class Best:
    """The k best (score, id) of each query so far; equal scores by id, no id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score, self.id, self.missing = self.query.copy(), self.query.copy(), np.zeros(0, bool)
        self.least = np.zeros(n, np.int64)  # k-th score; 0 while there are fewer
        self.last_id = np.full(n, np.iinfo(np.int64).max)  # id that has it

    def add(self, query, score, ids, missing) -> None:
        """Take candidates in, those that can't be among the k best left out."""
        go = (score > self.least[query]) | ((score > 0) & (score == self.least[query]) & (ids <= self.last_id[query]))
        if not go.any():
            return
        query, score, ids, missing = (
            np.concatenate([old, new[go]])
            for old, new in ((self.query, query), (self.score, score), (self.id, ids), (self.missing, missing))
        )
        order = np.lexsort((missing, ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        order = order[kept]
        self.query, self.score, self.id, self.missing = query[kept], score[order], ids[order], missing[order]
        full = rank[kept] == self.k - 1
        self.least[self.query[full]] = self.score[full]
        self.last_id[self.query[full]] = self.id[full]


def search(shard: Shard, ids: np.ndarray, missing: np.ndarray, queries: Queries, first: int, last: int, best: Best) -> int:
    """Put the best documents of the shard for the queries first to last into ``best``; its
    documents are in order of ``ids``. Returns the number of documents scored."""
    size = queries.bounds[first + 1 : last + 1] - queries.bounds[first:last]
    query = np.arange(first, last)
    term = queries.terms[queries.bounds[first] : queries.bounds[last]]
    # pool: the non-empty stretches of posting lists of all intervals; an interval is a slice of it
    owner = np.repeat(np.arange(len(query)), size)
    lo, hi = shard.bounds[term], shard.bounds[term + 1]
    pools: list[tuple] = []
    used = 0

    def intervals(owner, term, lo, hi, query, begin):
        """Bounded intervals of the stretches; those without any are gone."""
        nonlocal used
        some = hi > lo
        owner, term, lo, hi = owner[some], term[some], lo[some], hi[some]
        top = shard.maxima(lo, hi) if len(lo) else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        bound = np.add.reduceat(shard.impact[top], starts) if len(starts) else np.zeros(0, np.int64)
        which = owner[starts]
        pools.append((term, lo, hi, top))
        at = used + starts
        used += len(term)
        return np.stack([query[which], begin[which], bound, at, np.diff(np.append(starts, len(term)))])

    open_ = intervals(owner, term, lo, hi, query, np.zeros(len(query), np.int64))
    scored, width = 0, WIDTH
    while True:
        q, begin, bound = open_[0], open_[1], open_[2]
        least = best.least[q]
        can = (bound > least) | ((bound > 0) & (bound == least) & (ids[np.minimum(begin, len(ids) - 1)] <= best.last_id[q]))
        open_ = open_[:, can]
        if not open_.shape[1]:
            return scored
        order = np.lexsort((-open_[2], open_[0]))
        open_ = open_[:, order]
        rank = np.arange(open_.shape[1]) - np.searchsorted(open_[0], open_[0])
        now, open_ = open_[:, rank < width], open_[:, rank >= width]
        width = min(2 * width, 8 * WIDTH)
        if len(pools) > 1:
            pools[:] = [tuple(np.concatenate(part) for part in zip(*pools))]
        if used > 4 * (int(open_[4].sum()) + int(now[4].sum())) + 100_000:  # most of the pool is done with
            both = np.concatenate([now, open_], axis=1)
            alive = ragged(both[3], both[4])
            pools[:] = [tuple(part[alive] for part in pools[0])]
            used = len(alive)
            both[3] = np.cumsum(both[4]) - both[4]
            now, open_ = both[:, : now.shape[1]], both[:, now.shape[1] :]
        at = ragged(now[3], now[4])
        term, lo, hi, top = (part[at] for part in pools[0])
        starts = np.cumsum(now[4]) - now[4]
        owner = np.repeat(np.arange(now.shape[1]), now[4])
        value = shard.impact[top]
        greatest = np.flatnonzero(value == np.maximum.reduceat(value, starts)[owner])
        middle = shard.doc[top[greatest[np.searchsorted(owner[greatest], np.arange(now.shape[1]))]]].astype(np.int64)
        key = term * np.int64(shard.n_docs) + middle[owner]
        place = np.searchsorted(shard.key, key)
        has = shard.key[np.minimum(place, len(shard.key) - 1)] == key
        score = np.add.reduceat(np.where(has, shard.impact[np.minimum(place, len(shard.key) - 1)], 0), starts)
        scored += len(score)
        best.add(now[0], score, ids[middle], missing[middle])
        open_ = np.concatenate(
            [
                open_,
                intervals(owner, term, lo, place, now[0], now[1]),
                intervals(owner, term, place + has, hi, now[0], middle + 1),
            ],
            axis=1,
        )


def query_blocks(queries: DataFrame, *, id_col: str, text_col: str, block_bytes: int):
    """Blocks of distinct (id, text) queries of about ``block_bytes`` of text, one at a time."""
    rows = queries.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where(F.octet_length("text") > 0).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        yield Queries(*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in part.columns))


def count_terms(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all, documents with each vocabulary term) of docs (text)."""

    def count(batches):
        vocabulary = shared.value.vocabulary
        df = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for lo, hi in row_chunks(offsets):
                size, _, term, _ = chunk_terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], vocabulary)
                df += np.bincount(term, minlength=len(df))
                df[-2:] += ((size > 0).sum(), size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

    sums = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(shared.value.vocabulary) + 2, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return int(df[-2]), int(df[-1]), df[:-2]


def top_documents(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(query id, rank, document id as long, score) of each query's ``k`` best documents with
    a score above 0, ranks from 1; equal scores by ascending document id, no id last.

    Terms are runs of ASCII letters and digits and non-ASCII characters; only A-Z is
    lower-cased. Null, empty and termless texts have no terms and rank nowhere. Every row of
    ``docs`` is a document, also where ids or texts repeat. Queries of equal id and text are
    one; queries that share an id with different texts are ranked each for itself; a null
    query id is an id like any other. Queries or documents without rows give no rows. Other
    columns are not read. Queries beyond ``block_bytes`` of text pass over the documents
    block by block, so what is broadcast is bounded.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    bounded_batches(docs)
    spark = docs.sparkSession
    body = F.col(f"`{text_col}`").cast("string").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), body)
    kind = queries.schema[query_id_col].dataType.simpleString()
    out = None
    blocks = query_blocks(queries, id_col=query_id_col, text_col=query_text_col, block_bytes=block_bytes)
    for number, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        n_docs, n_terms, df = count_terms(docs.select(body), shared)
        weight = spark.sparkContext.broadcast(np.array([term_weight(n_docs, int(d)) for d in df], np.int64))

        def run(batches, shared=shared, weight=weight, n_docs=n_docs, n_terms=n_terms):
            queries, weights = shared.value, weight.value
            best = Best(len(queries.ids), k)
            held: list[tuple] = []

            def search_held():
                ids, missing, sizes, row, term, tf = (np.concatenate(part) for part in zip(*held))
                held.clear()
                some, row = np.unique(row, return_inverse=True)  # documents without query terms go
                if not len(some):
                    return
                ids, missing, sizes = ids[some], missing[some], sizes[some]
                order = np.lexsort((missing, ids))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                impact = impacts(weights[term], tf, length_factor(sizes, n_docs, n_terms)[row])
                shard = Shard(place[row], term, impact, len(order), len(weights))
                for first in range(0, len(queries.ids), GROUP):
                    search(shard, ids[order], missing[order], queries, first, min(first + GROUP, len(queries.ids)), best)

            n_held = n_rows = 0
            for batch in batches:
                data, offsets = column_bytes(batch.column(1))
                missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
                for lo, hi in row_chunks(offsets):
                    part = chunk_terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], queries.vocabulary)
                    size, row, term, tf = part
                    held.append((ids[lo:hi], missing[lo:hi], size, row + n_rows, term, tf))
                    n_held, n_rows = n_held + len(term), n_rows + hi - lo
                    if n_held >= shard_postings:
                        search_held()
                        n_held = n_rows = 0
            if held:
                search_held()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(best.query),
                    queries.ids.take(pa.array(best.query)),
                    pa.array(best.id, mask=best.missing),
                    pa.array(best.score),
                ],
                ["query", "query_id", "doc", "score"],
            )

        found = rows.mapInArrow(run, f"query long, query_id {kind}, doc long, score long").withColumn("block", F.lit(number))
        out = found if out is None else out.unionAll(found)
    order = W.partitionBy("block", "query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id_col), "rank", F.col("doc").alias(id_col), "score")
