"""Near-duplicates of embeddings by a robust-pruned flat graph.

Vectors go to their nearest few cluster centres, so shards overlap. Each shard builds a
graph: near candidates, pruned so that a kept neighbour covers those close to it. The
adjacency lists of a vector from all its shards are united. The search for a vector runs in
the shard of its nearest centre, on the united lists: over the shard's members and over
those near neighbours of its vectors that lie in other shards. It goes greedily from the medoid
of every connected part towards the vector, then outwards from all vectors within the
threshold less a slack until none is new. What it has found is verified by cosine in double
precision and is the result; nothing else is compared. Similar vectors search together: a
vector that one of a block reaches is held against all of the block.

A shard with many members is dealt into parts by hash, each with a graph of its own; its
vectors search all parts, a part and some of the vectors in a task. The recall is audited
against brute force on a sample: shards overlap more until it is reached.

Equal vectors take part once. Searches return each vector's number of links and the smallest
id that its links connect it to there, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ._bytes import ragged
from ._graph import connected_components

THRESHOLD = 0.95
SHARD = 500  # vectors per cluster centre, about
MAX_CENTRES = 1 << 14  # the centres are a sample of this bound at most, and are broadcast
PART = 2500  # vectors of a part of a shard, and vectors that search it in one task, about
OVERLAP = (3, 6)  # centres per vector; the next is tried if the audit finds too little, see _widths
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
SLACK = 0.07  # the search expands vectors this much below the threshold
BEAM = 8  # nearest vectors of each searching one that the greedy search goes on from
TOGETHER = 64  # vectors that search together
AUDIT_QUERIES, RECALL = 1000, 0.9  # so many of all vectors, and so many of those with links


def usable(column):
    """No null, and finite; a zero vector is left out by its norm."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(column, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.coalesce(column.isNotNull() & ~bad & (norm > 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pruned_neighbours(x: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbour numbers, -1 where there are fewer: of the nearest candidates, one
    is kept unless a kept one is ALPHA times closer to it than the vector itself is."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int32)
    if k < 1:
        return out
    for a in range(0, n, 512):
        z = min(n, a + 512)
        sim = x[a:z] @ x.T
        sim[np.arange(z - a), np.arange(a, z)] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        away = 1 - np.take_along_axis(sim, near, 1)
        vectors = x[near]
        between = 1 - np.einsum("ikd,ild->ikl", vectors, vectors)
        alive = np.ones(near.shape, bool)
        filled = np.zeros(z - a, np.int64)
        for c in range(k):
            take = alive[:, c] & (filled < DEGREE)
            rows = np.nonzero(take)[0]
            out[a + rows, filled[rows]] = near[rows, c]
            filled[rows] += 1
            alive[rows] &= ~(ALPHA * between[rows, c] <= away[rows])
    return out


def _undirected(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, neighbours) of the graph of (n, degree) neighbour numbers (-1: none), in both
    directions."""
    n = len(links)
    a, k = np.nonzero(links >= 0)
    b = links[a, k]
    pairs = np.unique(np.concatenate([a * np.int64(n) + b, b * np.int64(n) + a]))
    a, b = np.divmod(pairs, np.int64(max(1, n)))
    return np.searchsorted(a, np.arange(n + 1)), b


def medoids(x: np.ndarray, bounds: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean of each connected part of the graph."""
    n = len(x)
    part = np.arange(n)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    while len(owner):
        new = part.copy()
        np.minimum.at(new, owner, part[neighbours])
        new = new[new]
        if (new == part).all():
            break
        part = new
    _, part = np.unique(part, return_inverse=True)
    mean = np.zeros((int(part.max()) + 1, x.shape[1]))
    np.add.at(mean, part, x)
    near = np.einsum("id,id->i", x, mean[part])
    order = np.lexsort((-near, part))
    return order[np.searchsorted(part[order], np.arange(len(mean)))]


def search_in_range(x, bounds, neighbours, starts, queries, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes seen, (queries, nodes) cosines): greedy from ``starts`` towards each query, then
    outwards through all nodes within the threshold less SLACK of a query."""
    seen, expanded = np.zeros(len(x), bool), np.zeros(len(x), bool)
    nodes, cosines = np.zeros(0, np.int64), np.zeros((len(queries), 0))

    def look(new):
        nonlocal nodes, cosines
        new = np.unique(new[~seen[new]])
        seen[new] = True
        nodes = np.concatenate([nodes, new])
        cosines = np.concatenate([cosines, queries @ x[new].T], axis=1)

    def expand(some):
        expanded[some] = True
        look(neighbours[ragged(bounds[some], bounds[some + 1] - bounds[some])])

    look(starts)
    while True:
        k = min(BEAM, len(nodes))
        best = np.unique(nodes[np.argpartition(-cosines, k - 1, axis=1)[:, :k]])
        best = best[~expanded[best]]
        if not len(best):
            break
        expand(best)
    while True:
        near = nodes[(cosines >= threshold - SLACK).any(axis=0)]
        near = near[~expanded[near]]
        if not len(near):
            return nodes, cosines
        expand(near)


def _verified(cosines, queries, x, nodes, threshold: float) -> np.ndarray:
    """Whether each cosine reaches the threshold; close to it the same for (u, v) and (v, u)."""
    hit = cosines >= threshold
    a, b = np.nonzero(np.abs(cosines - threshold) < 1e-9)
    hit[a, b] = np.einsum("id,id->i", queries[a], x[nodes[b]]) >= threshold
    return hit


def found_links(x, copies, rep, links, queries, query_rep, threshold: float):
    """(linked rows of each query, smallest rep that the links connect each node to, the same
    for each query); ``links`` are neighbour numbers of the nodes."""
    bounds, neighbours = _undirected(links)
    starts = medoids(x, bounds, neighbours)
    n = np.zeros(len(queries), np.int64)
    label = rep.copy()
    own = query_rep.copy()
    pivots = queries[:: max(1, len(queries) // TOGETHER)]
    order = np.lexsort((query_rep, (queries @ pivots.T).argmax(axis=1)))  # similar ones together
    for a in range(0, len(order), TOGETHER):
        some = order[a : a + TOGETHER]
        nodes, cosines = search_in_range(x, bounds, neighbours, starts, queries[some], threshold)
        hit = _verified(cosines, queries[some], x, nodes, threshold)
        hit &= query_rep[some][:, None] != rep[nodes]
        n[some] = hit @ copies[nodes]
        for i in np.flatnonzero(hit.any(axis=1)):
            mine = nodes[hit[i]]
            groups = np.unique(np.append(label[mine], own[some[i]]))
            if len(groups) > 1:  # the groups that this query's links join
                label[np.isin(label, groups)] = groups[0]
                own[np.isin(own, groups)] = groups[0]
    return n, label, own


def _apart(x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of x, first come first kept, of which no two have a larger cosine."""
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            out.append(i)
            free[i + 1 :] &= x[i + 1 :] @ x[i] <= cosine
    return x[out]


def _centres(vectors: DataFrame, n: int, size: int, threshold: float) -> np.ndarray:
    """A sample by hash, without those that another links with: a group of near copies has few
    centres, however many of it the sample holds, and a narrow cone of others keeps its own."""
    want = max(1, min(MAX_CENTRES, -(-n // size)))
    part = vectors.where(F.pmod(F.xxhash64("rep", F.lit("centre")), F.lit(1 << 20)) < min(1 << 20, -(-(1 << 20) * 2 * want // n)))
    rows = part.orderBy(F.xxhash64("rep", F.lit("centre")), "rep").limit(want).select("v").toArrow()
    return _apart(_unit(_matrix(rows.column("v"))), threshold)


def _widths(overlap: tuple[int, ...], most: int):
    """Centres per vector to try: the given ones, then the last doubled, and at last all."""
    yield from (w for w in overlap if w < most)
    width = 2 * max(1, *overlap) if overlap else 1
    while width < most:
        yield width
        width *= 2
    yield most


def _numbers(lists: pa.Array, rep: np.ndarray) -> np.ndarray:
    """(rows, degree) places in the ascending ``rep`` of the ids listed, -1 where not in it."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    to = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(rep, to), len(rep) - 1)
    inside = rep[at] == to
    owner, at = owner[inside], at[inside]
    size = np.bincount(owner, minlength=len(lists))
    out = np.full((len(lists), max(1, int(size.max(initial=0)))), -1, np.int64)
    out[owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = at
    return out


def _linked(vectors: DataFrame, centres: np.ndarray, overlap: int, threshold: float, part: int = PART) -> DataFrame:
    """(u, n, v) of each vector with links: rep, linked rows, smallest rep connected to it; also
    (u, 0, v) for what others link with. The n of a rep add up."""
    shared, overlap = vectors.sparkSession.sparkContext.broadcast(centres), min(overlap, len(centres))

    def assign(batches):
        for batch in batches:
            sim = _unit(_matrix(batch.column("v"))) @ shared.value.T
            near = np.argpartition(-sim, overlap - 1, axis=1)[:, :overlap] if len(sim) else np.zeros((0, overlap), int)
            home = sim.argmax(axis=1).astype(np.int32) if len(sim) else np.zeros(0, np.int32)
            ends = pa.array(np.arange(len(near) + 1) * overlap, pa.int32())
            shards = pa.ListArray.from_arrays(ends, pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), shards], [*batch.schema.names, "home", "shards"])

    kind = vectors.schema["v"].dataType.simpleString()
    placed = checkpointed(vectors.mapInArrow(assign, f"rep long, copies long, v {kind}, home int, shards array<int>"))
    members = placed.select("rep", "copies", "v", F.explode("shards").alias("shard"))
    parts = members.groupBy("shard").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    slices = placed.groupBy(F.col("home").alias("shard")).agg(F.ceil(F.count("*") / part).cast("int").alias("slices"))
    layout = F.broadcast(checkpointed(parts.join(slices, "shard")))  # a row per centre at most
    members = members.join(layout, "shard", "left").withColumn("part", F.pmod(F.xxhash64("rep", "shard"), F.coalesce("parts", F.lit(1))).cast("int"))

    def build(table):
        rep, x = table.column("rep").to_numpy(), _unit(_matrix(table.column("v")))
        links = pruned_neighbours(x)
        near = np.full(links.shape, -1, links.dtype)  # those that a range search goes on from
        a, k = np.nonzero(links >= 0)
        within = np.einsum("id,id->i", x[a], x[links[a, k]]) >= threshold - SLACK
        near[a[within], k[within]] = links[a[within], k[within]]
        lists = {n: pa.array([rep[row[row >= 0]] for row in m], pa.list_(pa.int64())) for n, m in (("links", links), ("near", near))}
        return pa.table({"rep": rep, **lists})

    graph = members.select("shard", "part", "rep", "v").groupBy("shard", "part")
    graph = graph.applyInArrow(build, "rep long, links array<long>, near array<long>")
    both = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("links", "near")]
    union = checkpointed(graph.groupBy("rep").agg(*both))

    # What searches: every vector, in all parts of its home shard. What is searched: the part's
    # members, and with the first part those neighbours from elsewhere that are within range
    # less the slack of a vector that searches (a search does not go on from others).
    known = placed.join(union, "rep", "left")
    queries = known.select("rep", "v", "near", F.col("home").alias("shard")).join(layout, "shard")
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("rep", F.lit("slice")), F.col("slices")).cast("int"))
    outside = queries.select("shard", "slice", F.explode("near").alias("rep")).distinct()
    outside = outside.join(known, "rep").where(~F.array_contains("shards", F.col("shard")))
    columns = ["shard", "part", "slice", "rep", "copies", "v", "links"]
    nodes = members.where(F.col("slices").isNotNull()).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    nodes = nodes.join(union, "rep", "left").select(*columns)
    nodes = nodes.unionAll(outside.withColumn("part", F.lit(0)).select(*columns))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = queries.select(*[F.col(c).alias(c) for c in ("shard", "part", "slice", "rep", "v")])  # apart from the nodes' columns

    def search(table, asked):
        if not table.num_rows or not asked.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in "unv"})
        table = table.take(pa.array(np.argsort(table.column("rep").to_numpy())))
        rep, copies, x = table.column("rep").to_numpy(), table.column("copies").to_numpy(), _unit(_matrix(table.column("v")))
        lists = table.column("links").combine_chunks()
        query_rep, q = asked.column("rep").to_numpy(), _unit(_matrix(asked.column("v")))
        n, label, own = found_links(x, copies, rep, _numbers(lists, rep), q, query_rep, threshold)
        has, joined = np.flatnonzero((n > 0) | (own < query_rep)), np.flatnonzero(label < rep)
        u = np.concatenate([query_rep[has], rep[joined]])
        return pa.table({"u": u, "n": np.concatenate([n[has], np.zeros(len(joined), np.int64)]), "v": np.concatenate([own[has], label[joined]])})

    keys = ["shard", "part", "slice"]
    return checkpointed(nodes.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "u long, n long, v long"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float, queries: int) -> float:
    """Share of the true links of sampled vectors that were found, the smaller of two: of a
    sample of all vectors, and of a sample of those that have links (1.0 for a sample without
    any). The samples are of fixed size; their vectors are held against all rows."""
    some = links.select(F.col("u").alias("rep")).distinct().orderBy(F.xxhash64("rep", F.lit("linked"))).limit(queries)
    some = vectors.join(F.broadcast(some), "rep").select("rep", "v").toArrow()
    anyone = vectors.orderBy(F.xxhash64("rep", F.lit("audit"))).limit(queries).select("rep", "v").toArrow()
    rep = np.concatenate([anyone.column("rep").to_numpy(), some.column("rep").to_numpy()])
    x = np.concatenate([_unit(_matrix(t.column("v"))) for t in (anyone, some) if t.num_rows])
    shared = vectors.sparkSession.sparkContext.broadcast((rep, x))

    def count(batches):
        ids, x = shared.value
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            mine, copies, y = batch.column("rep").to_numpy(), batch.column("copies").to_numpy(), _unit(_matrix(batch.column("v")))
            for a in range(0, len(mine), 1024):
                hit = y[a : a + 1024] @ x.T >= threshold
                hit &= mine[a : a + 1024, None] != ids
                n += copies[a : a + 1024] @ hit
        has = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(n[has], pa.int64())], ["k", "n"])

    true = np.zeros(len(rep), np.int64)
    for k, n in vectors.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        true[k] = n
    of = links.where(F.col("u").isin(np.unique(rep).tolist())).groupBy("u").agg(F.sum("n").alias("n")).collect()
    of = {r.u: r.n for r in of}
    found = np.array([of.get(r, 0) for r in rep.tolist()], np.int64)
    parts = slice(0, anyone.num_rows), slice(anyone.num_rows, None)
    return min(found[p].sum() / true[p].sum() if true[p].any() else 1.0 for p in parts)


def near_duplicates(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    shard: int = SHARD,
    overlap: tuple[int, ...] = OVERLAP,
    min_recall: float = RECALL,
    part: int = PART,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links counts the links that the vector's own search found. Vectors that are null, zero,
    or hold null or non-finite components link with nothing, as do rows without id and vectors
    of another length than most have (of equally frequent lengths: than the smallest); each is
    its own component. Equal vectors link. Rows that share an id count each as a row. Other
    columns are not read. Raises if the audit fails even where every shard holds all vectors.
    """
    column = F.col(f"`{vector_col}`")
    table = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), column.alias("v"))
    good = table.where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = good.groupBy(F.size("v").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    length = lengths["length"] if lengths else 0
    good = good.where(F.size("v") == length)
    classes = checkpointed(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "v"))
    n = classes.count()
    links = None
    if n:
        centres, recalls = _centres(classes, n, shard, threshold), {}
        for width in _widths(overlap, len(centres)):
            links = _linked(classes, centres, width, threshold, part)
            recalls[width] = audit(classes, links, threshold, AUDIT_QUERIES)
            if recalls[width] >= min_recall:
                break
        else:
            raise RuntimeError(f"recall below {min_recall} at every overlap: {recalls}")
    of_class = classes
    if links is None:
        of_class = of_class.withColumn("n", F.lit(0).cast("long")).withColumn("component", F.col("rep"))
    else:
        counts = links.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
        joined = connected_components(links.select("u", "v")).select(F.col("u").alias("rep"), F.col("v").alias("component"))
        of_class = classes.join(counts, "rep", "left").join(joined, "rep", "left")
    of_class = of_class.select(
        "v",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    of_rows = good.join(of_class, "v").select("id", "n_links", "component_id").distinct()
    out = rows.select(F.col(f"`{id_col}`"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(usable(column) & (F.size(column) == length), F.lit(False)).alias("ok")).join(of_rows, "id", "left")
    n_links = F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    component = F.when(F.col("ok"), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(
        F.col(f"`{id_col}`"),
        n_links.alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
