import random
import re

from pyspark.sql import functions as F

from spendlens.llm import ngram_join, queries
from spendlens.llm._graph import connected_components
from tests.conftest import SF_SMALL
from tests.llm.util import ODD_TEXTS, docs_frame


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [grams(t) for t in texts]
    by_gram = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    n_links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in by_gram[g] if j < i}:
            inter = len(s & sets[j])
            if inter * 5 >= 4 * (len(s) + len(sets[j]) - inter):
                n_links[i] += 1
                n_links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(frozenset(s), i)
    return [(first[frozenset(s)] if s else i, n_links[i], find(i)) for i, s in enumerate(sets)]


def texts():
    rnd = random.Random(2)
    bases = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([6, 30, 120, 300]))] for _ in range(12)]
    out = list(ODD_TEXTS)
    for _ in range(300):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 8])):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 50)}"
        out.append(rnd.choice([" ", "  ", "\n"]).join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    return out


def check(rows, want):
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(want)
    for i, (cls, n, comp) in enumerate(want):
        r = got[i]
        assert (r.class_id, r.n_links, r.component_id, r.kept) == (cls, n, comp, comp == i), i


def test_equals_brute_force(spark):
    t = texts()
    docs = docs_frame(spark, t).withColumn("n", F.lit("clash")).withColumn("rep", F.lit(1)).repartition(4)
    for block in (16, 256):
        check(ngram_join.similar_groups(docs, block=block).collect(), brute(t))


def test_rows_without_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_links, r.component_id, r.kept) for r in ngram_join.similar_groups(docs).collect())
    assert got == [(-1, 0, None, True), (2, 1, 2, True), (4, 1, 2, False)]
    assert ngram_join.similar_groups(docs_frame(spark, [])).collect() == []


def test_rows_that_share_an_id(spark):
    """Every row by its own text: as many rows out as in, no link lost or doubled."""
    t = texts()
    rnd = random.Random(8)
    ids = [rnd.randrange(len(t) // 2) for _ in t]
    ids[:4] = [1, 1, 1, 1]
    rows = list(zip(ids, t)) + [(ids[3], t[3])]  # and one row twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_groups(docs, with_text_hash=True).collect()
    assert len(got) == len(rows)
    want = brute([x for _, x in rows])
    members = {}
    for i, (_, _, c) in enumerate(want):
        members.setdefault(c, []).append(i)
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    expected = []
    for i, (cls, n, comp) in enumerate(want):
        same = [j for j, w in enumerate(want) if w[0] == cls]
        words = (rows[i][1] or "").split()
        group = members[comp] if words else [i]
        first = min((rows[j][0], hashed[rows[j][1]]) for j in group)
        class_id = min(rows[j][0] for j in same) if words else rows[i][0]
        me = (rows[i][0], hashed[rows[i][1]])
        expected.append((me[0], me[1], class_id, n, first[0], me == first))
    assert sorted((r.doc_id, r.text_hash, r.class_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(expected)


def test_posterior_rule():
    rules = dict(ngram_join.least_matches(160, 16, 0.8, 1e-6))
    assert rules[16] < 0.8 * 16 and rules[160] < 0.8 * 160
    assert rules[160] / 160 > rules[16] / 16  # more values, closer to the threshold


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == list(range(len(docs)))
    check(queries.op1_ngram_join(spark, SF_SMALL).collect(), brute([d.text for d in docs]))


def test_a_chain_meets_link_by_link(spark):
    """Texts each like the next make one component, yet few of its pairs meet, each pair that
    shares a band meets once, and only those are compared."""
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(24_000)]
    chain = [" ".join(words[k : k + 200]) for k in range(0, 23_800, 12)]
    found = ngram_join.sketches(docs_frame(spark, chain), id_col="doc_id", text_col="text", n_gram=5, bands=32, rows=5).cache()
    classes = found.select("s1", F.col("id").alias("rep"), F.lit(1).alias("copies"), "size", "bands")
    members, pairs = (x.collect() for x in ngram_join.candidate_blocks(classes, 256))
    bands = {r.s1: set(r.bands) for r in found.collect()}
    holds = {}
    for r in members:
        holds.setdefault(r.block, []).append(r.s1)
    meet = [tuple(sorted((a, b))) for p in pairs for a in holds[p.lo] for b in holds[p.hi] if (p.lo < p.hi) or a < b]
    share = {(a, b) for a in bands for b in bands if a < b and bands[a] & bands[b]}
    assert len(meet) == len(set(meet)) and share <= set(meet)
    assert len(meet) < 8 * len(share) and len(meet) < len(chain) ** 2 / 50
    got = ngram_join.similar_groups(docs_frame(spark, chain)).collect()
    check(got, brute(chain))
    assert len({r.component_id for r in got}) < 20


def test_pairs_that_share_a_band():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 6, (40, 2)).astype(np.uint64)
    left, right = np.arange(25), np.arange(25, 40)
    for a, b in ((left, right), (left, left)):
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if (keys[a[i]] == keys[b[j]]).any() and (a is not b or i < j)}
        assert set(zip(*(x.tolist() for x in ngram_join.band_pairs(keys, a, b)))) == want
