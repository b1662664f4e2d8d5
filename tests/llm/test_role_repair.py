import random

from pyspark.sql import functions as F

from spendlens.llm import queries, role_repair as rr
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_cost(roles):
    """Cheapest repair by search over (turns used, state), one elementary step at a time."""
    import heapq

    heap, seen = [(0, 0, rr.START)], set()
    while heap:
        cost, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s in rr.ENDS:
            return cost
        for n in rr.NEXT[s]:
            heapq.heappush(heap, (cost + rr.INSERT, i, n))
        if i < len(roles):
            given = roles[i]
            change = lambda r: 0 if r == given else rr.UNKNOWN if given is None else rr.RELABEL
            for n in rr.NEXT[s]:
                heapq.heappush(heap, (cost + change(n), i + 1, n))
            if s != rr.START:
                heapq.heappush(heap, (cost + change(s) + rr.MERGE, i + 1, s))
    raise AssertionError


def legal(rendered):
    state = rr.START
    for line in rendered.split("\n"):
        if line.startswith("<|"):
            new = rr.ROLES[line[2:-2]]
            assert new in rr.NEXT[state]
            state = new
    assert state in rr.ENDS


def test_cheapest_and_legal(spark):
    rnd = random.Random(1)
    names = ["user", "assistant", "system", None, "tool", " User "]
    convs = [[rnd.choice(names) for _ in range(rnd.randint(1, 12))] for _ in range(150)]
    rows = [(c, t, r, f"text{t}") for c, conv in enumerate(convs) for t, r in enumerate(conv)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).repartition(3)
    whole = {r.conv_id: r for r in rr.format_chats(frame).collect()}
    cut = {}
    for r in sorted(rr.format_chats(frame, part_turns=3).collect(), key=lambda r: (r.conv_id, r.part)):
        old = cut.setdefault(r.conv_id, [0, ""])
        old[0] += r.cost
        old[1] += r.rendered
    assert len(whole) == len(convs)
    for c, conv in enumerate(convs):
        want = brute_cost([rr._role(r) for r in conv])
        r = whole[c]
        assert r.cost == want == cut[c][0]
        assert r.cost >= r.n_merged * rr.MERGE + r.n_inserted * rr.INSERT
        for text in (r.rendered, cut[c][1]):
            legal(text)
            assert [x for x in text.split("\n") if x.startswith("text")] == [f"text{t}" for t in range(len(conv))]


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 1, None, None), (1, None, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, 5, "system", "s")]
    got = rr.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.conv_id: r.rendered for r in got if r.conv_id is not None}
    assert sorted(r.rendered for r in got if r.conv_id is None) == ["<|user|>\n", "<|user|>\na"]
    assert by[2] == "<|user|>\ns"  # relabelling costs less than an empty turn
    assert by[1].endswith("q\nq") and len(got) == 4
    assert rr.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def joined(found):
    """{conv_id: (cost, rendered)} over the parts in order, which count from 0."""
    out = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.part)):
        cost, text, n = out.get(r.conv_id, (0, "", 0))
        assert r.part == n
        out[r.conv_id] = cost + r.cost, text + r.rendered, n + 1
    return out


def test_equal_numbers_and_long_texts_are_cut(spark, monkeypatch):
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", None]
    rows = [(1, rnd.choice([None, 7]), rnd.choice(roles), f"text{k}") for k in range(200)]
    rows += [(2, t, rnd.choice(roles), f"text{t}" + "x" * 3000) for t in range(9)]
    rows += [(3, 1, "user", "same")] * 20
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = joined(rr.format_chats(frame).collect())
    monkeypatch.setattr(rr, "PART_BYTES", 4000)
    monkeypatch.setattr(rr, "GROUP_BYTES", 3000)
    found = rr.format_chats(frame, part_turns=16).collect()
    assert max(r.n_turns for r in found if r.conv_id == 1) < 40 and sum(r.conv_id == 2 for r in found) == 9
    cut = joined(found)
    for c in (1, 2, 3):
        assert cut[c][0] == whole[c][0] and whole[c][2] == 1
        legal(cut[c][1])
        texts = [[x for x in t.split("\n") if x and not x.startswith("<|")] for t in (cut[c][1], whole[c][1])]
        assert texts[0] == texts[1] and sorted(texts[0]) == sorted(r[3] for r in rows if r[0] == c)


def test_query(spark):
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs = {}
    for t in turns:
        convs.setdefault(t.conv_id, []).append(rr._role(t.role))
    got = queries.op6_role_repair(spark, SF_SMALL).collect()
    assert len(got) == len(convs)
    for r in got:
        legal(r.rendered)
        assert r.cost == brute_cost(convs[r.conv_id])
