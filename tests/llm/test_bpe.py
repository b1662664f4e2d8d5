import hashlib
import random

import pytest
import tiktoken

import public_tokenizers as P
from spendlens.llm import bpe, queries
from tests.conftest import SF_SMALL
from tests.llm.util import ODD_TEXTS, docs_frame


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.load_ranks(P.path(queries.BPE_FILE))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def fuzz(n):
    rnd = random.Random(5)
    bits = ["a", "b", "'", "s", "t", "'re", "'ll", " ", "  ", "\n", "\t", "1", "é", "!", "?", "日本", "'ve", "X", "\x1c", "😀", "ing", "the "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_equals_the_public_library(spark, reference):
    texts = ODD_TEXTS + fuzz(3000)
    vocab = bpe.vocabulary(P.path(queries.BPE_FILE))
    rows = {r.doc_id: r for r in bpe.encode_decode(docs_frame(spark, texts).repartition(3), vocab).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert list(rows[i].ids) == reference.encode_ordinary(t or ""), repr((t or "")[:60])
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_query_digests(spark, reference):
    got = {r.doc_id: r for r in queries.op2_bpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_empty_table(spark):
    vocab = bpe.vocabulary(P.path(queries.BPE_FILE))
    assert bpe.encode_decode(docs_frame(spark, []), vocab).collect() == []


def test_rank_queue_pops_in_order():
    q = bpe.RankQueue(50_000)
    for r in (49_999, 3, 64, 4096, 3, 0):
        q.push(r)
    assert [q.pop() for _ in range(6)] == [0, 3, 64, 4096, 49_999, -1]
