import random

import numpy as np
import pytest

from spanloom.llm.tokenizer import Encoder, PerfectHash, encode_corpus, load_ranks

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SCHEMA = "doc_id long, text string, ids string, lang string"


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n):
    rng = random.Random(seed)
    parts = [" the", "The", "  ", "\n\n", "\r\n", "\t", "don't", "naïve", "漢字", "한국어", "😀", "é", "<|endoftext|>", "x" * 50, "12345", "　", "\x85", "...", "日本‍"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(PerfectHash(keys).slots(keys)) == list(range(len(keys)))
    assert len(PerfectHash(keys[:0]).slots(keys)) == len(keys)


def test_every_token_of_the_vocabulary_is_reached_by_merging(ranks):
    encoder = Encoder(ranks)
    assert all(encoder.merge(t) == [r] for t, r in ranks.items())
    assert encoder.encode(list(ranks)[:2000]) == [[r] for r in list(ranks.values())[:2000]]


def test_corpus_equals_the_library_and_decodes_to_the_text(spark, ranks, library):
    rows = [(i, t, "clash", None) for i, t in enumerate(texts(1, 300))]
    rows += [(300, None, None, None), (301, "", None, None), (None, "a b", None, None), (None, "a b", None, None), (302, "ab" * 60_000 + " " * 5000, None, None)]
    got = encode_corpus(spark.createDataFrame(rows, SCHEMA).repartition(3), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    expected = sorted((-1 if i is None else i, library.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == expected
    by_id = {r.doc_id: r.ids for r in got}
    assert all(library.decode(by_id[i]) == t for i, t, *_ in rows[:300])
    assert by_id[300] == by_id[301] == []


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
