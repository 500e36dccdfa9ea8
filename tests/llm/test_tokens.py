"""Token counts and byte-level BPE against their libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from pagemill.llm import bpe, common, merges, token_counts

RANKS, MODEL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab'stlrevmd  \n\t.,!1é２ 　\x1c\x85▁中😀<>/S\x00"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    odd = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return odd + ["", " ", "a" * 5000, "'" * 3000, " " * 999, "ab" * 40_000, "it's we'll they'veX ''s !'s", "<s>x</s><|endoftext|>"]


def test_bpe_equals_library(texts):
    own = bpe.ByteBpe(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, got in zip(texts, own.encode(texts)):
        assert got.ids.tolist() == library.encode_ordinary(text)
        assert own.decode(got.ids) == text.encode()
        edges = [*got.starts.tolist(), len(text)]
        assert [own.decode(got.ids[a:b]).decode() for a, b in zip(got.at, got.at[1:])] == [text[a:b] for a, b in zip(edges, edges[1:])]


def test_counts_equal_library(texts):
    own, library = token_counts.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in texts:
        assert own.tokens(text) == len(library.encode(text)) == own.tokens(text, chunk=7)


def test_tables(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "it's", 8), (2, "it's", 8), (None, "", 7)], "doc_id long, text string, n_tokens int")
    digest = {(r.doc_id, r.n_tokens) for r in bpe.coding_digest(rows, RANKS).collect()}
    assert digest == {(1, 0), (2, 2), (None, 0)}
    assert {r.decoded_sha256 for r in bpe.coding_digest(rows, RANKS).filter("doc_id = 2").collect()} == {hashlib.sha256(b"it's").hexdigest()}
    assert [bytes(r.text_bytes) for r in bpe.decode(bpe.encode(rows, RANKS), RANKS).filter("doc_id = 2").collect()] == [b"it's"] * 2
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in token_counts.token_counts(rows, MODEL).collect()) == [(0, 0, False), (1, 0, False), (2, 4, False), (2, 4, False)]
    assert bpe.coding_digest(rows.limit(0), RANKS).count() == token_counts.token_counts(rows.limit(0), MODEL).count() == 0


def test_short_pieces_merge_as_a_heap_would(monkeypatch):
    rng = random.Random(8)
    cases = [([rng.choice("ab") for _ in range(rng.randrange(1, 40))], {"".join(rng.choices("ab", k=rng.randrange(2, 6))): rng.randrange(20) for _ in range(25)}) for _ in range(400)]
    short = [merges.merge(s, ranks.get) for s, ranks in cases]
    assert short == [merges._merge_short(list(s), ranks.get) for s, ranks in cases]
    monkeypatch.setattr(merges, "_SHORT", 0)
    assert short == [merges.merge(s, ranks.get) for s, ranks in cases]


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_kept_by", {})
    freed = []
    common.takes_over("a", lambda: freed.append("a"))
    common.takes_over("a", lambda: freed.append("a"))
    assert not freed
    common.takes_over("b")
    assert freed == ["a"]
    common.takes_over("a")
    assert freed == ["a"]


def test_pieces_merged_together_are_as_each_alone():
    rng = random.Random(9)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(300):
        a, b = rng.choice([*ranks][97:]), rng.choice([*ranks][97:100])
        ranks.setdefault(a + b, len(ranks))
    pairs = merges.Pairs(ranks)
    for size in (1, 2, 3, 7, 30):
        raw = [bytes(rng.choices(b"abc~", k=size)) for _ in range(200)]
        ids, sizes = pairs.merge(np.frombuffer(b"".join(raw), np.uint8).astype(np.int64).reshape(-1, size))
        alone = [[ranks[s] for s in merges.merge([bytes([b]) for b in r], ranks.get)] for r in raw]
        assert [row[:n] for row, n in zip(ids.tolist(), sizes.tolist())] == alone


def test_pieces_are_kept_in_two_generations(texts, monkeypatch):
    want = [e.ids.tolist() for e in bpe.ByteBpe(RANKS).encode(texts)]
    monkeypatch.setattr(bpe, "_CACHE", 50)
    own = bpe.ByteBpe(RANKS)
    assert [e.ids.tolist() for t in texts for e in own.encode([t])] == want
    assert 0 < len(own.known) <= 50 and 0 < len(own._old) <= 50
