import random

import numpy as np
import pytest
import tiktoken

from mnemospark.llm import bpe, queries


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(queries.tokenizer()[0])


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Coder(ranks)


def test_pieces_have_the_ids_of_the_library(ranks, coder):
    own, rnd = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), random.Random(3)
    pieces = [bytes([i]) for i in range(256)] + [bytes(rnd.choices(b"etaoinshr \xc3\xa9\x00\xff", k=rnd.randint(1, 40))) for _ in range(2000)]
    pieces += ["aa" * 30 + "b", "the the", "éé日本 🙂", "ab" * 500]
    pieces = [p.encode() if isinstance(p, str) else p for p in pieces]
    got = [np.frombuffer(ids, "<i4").tolist() for ids in coder.tokens(pieces)]
    assert got == [own._encode_single_piece(p) for p in pieces]


def test_texts_are_cut_as_the_pattern_says():
    pattern, rnd = queries.tokenizer()[1], random.Random(4)
    exact = bpe.piece_patterns(pattern)[0]
    low = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    texts = [f"a {c}1" for c in low]
    for most in (0x80, 0x250, 0x10000, 0x110000):
        pick = [c for c in low if ord(c) < most] if most <= 0x10000 else ["🙂", "𝒜", "𝟗", "𠀀", *"aé 1'\n"]
        texts += ["".join(rnd.choice(pick) if rnd.random() < 0.4 else rnd.choice(" a1'stdlvreé\n\x85　\x1c.") for _ in range(60)) for _ in range(500)]
    assert all(bpe.cutter(pattern)(t) == exact.findall(t) for t in texts)
    other = r"\p{N}{1,3}|\p{L}+|[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    assert all(bpe.cutter(other)(t) == bpe.piece_patterns(other)[0].findall(t) for t in texts[-2000:])


def test_texts_in_european_scripts_do_not_take_the_slow_pattern(coder, monkeypatch):
    pattern = queries.tokenizer()[1]
    made = bpe.piece_patterns

    class Slow:
        def __init__(self, exact):
            self.pattern = exact.pattern

        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(bpe, "piece_patterns", lambda p: (Slow(made(p)[0]), made(p)[1]))
    pattern += "|(?!)"  # nothing is kept of this one
    texts = ["Straße, été 1²日本", "it's plain"]
    ids, starts = coder.encode(texts, pattern)
    assert [t.decode() for t in coder.decode(ids, starts).to_pylist()] == texts
    with pytest.raises(AssertionError):
        coder.encode(["🙂"], pattern)


def test_decoding_asks_no_query_keeps_order_and_drops_unknown_ids(ranks, coder, monkeypatch):
    monkeypatch.setattr(coder, "con", None)
    ids = np.array([5, ranks[b"\xff"], 10**9, -1, 2**19, 7], np.int64)
    by_id = {r: t for t, r in ranks.items()}
    got = coder.decode(ids, np.array([0, 0, 2, 5, 6]))
    assert got.to_pylist() == [b"", by_id[5] + b"\xff", b"", by_id[7]]
