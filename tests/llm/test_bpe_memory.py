import pytest

from mnemospark.llm import bpe, queries


@pytest.fixture
def coder():
    return bpe.Coder(bpe.load_ranks(queries.tokenizer()[0]))


def test_pieces_in_use_are_contracted_once(coder, monkeypatch):
    learned, learn = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    monkeypatch.setattr(bpe, "CACHE_BYTES", 8_000)
    pattern, all_ids = queries.tokenizer()[1], []
    for i in range(60):
        ids, starts = coder.encode([f"unheardofword {' '.join(f'qz{i}x{j}' for j in range(5))}"], pattern)
        all_ids.append(ids[: len(coder.cache["unheardofword"]) // 4].tobytes())
        assert coder.held <= 8_000
    assert len(set(all_ids)) == 1
    assert learned.count("unheardofword") == 1
    assert len(coder.cache) + len(coder.older) < 200


def test_short_pieces_do_not_wait_for_long_ones(coder, monkeypatch):
    asked, contract = [], coder.contract
    monkeypatch.setattr(coder, "contract", lambda pieces: (asked.append([len(p) for p in pieces]), contract(pieces))[1])
    monkeypatch.setattr(bpe, "QUERY_ROWS", 20_000)
    pieces = [b"ab" * 60 if i % 50 == 0 else b"zqxj%d" % i for i in range(1000)]
    got = coder.tokens(pieces)
    assert [contract([p])[0] for p in pieces[:60]] == got[:60]
    assert sum(max(n) > 20 and min(n) < 20 for n in asked) <= 1
    assert len({bytes(x) for x, p in zip(got, pieces, strict=True) if len(p) == 120}) == 1
