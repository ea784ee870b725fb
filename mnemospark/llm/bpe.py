"""Byte-level BPE: DuckDB recursive queries in each partition contract token-position rows to a fixpoint.

``encode`` cuts each text into pieces by the tokenizer's pattern. The distinct pieces of a batch become rows
(piece, position, token), one for each byte, which also hold the next position and token and the rank of the two as a
pair. A recursive query contracts, in every piece at once, the leftmost pair of the lowest rank and joins the pairs that
this makes with the merge table, until no pair is left. ``decode`` takes the bytes of ids from the vocabulary and joins
them in order.

Long pieces (text without spaces) go through the same query in overlapping windows. Two windows are joined at a token
that both have at the same place: no merge crossed its ends in either window, so none does in the whole, since the next
merge of the whole would also be the next one of a window. Where two windows share no token, as in periodic text, they
are laid anew at the places where the first one's tokens begin, and at last joined to a longer one.

Null texts count as empty, empty texts have no ids, repeated rows give repeated results, and columns other than the
text are passed through (an input column named like an output column is replaced). An id outside the vocabulary
decodes to nothing.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark import workers

from .common import by_bytes, gathered, list_array, map_batches, ragged

#: Bytes of pieces and ids that a Python worker remembers, with what each entry costs: two halves, of which the older goes
#: when the newer is full.
CACHE_BYTES, ENTRY = 60_000_000, 160
#: Text that is encoded at once, but for longer single texts: fewer queries, and their fixed cost weighs less.
BATCH_BYTES = 1_000_000
#: Pieces are contracted in windows of so many bytes, of which neighbours share the last and first OVERLAP; a piece of no
#: more is one window.
WINDOW, OVERLAP = 128, 48
#: So often windows without a common token are laid anew; then they are joined.
TRIES = 12
#: Rows that one recursive query may make: for each window half the square of its length.
QUERY_ROWS = 2_400_000
#: What follows a piece's last token, above all ids, and the rank of what is no pair.
END, NO_RANK = (1 << 20) - 1, 1 << 22

# The code points of White_Space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: One contraction of every live piece. k is rank << 40 | position << 20 | next position; of a pair that becomes one token,
#: the right row stays, with the left one's position.
CONTRACT = f"""
WITH RECURSIVE s(w, pos, tok, npos, ntok, k, live) AS (
  SELECT w, pos, tok, npos, ntok, k, true FROM init
  UNION ALL
  (WITH b AS (SELECT w, min(k) AS k FROM s WHERE live GROUP BY w),
   p AS (
     SELECT w, s.pos, tok, npos, ntok, s.k, (b.k >> 40)::INT AS n, ((b.k >> 20) & 1048575)::INT AS l, (b.k & 1048575)::INT AS r, n < {NO_RANK} AS live
     FROM s JOIN b USING (w) WHERE s.live),
   c AS (
     SELECT w, if(live AND pos = r, l, pos) AS pos, if(live AND pos = r, n, tok) AS tok, npos, if(live AND npos = l, n, ntok) AS ntok,
       k, live, live AND (pos = r OR npos = l) AS new
     FROM p WHERE NOT live OR pos <> l)
   SELECT w, pos, tok, npos, ntok, if(new, (coalesce(m.r, {NO_RANK}) << 40) | (pos::BIGINT << 20) | npos, k), live
   FROM c LEFT JOIN merges m ON m.ab = if(new, (tok::BIGINT << 20) | ntok, NULL))
)
SELECT w, tok FROM s WHERE NOT live ORDER BY w, pos"""

#: The alternatives with which the pattern of many tokenizers begins, and the same with the frequent ones first: none can
#: match where another does.
CONTRACTIONS_FIRST = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|"
WORDS_FIRST = " ?\\p{L}++| ?\\p{N}++|'(?:[stmd]|re|ve|ll)|"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def piece_patterns(pattern: str):
    """The pattern for any text, with white space as Unicode has it, and a faster one for ASCII texts."""
    import regex

    exact = pattern.replace("[^\\s", f"[^{SPACES}").replace("(?!\\S)", f"(?![^{SPACES}])").replace("\\s", f"[{SPACES}]")
    plain = pattern.replace("[^\\s\\p{L}\\p{N}]", "[^\\sA-Za-z0-9]").replace("\\p{L}", "[A-Za-z]").replace("\\p{N}", "[0-9]")
    return regex.compile(exact), re.compile(plain, re.ASCII)


@lru_cache(2)
def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into pieces as piece_patterns() does, by whichever of three patterns is the fastest for it."""
    import regex

    exact, plain = piece_patterns(pattern.replace(CONTRACTIONS_FIRST, WORDS_FIRST) if pattern.startswith(CONTRACTIONS_FIRST) else pattern)
    # For texts without code points of more than 16 bits: re instead of regex, with the letters and numbers spelled out.
    low = "".join(map(chr, range(0x10000)))
    letters, numbers = ("".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(kind, low)) for kind in ("\\p{L}+", "\\p{N}+"))
    spelled = exact.pattern.replace(f"[^{SPACES}\\p{{L}}\\p{{N}}]", f"[^{SPACES}{letters}{numbers}]").replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]")
    wide = re.compile(spelled)

    def cut(text: str) -> list[str]:
        if text.isascii():
            return plain.findall(text)
        return (wide if len(text.encode("utf-16-le")) == 2 * len(text) else exact).findall(text)

    return cut


class _Windows:
    """A piece in windows: which are still to be contracted, and where their tokens meet."""

    def __init__(self, piece: bytes):
        self.piece, self.known, self.ids, self.tries = piece, {}, None, 0
        n, step = len(piece), WINDOW - OVERLAP
        self.spans = [(a, min(a + WINDOW, n)) for a in range(0, max(n - OVERLAP, 1), step)]

    def missing(self) -> list[tuple[int, int]]:
        return [span for span in self.spans if span not in self.known]

    def settle(self) -> bool:
        """Whether all neighbours share a token; then ids is set. Else spans holds windows laid anew."""
        joints, low = [], 0
        for x, y in zip(self.spans[:-1], self.spans[1:], strict=True):
            joints.append(self._joint(x, y, low))
            low = joints[-1] or low
        if None not in joints:
            cuts, parts = [0, *joints, len(self.piece)], []
            for span, a, b in zip(self.spans, cuts[:-1], cuts[1:], strict=True):
                ids, starts = self.known[span]
                parts.append(ids[np.searchsorted(starts, a) : np.searchsorted(starts, b)])
            self.ids = np.concatenate(parts)
            return True
        self.tries += 1
        out, i = [self.spans[0]], 0
        while i < len(joints):
            if joints[i] is not None:
                out.append(self.spans[i + 1])
                i += 1
                continue
            # From here on windows are laid anew, in each try over twice as many; what follows may then meet them.
            j = min(i + (1 << self.tries), len(joints))
            out[-1:] = self._phased(self.spans[i], self.spans[j]) if self.tries <= TRIES else self._longer(self.spans[i : j + 1])
            i = j
        self.spans = out
        return False

    def _joint(self, x: tuple[int, int], y: tuple[int, int], low: int) -> int | None:
        """Where a token starts that both windows have, at low or after it."""
        (ids, at), (other, where) = self.known[x], self.known[y]
        both = np.intersect1d(at[:-1], where[:-1], assume_unique=True)
        both = both[both >= low]
        same = both[ids[np.searchsorted(at[:-1], both)] == other[np.searchsorted(where[:-1], both)]]
        return int(same[0]) if len(same) else None

    def _phased(self, first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
        """Windows from where a token of the first one begins, at steps of the period in which its tokens repeat there."""
        (ids, starts), step = self.known[first], WINDOW - OVERLAP
        k = max(int(np.searchsorted(starts, first[0] + step, "right")) - 1, 1)
        period = next((p for p in range(1, k // 2 + 1) if (ids[k - p : k] == ids[k - 2 * p : k - p]).all()), 1)
        begin, size = int(starts[k]), int(starts[k] - starts[k - period])
        step = max(step // size, 1) * size
        count = max(-(-(last[1] - WINDOW - begin) // step), 0) + 1  # whole windows, until the last one's end is reached
        return [first, *((a, min(a + WINDOW, len(self.piece))) for a in range(begin, begin + count * step, step))]

    def _longer(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Each two neighbours as one window."""
        pairs = [spans[i : i + 2] for i in range(0, len(spans), 2)]
        return [(p[0][0], p[-1][1]) for p in pairs]


class Coder:
    """DuckDB with the merge table and the vocabulary; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks, self.cache, self.older, self.held = ranks, {}, {}, 0
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "120MB"})
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a), right.append(b), rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.create("merges", {"ab": left << 20 | right, "r": rank})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        # Each id's bytes; the last entry, for all that is no id, has none.
        pieces = [b""] * (len(self.sizes) + 1)
        for token, r in ranks.items():
            pieces[r] = token
        self.vocabulary = pa.array(pieces, pa.binary())
        # Byte 256 stands for the end. The ranks of pairs of bytes, from which each piece starts.
        self.byte_id = np.array([*(ranks[bytes([i])] for i in range(256)), END], np.int32)
        self.byte_rank = np.full((257, 257), NO_RANK, np.int64)
        self.byte_rank[:256, :256] = [[ranks.get(bytes([i, j]), NO_RANK) for j in range(256)] for i in range(256)]

    def create(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, four bytes each."""
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        after = np.append(data[1:], 0).astype(np.int16)
        after[np.cumsum(lengths) - 1] = 256
        position = ragged(np.zeros(len(pieces), np.int64), lengths)
        k = self.byte_rank[data, after] << 40 | position << 20 | position + 1
        rows = {"w": np.repeat(np.arange(len(pieces)), lengths), "pos": position, "tok": self.byte_id[data], "npos": position + 1, "ntok": self.byte_id[after]}
        self.con.register("init", pa.table({name: column.astype(np.int32) for name, column in rows.items()} | {"k": k}))
        found = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("init")
        tokens = found["tok"].to_numpy().astype("<i4").tobytes()
        cut = (4 * np.searchsorted(found["w"].to_numpy(), np.arange(len(pieces) + 1))).tolist()
        return [tokens[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def windows(self, pieces: list[bytes]) -> list[bytes]:
        """contract() in groups, so that no query makes more than QUERY_ROWS rows."""
        out, begin, rows = [], 0, 0
        for i, piece in enumerate(pieces):
            more = len(piece) ** 2 // 2 + 1
            if i > begin and rows + more > QUERY_ROWS:
                out += self.contract(pieces[begin:i])
                begin, rows = i, 0
            rows += more
        return out + (self.contract(pieces[begin:]) if begin < len(pieces) else [])

    def tokens(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; pieces of no more than a window are contracted at once, others by way of windows."""
        # By length: a query goes on until its longest piece is done, so short pieces don't wait for long ones.
        once = sorted((piece for piece in pieces if len(piece) <= WINDOW), key=len)
        short = dict(zip(once, self.windows(once), strict=True))
        plans = [_Windows(piece) if len(piece) > WINDOW else None for piece in pieces]
        todo = [plan for plan in plans if plan]
        while todo:
            spans = [(plan, span) for plan in todo for span in plan.missing()]
            for (plan, (a, b)), ids in zip(spans, self.windows([plan.piece[a:b] for plan, (a, b) in spans]), strict=True):
                ids = np.frombuffer(ids, "<i4")
                plan.known[a, b] = ids, a + np.concatenate([[0], np.cumsum(self.sizes[ids])])
            todo = [plan for plan in todo if not plan.settle()]
        return [plan.ids.astype("<i4").tobytes() if plan else short[piece] for plan, piece in zip(plans, pieces, strict=True)]

    def remember(self, pieces: set[str]) -> None:
        """Puts the ids of these pieces into the newer half of the memory; what is still in use moves over from the older."""
        unknown, older, cache = [], self.older, self.cache
        for piece in pieces:
            if (ids := older.pop(piece, None)) is None:
                unknown.append(piece)
            else:
                cache[piece] = ids
        self.learn(unknown)
        self.held += sum(map(len, pieces)) + sum(map(len, map(cache.__getitem__, pieces))) + ENTRY * len(pieces)

    def learn(self, pieces: list[str]) -> None:
        unknown = []
        for piece in pieces:
            raw = piece.encode()
            if (one := self.ranks.get(raw)) is not None:
                self.cache[piece] = one.to_bytes(4, "little")
            else:
                unknown.append((piece, raw))
        for (piece, _), ids in zip(unknown, self.tokens([raw for _, raw in unknown]), strict=True):
            self.cache[piece] = ids

    def encode(self, texts: list[str | None], pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one more entry at the end)."""
        gc.disable()  # pieces and ids are many and in no cycles
        try:
            return self._encode(texts, pattern)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None], pattern: str) -> tuple[np.ndarray, np.ndarray]:
        cut, pieces, ends = cutter(pattern), [], [0]
        for text in texts:
            if text:
                pieces += cut(text)
            ends.append(len(pieces))
        if self.held > CACHE_BYTES // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        found = list(map(self.cache.get, pieces))
        if missing := [i for i, ids in enumerate(found) if ids is None]:
            self.remember({pieces[i] for i in missing})
            for i in missing:
                found[i] = self.cache[pieces[i]]
        rows = [b"".join(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return np.frombuffer(b"".join(rows), "<i4"), np.cumsum([0, *(len(row) // 4 for row in rows)])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
        """The bytes of each row's ids."""
        none = len(self.sizes)
        known = self.vocabulary.take(pa.array(np.where((ids < 0) | (ids > none), none, ids), pa.int32()))
        return pa.compute.binary_join(list_array(known, starts), b"")


def coder(key: str, ranks) -> Coder:
    coders = workers.memory("bpe")
    if key not in coders:
        coders[key] = Coder(ranks.value)
    return coders[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", back: bool = False) -> DataFrame:
    """Replaces the text by ``ids array<int>``, as many as the whole text has.

    back: also decodes the ids again, to ``decoded binary``, in the same pass.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # bounded by the vocabulary
    keep = [c for c in docs.columns if c not in ("ids", text, *(["decoded"] if back else []))]

    def run(batches):
        own = coder(path, ranks)
        for batch in gathered(batches, text, BATCH_BYTES):
            ids, starts = own.encode(batch.column(text).to_pylist(), pattern)
            more = {"ids": list_array(pa.array(ids, pa.int32()), starts)}
            if back:
                more["decoded"] = own.decode(ids, starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], [*keep, *more])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "ids array<int>", *(["decoded binary"] if back else [])])
    return map_batches(docs.select(*(f"`{c}`" for c in keep), f"`{text}`"), run, schema, "bpe")


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded binary``: the bytes that the ids stand for, in order."""
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))
    keep = [c for c in tokens.columns if c != "decoded"]

    def run(batches):
        own = coder(path, ranks)
        for batch in (part for whole in batches for part in by_bytes(whole, ids, 250_000)):
            column = batch.column(ids).fill_null([])
            starts = np.concatenate([[0], np.cumsum(np.array(pa.compute.list_value_length(column)))])
            out = own.decode(np.array(column.flatten(), np.int32), starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "decoded"])

    return map_batches(tokens, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in keep), "decoded binary"]), "bpe")
