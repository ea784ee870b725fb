"""BPE by forced boundaries: byte pairs that no token holds inside are certain cuts, and fragments are encoded apart.

``Vocabulary`` reads a tokenizer's file and marks each of the 65,536 byte pairs that stands inside some token. Wherever
another pair stands in a text, no token can span it, so the text is cut there, each fragment is contracted on its own,
and the fragments' ids are joined. Where the tokenizer's pattern cuts, it cuts too; the pattern is matched against
units, which are a run of white space with the run of other characters after it: no match of the pattern goes from
other characters on into white space, and none looks back, so a unit's matches are those of the whole text.

Fragments of a batch are contracted at once, in numpy: in each round all leftmost pairs of a fragment's lowest rank are
merged. That is the usual order, one pair at a time, since a merge is listed after those that make its parts (checked
when the file is read). Long fragments (text without any cut) go through a heap instead, in n log n steps.

Added tokens of the file (such as an end-of-text mark) are found first, as the library does, unless ``plain``.
Null texts count as empty, empty texts have no ids, repeated rows give repeated results, an empty table gives no rows, a
very long text is a batch of its own, and columns other than the text are passed through (an input column named like
an output column is replaced).
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark import workers

from .bpe import SPACES, piece_patterns
from .common import gathered, list_array, map_batches

#: Bytes of units and ids that a Python worker remembers, with what each entry costs; beyond it the memory starts anew.
MEMORY_BYTES, ENTRY = 90_000_000, 170
#: Text that is encoded at once, but for longer single texts.
BATCH_BYTES = 1_000_000
#: Fragments of more bytes are contracted by a heap.
LONG = 256
#: The pattern that the byte-level pre-tokenizer of such files stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers newer than the library's own tables, which it takes for other characters.
NEWER = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d-\\u209f \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd \\ua7e2 \\ua7f1 \\uab6c-\\uab6d \\U000107bb-\\U000107bf "
    "\\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 \\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb \\U00011de0-\\U00011de9 \\U00011df1 \\U0001246f \\U00012475-\\U0001247f "
    "\\U00012550-\\U00012686 \\U00016ea0-\\U00016eb8 \\U00016ebb-\\U00016ed3 \\U00016ff2-\\U00016ff6 \\U000187f8-\\U000187ff \\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 \\U00018d80-\\U00018df2 "
    "\\U00018e00-\\U00019191 \\U000191a0-\\U000191d2 \\U0001b123-\\U0001b128 \\U0001b168 \\U0001d6a6 \\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 "
    "\\U0001dfcd-\\U0001dfff \\U0001e6c0-\\U0001e6de \\U0001e6e0-\\U0001e6e2 \\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed \\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff "
    "\\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead \\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
).replace(" ", "")

_UNITS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_NEWER = re.compile(f"[{NEWER}]")
_NONE = np.int64(1 << 40)


@lru_cache(1)
def _newer_pattern():
    """The pattern for text with newer letters or numbers: slower, and right for them."""
    import regex

    other = PATTERN.replace("[^\\s\\p{L}\\p{N}]", "(?:@|[^\\s\\p{L}\\p{N}])").replace("(?!\\S)", f"(?![^{SPACES}])").replace("[^\\s", f"[^{SPACES}").replace("\\s", f"[{SPACES}]")
    for kind in ("\\p{L}+", "\\p{N}+"):
        other = other.replace(f" ?{kind}", f" ?(?:(?!@){kind[:-1]})+")
    return regex.compile(other.replace("@", f"[{NEWER}]"))


def pieces(unit: str) -> list[str]:
    """What the pattern cuts a unit into."""
    exact, plain = piece_patterns(PATTERN)
    return (plain if unit.isascii() else _newer_pattern() if _NEWER.search(unit) else exact).findall(unit)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabulary:
    """Tokens, merges and forced boundaries of a byte-level BPE file; plain to pickle, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letter = data["model"], byte_letters()
        if model["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a byte-level BPE file without normalizer and prefix space")
        size = max([*model["vocab"].values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.tokens = [b""] * size
        for name, i in model["vocab"].items():
            self.tokens[i] = bytes(letter[c] for c in name)
        self.inside = np.zeros((256, 256), bool)
        for token in self.tokens:
            raw = np.frombuffer(token, np.uint8)
            self.inside[raw[:-1], raw[1:]] = True
        self.added = {}
        for t in data["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens must be exact strings")
            self.added[t["content"]], self.tokens[t["id"]] = t["id"], t["content"].encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([model["vocab"][f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        last = np.full(size, -1, np.int64)
        np.maximum.at(last, made, np.arange(len(pairs)))
        if (np.maximum(last[left], last[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge stands before one that makes its parts")
        order = np.argsort(left << 32 | right)
        self.keys, self.rank, self.made = (left << 32 | right)[order], order.astype(np.int64), made
        self.byte_id = np.array([model["vocab"][c] for c, _ in sorted(letter.items(), key=lambda x: x[1])], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair is merged, or _NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def forced(self, data: np.ndarray) -> np.ndarray:
        """Whether each byte comes after a forced boundary; the first one does."""
        return np.concatenate([np.ones(min(len(data), 1), bool), ~self.inside[data[:-1], data[1:]]])


class Encoder:
    """A worker's memory of units and their ids beside a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memory, self.held = vocabulary, {}, 0
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None
        self.texts = pa.array(vocabulary.tokens, pa.large_binary())

    # ---- contraction ---------------------------------------------------------------------------

    def contract(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of fragments that lie one after the other, and the byte at which each token starts.

        begins: whether a fragment begins at each byte.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(begins)
        sizes = np.diff(np.concatenate([first, [len(data)]]))
        token, place, owner = self.v.byte_id[data], np.arange(len(data)), np.repeat(np.arange(len(first)), sizes)
        done = [self._by_heap(token[first[i] : first[i] + sizes[i]], first[i]) for i in np.flatnonzero(sizes > LONG)]
        if done:
            short = (sizes <= LONG)[owner]
            token, place, owner = token[short], place[short], owner[short]
        rank = self._pair_ranks(token, owner, np.arange(len(token)))
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate([first, [len(owner)]])))
            live = least < _NONE
            if not live.all():
                done.append((token[~live], place[~live]))
                token, place, owner, rank, least = token[live], place[live], owner[live], rank[live], least[live]
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            # In a run of overlapping hits (a pair of equal tokens) every second one goes.
            starts = at[np.concatenate([[True], np.diff(at) > 1])]
            at = at[(at - starts[np.searchsorted(starts, at, "right") - 1]) % 2 == 0]
            token[at] = self.v.made[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            here = at - np.arange(len(at))  # one token went for each merge before
            token, place, owner, rank = token[keep], place[keep], owner[keep], rank[keep]
            rank[here] = self._pair_ranks(token, owner, here)
            here = here[here > 0] - 1
            rank[here] = self._pair_ranks(token, owner, here)
        token, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return token[order], place[order]

    def _pair_ranks(self, token: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; _NONE at a fragment's end."""
        after = np.minimum(at + 1, len(token) - 1)
        inner = (owner[after] == owner[at]) & (at + 1 < len(token))
        return np.where(inner, self.v.ranks(token[at], token[after]), _NONE)

    def _by_heap(self, token: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        n, none, made = len(token), int(_NONE), self.v.made
        rank = np.concatenate([self.v.ranks(token[:-1], token[1:]), [_NONE]])
        heap = (rank << 32 | np.arange(n))[rank < _NONE].tolist()
        heapq.heapify(heap)
        table, token, rank = self._table(), token.tolist(), rank.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 32)
            if rank[i] != r:
                continue
            j = after[i]
            token[i], token[j], rank[j] = int(made[r]), -1, none
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0:
                    rank[a] = table.get(token[a] << 32 | token[b], none) if b < n else none
                    if rank[a] < none:
                        heapq.heappush(heap, rank[a] << 32 | a)
        token = np.array(token)
        return token[token >= 0], begin + np.flatnonzero(token >= 0)

    def _table(self) -> dict[int, int]:
        if not hasattr(self, "table"):
            self.table = dict(zip(self.v.keys.tolist(), self.v.rank.tolist(), strict=True))
        return self.table

    # ---- texts ---------------------------------------------------------------------------------

    def learn(self, units: list[str]) -> None:
        """Puts the ids of these units into the memory: all their fragments are contracted at once."""
        sizes, lengths = [], []
        for unit in units:
            own = [len(piece) for piece in pieces(unit)] if unit.isascii() else [len(piece.encode()) for piece in pieces(unit)]
            sizes += own
            lengths.append(sum(own))
        data = np.frombuffer("".join(units).encode(), np.uint8)
        begins = self.v.forced(data)
        begins[np.cumsum(np.array(sizes)) - np.array(sizes)] = True
        token, place = self.contract(data, begins)
        raw = token.astype("<i4").tobytes()
        cut = (4 * np.searchsorted(place, np.concatenate([[0], np.cumsum(np.array(lengths))]))).tolist()
        for unit, a, b in zip(units, cut[:-1], cut[1:], strict=True):
            self.memory[unit] = raw[a:b]
        self.held += len(data) + len(raw) + ENTRY * len(units)

    def encode(self, texts: list[str | None], plain: bool = False) -> list[bytes]:
        """The ids of each text, four little-endian bytes each. plain: added tokens' strings are ordinary text."""
        gc.disable()  # units and ids are many and in no cycles
        try:
            return self._encode(texts, plain)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None], plain: bool) -> list[bytes]:
        if self.held > MEMORY_BYTES:
            self.memory, self.held = {}, 0
        cut, known = [], self.memory
        for text in texts:
            parts = [text or ""] if plain or self.split is None else self.split.split(text or "")
            cut.append([(p, None) if i % 2 else (None, _UNITS.findall(p)) for i, p in enumerate(parts)])
        if new := list(dict.fromkeys(u for parts in cut for _, units in parts if units for u in units if u not in known)):
            self.learn(new)
        return [b"".join([x for mark, units in parts for x in ([self.v.added[mark].to_bytes(4, "little")] if mark else [known[u] for u in units])]) for parts in cut]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each row's ids; bytes that are no UTF-8 become U+FFFD. An id outside the vocabulary stands for nothing."""
        good = (ids >= 0) & (ids < len(self.texts))
        taken = self.texts.take(pa.array(np.where(good, ids, 0)))
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(ids) + 1]
        raw = data.to_pybytes() if data is not None else b""
        if not good.all():
            keep = np.repeat(good, np.diff(offsets))
            raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]][keep].tobytes()
            offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) * good)])
        at = offsets[starts].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str, vocabulary) -> Encoder:
    """The worker's own encoder of a broadcast vocabulary."""
    encoders = workers.memory("forced_bpe")
    if path not in encoders:
        encoders[path] = Encoder(vocabulary.value)
    return encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", plain: bool = False, packed: bool = False, back: bool = False) -> DataFrame:
    """Replaces the text by ``ids array<int>``, or with packed by ``ids binary`` (four little-endian bytes each).

    back: also decodes the ids again, to ``decoded string``, in the same pass.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # bounded by the tokenizer's file
    keep = [c for c in docs.columns if c not in ("ids", text, *(["decoded"] if back else []))]

    def run(batches):
        own = encoder(path, vocabulary)
        for batch in gathered(batches, text, BATCH_BYTES):
            found = own.encode(batch.column(text).to_pylist(), plain)
            ids, starts = np.frombuffer(b"".join(found), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int64)
            more = {"ids": pa.array(found, pa.binary()) if packed else list_array(pa.array(ids, pa.int32()), starts)}
            if back:
                more["decoded"] = pa.array(own.decode(ids, starts), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], [*keep, *more])

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), f"ids {'binary' if packed else 'array<int>'}", *(["decoded string"] if back else [])]
    return map_batches(docs.select(*(f"`{c}`" for c in keep), f"`{text}`"), run, ", ".join(schema), "forced_bpe")
