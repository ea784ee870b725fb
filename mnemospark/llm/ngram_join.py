"""N-gram Jaccard join by multiple-global-order filtering.

A text's set holds its distinct word n-grams, as 64-bit hashes. Two texts link when
``den * |intersection| >= num * |union|``. A global order of the n-grams makes prefixes: linked sets of n elements
share one of the first n - ceil(num/den * n) + 1 under any order. The first order puts the n-grams of many documents
last and sorts the rest by hash; its prefixes make the candidates, of which sizes and short parity bitmaps leave those
that can link (the bits in which two bitmaps differ are a lower bound of the elements in which the sets do). Each node
also has its prefixes under further orders: a candidate pair must share an element in every one of them, and agree with
full bitmaps, before any set moves. Who passes all filters is verified on the whole sets.

Documents of equal sets are one node. Two rounds find the components. In the first, a forest of nearest neighbours
inside each group of a prefix element is verified, large groups dealt by node and element into blocks of bounded size;
a node meets other blocks' nodes through its other elements. In the second, groups whose nodes are still in different
components are compared across components: nodes of a group's largest component stand in one block each, the others
in all of its blocks. So a group's pairs are never made, and no link between components is lost.

Null and empty texts have empty sets and link with nothing; a text of fewer words than n has one n-gram, the whole.
Rows of equal sets are linked, repeated rows too. A row without an id takes part; the component's id is the smallest
id there is (null if there is none). An empty table has no rows. Columns other than id and text don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, deal, map_batches, materialize, mix64, ragged, split_words, text_bytes, word_hashes
from .suffix_dedup import MESSAGE, _by_key, _joined, _messages, _packs, _send, _unpack, row_keys

#: Of each set the n-grams are counted that by their hash come within its prefix and half as many more, and MORE (so also
#: those that take the places of hot ones), or lie in the lowest 1/LOW; those of over HOT documents come last in the first order.
LOW, HOT, MORE = 8, 48, 4
#: So many are remembered, the most frequent; the rest stay where their hash puts them, which costs time alone.
HOT_MOST = 1 << 20
#: Groups of up to SMALL nodes are worked on many at once; larger ones are cut into blocks of BLOCK nodes.
SMALL, BLOCK = 24, 1536
#: Bits of the bitmaps that candidates are first compared by; the second round has longer ones for larger sets.
BITS = 512
#: Seeds of the further orders.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344)
FLUSH = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of each row, one after the other, and where each row's start."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = split_words(data, offsets, _SPACE)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(first)
    n = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    at = ragged(first[:-1], n)
    few = np.repeat(np.minimum(words, k), n)
    value = few.astype(np.uint64) * _FACTORS[k]
    for i in range(k):
        inside = few > i
        value[inside] += hashes[at[inside] + i] * _FACTORS[i]
    value = mix64(value)
    cut = np.concatenate([[0], np.cumsum(n)])
    parts = [np.unique(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def prefix_size(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _hold(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values if len(sorted_) else np.zeros(len(values), bool)


def further(values: np.ndarray, num: int, den: int) -> bytes:
    """A set's prefixes under the further orders, one after the other, as 32 bits of each element's hash."""
    n = prefix_size(len(values), num, den)
    return b"".join((np.sort(mix64(values ^ np.uint64(seed)))[:n] >> np.uint64(32)).astype(np.uint32).tobytes() for seed in ORDERS)


def prefixes(values: np.ndarray, starts: np.ndarray, hot: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether each element is in its row's prefix under the first order."""
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    late = _hold(hot, values)
    want = np.where(n > 0, prefix_size(n, num, den), 0)

    def rank(flag):
        seen = np.concatenate([[0], np.cumsum(flag)])
        return seen[:-1] - seen[starts[:-1]][row], seen[starts[1:]] - seen[starts[:-1]]

    early, n_early = rank(~late)
    later, _ = rank(late)
    return np.where(late, later < (want - n_early)[row], early < want[row])


def bitmap(values: np.ndarray) -> np.ndarray:
    """The parity of the elements that fall on each bit; twice to four times as many bits as elements, BITS at least."""
    bits = max(BITS, 1 << (2 * len(values) - 1).bit_length())
    at = ((values >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """The bitmap of n words for the same elements, of one with more words along the last axis."""
    return np.bitwise_xor.reduce(words.reshape(*words.shape[:-1], -1, n), axis=-2)


def _sigs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)], np.uint64).view(np.int64)


# ---- first order ---------------------------------------------------------------------------------


def _low(text: str, k: int, parts: int, num: int, den: int):
    def run(batches):
        def rows():
            held, size, seen = [], 0, set()

            def out():
                u, c = np.unique(np.concatenate(held), return_counts=True)
                return _by_key((u % np.uint64(parts)).astype(np.int64), {"t": u, "n": c}, 0)

            for batch in (part for whole in batches for part in by_bytes(whole, text)):
                values, starts = sets(batch.column(text), k)
                n = np.diff(starts)
                place = np.arange(len(values)) - np.repeat(starts[:-1], n)
                keep = (values < np.uint64(2**64 // LOW)) | (place < np.repeat(prefix_size(n, num, den) * 3 // 2 + MORE, n))
                held.append(values[keep])
                size += len(held[-1])
                if size > FLUSH:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

        yield from _send(rows())

    return run


def _hot(batches):
    got = [_unpack(x) for b in batches for x in b.column("data").to_pylist()]
    if got:
        u, at = np.unique(_joined(got, "t"), return_inverse=True)
        n = np.bincount(at, _joined(got, "n")).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u[n > HOT].view(np.int64)), pa.array(n[n > HOT])], ["t", "n"])


def hot_elements(docs: DataFrame, text: str, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams to come last, at most HOT_MOST, as sorted numbers, and how many documents have each."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = map_batches(deal(map_batches(docs.select(text), _low(text, k, parts, num, den), MESSAGE), parts), _hot, "t long, n long")
    found = counted.orderBy(F.desc("n"), "t").limit(HOT_MOST).toPandas()
    t, n = found["t"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    return t[np.argsort(t)], n[np.argsort(t)]


# ---- candidates ----------------------------------------------------------------------------------


def _table(doc_id: str, text: str, k: int, num: int, den: int, hot):
    def run(batches):
        seen: set[int] = set()
        for batch in (part for whole in batches for part in by_bytes(whole, text)):
            values, starts = sets(batch.column(text), k)
            n = np.diff(starts)
            sig, key = _sigs(values, starts), row_keys(batch.column(doc_id), batch.column(text)).view(np.int64)
            chosen = prefixes(values, starts, hot.value[0], num, den)
            prefix, bits, orders = [], [], []
            for i, s in enumerate(sig.tolist()):
                if n[i] == 0 or s in seen:  # once in a task is enough
                    prefix.append(None), bits.append(None), orders.append(None)
                    continue
                seen.add(s)
                a, b = starts[i], starts[i + 1]
                prefix.append(values[a:b][chosen[a:b]].tobytes())
                bits.append(bitmap(values[a:b]).tobytes())
                orders.append(further(values[a:b], num, den))
            if len(seen) > 200_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(key), pa.array(sig), pa.array(n), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), pa.array(orders, pa.binary())], ["doc_id", "key", "sig", "n", "prefix", "bitmap", "orders"])

    return run


def _postings(parts: int, hot):
    """Prefix elements to the tasks of their groups (kind 0). How many have a hot one is known, so it goes on at once (kind 2)."""

    def run(batches):
        def rows():
            held, size = [], 0

            def out():
                t, s = (np.concatenate(x) for x in zip(*held, strict=True))
                known = _hold(hot.value[0], t)
                yield from _by_key((t[~known] % np.uint64(parts)).astype(np.int64), {"t": t[~known], "s": s[~known]}, 0)
                if known.any():
                    t, s = t[known], s[known]
                    n = hot.value[1][np.searchsorted(hot.value[0], t)]
                    yield from ((k, 2, d) for k, _, d in _by_key((s.view(np.uint64) % np.uint64(parts)).astype(np.int64), {"t": t, "s": s, "b": np.maximum(-(-n // BLOCK), 1)}, 0))

            for batch in batches:
                raw = batch.column("prefix").to_pylist()
                t = np.frombuffer(b"".join(raw), np.uint64)
                held.append((t, np.repeat(batch.column("sig").to_numpy(), [len(r) // 8 for r in raw])))
                size += len(t)
                if size > FLUSH:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

        yield from _send(rows())

    return run


def _groups(parts: int):
    """Postings whose element several nodes have, with the number of blocks of its group."""

    def run(batches):
        got = []
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == 2:
                    yield _messages([(batch.column("key")[0].as_py(), 0, data)])
                else:
                    got.append(_unpack(data))
        if not got:
            return
        t, s = _joined(got, "t"), _joined(got, "s")
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s = t[fresh], s[fresh]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        keep = size > 1
        t, s, size = t[keep], s[keep], size[keep]
        blocks = np.where(size > SMALL, -(-size // BLOCK), 0)
        yield from _send(_by_key((s.view(np.uint64) % np.uint64(parts)).astype(np.int64), {"t": t, "s": s, "b": blocks}, 0))

    return run


def _nodes(parts: int):
    def run(batches):
        def rows():
            for batch in batches:
                if batch.num_rows:
                    s = batch.column("sig").to_numpy()
                    yield from _by_key((s.view(np.uint64) % np.uint64(parts)).astype(np.int64), {"s": s, "n": batch.column("n").to_numpy(), "m": pa.array([fold(np.frombuffer(x, np.uint64), BITS // 64).tobytes() for x in batch.column("bitmap").to_pylist()], pa.binary())}, 1)

        yield from _send(rows())

    return run


def _meet(parts: int):
    """Postings with their nodes' sizes and bitmaps, to the groups, of large ones to one of their blocks."""

    def run(batches):
        post, nodes = [], []
        for b in batches:
            for kind, x in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
                (nodes if kind else post).append(_unpack(x))
        if not post or not nodes:
            return
        s, n = _joined(nodes, "s"), _joined(nodes, "n")
        m = pa.concat_arrays([x.column("m") for x in nodes])
        _, at = np.unique(s, return_index=True)
        s, n, m = s[at], n[at], m.take(pa.array(at))

        def rows():
            every = [_joined(post, c) for c in ("s", "t", "b")]
            for a in range(0, len(every[0]), 400_000):
                ps, t, b = (c[a : a + 400_000] for c in every)
                node = np.searchsorted(s, ps)
                block = (mix64(ps.view(np.uint64) ^ t) % np.maximum(b, 1).astype(np.uint64)).astype(np.int64)
                code = np.where(b > 0, block + 1, 0)
                key = mix64(t ^ code.astype(np.uint64))
                yield from _by_key((key % np.uint64(parts)).astype(np.int64), {"t": t, "code": code, "s": ps, "n": n[node], "m": m.take(pa.array(node)), "b": b}, 0)

        yield from _send(rows())

    return run


def _passes(n1, n2, differ, num: int, den: int):
    total = n1 + n2
    return (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & ((total - differ) * (den + num) >= 2 * num * total)


def _nearest(n: np.ndarray, m: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of a block the nearest earlier one that passes, as pairs; and which nodes are in any pair that passes."""
    out, some = [], np.zeros(len(n), bool)
    for x in range(0, len(n), 128):
        i = np.arange(x, min(x + 128, len(n)))
        differ = _differ(m[i], m)
        ok = _passes(n[i][:, None], n[None, :], differ, num, den) & (np.arange(len(n))[None, :] < i[:, None])
        differ[~ok] = 64 * m.shape[1] + 1
        some[i] |= ok.any(1)
        some |= ok.any(0)
        p = np.flatnonzero(ok.any(1))
        out.append((i[p], differ.argmin(1)[p]))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), some


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        differ += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return differ


def _across(left: tuple, right: tuple, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left node with side True and a right one, of different components, that pass. Both: sizes, bitmaps, components."""
    (n1, m1, c1), (n2, m2, c2) = left, right
    chosen = np.flatnonzero(side)
    out = [(np.zeros(0, np.int64),) * 2]
    for x in range(0, len(chosen), 128):
        i = chosen[x : x + 128]
        ok = _passes(n1[i][:, None], n2[None, :], _differ(m1[i], m2), num, den) & (c1[i][:, None] != c2[None, :])
        p, q = np.nonzero(ok)
        out.append((i[p], q))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_EDGE = "a long, b long, t long, s long"


def _edges_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], ["a", "b", "t", "s"])


def _again_batch(t: np.ndarray, s: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(which), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(t[which].view(np.int64)), pa.array(s[which])], ["a", "b", "t", "s"])


def _candidates(num: int, den: int):
    """Nearest neighbours as candidate pairs; nodes with other pairs that pass, once more, for the second round."""

    def run(batches):
        got = [_unpack(x) for b in batches for x in b.column("data").to_pylist()]
        if not got:
            return
        t, code, s, n, blocks = (_joined(got, c) for c in ("t", "code", "s", "n", "b"))
        m = pa.concat_arrays([x.column("m") for x in got])
        del got
        m = np.frombuffer(m.buffers()[2], np.uint64).reshape(len(m), -1)
        order = np.lexsort((s, n, code, t))
        t, code, s, n, m, blocks = t[order], code[order], s[order], n[order], m[order], blocks[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(t)))
        small = (code[first] == 0) & (size > 1)
        group = np.cumsum(new) - 1
        rest = (first + size)[group] - np.arange(len(t)) - 1
        rest[~small[group]] = 0
        total = np.cumsum(rest)
        at = 0
        while at < len(t):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 300_000, "right")))
            i = np.repeat(np.arange(at, end), rest[at:end])
            j = ragged(np.arange(at, end) + 1, rest[at:end])
            at = end
            close = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            i, j = i[close], j[close]
            near = np.bitwise_count(m[i] ^ m[j]).sum(1, dtype=np.int64)
            ok = _passes(n[i], n[j], near, num, den)
            if ok.any():
                i, j, near = i[ok], j[ok], near[ok]
                best = np.lexsort((i, near, j))
                best = best[np.concatenate([[True], j[best][1:] != j[best][:-1]])]
                yield _edges_batch(s[i[best]], s[j[best]])
                if len(best) < len(i):  # the group's other pairs may matter in the second round
                    some = np.unique(group[j[np.setdiff1d(np.arange(len(i)), best)]])
                    member = np.unique(np.concatenate([i, j]))
                    yield _again_batch(t, s, member[np.isin(group[member], some)])
        for g in np.flatnonzero(code[first] > 0):
            own = slice(first[g], first[g] + size[g])
            a, b, some = _nearest(n[own], m[own], num, den)
            yield _edges_batch(s[own][a], s[own][b])
            if blocks[own.start] > 1:  # other blocks are yet to be met
                some[:] = True
            yield _again_batch(t, s, own.start + np.flatnonzero(some))

    return run


def _second(num: int, den: int):
    """Pairs that pass, of different components, of a node outside its group's largest component with another.

    Rows come sorted by group and block. Two nodes outside it meet in all blocks; their pair is made in one.
    """

    def run(batches):
        def groups():
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                g = np.stack([batch.column("t").to_numpy(), batch.column("block").to_numpy()])
                cut = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1
                for x, y in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                    if y > x:
                        if last is not None and tuple(g[:, x]) != last:
                            yield held
                            held = []
                        held.append(batch.slice(x, y - x))
                        last = tuple(g[:, x])
            if held:
                yield held

        for held in groups():
            comp, s, n, minor = (_joined(held, c) for c in ("c", "s", "n", "minor"))
            block, blocks = held[0].column("block")[0].as_py(), held[0].column("blocks")[0].as_py()
            maps = [np.frombuffer(x, np.uint64) for h in held for x in h.column("m").to_pylist()]
            words = np.array([len(m) for m in maps])
            for w in np.unique(words):
                # Sizes that can link differ by less than a half, so their bitmaps by a factor of two at most.
                folded = lambda own, w=w: (n[own], np.stack([fold(maps[x], w) for x in own]), comp[own])
                same, twice = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
                turns = [(same, same), (same, twice), (twice, same)] if len(twice) else [(same, same)]
                sides = {id(x): folded(x) for x in (same, twice) if len(x)}
                found = [(x, y, _across(sides[id(x)], sides[id(y)], minor[x].astype(bool), num, den)) for x, y in turns]
                a, b = (np.concatenate(z) for z in zip(*((x[i], y[j]) for x, y, (i, j) in found), strict=True))
                both = minor[a].astype(bool) & minor[b].astype(bool)
                turn = (mix64(np.minimum(s[a], s[b]).view(np.uint64)) % np.uint64(blocks)).astype(np.int64) == block
                keep = ~both | (turn & (s[a] < s[b]))
                a, b = s[a[keep]], s[b[keep]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


# ---- verification --------------------------------------------------------------------------------


def shares_all(x: bytes, y: bytes) -> bool:
    """Whether two sets have an element in both prefixes under every further order."""
    a, b = (np.frombuffer(v, np.uint32).reshape(len(ORDERS), -1) for v in (x, y))
    return all(len(np.intersect1d(p, q)) for p, q in zip(a, b, strict=True))


def _close(num: int, den: int):
    """Pairs that share prefixes under all orders, and that their full bitmaps, folded to one size, leave possible."""

    def run(batches):
        for batch in batches:
            n1, n2 = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            shared = [shares_all(x, y) for x, y in zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)]
            differ = []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(a), len(b))
                differ.append(int(np.bitwise_count(fold(a, w) ^ fold(b, w)).sum()))
            yield batch.select(["a", "b"]).filter(pa.array(np.array(shared, bool) & _passes(n1, n2, np.array(differ, np.int64), num, den)))

    return run


def _wanted(parts: int):
    def run(batches):
        def rows():
            for batch in batches:
                if batch.num_rows:
                    k = batch.column("key").to_numpy()
                    yield from _by_key(((k.view(np.uint64) & np.uint64((1 << 48) - 1)) % np.uint64(parts)).astype(np.int64), {"k": k}, 0)

        yield from _send(rows())

    return run


def _wanted_sets(doc_id: str, text: str, k: int):
    def run(batches):
        asked: list = []
        ready = None
        seen: set[int] = set()
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == 0:
                    asked.append(_unpack(data))
                    continue
                if ready is None:
                    ready = np.unique(_joined(asked, "k"))
                whole = _unpack(data)
                if len(ready):
                    keys = row_keys(whole.column(doc_id), whole.column(text)).view(np.int64)
                    whole = whole.filter(pa.array(ready[np.minimum(np.searchsorted(ready, keys), len(ready) - 1)] == keys))
                    for part in by_bytes(whole, text):
                        values, starts = sets(part.column(text), k)
                        # Rows alike in id and text come to one partition; one of them is enough.
                        once = [(s, values[a:b].tobytes()) for s, a, b in zip(_sigs(values, starts).tolist(), starts[:-1], starts[1:], strict=True) if not (s in seen or seen.add(s))]
                        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in once], pa.int64()), pa.array([e for _, e in once], pa.binary())], ["sig", "elements"])

    return run


def _verified(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that edges a - b reach): alternating large and small stars."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        star = large.join(down, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = star.unionAll(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small, "edges")
        old, now = (e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (edges, small))
        edges = small
        if old == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each row.

    doc_id: an integer column.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hot = spark.sparkContext.broadcast(hot_elements(docs, "text", k, num, den))  # HOT_MOST numbers at most
    table = materialize(map_batches(docs, _table("doc_id", "text", k, num, den, hot), "doc_id long, key long, sig long, n long, prefix binary, bitmap binary, orders binary"), "sets")
    own = table.where("prefix IS NOT NULL")
    groups = map_batches(deal(map_batches(own.select("sig", "prefix"), _postings(parts, hot), MESSAGE), parts), _groups(parts), MESSAGE)
    nodes = map_batches(own.select("sig", "n", "bitmap"), _nodes(parts), MESSAGE)
    met = map_batches(deal(groups.unionAll(nodes), parts), _meet(parts), MESSAGE)
    found = materialize(map_batches(deal(met, parts), _candidates(num, den), _EDGE), "candidates")

    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    again = found.where("s IS NOT NULL").select("t", "s")
    bits = materialize(own.select("sig", "n", "bitmap", "orders").dropDuplicates(["sig"]), "bitmaps")

    def filtered(pairs: DataFrame) -> DataFrame:
        """Before whole sets are fetched, pairs are held against all further orders and the full bitmaps."""
        both = pairs.join(bits.toDF("a", "na", "ma", "oa"), "a").join(bits.toDF("b", "nb", "mb", "ob"), "b")
        return map_batches(both, _close(num, den), "a long, b long")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        keys = own.select("sig", "key").join(asked, "sig", "left_semi").groupBy("sig").agg(F.min("key").alias("key")).select("key")
        wanted = map_batches(keys, _wanted(parts), MESSAGE).unionAll(map_batches(docs, _packs("doc_id", "text", parts), MESSAGE))
        got = materialize(map_batches(deal(wanted, parts).sortWithinPartitions("kind"), _wanted_sets("doc_id", "text", k), "sig long, elements binary"), "elements")
        both = pairs.join(got.toDF("a", "ea"), "a").join(got.toDF("b", "eb"), "b")
        return materialize(map_batches(both, _verified(num, den), "a long, b long"), "links")

    first = links(filtered(pairs))
    roots = components(first)
    placed = again.join(roots, F.col("s") == F.col("node"), "left").select("t", "s", F.coalesce("root", "s").alias("c"))
    # The groups with several components: their largest one, and into how many blocks it is dealt.
    sizes = placed.groupBy("t", "c").agg(F.count("*").alias("k")).groupBy("t").agg(F.max(F.struct("k", "c"))["c"].alias("major"), F.sum("k").alias("size"), F.count("*").alias("several")).where("several > 1")
    mixed = sizes.select("t", "major", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    placed = placed.join(mixed, "t").withColumn("minor", F.col("c") != F.col("major"))
    spread = F.when(F.col("minor"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("s"), F.col("blocks"))))
    placed = materialize(placed.select("t", "s", "c", "minor", "blocks", F.explode(spread).alias("block")), "again")
    if not placed.isEmpty():
        placed = placed.join(bits.select(F.col("sig").alias("s"), "n", F.col("bitmap").alias("m")), "s").select("t", "block", "blocks", "s", "n", "m", "c", F.col("minor").cast("int").alias("minor"))
        placed = placed.repartition(parts, "t", "block").sortWithinPartitions("t", "block")
        more = links(filtered(map_batches(placed, _second(num, den), "a long, b long").distinct()))
        roots = components(first.unionAll(more))
    labelled = table.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(roots, F.col("sig") == F.col("node"), "left").select("doc_id", "n", F.coalesce("root", "sig").alias("label"))
    return _with_least(labelled, parts, doc_id)


def _with_least(labelled: DataFrame, parts: int, doc_id: str) -> DataFrame:
    """Rows with the smallest id of their label. Labels of many rows are few and broadcast, so that no task has all of one."""
    labelled = materialize(labelled, "labelled")
    least = materialize(labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")), "least")
    most = least.agg(F.sum("k").alias("k")).first().k or 0
    large = least.where(F.col("k") > max(most // (4 * parts), 1))  # at most 4 * parts labels
    known = F.broadcast(large.select(F.col("label").alias("l"), F.struct("least").alias("big")))
    marked = labelled.join(known, F.col("label") == F.col("l"), "left").drop("l")
    rest = marked.where("big IS NULL").drop("big").join(least.select(F.col("label").alias("l"), "least"), F.col("label") == F.col("l"), "left")
    every = marked.where("big IS NOT NULL").select("doc_id", "n", "label", F.col("big.least").alias("least")).unionAll(rest.select("doc_id", "n", "label", "least"))
    return every.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
