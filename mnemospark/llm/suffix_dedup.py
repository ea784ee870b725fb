"""Suffix-array dedup of repeated byte strings, by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id is removed.

Parsing: the rolling hash of each 16-byte string is compared with its neighbours; where it is the least within a
LENGTH-byte window, it triggers. Windows that follow one another with the same trigger form a phrase, so the phrases of
a text depend on its content alone, and equal windows lie in phrases of one trigger. Four shuffles follow:

1. The triggers of all texts. Those of a single document end here; nothing that repeats can lie around them.
2. Texts meet the triggers they share with others. Phrases around these form the dictionary; within a task a phrase
   is kept once, with the least document that has it, and later documents' places are marked at once.
3. Dictionary phrases of one trigger meet. The suffix array of the dictionary, to LENGTH bytes, puts equal windows
   next to each other. Phrases overlap by LENGTH - 1 bytes, so no window leaves its phrase, and of the parse its
   documents are all that the order of two equal windows hangs on: where a phrase stands is kept as a list sorted by
   document, in place of a suffix array of the parse. Both combined give each window's first document; windows with an
   earlier one are marked. The windows of a trigger with many phrases are sorted in passes of bounded size.
4. Marks meet their texts, and what is marked goes.

Null texts count as empty. Rows without an id come after all others; rows of one id don't remove each other's bytes.
Rows alike in id and text get the same result. An empty table has no rows. Other columns pass through. Hashes have 64 bits (48 in the first
filter); windows are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_bytes, deal, map_batches, mix64, ragged, sliding_min, text_bytes, window_hashes, word_hashes

LENGTH, TRIGGER = 50, 16
#: Windows in a phrase, at most; longer runs of one trigger (periodic text) are several phrases.
PHRASE = LENGTH - TRIGGER + 1
#: Sizes at which a task hands on what it has gathered: triggers, phrases, bytes of text, windows to sort at once.
FLUSH_TRIGGERS, FLUSH_PHRASES, FLUSH_BYTES, SORT_WINDOWS = 600_000, 200_000, 8_000_000, 300_000

#: All four shuffles carry such rows; what comes first in a partition has the lower kind.
MESSAGE = "key int, kind int, data binary"
LAST = np.iinfo(np.int64).max


def _pack(columns: dict) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns) if isinstance(columns, dict) else columns
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, data = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["key", "kind", "data"])


def _by_key(keys: np.ndarray, columns: dict[str, np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = {name: pa.array(values[order]) if isinstance(values, np.ndarray) else values.take(pa.array(order)) for name, values in columns.items()}
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(keys[a]), kind, _pack({name: values.slice(a, b - a) for name, values in columns.items()})


def _send(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8_000_000 or len(held) >= 500:
            yield _messages(held)
            held, size = [], 0
    yield _messages(held)


def row_keys(ids: pa.Array, texts: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t or "", (i if i is not None else LAST) & 0xFFFFFFFFFFFFFFFF) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], np.uint64)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of windows with one trigger: first window, number of windows, row, trigger's hash (48 bits)."""
    lengths = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not lengths.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    least = sliding_min(window_hashes(data, TRIGGER), LENGTH - TRIGGER + 1)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = ragged(offsets[:-1], lengths)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return at[first], n, row[first], mix64(value[first]) >> np.uint64(16)


def _six(values: np.ndarray) -> pa.Array:
    """48-bit numbers as six bytes each."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(6), len(values), [None, pa.py_buffer(raw)])


def _from_six(column: pa.Array) -> np.ndarray:
    raw = np.zeros((len(column), 8), np.uint8)
    if len(column):
        raw[:, :6] = np.frombuffer(column.buffers()[1], np.uint8)[6 * column.offset : 6 * (column.offset + len(column))].reshape(-1, 6)
    return raw.view("<u8").ravel().astype(np.uint64)


def _joined(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    parts = [_from_six(b.column(name)) if pa.types.is_fixed_size_binary(b.schema.field(name).type) else b.column(name).to_numpy(zero_copy_only=False) for b in batches]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


# ---- the four steps ------------------------------------------------------------------------------


def _triggers(doc_id: str, text: str, parts: int):
    def run(batches):
        def rows():
            found: list = []
            size = 0

            def out():
                f, k = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from _by_key((f % np.uint64(parts)).astype(np.int64), {"f": _six(f), "k": _six(k & np.uint64((1 << 48) - 1))}, 0)

            for batch in (part for whole in batches for part in by_bytes(whole, text)):
                keys = row_keys(batch.column(doc_id), batch.column(text))
                _, _, row, f = phrases(*text_bytes(batch.column(text)))
                found.append((f, keys[row]))
                size += len(f)
                if size > FLUSH_TRIGGERS:
                    yield from out()
                    found, size = [], 0
            if found:
                yield from out()

        yield from _send(rows())

    return run


def _shared(parts: int):
    def run(batches):
        got = [_unpack(x) for b in batches for x in b.column("data").to_pylist()]
        f, k = _joined(got, "f"), _joined(got, "k")
        order = np.lexsort((k, f))
        f, k = f[order], k[order]
        new = np.ones(len(f), bool)
        new[1:] = f[1:] != f[:-1]
        group = np.cumsum(new) - 1
        first = k[new]
        several = np.zeros(len(first), bool)
        several[group[k != first[group]]] = True
        again = np.zeros(len(f), bool)
        again[1:] = ~new[1:] & (k[1:] == k[:-1])
        keep = several[group] & ~again
        f, k = f[keep], k[keep]
        yield from _send(_by_key((k % np.uint64(parts)).astype(np.int64), {"f": _six(f), "k": _six(k)}, 0))

    return run


def _packs(doc_id: str, text: str, parts: int):
    """All rows, packed by where they go; nothing is lost of them."""

    def run(batches):
        def rows():
            held: list = []
            size = 0

            def out():
                whole = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
                keys = np.concatenate([k for _, k in held])
                part = ((keys & np.uint64((1 << 48) - 1)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    own = whole.take(pa.array(order[a:b])).combine_chunks()
                    yield int(part[a]), 1, _pack(own.to_batches()[0])

            for batch in batches:
                if batch.num_rows:
                    held.append((batch, row_keys(batch.column(doc_id), batch.column(text))))
                    size += batch.nbytes
                if size > FLUSH_BYTES:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

        yield from _send(rows())

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _intervals(key: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    yield from _by_key(((key & np.uint64((1 << 48) - 1)) % np.uint64(parts)).astype(np.int64), {"key": key, "start": start.astype(np.int64), "end": end.astype(np.int64)}, 0)


def _dictionary(doc_id: str, text: str, parts: int):
    def run(batches):
        def rows():
            shared: list = []
            ready = None
            held: list = []
            size = 0

            def out():
                """Phrases kept once, with the least document; places in later documents are marked."""
                content = pa.concat_arrays([h[0] for h in held])
                mark, f, doc, key, at = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
                order = np.lexsort((doc, mark, f))
                same = (f[order][1:] == f[order][:-1]) & (mark[order][1:] == mark[order][:-1])
                group = np.cumsum(np.concatenate([[True], ~same])) - 1
                least = doc[order][np.flatnonzero(np.concatenate([[True], ~same]))][group]
                later = order[doc[order] > least]
                size = np.asarray(pc.binary_length(content))
                yield from ((k, 2, d) for k, _, d in _intervals(key[later], at[later], at[later] + size[later], parts))
                kept = np.sort(order[doc[order] == least])
                yield from _by_key((f[kept] % np.uint64(parts)).astype(np.int64), {"c": content.take(pa.array(kept)), "f": _six(f[kept]), "doc": doc[kept], "key": key[kept], "at": at[kept]}, 3)

            for batch in batches:
                for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if kind == 0:
                        shared.append(_unpack(data))
                        continue
                    if ready is None:
                        k, f = _joined(shared, "k"), _joined(shared, "f")
                        order = np.lexsort((f, k))
                        ready, shared = (k[order], f[order]), []
                    for part in by_bytes(_unpack(data), text):
                        keys = row_keys(part.column(doc_id), part.column(text))
                        bytes_, offsets = text_bytes(part.column(text))
                        start, n, row, f = phrases(bytes_, offsets)
                        short = keys & np.uint64((1 << 48) - 1)
                        a, b = np.searchsorted(ready[0], short, "left"), np.searchsorted(ready[0], short, "right")
                        # Row and trigger in one number; rows of a slice are few.
                        known = (np.repeat(np.arange(len(keys), dtype=np.uint64), b - a) << np.uint64(48)) | ready[1][ragged(a, b - a)]
                        asked = (row.astype(np.uint64) << np.uint64(48)) | f
                        keep = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(len(asked), bool)
                        start, n, row, f = start[keep], n[keep], row[keep], f[keep]
                        pieces = -(-n // PHRASE)
                        which = ragged(np.zeros(len(n), np.int64), pieces)
                        start, left, row, f = np.repeat(start, pieces) + which * PHRASE, np.repeat(n, pieces) - which * PHRASE, np.repeat(row, pieces), np.repeat(f, pieces)
                        n = np.minimum(left, PHRASE) + LENGTH - 1
                        if not len(n):
                            continue
                        content = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(bytes_[ragged(start, n)])])
                        held.append((content, word_hashes(bytes_, start, start + n), f, _numbers(part.column(doc_id))[row], keys[row], start - offsets[row]))
                        size += len(n)
                        if size > FLUSH_PHRASES:
                            yield from out()
                            held, size = [], 0
            if held:
                yield from out()

        yield from _send(rows())

    return run


def first_documents(data: np.ndarray, starts: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each window, in the order of phrases and windows.

    The suffix array of the dictionary to LENGTH bytes: windows sorted as big-endian words; equal ones are neighbours.
    More windows than SORT_WINDOWS are sorted in several passes, equal ones in one, by a hash of their bytes.
    """
    size = n + LENGTH - 1
    data = data[ragged(starts, size)]
    at = ragged(np.cumsum(size) - size, n)
    own = np.repeat(doc, n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))  # the word that starts at each byte
    places = (*range(0, LENGTH - 8, 8), LENGTH - 8)
    out = np.empty(len(at), np.int64)
    passes = -(-len(at) // SORT_WINDOWS)
    turn = np.zeros(len(at), np.uint64)
    for k in places if passes > 1 else ():
        turn = mix64(turn ^ words[at + k].astype(np.uint64))
    turn %= np.uint64(max(passes, 1))
    for p in range(passes):
        some = np.flatnonzero(turn == p)
        if not len(some):
            continue
        keys = [words[at[some] + k].astype(np.uint64) for k in places]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for w in keys:
            w = w[order]
            new[1:] |= w[1:] != w[:-1]
        least = np.minimum.reduceat(own[some][order], np.flatnonzero(new))
        out[some[order]] = least[np.cumsum(new) - 1]
    return out


def _marks(parts: int):
    def run(batches):
        def rows():
            got = []
            for batch in batches:
                for key, kind, data in zip(batch.column("key").to_pylist(), batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if kind == 2:
                        yield key, 0, data
                    else:
                        got.append(_unpack(data))
            if not got:
                return
            content = pa.concat_arrays([b.column("c") for b in got])
            f, doc, key, at = (_joined(got, x) for x in ("f", "doc", "key", "at"))
            del got
            data, offsets = np.frombuffer(content.buffers()[2], np.uint8), np.frombuffer(content.buffers()[1], np.int32)[: len(content) + 1].astype(np.int64)
            size = np.diff(offsets)
            mark = word_hashes(data[: offsets[-1]], offsets[:-1], offsets[1:])
            order = np.lexsort((doc, mark, f))
            f, mark, doc, key, at, start, size = f[order], mark[order], doc[order], key[order], at[order], offsets[:-1][order], size[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (mark[1:] != mark[:-1])
            entry = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            least = doc[head]
            later = doc > least[entry]
            yield from _intervals(key[later], at[later], at[later] + size[later], parts)
            # Triggers with several phrases: their windows can have earlier documents in other phrases.
            fresh = np.ones(len(head), bool)
            fresh[1:] = f[head][1:] != f[head][:-1]
            group = np.cumsum(fresh) - 1
            several = np.bincount(group)[group] > 1
            entries = np.flatnonzero(several)
            total = np.cumsum(size[head[entries]] - LENGTH + 1)
            begin = 0
            while begin < len(entries):
                end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SORT_WINDOWS, "right"))
                end = max(end, begin + 1)
                while end < len(entries) and group[entries[end]] == group[entries[end - 1]]:
                    end += 1  # the phrases of a trigger stay together
                some = entries[begin:end]
                begin = end
                n = size[head[some]] - LENGTH + 1
                first = first_documents(data, start[head[some]], n, least[some])
                which = np.repeat(np.arange(len(some)), n)
                hit = np.flatnonzero(first < least[some][which])
                if not len(hit):
                    continue
                offset = ragged(np.zeros(len(some), np.int64), n)[hit]
                breaks = np.ones(len(hit), bool)
                breaks[1:] = (np.diff(hit) != 1) | (which[hit][1:] != which[hit][:-1])
                a = np.flatnonzero(breaks)
                z = np.append(a[1:], len(hit)) - 1
                e, lo, hi = some[which[hit[a]]], offset[a], offset[z] + LENGTH
                # Every place in the entry's first document.
                own = np.searchsorted(entry * 2 + later, e * 2, "left"), np.searchsorted(entry * 2 + later, e * 2, "right")
                times = own[1] - own[0]
                place = ragged(own[0], times)
                yield from _intervals(key[place], at[place] + np.repeat(lo, times), at[place] + np.repeat(hi, times), parts)

        yield from _send(rows())

    return run


def _removal(doc_id: str, text: str, keep: list[str], with_text: bool):
    def run(batches):
        marks: list = []
        ready = None
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == 0:
                    marks.append(_unpack(data))
                    continue
                if ready is None:
                    key, start, end = (_joined(marks, x) for x in ("key", "start", "end"))
                    order = np.argsort(key, kind="stable")
                    ready, marks = (key[order], start[order].astype(np.int64), end[order].astype(np.int64)), []
                for part in by_bytes(_unpack(data), text):
                    keys = row_keys(part.column(doc_id), part.column(text))
                    bytes_, offsets = text_bytes(part.column(text))
                    a, b = np.searchsorted(ready[0], keys, "left"), np.searchsorted(ready[0], keys, "right")
                    place = ragged(a, b - a)
                    base = np.repeat(offsets[:-1], b - a)
                    step = np.bincount(base + ready[1][place], minlength=len(bytes_) + 1) - np.bincount(base + ready[2][place], minlength=len(bytes_) + 1)
                    gone = np.cumsum(step)[: len(bytes_)] > 0
                    rise = gone.copy()
                    rise[1:] &= ~gone[:-1]
                    inner = offsets[:-1][offsets[:-1] < len(bytes_)]
                    rise[inner] = gone[inner]
                    before = np.concatenate([[0], np.cumsum(gone)])
                    spans = np.concatenate([[0], np.cumsum(rise)])
                    left = offsets - before[offsets]
                    kept = bytes_[~gone].tobytes()
                    texts = [kept[x:y] for x, y in zip(left[:-1], left[1:], strict=True)]
                    columns = [*(part.column(c) for c in keep), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                    names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                    if with_text:
                        columns.append(pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()))
                        names.append("kept")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and, with_text, ``kept string``; drops the text.

    Characters that a removal cuts in two are not in ``kept``; the hash is of all bytes left.

    doc_id: an integer column.
    """
    more = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    columns = [c for c in docs.columns if c not in more]
    keep = [c for c in columns if c != text]
    docs = docs.select(*columns)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(doc_id, text)
    sort = lambda df: deal(df, parts).sortWithinPartitions("kind")
    shared = map_batches(deal(map_batches(own, _triggers(doc_id, text, parts), MESSAGE), parts), _shared(parts), MESSAGE)
    found = map_batches(sort(shared.unionAll(map_batches(own, _packs(doc_id, text, parts), MESSAGE))), _dictionary(doc_id, text, parts), MESSAGE)
    marks = map_batches(deal(found, parts), _marks(parts), MESSAGE)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept string"] if with_text else [])])
    return map_batches(sort(marks.unionAll(map_batches(docs, _packs(doc_id, text, parts), MESSAGE))), _removal(doc_id, text, keep, with_text), schema)
