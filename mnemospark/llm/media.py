"""Media columns: byte payloads as baseline JPEG files, and luminance thumbnails from the DC coefficients alone.

``store`` writes each text's bytes, padded, as the mean grey values of 8 x 8 blocks: one DC coefficient for each byte,
all AC coefficients zero, a quantizer of 8 and a restart marker after every 24 blocks. The DC-only thumbnail of such a
file is the payload itself, bit for bit. ``read`` parses the markers of any baseline JPEG file, decodes its Huffman
scans, many restart intervals at once in numpy, and rebuilds the thumbnail of the luminance (the first component, whose
scan may hold others too).

Null texts count as empty, an empty text still fills one unit of padding, equal texts have equal files, and payloads
too large for one picture become several files back to back, all of which are read. Media that are null, empty, not
JPEG, not baseline or broken have a null payload and no pictures. An empty table has no rows, and repeated rows give
repeated results. Columns other than those named are passed through.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, ragged

UNIT, PAD, RUN = 576, 255, 24
#: A side of a baseline picture is at most 65,535 pixels.
MOST_ROWS = 65_535 // 8
#: Payload bytes that are worked on at once.
CHUNK = 2_000_000

_D = np.arange(-255, 256)
_SIZE = np.array([int(abs(d)).bit_length() for d in _D], np.int64)
_BITS = 5 + _SIZE  # four for the size, the value, one for the end of the block
_CODE = ((_SIZE << _SIZE | np.where(_D < 0, _D + (1 << _SIZE) - 1, _D)) << 1).astype(np.uint32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(width: int, height: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\0" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"),
        _segment(0xDD, struct.pack(">H", RUN)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def _shapes(n: int) -> list[tuple[int, int]]:
    """Rows and columns, in blocks, of the pictures for a payload of n bytes: UNIT columns, and as many rows as it takes."""
    rows = n // UNIT
    return [(min(MOST_ROWS, rows - at), UNIT) for at in range(0, rows, MOST_ROWS)]


def write_jpegs(payload: np.ndarray, shapes: list[tuple[int, int]]) -> list[bytes]:
    """Baseline JPEG files whose DC-only thumbnails are the given bytes, one after the other."""
    diff = payload.reshape(-1, RUN).astype(np.int64) - 128
    diff[:, 1:] -= diff[:, :-1].copy()
    diff += 255
    n, bits, code = len(diff), _BITS[diff], _CODE[diff]
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    size = (total + 7) // 8
    width = RUN * 13 // 8 + 6
    out = np.zeros(n * width, np.uint8)
    row = np.arange(n) * width
    for j in range(RUN):
        at = ends[:, j] - bits[:, j]
        value = code[:, j] << (24 - (at & 7) - bits[:, j]).astype(np.uint32)
        at = row + (at >> 3)
        out[at] |= (value >> 16).astype(np.uint8)
        out[at + 1] |= (value >> 8).astype(np.uint8)
        out[at + 2] |= value.astype(np.uint8)
    out[row + size - 1] |= np.where(total & 7, 255 >> (total & 7), 0).astype(np.uint8)
    # The marker after each interval: a restart, or the end of the picture.
    count = np.array([r * c // RUN for r, c in shapes])
    last = np.cumsum(count) - 1
    marker = 0xD0 + ragged(np.zeros(len(count), np.int64), count) % 8
    marker[last] = 0xD9
    out = out.reshape(n, width)
    column = np.arange(width)
    stuffed = (out == 255) & (column < size[:, None])
    out[np.arange(n), size] = 255
    out[np.arange(n), size + 1] = marker
    valid = column < size[:, None] + 2
    times = 1 + stuffed[valid]
    data = np.repeat(out[valid], times)
    data[(np.cumsum(times) - 1)[times == 2]] = 0
    cut = np.concatenate([[0], np.cumsum(size + 2 + stuffed.sum(1))[last]])
    return [_header(8 * c, 8 * r) + data[a:b].tobytes() for (r, c), a, b in zip(shapes, cut[:-1], cut[1:], strict=True)]


# ---- reading -------------------------------------------------------------------------------------


def _huffman(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits that may follow; length 0: no such code."""
    symbol, length, at, code = np.zeros(65536, np.int64), np.zeros(65536, np.int64), 16, 0
    for bits in range(1, 17):
        for _ in range(body[bits - 1]):
            span = slice(code << (16 - bits), (code + 1) << (16 - bits))
            symbol[span], length[span] = body[at], bits
            at, code = at + 1, code + 1
        code <<= 1
    return symbol, length


def parse(media: bytes) -> list[dict]:
    """The frames of one or more baseline files back to back: size, tables and where the scan stands."""
    frames, at, quant, tables, frame, restart = [], 0, {}, {}, None, 0
    while at + 4 <= len(media):
        if media[at] != 255:
            raise ValueError("no marker where one is due")
        marker = media[at + 1]
        if marker in (0xD8, 0xD9, 255):
            quant, tables, restart = ({}, {}, 0) if marker == 0xD8 else (quant, tables, restart)
            at += 1 if marker == 255 else 2
            continue
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H" if wide else "B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = {"width": width, "height": height, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = [(h, v, tables[chosen[k] >> 4], tables[16 | chosen[k] & 15]) for k, h, v, _ in frame["parts"] if k in chosen]
            end = at
            while True:
                end = media.index(b"\xff", end)
                if end + 1 >= len(media) or media[end + 1] and not 0xD0 <= media[end + 1] <= 0xD7:
                    break
                end += 2
            if frame["parts"][0][0] in chosen:
                frames.append(frame | {"scan": (at, end), "kind": (tuple(parts), quant[frame["parts"][0][3]], restart)})
            at = end
    if not frames:
        raise ValueError("no picture")
    return frames


def _scan(data: np.ndarray, frames: list[dict], ends: np.ndarray, kind: tuple) -> list[np.ndarray]:
    """Thumbnails of frames with the same tables; data: their scans, each followed by a marker that ends at ends."""
    parts, quant, restart = kind
    single = len(parts) == 1
    blocks = [(k, bx, by) for k, (h, v, _, _) in enumerate(parts) for by in range(1 if single else v) for bx in range(1 if single else h)]
    across, units = [], []
    for f in frames:
        wide, high = (8, 8) if single else (8 * max(p[0] for p in parts), 8 * max(p[1] for p in parts))
        across.append(-(-f["width"] // wide))
        units.append(across[-1] * -(-f["height"] // high))
    # Lanes: stretches between markers, without stuffed bytes.
    first = np.flatnonzero(data[:-1] == 255)
    after = data[first + 1]
    stuffed, marks = first[after == 0] + 1, first[after >= 0xD0]
    kept = np.ones(len(data), bool)
    kept[stuffed] = kept[marks] = kept[marks + 1] = False
    before = np.concatenate([[0], np.cumsum(kept)])
    starts = 8 * before[np.concatenate([[0], marks[:-1] + 2])]
    lane_frame = np.searchsorted(ends, marks, "right")
    data = np.concatenate([data[kept], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    units = np.array(units)
    lanes = np.bincount(lane_frame, minlength=len(frames))
    within = ragged(np.zeros(len(frames), np.int64), lanes)
    todo = np.clip(units[lane_frame] - within * restart, 0, restart) if restart else units[lane_frame]
    order = np.argsort(-todo, kind="stable")
    at, todo = starts[order].astype(np.int64), todo[order]
    trees = [(_huffman(p[2]), _huffman(p[3])) for p in parts]
    last = np.zeros((len(parts), len(at)), np.int64)
    light = [b for b in blocks if b[0] == 0]
    found = np.zeros((int(todo.max(initial=0)), len(light), len(at)), np.int64)

    def peek(p):
        return (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF

    for unit in range(len(found)):
        n = int(np.searchsorted(-todo, -unit, "left"))
        p = at[:n]
        for j, (part, _, _) in enumerate(blocks):
            (symbol, length), (ac, ac_length) = trees[part]
            bits = peek(p)
            size = symbol[bits]
            p += length[bits]
            value = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int64)
            p += size
            last[part, :n] += np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
            if part == 0:
                found[unit, j, :n] = last[0, :n]
            rest, k = np.arange(n), np.ones(n, np.int64)
            while len(rest):
                bits = peek(p[rest])
                sign = ac[bits]
                p[rest] += ac_length[bits] + (sign & 15)
                open_ = sign != 0
                if not open_.any():
                    break
                k[rest] += (sign >> 4) + 1
                rest = rest[open_ & (k[rest] < 64)]
    grey = np.clip((found * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out, lane = [], 0
    for f, wide, n, k in zip(frames, across, units, lanes, strict=True):
        own = grey[:, :, place[lane : lane + k]].transpose(2, 0, 1).reshape(-1, len(light))[:n]
        lane += k
        h, v = (1, 1) if single else parts[0][:2]
        tiles = own.reshape(-1, wide, v, h).transpose(0, 2, 1, 3).reshape(-1, wide * h)
        out.append(tiles[: -(-f["height"] // 8), : -(-f["width"] // 8)])
    return out


#: What reading broken media can raise.
BROKEN = (ValueError, KeyError, IndexError, struct.error, TypeError, OverflowError)


def thumbnails(media: list[bytes]) -> list[list[np.ndarray] | None]:
    """The luminance thumbnails of each value's pictures, an eighth of their size each way; None for broken values."""
    out: list[list | None] = []
    groups = defaultdict(list)
    for i, value in enumerate(media):
        try:
            frames = parse(value)
        except BROKEN:
            out.append(None)
            continue
        out.append([None] * len(frames))
        for j, f in enumerate(frames):
            groups[f["kind"]].append((i, j, f))
    for kind, group in groups.items():
        try:
            pictures = _group(media, kind, group)
        except BROKEN:  # one is broken: each by itself
            pictures = []
            for one in group:
                try:
                    pictures += _group(media, kind, [one])
                except BROKEN:
                    pictures.append(None)
        for (i, j, _), picture in zip(group, pictures, strict=True):
            if picture is None:
                out[i] = None
            elif out[i] is not None:
                out[i][j] = picture
    return out


def _group(media: list[bytes], kind: tuple, group: list) -> list[np.ndarray]:
    data = np.concatenate([np.frombuffer(media[i], np.uint8)[f["scan"][0] : f["scan"][1] + 2] for i, _, f in group])
    ends = np.cumsum([f["scan"][1] + 2 - f["scan"][0] for *_, f in group])
    return _scan(data, [f for *_, f in group], ends, kind)


def thumbnail_hash(picture: np.ndarray) -> str:
    """64 bits: in an 8 x 9 grid of mean grey values, whether each is above its left neighbour."""
    rows = np.linspace(0, picture.shape[0], 9).astype(int)[:-1]
    columns = np.linspace(0, picture.shape[1], 10).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(picture.astype(np.int64), rows, axis=0), columns, axis=1)
    areas = np.outer(np.diff([*rows, picture.shape[0]]), np.diff([*columns, picture.shape[1]]))
    grid = sums / np.maximum(areas, 1)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


# ---- columns -------------------------------------------------------------------------------------


def _chunks(sizes: list[int]):
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= CHUNK):
            total, end = total + sizes[end], end + 1
        yield at, end
        at = end


def _types(df: DataFrame, keep: list[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by ``n_bytes long`` and ``media binary``."""
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "media")]

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            media = []
            for a, b in _chunks([len(r) for r in raw]):
                padded = [r + bytes([PAD]) * (-len(r) % UNIT if r else UNIT) for r in raw[a:b]]
                shapes = [_shapes(len(p)) for p in padded]
                files = iter(write_jpegs(np.frombuffer(b"".join(padded), np.uint8), [s for own in shapes for s in own]))
                media += [b"".join(next(files) for _ in own) for own in shapes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return map_batches(docs, run, ", ".join([*_types(docs, keep), "n_bytes long, media binary"]))


def read(files: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``payload binary`` (all thumbnails' samples) and ``pictures array<struct<width, height, thumb_hash>>``."""
    more = ["payload", "pictures"]
    keep = [c for c in files.columns if c not in more]
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("thumb_hash", pa.string())]))

    def run(batches):
        for batch in batches:
            values = batch.column(media).to_pylist()
            payloads, pictures = [], []
            for a, b in _chunks([len(v or b"") for v in values]):
                for found in thumbnails([v or b"" for v in values[a:b]]):
                    payloads.append(None if found is None else b"".join(p.tobytes() for p in found))
                    pictures.append([{"width": 8 * p.shape[1], "height": 8 * p.shape[0], "thumb_hash": thumbnail_hash(p) if p.size else ""} for p in found or []])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(payloads, pa.binary()), pa.array(pictures, kind)], [*keep, *more])

    return map_batches(files, run, ", ".join([*_types(files, keep), "payload binary, pictures array<struct<width:int,height:int,thumb_hash:string>>"]))
