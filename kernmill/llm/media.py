"""Media columns: baseline JPEG.

encode() stores a payload as a greyscale baseline JPEG whose 8x8 blocks are
flat: block i is the payload's byte i, carried by the DC coefficient alone with
a DC quantiser of 8, so `8 * (sample - 128) / 8` loses nothing.  Blocks stand in
rows of up to 192, each row is a restart interval, and a payload beyond the
65,535 pixels of one image goes on in further images of the same stream.

decode() takes any such stream, or any baseline greyscale or interleaved JPEG:
it parses the markers, Huffman-decodes the scan and reconstructs the DC-only
luminance thumbnail.  Restart intervals are decoded in lockstep by numpy: step k
handles the k-th symbol of all intervals of all images of a batch, so Python's
overhead is a step's and not a symbol's.

Defined results: a null payload is an empty one; an empty text has a payload of
192 blanks; equal payloads give equal media bytes; a stream that is no baseline
JPEG gives a ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts, with_text

#: Blocks in a row, and rows in one image (8 pixels each, 65,535 at most).
ROW = 192
MAX_ROWS = 8191
#: Fixed values of the format: zig-zag is not needed for DC; these are its markers.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xD0


# --------------------------------------------------------------------- Huffman
def canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) from the counts of a DHT segment."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code += 1
            k += 1
        code <<= 1
    return out


def lookup(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tables over the next 16 bits: symbol, and code length (0: no code)."""
    sym, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, bits) in canonical(lengths, symbols).items():
        sym[code << (16 - bits) : (code + 1) << (16 - bits)] = s
        size[code << (16 - bits) : (code + 1) << (16 - bits)] = bits
    return sym, size


#: DC categories 0 to 8, four bits for most and three for the frequent 5 to 7; AC: only the end of a block.
DC_LENGTHS, DC_SYMBOLS = [0, 0, 3, 6] + [0] * 12, [6, 5, 7, 4, 0, 3, 8, 2, 1]
AC_LENGTHS, AC_SYMBOLS = [1] + [0] * 15, [0]
_DC = canonical(DC_LENGTHS, DC_SYMBOLS)
#: For each difference -255..255: its code, extra bits and the end of the block, left-aligned in 16 bits, and how many.
_CODE, _SIZE = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
for _d in range(-255, 256):
    _cat = abs(_d).bit_length()
    _extra = _d if _d >= 0 else _d + (1 << _cat) - 1
    _code, _bits = _DC[_cat]
    _SIZE[_d + 255] = _bits + _cat + 1
    _CODE[_d + 255] = (_code << _cat | _extra) << 1 << (15 - _bits - _cat)
#: Which of 16 bits count, by size.
_TAKEN = np.arange(16) < np.arange(17)[:, None]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _header(rows: int, columns: int) -> bytes:
    return (
        bytes((0xFF, SOI))
        + _segment(DQT, bytes([0] + [8] * 64))
        + _segment(SOF0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes((1, 0x11, 0)))
        + _segment(DHT, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS]))
        + _segment(DHT, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS]))
        + _segment(DRI, struct.pack(">H", columns))
        + _segment(SOS, bytes((1, 1, 0x00, 0, 63, 0)))
    )


def _scans(samples: np.ndarray, markers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entropy-coded rows of samples (uint8, rows x columns of blocks), each
    followed by 0xFF and its marker; and where each row ends."""
    rows, columns = samples.shape
    index = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255  # each row begins anew at a restart
    code, size = np.empty((rows, columns + 1), np.uint16), np.empty((rows, columns + 1), np.uint8)
    code[:, :-1], size[:, :-1] = _CODE[index], _SIZE[index]
    code[:, -1] = 0xFFFF  # filled up with ones
    bits = size[:, :-1].sum(axis=1, dtype=np.int64)
    size[:, -1] = -bits % 8
    every = np.unpackbits(code.astype(">u2").reshape(-1).view(np.uint8))
    data = np.packbits(every[_TAKEN[size.reshape(-1)].reshape(-1)])
    # stuffing: a zero after each 0xFF
    full = np.flatnonzero(data == 255)
    ends = np.cumsum((bits + 7) // 8)
    ends_stuffed = ends + np.searchsorted(full, ends)
    total = data.size + full.size
    stuffed = np.zeros(total + 2 * rows, np.uint8)
    shift = np.arange(data.size)
    extra = np.zeros(data.size + 1, np.int64)
    extra[full + 1] += 1
    extra[ends[:-1]] += 2
    shift += np.cumsum(extra[:-1])
    stuffed[shift] = data
    ends_all = ends_stuffed + 2 * np.arange(1, rows + 1)
    stuffed[ends_all - 2], stuffed[ends_all - 1] = 255, markers
    return stuffed.tobytes(), ends_all


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """For each payload a JPEG stream (several images if long) whose blocks are
    the payload's bytes; a payload's length is a positive multiple of 192."""
    if not payloads:
        return []
    out: list[list[bytes]] = [[] for _ in payloads]
    batch: list[tuple[int, bytes]] = []
    rows = 0
    for k, p in enumerate(payloads):
        for start in range(0, len(p), MAX_ROWS * ROW):
            part = p[start : start + MAX_ROWS * ROW]
            if rows and rows + len(part) // ROW > MAX_ROWS:  # so that memory is an image's at most
                _put(batch, out)
                batch, rows = [], 0
            batch.append((k, part))
            rows += len(part) // ROW
    _put(batch, out)
    return [b"".join(x) for x in out]


def _put(images: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
    samples = np.frombuffer(b"".join(p for _, p in images), np.uint8).reshape(-1, ROW)
    markers = []
    for _, p in images:
        own = RST0 + np.arange(len(p) // ROW) % 8
        own[-1] = EOI
        markers.append(own)
    flat, ends = _scans(samples, np.concatenate(markers))
    row = begin = 0
    for k, p in images:
        row += len(p) // ROW
        end = int(ends[row - 1])
        out[k] += [_header(len(p) // ROW, ROW), flat[begin:end]]
        begin = end


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


# ---------------------------------------------------------------------- decode
@dataclass
class Frame:
    width: int
    height: int
    dc_step: int
    tables: dict
    blocks: list[tuple[int, int, int]]  # of an MCU: component, DC table, AC table
    mcus: int
    columns: int
    factor: tuple[int, int]
    intervals: list[tuple[int, bytes]]  # MCUs, entropy-coded bytes without stuffing


def parse(data: bytes) -> list[Frame]:
    """The images of a stream."""
    frames, i, n = [], 0, len(data)
    quant: dict = {}
    tables: dict = {}
    sof, restart = None, 0
    while i < n:
        if data[i] != 0xFF or i + 1 >= n:
            raise ValueError("no marker where one is due")
        marker = data[i + 1]
        i += 2
        if marker == SOI:
            quant, tables, sof, restart = {}, {}, None, 0
            continue
        if marker == EOI:
            continue
        size = struct.unpack_from(">H", data, i)[0]
        body = data[i + 2 : i + size]
        i += size
        if marker == DQT:
            k = 0
            while k < len(body):
                wide, t = body[k] >> 4, body[k] & 15
                quant[t] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker == DHT:
            k = 0
            while k < len(body):
                lengths = list(body[k + 1 : k + 17])
                symbols = list(body[k + 17 : k + 17 + sum(lengths)])
                tables[body[k]] = (tuple(lengths), tuple(symbols))
                k += 17 + len(symbols)
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == SOF0:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            sof = (width, height, {body[6 + 3 * c]: (body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(count)})
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == SOS:
            if sof is None:
                raise ValueError("a scan without a frame")
            width, height, components = sof
            scan = [(body[1 + 2 * c], body[2 + 2 * c] >> 4, body[2 + 2 * c] & 15) for c in range(body[0])]
            first = components[scan[0][0]]
            if len(scan) == 1:
                units, factor = [(0, scan[0][1], scan[0][2])], (1, 1)
                columns, rows = -(-width // 8), -(-height // 8)
            else:
                most = max(c[0] for c in components.values()), max(c[1] for c in components.values())
                units = [(k, d, a) for k, (c, d, a) in enumerate(scan) for _ in range(components[c][0] * components[c][1])]
                columns, rows = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
                factor = first[:2]
            total = columns * rows
            every = restart or total
            pieces, begin = [], i
            while True:
                k = data.find(b"\xff", i)
                if k < 0 or k + 1 >= n:
                    raise ValueError("the scan does not end")
                if data[k + 1] == 0:
                    i = k + 2
                    continue
                pieces.append(data[begin:k].replace(b"\xff\x00", b"\xff"))
                i = k
                if RST0 <= data[k + 1] < RST0 + 8:
                    begin = i = k + 2
                    continue
                break
            counts = [min(every, total - every * k) for k in range(len(pieces))]
            if sum(counts) != total or min(counts) <= 0:
                raise ValueError("restart intervals are missing")
            frames.append(Frame(width, height, quant[first[2]], dict(tables), units, total, columns, factor, list(zip(counts, pieces, strict=True))))
    if not frames:
        raise ValueError("no image")
    return frames


_TABLES: dict = {}


def _lookup(spec: tuple) -> tuple[np.ndarray, np.ndarray]:
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[spec] = lookup(list(spec[0]), list(spec[1]))
    return _TABLES[spec]


def _whole(dc: tuple, ac: tuple) -> np.ndarray:
    """Over the next 16 bits: difference << 8 | bits, if these hold a block of a
    DC coefficient alone with its end; else 0."""
    if ("whole", dc, ac) not in _TABLES:
        (dsym, dsize), (asym, asize) = _lookup(dc), _lookup(ac)
        code = np.arange(1 << 16)
        used = dsize + dsym
        extra = code >> np.maximum(16 - used, 0) & ((1 << np.minimum(dsym, 16)) - 1)
        diff = np.where(dsym == 0, 0, np.where(extra >> np.maximum(dsym - 1, 0), extra, extra - (1 << np.minimum(dsym, 16)) + 1))
        after = code << np.minimum(used, 16) & 0xFFFF
        bits = used + asize[after]
        good = (dsize > 0) & (asize[after] > 0) & (asym[after] == 0) & (bits <= 16)
        _TABLES["whole", dc, ac] = np.where(good, diff << 8 | bits, 0).astype(np.int32)
    return _TABLES["whole", dc, ac]


def _signature(f: Frame) -> tuple:
    return tuple((c, f.tables[d], f.tables[0x10 | a]) for c, d, a in f.blocks)


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """The luminance of each block (rows x columns, uint8) of every frame."""
    out: list = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault(_signature(f), []).append(i)
    for signature, members in groups.items():
        lanes = [(i, count, piece) for i in members for count, piece in frames[i].intervals]
        dc = _lockstep(signature, [x[1] for x in lanes], [x[2] for x in lanes])
        luma = sum(1 for x in signature if x[0] == 0)
        k = 0
        for i in members:
            f = frames[i]
            parts = []
            for count, _ in f.intervals:
                parts.append(dc[k, : count * luma])
                k += 1
            units = np.concatenate(parts)
            h, v = f.factor
            rows = f.mcus // f.columns
            grid = units.reshape(rows, f.columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, f.columns * h)
            value = np.clip((grid * f.dc_step + 1028) // 8, 0, 255).astype(np.uint8)  # 8 * 128, and 4 to round
            out[i] = value[: -(-f.height // 8), : -(-f.width // 8)] if len(signature) > 1 else value
    return out


def _lockstep(signature: tuple, counts: list[int], pieces: list[bytes]) -> np.ndarray:
    """DC levels of component 0, a row for each interval."""
    lanes = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8).astype(np.int32)
    words = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]  # 24 bits from each byte
    base = np.concatenate(([0], np.cumsum(lengths)[:-1])) * 8
    position, last = base.copy(), base + lengths * 8
    per = len(signature)
    luma = [k for k, x in enumerate(signature) if x[0] == 0]
    steps = max(counts)
    active_until = np.array(counts)
    out = np.zeros((lanes, steps * len(luma)), np.int32, order="F")
    predictor = np.zeros((lanes, max(x[0] for x in signature) + 1), np.int64, order="F")
    order = np.argsort(-active_until, kind="stable")  # the lanes at work are a prefix
    position, last, sorted_counts = position[order], last[order], active_until[order]
    tables = [(c, _lookup(d), _lookup(a)) for c, d, a in signature]
    whole = [_whole(d, a) for _, d, a in signature]

    def peek(p: np.ndarray) -> np.ndarray:
        return words.take(p >> 3) >> (8 - (p & 7)) & 0xFFFF

    live = lanes
    for step in range(steps):
        while live and sorted_counts[live - 1] <= step:
            live -= 1
        p = position[:live]
        for k in range(per):
            c, (dsym, dsize), (asym, asize) = tables[k]
            code = peek(p)
            got = whole[k].take(code)
            if got.all():  # every lane has a flat block
                predictor[:live, c] += got >> 8
                if c == 0:
                    out[:live, step * len(luma) + luma.index(k)] = predictor[:live, 0]
                p = p + (got & 255)
                continue
            category, size = dsym[code], dsize[code]
            if not size.all():
                raise ValueError("no such DC code")
            p = p + size
            extra = peek(p) >> (16 - category)
            p = p + category
            diff = np.where(extra >> np.maximum(category - 1, 0), extra, extra - (1 << category) + 1)
            level = predictor[:live, c] + np.where(category == 0, 0, diff)
            predictor[:live, c] = level
            if c == 0:
                out[:live, step * len(luma) + luma.index(k)] = level
            # AC coefficients are stepped over up to the end of the block
            code = peek(p)
            symbol, size = asym[code], asize[code]
            p = p + size + (symbol & 15)
            if not size.all():
                raise ValueError("no such AC code")
            if symbol.any():
                index = np.where(symbol == 0, 64, 1 + (symbol >> 4) + 1)
                rest = np.flatnonzero(index < 64)
                while rest.size:
                    code = peek(p[rest])
                    symbol, size = asym[code], asize[code]
                    if not size.all():
                        raise ValueError("no such AC code")
                    p[rest] += size + (symbol & 15)
                    index[rest] = np.where(symbol == 0, 64, index[rest] + (symbol >> 4) + 1)
                    rest = rest[index[rest] < 64]
        if (p > last[:live]).any():
            raise ValueError("the scan ends early")
        position[:live] = p
    back = np.empty_like(out)
    back[order] = out
    return back


def decode(data: bytes) -> bytes:
    """The payload of encode()."""
    return b"".join(t.tobytes() for t in thumbnails(parse(data)))


def feature(samples: np.ndarray) -> str:
    """A 64-bit hash of the thumbnail: which cells of an 8x8 grid of means are
    brighter than their mean, after the dimensions in blocks. Cell (i, j) holds the
    rows and columns from i and j eighths on, one of each at least."""
    edges = [np.arange(8) * n // 8 for n in samples.shape]
    counts = [np.maximum(np.diff(np.append(e, n)), 1) for e, n in zip(edges, samples.shape, strict=True)]
    sums = np.add.reduceat(np.add.reduceat(samples.astype(np.float64), edges[0], axis=0), edges[1], axis=1)
    means = (sums / counts[0][:, None] / counts[1]).reshape(-1)
    bits = int("".join("1" if x else "0" for x in means > means.mean()), 2)
    return f"{samples.shape[1]}x{samples.shape[0]}:{bits:016x}"


# ------------------------------------------------------------------- operators
MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, media binary"


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW or (ROW if not data else 0))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        raw = [t.encode() for t in texts(b.column(1))]
        media = encode_all([pad(x) for x in raw])
        n = [len(x) for x in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([len(pad(x)) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """A media column of the documents' texts: doc_id, n_bytes, payload_bytes, media."""
    return with_text(docs).mapInArrow(_store, MEDIA_SCHEMA)


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, images int"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, text=3):
        media = b.column(3).to_pylist()
        parsed = [parse(m) for m in media]
        thumbs = iter(thumbnails([f for frames in parsed for f in frames]))
        rows = []
        for m, frames in zip(media, parsed, strict=True):
            own = [next(thumbs) for _ in frames]
            samples = np.concatenate([t.reshape(-1, own[0].shape[1]) for t in own])
            payload = samples.tobytes()
            rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples), frames[0].width, frames[0].height, len(frames)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        more = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *more], [x.split()[0] for x in FEATURE_SCHEMA.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """Reads stored media back: payload hash, dimensions and thumbnail hash."""
    return media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(_read, FEATURE_SCHEMA)
