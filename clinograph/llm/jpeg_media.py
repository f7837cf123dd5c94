"""Media columns of baseline JPEG: parsing, Huffman decoding, DC thumbnails and a lossless payload store.

A payload is stored as the quantised coefficients of a grey baseline image: 64 bytes make a block,
in zigzag order.  A byte becomes one of the 256 non-zero values from -128 to 128, coded with the
customary luminance tables, and every block is a restart interval of its own.  Any JPEG decoder can
read such a file.

Restart intervals don't depend on each other, so the decoder goes through the intervals of many
images side by side: each step takes a window of bits of every interval, looks its Huffman code up,
and takes the magnitude behind it.  Images without restart markers are one interval each.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, slices, to_arrow, utf8

# The Huffman tables for luminance that the JPEG standard prints as typical (codes by length, symbols).
DC_TABLE = bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))
AC_TABLE = (
    bytes.fromhex("0002010303020403050504040000017d"),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a"
        "3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a929394"
        "95969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8"
        "e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)


def category(value: np.ndarray) -> np.ndarray:
    """The size category of a coefficient: bits of its magnitude."""
    return np.frexp(np.abs(value).astype(np.float64))[1].astype(np.int64)


def codes(table: tuple[bytes, bytes]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for symbol in table[1][k : k + n]:
            out[symbol] = code, length
            code += 1
        code, k = code << 1, k + n
    return out


def words(values: np.ndarray, table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and magnitude bits of each value, no zeros before it, and how many bits that is."""
    size = category(values)
    code, length = (np.array([codes(table).get(c, (0, 0))[i] for c in range(16)])[size] for i in (0, 1))
    return (code << size | np.where(values < 0, values + (1 << size) - 1, values)).astype(np.uint64), (length + size).astype(np.uint8)


VALUE_OF_BYTE = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int64)
BYTE_OF_VALUE = np.zeros(257, np.uint8)
BYTE_OF_VALUE[VALUE_OF_BYTE + 128] = np.arange(256)
(AC_WORD, AC_BITS), (DC_WORD, DC_BITS) = words(VALUE_OF_BYTE, AC_TABLE), words(VALUE_OF_BYTE, DC_TABLE)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLES = segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]) + segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1])
ONES = segment(0xDB, bytes([0] + [1] * 64))
EVERY_BLOCK = segment(0xDD, b"\0\1")
SCAN = segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def bit_stream(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of blocks of 64 bytes, each from a byte of its own and filled up with ones, and where each ends."""
    value, bits = np.zeros((len(blocks), 65), np.uint64), np.zeros((len(blocks), 65), np.uint8)
    value[:, :64], bits[:, :64] = AC_WORD[blocks], AC_BITS[blocks]
    value[:, 0], bits[:, 0] = DC_WORD[blocks[:, 0]], DC_BITS[blocks[:, 0]]
    ends = bits.cumsum(1, dtype=np.int64)
    bits[:, 64] = -ends[:, 63] % 8
    value[:, 64] = (1 << bits[:, 64].astype(np.uint64)) - 1
    ends[:, 64] += bits[:, 64]
    last = np.cumsum(ends[:, 64])
    ends += (last - ends[:, 64])[:, None]
    ends, value = ends.reshape(-1), value.reshape(-1)
    begin = ends - bits.reshape(-1)
    word, over = begin >> 6, ends - (begin >> 6 << 6) - 64  # bits that reach into the next word
    inside = over <= 0
    high = np.where(inside, value << np.where(inside, -over, 0).astype(np.uint64), value >> np.where(inside, 0, over).astype(np.uint64))
    out = np.zeros((int(last[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    spill = np.flatnonzero(~inside)
    out[word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: int(last[-1]) >> 3], last >> 3


def encode_all(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each payload a baseline JPEG that holds it, padded with zero bytes to a positive multiple of 64."""
    sizes = np.diff(offsets)
    used = np.maximum(1, -(-sizes // 64))
    across = np.minimum(8191, np.ceil(np.sqrt(used)).astype(np.int64))
    down = -(-used // across)
    if (down > 8191).any():
        raise ValueError("a baseline image has at most 8191 x 8191 blocks")
    first = np.concatenate([[0], np.cumsum(across * down)])
    blocks = np.zeros((first[-1], 64), np.uint8)
    blocks.reshape(-1)[np.arange(len(data)) + np.repeat(first[:-1] * 64 - offsets[:-1], sizes)] = data
    stream, ends = bit_stream(blocks)
    stuffed = np.flatnonzero(stream == 0xFF) + 1
    number = np.arange(len(ends)) - np.repeat(first[:-1], np.diff(first))
    inner = np.ones(len(ends), bool)
    inner[first[1:] - 1] = False  # no marker behind the last block
    places = np.concatenate([stuffed, ends[inner], ends[inner]])
    stream = np.insert(stream, places, np.concatenate([np.zeros(len(stuffed), np.uint8), np.full(inner.sum(), 0xFF, np.uint8), (0xD0 + number[inner] % 8).astype(np.uint8)]))
    cuts = np.concatenate([[0], ends[first[1:] - 1]])
    cuts += np.searchsorted(np.sort(places), cuts, side="right")
    out = []
    for k, size in enumerate(sizes.tolist()):
        head = segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])) + segment(0xFE, b"payload %d" % size) + ONES
        frame = segment(0xC0, struct.pack(">BHHB", 8, 8 * int(down[k]), 8 * int(across[k]), 1) + bytes([1, 0x11, 0]))
        out.append(b"\xff\xd8" + head + frame + TABLES + EVERY_BLOCK + SCAN + stream[cuts[k] : cuts[k + 1]].tobytes() + b"\xff\xd9")
    return out


def encode(data: bytes) -> bytes:
    return encode_all(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


class Jpeg:
    """What the markers of a baseline JPEG say; `scan` is its entropy-coded data, still stuffed."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        try:
            self.parse(data)
        except (struct.error, IndexError, KeyError) as e:
            raise ValueError("damaged JPEG") from e

    def parse(self, data: bytes) -> None:
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.comments: list[bytes] = []
        self.restart, at = 0, 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, name = body[k] >> 4, body[k] & 15
                    self.quant[name] = list(struct.unpack_from(">64" + ("H" if wide else "B"), body, k + 1))
                    k += 65 + 64 * wide
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    self.huffman[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = {body[6 + 3 * c]: (body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)}
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                self.order = [(body[1 + 2 * c], body[2 + 2 * c] >> 4, 0x10 | body[2 + 2 * c] & 15) for c in range(body[0])]
                break
        end = data.rfind(b"\xff\xd9")
        self.scan = data[at : end if end >= at else len(data)]

    @property
    def kind(self) -> tuple:
        """Images of one kind are decoded together."""
        tables = tuple((name, self.huffman[dc], self.huffman[ac], self.components[name][:2]) for name, dc, ac in self.order)
        return tables, tuple(c[:2] for c in self.components.values()), self.restart or (self.width, self.height)


@lru_cache(16)
def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Code length * 256 + symbol for each 16 bits that may come next; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in codes(table).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a scan without stuffing and markers, and where each restart interval begins."""
    data = np.frombuffer(scan, np.uint8)
    mark = np.flatnonzero(data[:-1] == 0xFF)
    after = data[mark + 1]
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[mark[after == 0] + 1] = False
    keep[mark[after == 0xFF]] = False
    keep[restart] = keep[restart + 1] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)[restart]])


def coefficient(window: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, value, next place) of the Huffman code and magnitude at each bit place."""
    bits = window[at >> 3] << (24 + (at & 7)).astype(np.uint64)
    entry = table[bits >> np.uint64(48)]
    if not entry.all():
        raise ValueError("no such Huffman code")
    length, size = entry >> 8, (entry & 15).astype(np.uint64)
    raw = (bits << length.astype(np.uint64) >> (np.uint64(64) - size)).astype(np.int64)
    half = np.int64(1) << size.astype(np.int64) >> 1
    return entry & 255, np.where(raw < half, raw - 2 * half + 1, raw), at + length + size.astype(np.int64)


def decode_alike(images: list[Jpeg]) -> list[dict[int, np.ndarray]]:
    """For images of one kind: of each component the coefficients in zigzag order, a row a block in raster order."""
    model = images[0]
    most_h, most_v = (max(c[i] for c in model.components.values()) for i in (0, 1))
    single = len(model.order) == 1
    units, grids, across, count, data, starts, total = [], [], [], [], [], [], 0
    for name, dc, ac in model.order:
        h, v = (1, 1) if single else model.components[name][:2]
        units += [(name, y, x, lookup(model.huffman[dc]), lookup(model.huffman[ac])) for y in range(v) for x in range(h)]
    for image in images:
        mcus_x, mcus_y = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        if single:
            h, v, _ = image.components[model.order[0][0]]
            mcus_x, mcus_y = -(-(-(-image.width * h // most_h)) // 8), -(-(-(-image.height * v // most_v)) // 8)
        grids.append({name: np.zeros((mcus_y * (1 if single else image.components[name][1]), mcus_x * (1 if single else image.components[name][0]), 64), np.int32) for name, *_ in image.order})
        across.append(mcus_x)
        count.append(mcus_x * mcus_y)
        plain, begin = intervals(image.scan)
        if len(begin) < -(-count[-1] // (image.restart or max(1, count[-1]))):
            raise ValueError("too few restart intervals")
        data += [plain, np.full(16, 0xFF, np.uint8)]
        starts.append((begin + total) * 8)
        total += len(plain) + 16
    every = model.restart or max(1, count[0])
    parts = [-(-n // every) for n in count]
    at = np.concatenate([s[:n] for s, n in zip(starts, parts)])
    held = np.concatenate([np.minimum(every, n - every * np.arange(k)) for n, k in zip(count, parts)])
    wide = np.concatenate(data).astype(np.uint64)
    window = wide[:-4] << np.uint64(32) | wide[1:-3] << np.uint64(24) | wide[2:-2] << np.uint64(16) | wide[3:-1] << np.uint64(8) | wide[4:]
    last = {name: np.zeros(len(at), np.int64) for name, *_ in model.order}
    limit = 8 * (len(window) - 1)
    out = np.zeros((len(at), every, len(units), 64), np.int16)
    flat = out.reshape(-1)
    for m in range(every):
        rows = np.flatnonzero(held > m)
        for u, (name, _, _, dc, ac) in enumerate(units):
            _, step, place = coefficient(window, np.minimum(at[rows], limit), dc)
            last[name][rows] += step
            base = ((rows * every + m) * len(units) + u) * 64
            flat[base] = last[name][rows]
            live, k = np.arange(len(rows)), np.ones(len(rows), np.int64)
            while len(live):
                symbol, value, place_ = coefficient(window, np.minimum(place[live], limit), ac)
                place[live] = place_
                k += symbol >> 4
                if (k > 63).any() and ((k > 63) & (symbol != 0)).any():
                    raise ValueError("a block of over 64 coefficients")
                flat[base[live] + np.minimum(k, 63)] += value.astype(np.int16)  # nothing for ends and runs of sixteen
                k += 1
                on = (symbol != 0) & (k < 64)
                if not on.all():
                    live, k = live[on], k[on]
            at[rows] = place
    first = 0
    for grid, mcus_x, n, k in zip(grids, across, count, parts):
        mcus = out[first : first + k].reshape(-1, len(units), 64)[:n]
        number, first = np.arange(n), first + k
        for u, (name, y, x, _, _) in enumerate(units):
            h, v = (1, 1) if single else model.components[name][:2]
            grid[name][number // mcus_x * v + y, number % mcus_x * h + x] = mcus[:, u]
    return grids


def decode_scan(image: Jpeg) -> dict[int, np.ndarray]:
    """Coefficients of each component, zigzag order, one row a block in raster order."""
    return decode_alike([image])[0]


def thumbnail(image: Jpeg) -> np.ndarray:
    """The luminance of each 8 x 8 block from its DC coefficient alone."""
    name = image.order[0][0]
    return luminance(decode_scan(image)[name][:, :, 0], image.quant[image.components[name][2]][0])


def luminance(dc: np.ndarray, step: int) -> np.ndarray:
    return np.clip(np.rint(dc * step / 8 + 128), 0, 255).astype(np.uint8)


def feature(width: int, height: int, thumb: np.ndarray) -> str:
    """Dimensions, an 8 x 8 average hash and the CRC-32 of a thumbnail."""
    rows, columns = (np.minimum(np.arange(9) * n // 8, n - 1) for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    top, bottom = rows[:8, None], np.maximum(rows[1:], rows[:8] + 1)[:, None]
    left, right = columns[None, :8], np.maximum(columns[1:], columns[:8] + 1)[None, :]
    mean = (sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]) / ((bottom - top) * (right - left))
    bits = int.from_bytes(np.packbits(mean.reshape(-1) > thumb.mean()).tobytes(), "big")
    return f"{width}x{height}:{bits:016x}:{zlib.crc32(thumb.tobytes()):08x}"


def payload(image: Jpeg, grid: np.ndarray) -> tuple[bytes, int] | None:
    """The stored payload with its padding and its length without; None for an image that holds none."""
    said = next((c for c in image.comments if c.startswith(b"payload ") and c[8:].isdigit()), None)
    if said is None or len(image.order) > 1 or grid.min() < -128 or grid.max() > 128 or not grid.all():
        return None
    size, stored = int(said[8:]), BYTE_OF_VALUE[grid.reshape(-1) + 128]
    padded = max(64, -(-size // 64) * 64)
    return (stored[:padded].tobytes(), size) if padded <= len(stored) else None


def read_back(media: list[bytes | None]) -> list[tuple | None]:
    """(payload, length, feature) of each stored image; payload and length None where an image holds none.

    None for what is null, no baseline JPEG or damaged.
    """
    images, alike = {}, {}
    for i, data in enumerate(media):
        try:
            images[i] = Jpeg(data) if data is not None else None
            if images[i]:
                alike.setdefault(images[i].kind, []).append(i)
        except (ValueError, KeyError):
            continue
    grids = {}
    for group in alike.values():
        try:
            grids |= zip(group, decode_alike([images[i] for i in group]))
        except (ValueError, IndexError):  # one of them is damaged
            for i in group:
                try:
                    grids[i] = decode_scan(images[i])
                except (ValueError, IndexError):
                    continue
    out: list[tuple | None] = [None] * len(media)
    for i, found in grids.items():
        image = images[i]
        name = image.order[0][0]
        step = image.quant.get(image.components[name][2])
        if step and found[name].size:
            out[i] = *(payload(image, found[name]) or (None, None)), feature(image.width, image.height, luminance(found[name][:, :, 0], step[0]))
    return out


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media (the JPEG that holds the text's UTF-8 bytes) for each row; null text: an empty payload.

    Rows are independent; repeated rows and null ids are carried through.  A payload of more than
    4 GB does not fit an image and raises ValueError.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("media", pa.binary())])
            for part in slices(batch, 1):
                yield to_arrow(schema, id=part.column(0), media=encode_all(*flat_bytes(part.column(1))))

    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b")).mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The stored payload's sizes and digests, and the image's feature, from the media column alone.

    A null image gives nulls.  Of media that are no baseline JPEG or damaged only size and digest are
    told; of images that hold no payload those and the feature.
    """
    kind = media.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def of(data: bytes | None, found: tuple | None) -> tuple:
        if data is None:
            return (None,) * 7
        stored, size, image = found or (None,) * 3
        told = (size, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:])) if stored is not None else (None,) * 4
        return *told, len(data), hashlib.sha256(data).hexdigest(), image

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                held = part.column(1).to_pylist()
                rows = [of(*x) for x in zip(held, read_back(held))]
                yield to_arrow(pa.schema([("id", batch.schema.field(0).type), *fields]), id=part.column(0), **{n: [r[k] for r in rows] for k, (n, _) in enumerate(fields)})

    out = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
