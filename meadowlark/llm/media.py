"""Media columns as progressive JPEG (operator 2): scans into coefficient arrays, inverse transform, RGB tensors.

`decode` reads any baseline-precision (8-bit) Huffman-coded progressive JPEG of one or three components. A payload is
stored losslessly as quantised coefficients, the unit that the format keeps exactly: 64 bytes are one 8 x 8 block, and
six blocks one 16 x 16 unit of a 4:2:0 image (four of luma, one of each chroma). The coefficients are written by
spectral selection (DC, 1-5, 6-63) and successive approximation (all but the last bit, then the last bit), with
Huffman tables of one symbol, so that every record of a scan is equally wide and whole scans are read as bit arrays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, stored

BLOCK, UNIT = 64, 6
#: Largest number of 16-pixel units along one side.
SIDE = 65535 // 16
BANDS = ((1, 5), (6, 63))
#: What keeps DC differences of neighbouring blocks at ten bits: blocks in turn are lifted by 0 and by this much.
LIFT = 768
SOI, EOI, SOF2, DHT, DQT, SOS, DRI, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDA, 0xDD, 0xFE


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Raster position of each coefficient in zigzag order."""
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8)))
    return np.array(order)


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """64 x 64 integers: pixel values times 2^14 of each coefficient in zigzag order. Integers below 2^53 make the
    transform exact in doubles, so equal blocks give equal pixels on every machine."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(u == 0, np.sqrt(0.5), 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(full[zigzag()] * (1 << 14))


# -- writing ------------------------------------------------------------------------------------------------------


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def one_symbol(kind: int, symbol: int) -> bytes:
    """A Huffman table whose only code, one bit 0, is the symbol."""
    return segment(DHT, bytes([kind << 4, 1, *[0] * 15, symbol]))


def scan(component: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return segment(SOS, bytes([1, component, 0, first, last, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def bits(rows: np.ndarray) -> bytes:
    """0/1 values in order as bytes, filled up with ones."""
    flat = rows.reshape(-1)
    return np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes()


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG that holds payload (a positive multiple of 64 bytes) in its coefficients.

    Byte b of an AC place is the coefficient of magnitude 128 + (b mod 128), negative below 128; of the DC place it is
    b, lifted in every other block. The payload's length is in a comment; unused blocks hold zeros.
    """
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-len(payload) // (BLOCK * UNIT))
    high = -(-units // SIDE)
    wide = -(-units // high)
    blocks = np.zeros((wide * high * UNIT, BLOCK), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = wide * high
    parts = (blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :])
    out = [
        b"\xff\xd8",
        segment(COM, b"payload " + struct.pack(">Q", len(payload))),
        segment(DQT, bytes([0, *[1] * 64])),
        segment(SOF2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        one_symbol(0, 9),
    ]
    lows = []
    for k, part in enumerate(parts, 1):  # DC but for the last bit: a bit 0, then the difference in nine bits
        dc = part[:, 0].astype(np.int32) + LIFT * (1 - np.arange(len(part)) % 2)
        lows.append(dc & 1)
        diff = np.diff(dc >> 1, prepend=0)
        code = np.where(diff > 0, diff, diff + 511)
        wide_bits = (code[:, None] >> np.arange(9, -1, -1)) & 1
        out.append(scan(k, 0, 0, 0, 1, bits(wide_bits.astype(np.uint8))))
    out.append(one_symbol(1, 7))
    for k, part in enumerate(parts, 1):  # a bit 0 and seven bits a coefficient: a byte, never 0xFF
        coded = np.where(part >= 128, part >> 1, 63 - (part >> 1))
        for first, last in BANDS:
            out.append(scan(k, first, last, 0, 1, coded[:, first : last + 1].tobytes()))
    for k, low in enumerate(lows, 1):
        out.append(scan(k, 0, 0, 1, 0, bits(low.astype(np.uint8))))
    out.append(one_symbol(1, 0))
    for k, part in enumerate(parts, 1):  # end of block (a bit 0), then the last bit of each coefficient
        last_bits = part & 1
        last_bits[:, 0] = 0
        out.append(scan(k, 1, 63, 1, 0, np.packbits(last_bits, axis=1).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


# -- reading ------------------------------------------------------------------------------------------------------


class Bits:
    """Bit by bit, for scans whose records differ in width."""

    def __init__(self, data: bytes):
        self.bit = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def get(self, n: int) -> int:
        v = 0
        for b in self.bit[self.at : self.at + n]:
            v = v << 1 | b
        short = self.at + n - len(self.bit)
        self.at += n
        return v << short if short > 0 else v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.get(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def huffman(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at, code, table = at + 17, 0, {}
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                table[n, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        tables[kind >> 4, kind & 15] = table


class Component:
    """One colour component; coef is its part of the image's coefficient array, a row for each block."""

    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant

    def shape(self, units: tuple[int, int], width: int, height: int, most: tuple[int, int]) -> int:
        """Sets stored blocks (whole units) and those that a scan of this component alone has; number of the former."""
        self.cols, self.rows = units[0] * self.h, units[1] * self.v
        self.own_cols = -(-(-(-width * self.h // most[0])) // 8)
        self.own_rows = -(-(-(-height * self.v // most[1])) // 8)
        return self.rows * self.cols

    def own(self) -> np.ndarray | slice:
        if (self.own_rows, self.own_cols) == (self.rows, self.cols):
            return slice(0, self.rows * self.cols)
        r, c = np.arange(self.own_rows)[:, None], np.arange(self.own_cols)[None, :]
        return (r * self.cols + c).reshape(-1)


@lru_cache(maxsize=64)
def signed_values(size: int, low: int) -> np.ndarray:
    """The coefficient of each code of `size` magnitude bits."""
    v = np.arange(1 << size, dtype=np.int32)
    return np.where(v >> (size - 1), v, v - (1 << size) + 1) * (1 << low)


@lru_cache(maxsize=64)
def weights(size: int) -> np.ndarray:
    return 1 << np.arange(size, -1, -1, dtype=np.int32)


def read_uniform(c: Component, table: dict, first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """Reads a scan of one component at once if its records must be equally wide: raw bits, or a table with one
    symbol under which no record can end early. False: the scan isn't of this kind, nothing was read."""
    own = c.own()
    n, a = c.own_rows * c.own_cols, np.frombuffer(data, np.uint8)
    if first == 0 and high:  # raw bits
        c.coef[own, 0] |= np.unpackbits(a, count=n).astype(np.int32) << low
        return True
    if len(table) != 1 or (1, 0) not in table:
        return False
    run, size = divmod(table[1, 0], 16)
    if first == 0:
        if not size:
            return False
        v = np.unpackbits(a, count=n * (1 + size)).reshape(n, 1 + size) @ weights(size)
        c.coef[own, 0] = signed_values(size, 0)[v].cumsum() << low
        return True
    width = last - first + 1
    if not high:
        if run or not size:
            return False
        v = a[: n * width] if size == 7 else np.unpackbits(a, count=n * width * (1 + size)).reshape(n * width, 1 + size) @ weights(size)
        c.coef[own, first : last + 1] = signed_values(size, low)[v].reshape(n, width)
        return True
    known = c.coef[own, first : last + 1]
    if table[1, 0] or not known.all():
        return False
    got = np.unpackbits(a, count=n * (1 + width)).view(np.int8).reshape(n, 1 + width)[:, 1:] << low
    known += np.where(known > 0, got, -got)
    if not isinstance(own, slice):
        c.coef[own, first : last + 1] = known
    return True


def read_scan(parts: list, units: tuple[int, int], tables: dict, first: int, last: int, high: int, low: int, data: bytes, restart: int) -> None:
    """Adds one scan to the coefficient arrays. parts: (component, DC table, AC table)."""
    if len(parts) == 1 and not restart and read_uniform(parts[0][0], tables.get((0, parts[0][1]) if first == 0 else (1, parts[0][2]), {}), first, last, high, low, data):
        return
    if len(parts) == 1:
        c = parts[0][0]
        order = [[(parts[0], y * c.cols + x)] for y in range(c.own_rows) for x in range(c.own_cols)]
    else:
        order = [
            [(p, (y * p[0].v + j) * p[0].cols + x * p[0].h + i) for p in parts for j in range(p[0].v) for i in range(p[0].h)]
            for y in range(units[1])
            for x in range(units[0])
        ]
    pieces = split_restarts(data) if restart else [data]
    bits_in, before, left = Bits(pieces[0]), dict.fromkeys((id(p[0]) for p in parts), 0), 0
    for k, unit in enumerate(order):
        if restart and k and k % restart == 0:
            bits_in, before, left = Bits(pieces[k // restart]), dict.fromkeys(before, 0), 0
        for (c, dc, ac), b in unit:
            block = c.coef[b]
            if first == 0:
                if high:
                    block[0] |= bits_in.get(1) << low
                else:
                    before[id(c)] += bits_in.signed(bits_in.symbol(tables[0, dc]))
                    block[0] = before[id(c)] << low
            elif high:
                left = refine(block, bits_in, tables[1, ac], first, last, low, left)
            elif left:
                left -= 1
            else:
                left = first_pass(block, bits_in, tables[1, ac], first, last, low)


def first_pass(block: np.ndarray, bits_in: Bits, table: dict, first: int, last: int, low: int) -> int:
    """One block of an AC band; returns how many more blocks are empty."""
    k = first
    while k <= last:
        run, size = divmod(bits_in.symbol(table), 16)
        if not size and run < 15:
            return (1 << run) + bits_in.get(run) - 1
        k += run
        if size:
            block[k] = bits_in.signed(size) * (1 << low)
        k += 1
    return 0


def refine(block: np.ndarray, bits_in: Bits, table: dict, first: int, last: int, low: int, left: int) -> int:
    """One more bit of each known coefficient of an AC band, and coefficients that become known with it."""

    def correct(k: int) -> None:
        if bits_in.get(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    k = first
    while k <= last and not left:
        run, size = divmod(bits_in.symbol(table), 16)
        if not size and run < 15:
            left = (1 << run) + bits_in.get(run)
            break
        new = (1 if bits_in.get(1) else -1) * (1 << low) if size else 0
        while k <= last:
            if block[k]:
                correct(k)
            elif run:
                run -= 1
            else:
                block[k] = new
                k += 1
                break
            k += 1
    if left:
        for k in range(k, last + 1):
            if block[k]:
                correct(k)
        left -= 1
    return left


def split_restarts(data: bytes) -> list[bytes]:
    out, at, k = [], 0, 0
    while k < len(data) - 1:
        if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[at:k])
            at = k = k + 2
        else:
            k += 1
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, data[at:]]]


class Image:
    """Coefficient arrays of a progressive JPEG, and what follows from them."""

    def __init__(self, media: bytes):
        a = np.frombuffer(media, np.uint8)
        ff = np.flatnonzero(a[:-1] == 0xFF)
        follow = a[ff + 1]
        ends = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 0xFF)].tolist()
        self.comment, tables, quant, restart, at = b"", {}, {}, 0, 2
        self.parts: dict[int, Component] = {}
        if media[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(media):
            if media[at] != 0xFF:
                raise ValueError("no marker where one must be")
            while media[at + 1] == 0xFF:  # fill bytes
                at += 1
            marker = media[at + 1]
            if marker == EOI:
                break
            (length,) = struct.unpack_from(">H", media, at + 2)
            body = media[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == COM:
                self.comment = body
            elif marker == DHT:
                huffman(body, tables)
            elif marker == DQT:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                    k += 129 if wide else 65
            elif marker == DRI:
                (restart,) = struct.unpack(">H", body)
            elif marker == SOF2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
                self.most = max(c.h for c in self.parts.values()), max(c.v for c in self.parts.values())
                self.units = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
                sizes = [c.shape(self.units, self.width, self.height, self.most) for c in self.parts.values()]
                if sum(sizes) > 8 * len(media):  # every block has a bit at least
                    raise ValueError("too large for its bytes")
                self.coef, start = np.zeros((sum(sizes), 64), np.int32), 0
                for c, blocks in zip(self.parts.values(), sizes, strict=True):
                    c.coef, start = self.coef[start : start + blocks], start + blocks
            elif marker == SOS:
                k = bisect_left(ends, at)
                end = ends[k] if k < len(ends) else len(media)
                data, n = media[at:end], body[0]
                at = end
                chosen = [(self.parts[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
                first, last, shift = body[1 + 2 * n : 4 + 2 * n]
                read_scan(chosen, self.units, tables, first, last, shift >> 4, shift & 15, data if restart else data.replace(b"\xff\x00", b"\xff"), restart)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"not progressive: marker {marker:x}")
        self.quant = quant
        if not self.parts:
            raise ValueError("no image")

    def planes(self) -> list[np.ndarray]:
        """8-bit samples of each component, at its own resolution."""
        parts, out = list(self.parts.values()), np.empty(self.coef.shape, np.uint8)
        q = np.concatenate([np.broadcast_to(self.quant[c.quant], c.coef.shape) for c in parts]) if len({c.quant for c in parts}) > 1 else self.quant[parts[0].quant][None, :]
        for k in range(0, len(out), 4096):
            pixels = (self.coef[k : k + 4096] * (q if len(q) == 1 else q[k : k + 4096])) @ basis()
            pixels += (128 << 14) + (1 << 13)
            pixels *= 1 / (1 << 14)
            np.minimum(np.maximum(pixels, 0, out=pixels), 255, out=pixels)
            out[k : k + 4096] = pixels
        found, start = [], 0
        for c in parts:
            own = out[start : start + c.rows * c.cols]
            start += len(own)
            found.append(own.reshape(c.rows, c.cols, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.cols * 8))
        return found

    def rgb(self) -> np.ndarray:
        """height x width x 3, chroma repeated up to full resolution (JFIF conversion in 16-bit fixed point)."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][: self.height, : self.width, None], 3, axis=2)
        for k, c in enumerate(self.parts.values()):
            if (c.h, c.v) != self.most:
                planes[k] = planes[k].repeat(self.most[1] // c.v, 0).repeat(self.most[0] // c.h, 1)
        y, cb, cr = (p[: self.height, : self.width].astype(np.int32) for p in planes)
        y <<= 16
        y += 32768
        cb -= 128
        cr -= 128
        out = np.empty((*y.shape, 3), np.uint8)
        for k, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
            v >>= 16
            out[:, :, k] = np.minimum(np.maximum(v, 0, out=v), 255, out=v)
        return out

    def payload(self) -> bytes:
        """The bytes that encode_payload stored."""
        if not self.comment.startswith(b"payload "):
            raise ValueError("holds no payload")
        (n,) = struct.unpack(">Q", self.comment[8:])
        v = self.coef.astype(np.int16)
        b = np.where(v > 0, v, -v - 128).astype(np.uint8)  # positive: 128 to 255 as they are
        start = 0
        for c in self.parts.values():
            dc = c.coef[:, 0].astype(np.uint8)
            dc[::2] -= LIFT % 256
            b[start : start + len(dc), 0] = dc
            start += len(dc)
        return b.tobytes()[:n]


def features(image: Image, media: bytes, tensor: np.ndarray) -> dict:
    """What the stored bytes hold: the payload's digests, and sums over the RGB tensor as a feature string."""
    payload = image.payload()
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{tensor.shape[0]}x{tensor.shape[1]}x3 rgb {sums[0]} {sums[1]} {sums[2]}",
    }


def padded(data: Column) -> Column:
    """Bytes (null: none) with bytes 0 appended up to a positive multiple of 64."""
    data = F.coalesce(data.cast("binary"), F.lit(b"").cast("binary"))
    short = F.when(F.octet_length(data) == 0, 64).otherwise((-F.octet_length(data) % 64 + 64) % 64)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), short.cast("int"))))


def store_media(payload: Column) -> Column:
    """A media column: each payload (a positive multiple of 64 bytes) as a progressive JPEG; null stays null."""

    @F.arrow_udf("binary")
    def store(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encode_payload(x) for x in values.to_pylist()], pa.binary())

    return store(payload)


#: What malformed bytes may raise on their way through the reader.
MALFORMED = (ArithmeticError, AttributeError, LookupError, TypeError, ValueError, struct.error)
TENSOR = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])


def tensor_row(t: np.ndarray) -> dict:
    return {"height": t.shape[0], "width": t.shape[1], "data": t.tobytes()}


def rgb_tensors(media: Column) -> Column:
    """Full-resolution RGB tensors of progressive JPEGs: struct(height, width, data); null, or bytes that are no
    progressive JPEG: null."""

    @F.arrow_udf("struct<height:int,width:int,data:binary>")
    def tensors(values: pa.Array) -> pa.Array:
        out = []
        for x in values.to_pylist():
            try:
                out.append(tensor_row(Image(x).rgb()))
            except MALFORMED:
                out.append(None)
        return pa.array(out, TENSOR)

    return tensors(media)


FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with `tensor`, the full-resolution RGB tensor of a media column of store_media as in rgb_tensors, and `found`,
    a struct of features of the stored bytes and of the tensor. Null, and bytes that hold no payload: null in both.
    Columns of df with these names are replaced.

    The media are written as Parquet in the shared folder and decoded from what is read back. The tensors, larger than
    all else here, are a column of the result, stored where its user writes it, and not twice.
    """
    fields = pa.struct([(k, pa.int64() if t == "long" else pa.string()) for k, t in FEATURES.items()])
    kinds = ",".join(f"{k}:{t}" for k, t in FEATURES.items())

    @F.arrow_udf(f"struct<tensor:struct<height:int,width:int,data:binary>,found:struct<{kinds}>>")
    def decoded(values: pa.Array) -> pa.Array:
        tensors, found = [], []
        for x in values.to_pylist():
            try:
                image = Image(x)
                t = image.rgb()
                one = features(image, x, t)
            except MALFORMED:
                t = one = None
            tensors.append(None if t is None else tensor_row(t))
            found.append(one)
        return pa.StructArray.from_arrays([pa.array(tensors, TENSOR), pa.array(found, fields)], ["tensor", "found"])

    kept = df.select(*[named(c) for c in df.columns if c.lower() not in ("tensor", "found")])
    both = fresh(kept, "decoded")[0]
    read = stored(kept).withColumn(both, decoded(named(media)))
    return read.select(*[named(c) for c in kept.columns], F.col(f"{both}.tensor").alias("tensor"), F.col(f"{both}.found").alias("found"))
