"""Media columns: bytes stored as progressive JPEG coefficients and decoded to full-resolution RGB tensors.

Storage is lossless in the format's own unit, the quantised DCT coefficient: every
payload byte b is one AC coefficient b + 256 of a 4:2:0 image (six blocks of 63 AC
coefficients a unit of 16 x 16 pixels), in zigzag order, first all of Y, then Cb, Cr.
The DC coefficients are 0.  The scans are progressive: DC, then for each component
the AC bands 1-5 and 6-63 without their lowest bit, then the lowest bits in one
refining scan each.  Every coefficient has the same size category, so a scan is a
table of equal codes.

Decoding accumulates all scans in coefficient arrays.  It reads any Huffman-coded
baseline or progressive image with 8-bit samples (grey or three components,
restart intervals included); scans of equal codes take a vectorised way.
Coefficients are dequantised, inverse-transformed by one matrix product, chroma is
upsampled by repetition, and the result is a height x width x 3 tensor.

Null counts as the empty text, whose payload is 192 spaces.  Equal texts give equal
values.  Codes, samples and features of a very long text are made piece by piece: a
worker holds about ten times its bytes (text, payload, stored form, coefficients and
tensor).  A text of over 6.3 GB would exceed one image; Spark's strings end at 2 GB.  Repeated rows are stored alike, a null doc_id stays null, other columns are
passed over, empty tables give empty results.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column

UNIT = 192
#: Payload bytes that one unit of 16 x 16 pixels carries: 4 Y blocks, a Cb and a Cr block, 63 each.
MCU_BYTES = 6 * 63
#: Coefficient of byte 0: puts all bytes in the same size category.
SHIFT = 256
MAX_SIDE = 4095  # units a side
#: Pixels that are transformed at once.
STRIPE = 1 << 18


def _zigzag() -> np.ndarray:
    """Natural place of each zigzag place."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([i * 8 + j for i, j in cells])


ZIGZAG = _zigzag()


def _idct() -> np.ndarray:
    """Matrix from 64 zigzag coefficients to 64 samples."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1.0) / 2
    full = np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


IDCT = _idct()


def _stuffed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of a scan: ones fill the last byte, and a zero byte follows each 255."""
    fill = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits)
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, ident: int, symbols: bytes) -> bytes:
    """A Huffman table with equal code lengths, or one code of one bit."""
    length = max(1, len(symbols).bit_length())
    counts = bytearray(16)
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | ident]) + bytes(counts) + symbols)


def _scan(components: list[tuple[int, int, int]], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body)


#: Values whose codes are packed or unpacked at once: bounds the bits that are held one a byte (a multiple of 8).
SLICE = 1 << 16


def _codes_of(values: np.ndarray) -> bytes:
    """Entropy-coded scan of one-bit codes 0, each with the eight bits of a value behind it."""
    out = []
    for i in range(0, len(values), SLICE):
        part = values[i : i + SLICE]
        code = np.zeros((len(part), 9), np.uint8)
        code[:, 1:] = np.unpackbits(part[:, None], axis=1)
        out.append(_stuffed(code.ravel()))
    return b"".join(out)


def _number(value: int, width: int) -> np.ndarray:
    """The lowest `width` bits of a number, highest first."""
    return np.array([value >> k & 1 for k in range(width - 1, -1, -1)], np.uint8)


def _shape(n_units: int) -> tuple[int, int]:
    wide = max(1, min(MAX_SIDE, int(np.ceil(np.sqrt(n_units)))))
    return wide, -(-n_units // wide)


QUANT = bytes(np.concatenate([[16], np.full(63, 1)]).astype(np.uint8).tolist())


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose AC coefficients carry the payload."""
    wide, high = _shape(-(-len(payload) // MCU_BYTES))
    n = wide * high
    if high > MAX_SIDE:
        raise ValueError("payload exceeds one image")
    data = np.zeros(n * MCU_BYTES, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = [data[: n * 252].reshape(n * 4, 63), data[n * 252 : n * 315].reshape(n, 63), data[n * 315 :].reshape(n, 63)]
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + QUANT)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC: size category 0 only.  AC: run 0 with size 8.  Refining: one end-of-band run of 2**14 to 2**15 - 1 blocks, or of one or less.
    out += [_table(0, 0, b"\x00"), _scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 0), _stuffed(np.zeros(n * 6, np.uint8))]
    out.append(_table(1, 0, b"\x08"))
    for k, ac in enumerate(parts, 1):
        for a, b in ((1, 5), (6, 63)):  # a coefficient without its lowest bit, (byte + SHIFT) >> 1
            out += [_scan([(k, 0, 0)], a, b, 0, 1), _codes_of((ac[:, a - 1 : b].ravel() >> 1) | np.uint8(SHIFT >> 1))]
    out.append(_table(1, 0, bytes(r << 4 for r in range(15))))
    for k, ac in enumerate(parts, 1):
        low = ac & 1
        bits, at = [], 0
        while at < len(low):  # end-of-band runs, the correction bits of their blocks behind each
            run = min(len(low) - at, 32767)
            r = run.bit_length() - 1
            bits += [_number(r, 4), _number(run - (1 << r), r), low[at : at + run].ravel()]
            at += run
        out += [_scan([(k, 0, 0)], 1, 63, 1, 0), _stuffed(np.concatenate(bits))]
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Bits:
    """Bits of the entropy-coded data between two markers."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, table: dict) -> int:
        code, length = 0, 0
        while True:
            if self.at >= len(self.bits) or length > 16:
                raise ValueError("no such code")
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            length += 1
            if (length, code) in table:
                return table[length, code]


def _signed(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Image:
    """Coefficient arrays of an image, filled scan by scan."""

    def __init__(self, data: bytes, fast: bool = True):
        self.fast, self.tables, self.quant, self.restart = fast, {}, {}, 0
        self.parts: dict[int, dict] = {}
        self._previous: dict[int, int] = {}
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at)[0]
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                end = at
                while True:  # a scan ends before the next marker that is neither stuffing nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    end += 2
                self._scan(body, data[at:end])
                at = end

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[ident] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            at += 1 + n

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            code, k, table = 0, at + 17, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.tables[body[at] >> 4, body[at] & 15] = table
            at = k

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or n not in (1, 3):
            raise ValueError("8-bit images of one or three components only")
        spec = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(s[1] for s in spec), max(s[2] for s in spec)
        self.mx, self.my = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c, h, v, q in spec:
            self.parts[c] = {
                "h": h, "v": v, "q": q, "bx": self.mx * h, "by": self.my * v, "coef": np.zeros((self.mx * h * self.my * v, 64), np.int16),
                "own": (-(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)),
            }

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        spec = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        units = []
        if n == 1:
            p = self.parts[spec[0][0]]
            wide, tall = p["own"]
            order = (np.arange(tall)[:, None] * p["bx"] + np.arange(wide)).ravel()
            if self.fast and not self.restart and first and self._equal_codes(p["coef"], order, self.tables.get((1, spec[0][2]), {}), data, first, last, high, low):
                return
            units = [[(0, int(b))] for b in order]
        else:
            if self.fast and not self.restart and not last and not high and self._zero_dc(spec, data):
                return
            for y in range(self.my):
                for x in range(self.mx):
                    units.append([(i, (y * p["v"] + r) * p["bx"] + x * p["h"] + s) for i, (c, _, _) in enumerate(spec) for p in (self.parts[c],) for r in range(p["v"]) for s in range(p["h"])])
        pieces, start = [data], 0
        if self.restart:
            pieces, k = [], 0
            while k < len(data) - 1:
                if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
                    pieces.append(data[start:k])
                    start = k = k + 2
                else:
                    k += 2 if data[k] == 0xFF else 1
            pieces.append(data[start:])
        for i, piece in enumerate(pieces):
            bits, self._run, self._previous = _Bits(piece), 0, {}
            for unit in units[i * self.restart : (i + 1) * self.restart] if self.restart else units:
                for c, b in unit:
                    self._block(bits, self.parts[spec[c][0]]["coef"][b], spec[c], first, last, high, low)

    def _zero_dc(self, spec: list, data: bytes) -> bool:
        """A first DC scan of zeros alone."""
        if any(self.tables[0, dc].get((1, 0)) != 0 for _, dc, _ in spec):
            return False
        n = sum(p["bx"] * p["by"] for p in (self.parts[c] for c, _, _ in spec))
        whole = -(-n // 8)
        return len(data) == whole and not np.unpackbits(np.frombuffer(data, np.uint8))[:n].any()

    def _equal_codes(self, coef: np.ndarray, order: np.ndarray, table: dict, data: bytes, first: int, last: int, high: int, low: int) -> bool:
        """AC scans whose coefficients all have one code, or that refine blocks without zeros; false if this is none."""
        n, band = len(order), last - first + 1
        if not high:
            if len(table) != 1:
                return False
            (length, _), symbol = next(iter(table.items()))
            size = symbol & 15
            if symbol >> 4 or not size:
                return False
            raw, step = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8), length + size
            if not 0 <= 8 * len(raw) - n * band * step < 8:
                return False
            v = np.empty(n * band, np.int16)
            weights = (1 << np.arange(size - 1, -1, -1)).astype(np.int32)
            for i in range(0, len(v), SLICE):
                m = min(SLICE, len(v) - i)
                bits = np.unpackbits(raw[i * step // 8 : -(-(i + m) * step // 8)])[: m * step].reshape(m, step)[:, length:]
                got = np.packbits(bits, axis=1)[:, 0].astype(np.int32) if size == 8 else bits @ weights
                v[i : i + m] = np.where(got >> (size - 1), got, got - (1 << size) + 1) << low
            coef[order, first : last + 1] = v.reshape(n, band)
            return True
        old = coef[order, first : last + 1]
        if not old.all():
            return False
        bits, at = _Bits(data), 0
        new = np.empty((n, band), np.uint8)
        while at < n:
            symbol = bits.symbol(table)
            if symbol & 15 or symbol == 0xF0:
                return False
            run = (1 << (symbol >> 4)) + bits.take(symbol >> 4)
            new[at : at + run] = bits.bits[bits.at : bits.at + run * band].reshape(run, band)
            bits.at += run * band
            at += run
        coef[order, first : last + 1] = old + np.sign(old) * (new.astype(np.int16) << low)
        return True

    def _block(self, bits: _Bits, coef: np.ndarray, spec: tuple, first: int, last: int, high: int, low: int) -> None:
        """One block of any scan, by the book."""
        c, dc, ac = spec
        if first == 0:
            if high:
                coef[0] |= bits.take(1) << low
            else:
                size = bits.symbol(self.tables[0, dc])
                self._previous[c] = self._previous.get(c, 0) + _signed(bits.take(size), size)
                coef[0] = self._previous[c] << low
            first = 1
            if not last:
                return
        k, table = first, self.tables[1, ac]
        if not high:
            if self._run:
                self._run -= 1
                return
            while k <= last:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                if size:
                    k += run
                    coef[k] = _signed(bits.take(size), size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    self._run = (1 << run) + bits.take(run) - 1
                    return
            return
        plus = 1 << low

        def refine(j: int) -> None:
            if bits.take(1) and not abs(int(coef[j])) & plus:
                coef[j] += plus if coef[j] > 0 else -plus

        if not self._run:
            while k <= last:
                symbol = bits.symbol(table)
                run, size, value = symbol >> 4, symbol & 15, 0
                if size:
                    value = plus if bits.take(1) else -plus
                elif run < 15:
                    self._run = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if coef[k]:
                        refine(k)
                    elif run:
                        run -= 1
                    else:
                        coef[k] = value
                        k += 1
                        break
                    k += 1
        if self._run:
            for j in range(k, last + 1):
                if coef[j]:
                    refine(j)
            self._run -= 1

    def payload(self, n: int) -> bytes:
        """The first n bytes that encode() stored."""
        ac = [(self.parts[c]["coef"][:, 1:] & 255).astype(np.uint8) for c in sorted(self.parts)]  # byte + SHIFT modulo 256
        return b"".join(x.tobytes() for x in ac)[:n]

    def samples(self, c: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Samples of a component in the block rows from first up to last."""
        p = self.parts[c]
        last = p["by"] if last is None else last
        px = (p["coef"][first * p["bx"] : last * p["bx"]] * self.quant[p["q"]]).astype(np.float32) @ IDCT + np.float32(128)
        return np.clip(px, 0, 255, out=px).reshape(last - first, p["bx"], 8, 8).transpose(0, 2, 1, 3).reshape((last - first) * 8, p["bx"] * 8)

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes at full resolution, made stripe by stripe."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        tall = 8 * self.v
        many = max(1, STRIPE // max(1, tall * self.width))
        for at in range(0, self.my, many):
            end = min(self.my, at + many)
            stripe = out[at * tall : end * tall]
            planes = []
            for c in sorted(self.parts):
                p = self.parts[c]
                s = self.samples(c, at * p["v"], end * p["v"])
                if p["v"] != self.v:
                    s = s.repeat(self.v // p["v"], 0)
                if p["h"] != self.h:
                    s = s.repeat(self.h // p["h"], 1)
                planes.append(s[: len(stripe), : self.width])
            if len(planes) == 1:
                stripe[...] = np.rint(planes[0])[..., None]
                continue
            y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            for i, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
                np.clip(x, 0, 255, out=x)
                stripe[..., i] = np.rint(x, out=x)
        return out


def features(rgb: np.ndarray) -> str:
    """Size, mean of each channel, contrast of green and a checksum of the tensor; sums are exact, stripe by stripe."""
    flat = rgb.reshape(-1, 3)
    sums, squares = np.zeros(3, np.int64), 0
    for i in range(0, len(flat), STRIPE):
        part = flat[i : i + STRIPE]
        sums += part.sum(0, dtype=np.int64)
        squares += int((part[:, 1].astype(np.int64) ** 2).sum())
    mean = sums / len(flat)
    contrast = np.sqrt(max(0.0, squares / len(flat) - mean[1] ** 2))
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f}:{contrast:.3f}:{zlib.crc32(rgb):08x}"


def padded(text: bytes) -> bytes:
    return text + b" " * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, jpeg) of every row of docs (doc_id, text): the stored form."""

    def run(batch: pa.RecordBatch) -> dict:
        data = [t.as_py() or b"" for t in column(batch, "text").cast(pa.binary())]
        return {"doc_id": column(batch, "doc_id"), "n_bytes": [len(x) for x in data], "jpeg": pa.array([encode(padded(x)) for x in data], pa.binary())}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, jpeg binary")


def load(stored: DataFrame) -> DataFrame:
    """What the stored images (doc_id, n_bytes, jpeg) hold: their payload, and the full-resolution tensor with its feature."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload", "feature", "height", "width", "rgb")}
        for n, jpeg in zip(column(batch, "n_bytes").to_pylist(), column(batch, "jpeg"), strict=True):
            image = Image(jpeg.as_py())
            rgb = image.rgb()
            for k, v in zip(out, (image.payload(UNIT * max(1, -(-n // UNIT))), features(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes()), strict=True):
                out[k].append(v)
        return {k: column(batch, k) for k in ("doc_id", "n_bytes", "jpeg")} | out

    return arrow_map(stored, run, "doc_id long, n_bytes long, jpeg binary, payload binary, feature string, height int, width int, rgb binary")


def media(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """Store, read back and describe every row of docs (doc_id, text); with tensors also height, width and rgb."""
    data = F.col("payload")
    return load(store(docs)).select(
        "doc_id", "n_bytes", F.octet_length(data).cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.substring(data, -16, 16)).alias("tail_crc32"), F.octet_length("jpeg").cast("long").alias("media_bytes"), F.sha2("jpeg", 256).alias("media_sha256"), "feature",
        *(("height", "width", "rgb") if tensors else ()),
    )
