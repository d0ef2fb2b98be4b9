"""Media columns: progressive JPEG.

The decoder reads baseline and progressive Huffman JPEGs. Scans (spectral selection, successive approximation) are
accumulated into coefficient arrays per component, inverse-transformed by one numpy product, chroma is upsampled to
full resolution, and the RGB tensor is stored. The transform runs on scaled whole numbers, so it is exact and equal
on every machine.

The encoder stores bytes losslessly in the format's unit, the quantised coefficient: 64 bytes are one block, a byte b
is the coefficient of magnitude category 8 whose additional bits are b (128..255 for themselves, 0..127 for -255..-128).
All coefficients being of one category, its Huffman codes have one symbol, and its scans can be read without a bit loop;
scans of other encoders are read bit by bit.
"""

from __future__ import annotations

import hashlib
import math
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: The zigzag order of the format, as row * 8 + column.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
SCALE = 1 << 16
_MATRIX = None


def transform_matrix():
    """(64, 64): zigzag coefficients to samples in rows, in units of 1/SCALE."""
    global _MATRIX
    if _MATRIX is None:
        import numpy as np

        k, n = np.arange(8)[:, None], np.arange(8)[None, :]
        c = np.where(k == 0, math.sqrt(0.125), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
        both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
        _MATRIX = np.rint(both[ZIGZAG] * SCALE)
    return _MATRIX


# ---- encoder


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, number: int, lengths: list[int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number, *lengths]) + symbols)


def _stuff(data):
    import numpy as np

    at = np.flatnonzero(data == 255)
    return np.insert(data, at + 1, 0) if len(at) else data


def encode_jpeg(payload: bytes, spare_symbol: bool = False) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the payload, a positive multiple of 64 bytes.

    spare_symbol adds an unused code to each table, which sends a reader down its bit-by-bit path.
    """
    import numpy as np

    data = np.frombuffer(payload, np.uint8)
    units = -(-(len(data) // 64) // 6)
    wide = max(1, math.isqrt(units))
    high = -(-units // wide)
    blocks = np.full((wide * high * 6, 64), 128, np.uint8)
    blocks.reshape(-1)[: len(data)] = data
    n = wide * high
    planes = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    one = lambda length, symbol: ([int(i == length) + (int(i == length + 1) if spare_symbol else 0) for i in range(1, 17)], bytes([symbol]) + (b"\x05" if spare_symbol else b""))
    out = [
        b"\xff\xd8", _segment(0xFE, b"payload %d" % len(data)), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, b"\x08" + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, *one(8, 8)), _segment(0xDD, b"\0\1"),
    ]
    scan = lambda c, start, end, high_bit, low_bit: _segment(0xDA, bytes([1, c + 1, 0, start, end, high_bit << 4 | low_bit]))
    for c, p in enumerate(planes):  # DC: a restart after each block, so no prediction: 00, the byte, a marker
        dc = p[:, 0]
        rows = np.zeros((len(p), 5), np.uint8)
        rows[:, 1], rows[:, 3], rows[:, 4] = dc, 255, 0xD0 + np.arange(len(p)) % 8
        keep = np.ones_like(rows, bool)
        keep[:, 2] = dc == 255
        keep[-1, 3:] = False
        out += [scan(c, 0, 0, 0, 0), rows[keep].tobytes()]
    out += [_segment(0xDD, b"\0\0"), _table(1, 0, *one(1, 7))]
    for c, p in enumerate(planes):  # AC without the lowest bit: 0, then 7 bits
        for start, end in ((1, 5), (6, 63)):
            out += [scan(c, start, end, 0, 1), (p[:, start : end + 1] >> 1).tobytes()]
    out.append(_table(1, 0, *one(1, 0)))
    for c, p in enumerate(planes):  # the lowest bit: 0 for end of block, then a bit for each coefficient
        bits = np.zeros((len(p), 64), np.uint8)
        bits[:, 1:] = (p[:, 1:] & 1) ^ (p[:, 1:] < 128)
        out += [scan(c, 1, 63, 1, 0), _stuff(np.packbits(bits, axis=1).reshape(-1)).tobytes()]
    return b"".join([*out, b"\xff\xd9"])


# ---- decoder


class _Bits:
    """Bits of entropy-coded data without stuffing; zeros after its end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            got, self.left, self.value = (self.value << -self.left) & ((1 << n) - 1), 0, 0
            return got
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def value_of(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Jpeg:
    """Coefficients (zigzag, per component: block rows, block columns, 64), quantisation and sizes of a JPEG."""

    def __init__(self, data: bytes):
        import numpy as np

        self.quant, self.codes, self.restart, self.comment = {}, {}, 0, b""
        raw = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 255)
        after = raw[ff + 1]
        stops = ff[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 255)]
        at = 2
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body, marker == 0xC2)
            elif marker == 0xDA:
                end = int(stops[np.searchsorted(stops, at)]) if len(stops) and stops[-1] >= at else len(data)
                self._scan(body, raw[at:end])
                at = end
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError(f"JPEG process {marker:#x} is not Huffman baseline or progressive")

    def _quant(self, body: bytes) -> None:
        import numpy as np

        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[65 + 64 * wide :]

    def _huffman(self, body: bytes) -> None:
        while body:
            code, codes, at = 0, {}, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.codes[body[0]] = codes
            body = body[at:]

    def _frame(self, body: bytes, progressive: bool) -> None:
        import numpy as np

        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
        self.progressive, self.ids = progressive, [p[0] for p in parts]
        self.sampling, self.tables = [(p[1] >> 4, p[1] & 15) for p in parts], [p[2] for p in parts]
        self.most = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.units = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        self.coefs = [np.zeros((self.units[1] * v, self.units[0] * h, 64), np.int32) for h, v in self.sampling]

    def _scan(self, body: bytes, raw) -> None:
        import numpy as np

        n = body[0]
        parts = [(self.ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            start, end, high, low = 0, 63, 0, 0
        if n == 1 and self._fast(parts[0], start, end, high, low, raw):
            return
        # split at restart markers, then take out the stuffing
        ff = np.flatnonzero(raw[:-1] == 255)
        marks = ff[(raw[ff + 1] & 0xF8) == 0xD0]
        cuts = [0, *(marks + 2).tolist()]
        ends = [*marks.tolist(), len(raw)]
        segments = [raw[a:b].tobytes().replace(b"\xff\x00", b"\xff") for a, b in zip(cuts, ends, strict=True)]
        if n == 1:
            c = parts[0][0]
            (h, v), (mh, mv) = self.sampling[c], self.most
            across, down = -(-(-(-self.width * h // mh)) // 8), -(-(-(-self.height * v // mv)) // 8)
            order = [[(0, y, x)] for y in range(down) for x in range(across)]
        else:
            order = [
                [(i, my * self.sampling[c][1] + y, mx * self.sampling[c][0] + x) for i, (c, _, _) in enumerate(parts) for y in range(self.sampling[c][1]) for x in range(self.sampling[c][0])]
                for my in range(self.units[1]) for mx in range(self.units[0])
            ]
        step = self.restart or len(order)
        for k, segment in enumerate(segments):
            bits, last, self.run = _Bits(segment), [0] * n, 0
            for unit in order[k * step : (k + 1) * step]:
                for i, y, x in unit:
                    c, dc, ac = parts[i]
                    block = self.coefs[c][y, x]
                    if start == 0:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            last[i] += bits.value_of(bits.symbol(self.codes[dc]))
                            block[0] = last[i] << low
                    if end and not high:
                        self._ac_first(bits, block, self.codes[16 + ac], max(1, start), end, low)
                    elif end:
                        self._ac_refine(bits, block, self.codes[16 + ac], start, end, low)

    def _ac_first(self, bits, block, codes, k, end, low) -> None:
        if self.run:
            self.run -= 1
            return
        while k <= end:
            run, size = divmod(bits.symbol(codes), 16)
            if size:
                k += run
                block[k] = bits.value_of(size) * (1 << low)
            elif run < 15:
                self.run = (1 << run) - 1 + (bits.take(run) if run else 0)
                return
            else:
                k += 15
            k += 1

    def _ac_refine(self, bits, block, codes, k, end, low) -> None:
        def correct(k):
            if bits.take(1):
                block[k] += (1 << low) if block[k] > 0 else -(1 << low)

        while not self.run and k <= end:
            run, size = divmod(bits.symbol(codes), 16)
            new = bits.value_of(1) if size else 0
            if not size and run < 15:
                self.run = (1 << run) + (bits.take(run) if run else 0)
                break
            while k <= end:  # pass over `run` zeros, correcting what is not zero
                if block[k]:
                    correct(k)
                elif run == 0:
                    if size:
                        block[k] = new * (1 << low)
                    break
                else:
                    run -= 1
                k += 1
            k += 1
        if self.run:
            for j in range(k, end + 1):
                if block[j]:
                    correct(j)
            self.run -= 1

    def _fast(self, part, start: int, end: int, high: int, low: int, raw) -> bool:
        """Reads a scan of one component all of whose codes are equal and, with their bits, whole bytes; else False."""
        import numpy as np

        c, dc, ac = part
        codes = self.codes.get(ac + 16 if start else dc, {})
        coefs = self.coefs[c].reshape(-1, 64)
        h, v = self.sampling[c]
        if len(codes) != 1 or self.width % (8 * self.most[0]) or self.height % (8 * self.most[1]) or (h, v) not in ((1, 1), self.most):
            return False
        ((length, _), symbol), n = next(iter(codes.items())), len(coefs)
        if start == 0 and end == 0 and not high and self.restart == 1 and (length, symbol) == (8, 8):
            stuffed = np.zeros(len(raw), bool)
            stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
            rows = np.concatenate([raw[~stuffed], np.zeros(2, np.uint8)])
            if len(rows) != 4 * n:
                return False
            b = rows.reshape(n, 4)[:, 1].astype(np.int32)
            coefs[:, 0] = np.where(b < 128, b - 255, b) << low
            return not rows.reshape(n, 4)[:, 0].any()
        width = end - start + 1
        if start and not high and not self.restart and (length, symbol) == (1, 7) and len(raw) == n * width and not (raw & 128).any():
            b = raw.reshape(n, width).astype(np.int32)
            coefs[:, start : end + 1] = np.where(b < 64, b - 127, b) * (1 << low)
            return True
        if start and high and not self.restart and (length, symbol) == (1, 0) and width == 63:
            now = coefs[:, 1:]
            stuffed = np.zeros(len(raw), bool)
            stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
            rows = raw[~stuffed]
            if len(rows) != 8 * n or (rows.reshape(n, 8)[:, 0] & 128).any() or not now.all():
                return False
            bit = np.unpackbits(rows.reshape(n, 8), axis=1)[:, 1:].astype(np.int32) << low
            coefs[:, 1:] = np.where(now > 0, now + bit, now - bit)
            return True
        return False

    def payload(self) -> bytes:
        """The bytes that encode_jpeg stored."""
        import numpy as np

        size = int(self.comment.removeprefix(b"payload "))
        values = np.concatenate([c.reshape(-1) for c in self.coefs])[:size]
        return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()

    def rgb(self):
        """(height, width, 3) uint8, chroma upsampled to full resolution."""
        import numpy as np

        planes = []
        for c, (h, v), t in zip(self.coefs, self.sampling, self.tables, strict=True):
            down, across = c.shape[:2]
            whole = (c.reshape(-1, 64) * self.quant[t]).astype(np.float64) @ transform_matrix()
            samples = np.clip(np.floor(whole / SCALE + 128.5), 0, 255).astype(np.int32)
            plane = samples.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
            plane = plane.repeat(self.most[1] // v, axis=0).repeat(self.most[0] // h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        # The JFIF colour matrix in units of 1/65536.
        out = np.stack([y + ((91881 * r + 32768) >> 16), y - ((22554 * b + 46802 * r + 32768) >> 16), y + ((116130 * b + 32768) >> 16)], axis=2)
        return np.clip(out, 0, 255).astype(np.uint8)


# ---- columns


def padded(text_bytes: bytes) -> bytes:
    return text_bytes + bytes(-len(text_bytes) % 64 if text_bytes else 64)


def _encode(batches):
    import pyarrow as pa

    for batch in batches:
        for ids, texts in common.text_slices(batch.column("doc_id"), batch.column("text")):
            raw, o = common.utf8_buffer(texts)
            data, o = raw.tobytes(), o.tolist()
            media = [encode_jpeg(padded(data[a:b])) for a, b in zip(o[:-1], o[1:], strict=True)]
            sizes = [b - a for a, b in zip(o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, UTF-8, zero-padded to a positive multiple of 64, as a JPEG.

    Null counts as empty. One row per row, repeated rows too; other columns are ignored, an empty table gives no rows.
    """
    return common.source(docs, id_col, text_col).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """media's rows with height, width and rgb, the full-resolution tensor in rows, 3 bytes a pixel; null media give nulls."""
    common.ship(media.sparkSession)
    columns = [c for c in media.columns if c not in ("height", "width", "rgb")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                data = batch.column(column)[i].as_py()
                jpeg = Jpeg(data) if data is not None else None
                extra = [jpeg and jpeg.height, jpeg and jpeg.width, jpeg and jpeg.rgb().tobytes()]
                kinds = (pa.int32(), pa.int32(), pa.binary())
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([x], k) for x, k in zip(extra, kinds, strict=True))], [*batch.schema.names, "height", "width", "rgb"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*columns).schema)
    return media.select(*columns).mapInArrow(run, f"{kinds}, height int, width int, rgb binary")


def feature(rgb) -> str:
    """Size, mean of each channel in 1/1000, mean absolute step along rows and columns, and a checksum of the tensor."""
    import numpy as np

    n = rgb.shape[0] * rgb.shape[1]
    means = [int(x) * 1000 // n for x in rgb.reshape(-1, 3).sum(0, dtype=np.int64)]
    g = rgb[:, :, 1].astype(np.int16)
    steps = [int(np.abs(np.diff(g, axis=a)).sum(dtype=np.int64)) * 1000 // n for a in (0, 1)]
    return f"{rgb.shape[1]}x{rgb.shape[0]};rgb={','.join(map(str, means))};step={','.join(map(str, steps))};crc={zlib.crc32(rgb.tobytes()):08x}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
    for batch in batches:
        out = [[] for _ in names]
        ids, sizes, media = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")
        for i in range(len(batch)):
            data = media[i].as_buffer().to_pybytes()
            jpeg = Jpeg(data)
            payload = jpeg.payload()
            row = (ids[i], sizes[i], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(jpeg.rgb()))
            for o, v in zip(out, row, strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of what is read back from media(doc_id, n_bytes, media), with a feature of the decoded tensor."""
    common.ship(media.sparkSession)
    return media.mapInArrow(_digests, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the JPEGs as reread from the written table; tensors are decoded row by row and not written."""
    stored = common.materialise(to_media(common.table(spark, sf_dir, "documents")), "media")
    return media_digests(stored)
