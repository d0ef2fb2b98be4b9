"""Packing along a space-filling curve.

Each document is tokenised once and gets a hashed document vector, the mean of fixed pseudo-random vectors of its
words, projected to DIMS dimensions as it is summed, and quantised to a Hilbert key. Ids and keys go to a table in the
shared folder. Only light rows (key, length) are range-sorted; a running sum of lengths along the curve gives every
document its place in one endless stream, which is cut each `length` tokens. So neighbours on the curve share
sequences, no sequence but the last has padding, and no text is sorted.
"""

from __future__ import annotations

import itertools
import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

DIMS, BITS = 3, 16
SEQUENCE = 4096
#: A worker forgets its words when it knows so many.
CACHE_WORDS = 1_500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Classes of bytes for cutting words as the tokenizer does: white space, ASCII letters, digits, other visible ASCII,
#: the lead byte of U+00C0-U+00FF, its second byte, and bytes whose words are left to the tokenizer as they are.
SPACE, LETTER, DIGIT, SIGN, LEAD, TAIL, OTHER = range(7)


def byte_classes():
    import numpy as np

    c = np.full(256, OTHER, np.uint8)
    c[0x21:0x7F] = SIGN
    c[[0x27, 0x3C, 0x7C]] = OTHER  # apostrophes begin contractions, <| special tokens
    c[[0x20, *range(9, 14)]] = SPACE
    c[0x30:0x3A] = DIGIT
    c[0x41:0x5B] = c[0x61:0x7B] = LETTER
    c[0xC3] = LEAD
    c[0x80:0xC0] = TAIL
    return c


def cut_words(raw, offsets, classes):
    """(units, units of each text): words as the tokenizer's normaliser and pre-tokenizer cut them.

    Words of ASCII and precomposed Latin-1 letters (which neither NFC nor contractions touch) are lower-cased and cut
    into runs of letters, single digits and runs of signs. A word with any other byte is one unit, to be cut by the
    tokenizer itself. Units are a large_binary array.
    """
    import numpy as np
    import pyarrow as pa

    kind = classes[raw]
    word = kind != SPACE
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = word[heads]
    data, kind, start = raw[word], kind[word], start[word]
    before = np.concatenate([[0], np.cumsum(word)])[offsets]
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets) - 1, np.int64)
    lead, tail = kind == LEAD, kind == TAIL
    follows = np.zeros(len(data), bool)
    follows[1:] = lead[:-1] & ~start[1:]
    odd = (kind == OTHER) | (tail != follows) | (follows & ((data == 0x97) | (data == 0xB7)))
    odd[-1] |= lead[-1]
    at = np.flatnonzero(start)
    plain = np.repeat(~np.logical_or.reduceat(odd, at), np.diff(np.append(at, len(data))))
    upper = plain & (((data >= 0x41) & (data <= 0x5A)) | (follows & (data <= 0x9E)))
    data = np.where(upper, data | 0x20, data)
    sort = np.where(kind == DIGIT, 2, np.where(kind == SIGN, 3, 1))
    cut = start.copy()
    cut[1:] |= plain[1:] & ((sort[1:] != sort[:-1]) | (sort[1:] == 2))
    at = np.append(np.flatnonzero(cut), len(data))
    counts = np.diff(np.searchsorted(at[:-1], before))
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]), counts


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordTokenizer:
    """Ids of whole texts from ids of distinct words.

    For tokenizers that normalise by NFC, white space to spaces and lower case, drop white space and cut letters, digits
    and signs apart, so that a text's ids are its words' ids; any other is refused. Words are known by 64-bit hashes.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if (steps, cuts) != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("not a tokenizer of lower-cased words")
        self.tok, self.classes = Tokenizer.from_file(path), byte_classes()
        # For units of lower-case letters, which normaliser and pre-tokenizer would leave as they are.
        self.plain = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]}
        self.light = Tokenizer.from_str(json.dumps(spec))
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.size = self.used = 0
        self.starts, self.lengths = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)

    def learn(self, keys, words: list[bytes]) -> None:
        """keys: sorted hashes of words that are not known."""
        import numpy as np

        def room(a, n):
            return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 3 * len(a) // 2) - len(a), a.dtype)])

        plain = [self.plain.fullmatch(w) is not None for w in words]
        for tok, which in ((self.light, [i for i, p in enumerate(plain) if p]), (self.tok, [i for i, p in enumerate(plain) if not p])):
            for k in range(0, len(which), 4096):
                part = which[k : k + 4096]
                lists = [e.ids for e in tok.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)]
                flat = list(itertools.chain.from_iterable(lists))
                at = self.size + np.array(part)
                self.starts, self.lengths = room(self.starts, self.size + len(words)), room(self.lengths, self.size + len(words))
                self.pool = room(self.pool, self.used + len(flat))
                self.pool[self.used : self.used + len(flat)] = flat
                lengths = np.array(list(map(len, lists)), np.int32)
                self.starts[at], self.lengths[at] = self.used + np.cumsum(lengths) - lengths, lengths
                self.used += len(flat)
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.place = np.insert(self.place, spot, self.size + np.arange(len(keys), dtype=np.int32))
        self.size += len(words)

    def __call__(self, texts):
        """(flat ids, id count of each text, DIMS sums of word vectors, word counts)."""
        import numpy as np

        words, counts = cut_words(*common.utf8_buffer(texts), self.classes)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMS)), counts
        at, data = np.frombuffer(words.buffers()[1], np.int64), np.frombuffer(words.buffers()[2], np.uint8)
        sizes = np.diff(at)
        position = np.arange(len(data)) - np.repeat(at[:-1], sizes)
        hashes = mixed(np.add.reduceat(mixed((position * 256 + data + 1).astype(np.uint64)), at[:-1]) + sizes.astype(np.uint64))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.size > CACHE_WORDS:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, distinct), max(0, self.size - 1))
        known = self.keys[spot] == distinct if self.size else np.zeros(len(distinct), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            raw, a, b = data.tobytes(), at[first[new]].tolist(), at[first[new] + 1].tolist()
            self.learn(distinct[new], [raw[x:y] for x, y in zip(a, b, strict=True)])
            spot = np.searchsorted(self.keys, distinct)
        place = self.place[spot]
        lengths = self.lengths[place].astype(np.int64)[back]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.starts[place][back] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        doc_ends = np.cumsum(counts)
        up_to = np.concatenate([[0], ends])
        vectors = np.stack([unit_noise(distinct, d) for d in range(DIMS)], 1)[back]
        running = np.concatenate([np.zeros((1, DIMS)), np.cumsum(vectors, axis=0, dtype=np.float64)])
        return flat, up_to[doc_ends] - up_to[doc_ends - counts], running[doc_ends] - running[doc_ends - counts], counts


def unit_noise(seeds, dim: int):
    """Fixed pseudo-random numbers in [-1, 1) of uint64 seeds."""
    import numpy as np

    x = (seeds + np.uint64(dim * 0x9E3779B9 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1).astype(np.float32)


def hilbert_key(points):
    """Hilbert index of integer points (n, dims) of BITS bits: Gray-code transform of the coordinates, bits interleaved."""
    import numpy as np

    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ flip) >> bit) & 1)
    return key


_TOKENIZER: dict[str, WordTokenizer] = {}


def _tokenised(path: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        tok = _TOKENIZER.get(path) or _TOKENIZER.setdefault(path, WordTokenizer(path))
        for batch in batches:
            index = pa.array(np.arange(len(batch)))
            for rows, texts in common.text_slices(index, batch.column("text"), 1 << 21):
                flat, sizes, sums, counts = tok(texts)
                full = np.full(len(flat) + len(sizes), end_id, np.uint32)
                full[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
                width = 2 if not len(full) or full.max() < 1 << 16 else 4
                raw, at = full.astype(f"<u{width}").tobytes(), np.concatenate([[0], np.cumsum(sizes + 1)]) * width
                ids = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                mean = sums / np.sqrt(np.maximum(counts, 1))[:, None]
                points = np.clip((mean / (1 + np.abs(mean)) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
                part = batch.take(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), pa.array(sizes + 1, pa.int64()), pa.array(hilbert_key(points), pa.int64()), pa.array(ids, pa.binary())],
                    ["rid", "doc_id", "n", "key", "ids"],
                )

    return run


def _wide(data: bytes, n: int):
    """Ids are kept as 16-bit numbers where all fit."""
    import numpy as np

    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def _pieces(length: int, keep_ids: bool):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, n, data, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "place")), strict=True):
                ids, start = _wide(data, n), 0
                while start < n:
                    seq, offset = divmod(place + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[start : start + size]
                    row = (doc_id, start, size, zlib.crc32(piece.tobytes()), n, seq, offset, piece)
                    for o, v in zip(out, row):  # noqa: B905  ids only if asked for
                        o.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if keep_ids).

    A null or empty text is the single id end_id. Repeated rows are packed each; ties on the curve are ordered by
    doc_id, then by row. Other columns are ignored, whatever their names; an empty table gives no rows. Very long texts
    are tokenised whole and run over as many sequences as they need.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    source = common.source(docs, id_col, text_col, F.monotonically_increasing_id().alias("rid"))
    ids = source.mapInArrow(_tokenised(path, end_id), "rid long, doc_id long, n long, key long, ids binary")
    ids = common.materialise(ids, "pack-ids")
    parts = common.shuffle_partitions(spark)
    light = ids.select("rid", "doc_id", "n", "key").repartitionByRange(parts, "key", "doc_id", "rid").withColumn("part", F.spark_partition_id())
    light = common.materialise(light, "pack-order")
    sums = sorted(light.groupBy("part").agg(F.sum("n")).collect())  # a row per partition
    before, starts = 0, []
    for part, n in sums:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part int, before long")
    along = Window.partitionBy("part").orderBy("key", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = light.withColumn("upto", F.sum("n").over(along)).join(F.broadcast(starts), "part")
    placed = placed.select("rid", (F.col("before") + F.col("upto") - F.col("n")).alias("place"))
    joined = ids.select("rid", "doc_id", "n", "ids").join(placed, "rid")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return joined.select("doc_id", "n", "ids", "place").mapInArrow(_pieces(length, keep_ids), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
