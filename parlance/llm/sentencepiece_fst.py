"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model file: the normaliser (identity, a space becomes U+2581, a dummy prefix), the
lexicon (pieces to ids, an arc per piece) and byte fallback (a character outside the lexicon to the ids of its bytes).
Their composition with an input is a lattice whose states are (position, last piece), and the encoding is its shortest
path in the tropical semiring. For a unigram model an arc weighs minus the piece's score. For a BPE model an arc from
piece u to piece v weighs 0 if merging the joined text leaves exactly u and v, else infinity: a piece sequence is the
BPE encoding of its text if and only if each adjacent pair is such, and so each prefix has one state of finite weight,
and one array cell per position holds the lattice of a whole batch of words.

Texts are cut between neighbours that no piece holds side by side, where no piece can span; each distinct word between
cuts is composed once per worker and known by its 64-bit hash from then on.
"""

from __future__ import annotations

import itertools
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .packing import mixed

SPACE = "▁"
CACHE_WORDS = 1_500_000
#: Words of more characters are composed one by one.
LONG = 48


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    def __init__(self, path: str):
        import numpy as np
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with a dummy prefix can be compiled")
        self.bpe = train.model_type == train.BPE
        if train.model_type not in (train.BPE, train.UNIGRAM):
            raise ValueError("only BPE and unigram models can be compiled")
        self.pieces = [p.piece for p in spec.pieces]
        kind = sentencepiece_kinds(spec)
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if train.byte_fallback else None
        self.unknown = kind.index("unknown")
        self.lexicon = {p: i for i, p in enumerate(self.pieces) if kind[i] == "normal"}
        self.scores = [p.score for p in spec.pieces]
        self.longest = max(map(len, self.lexicon))
        self.inside = {c for p in self.lexicon if len(p) > 1 for c in p}
        #: Decoder: the bytes each id writes; control pieces write nothing.
        self.writes = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else p.replace(SPACE, " ").encode() if k == "normal" else b" \xe2\x81\x87 " for p, k in zip(self.pieces, kind, strict=True)]
        self._hash_pieces(np)
        if self.bpe:
            self._compile_pairs(np)
        self.clear()
        del sentencepiece

    # ---- lexicon

    def _hash_pieces(self, np) -> None:
        """Pieces by a hash that grows by one character to the left, for looking up all ends of many words at once."""
        chars = sorted({c for p in self.lexicon for c in p})
        self.char_hash = {c: int(x) for c, x in zip(chars, mixed(np.array([ord(c) for c in chars], np.uint64)).tolist(), strict=True)}
        rows = sorted((self._hash(p), i) for p, i in self.lexicon.items())
        self.hashes, self.hash_ids = np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)
        if len(np.unique(self.hashes)) != len(rows):
            raise ValueError("two pieces share a hash")
        self.points = {n: np.zeros((len(self.pieces), n), np.uint32) for n in range(1, self.longest + 1)}
        for p, i in self.lexicon.items():
            self.points[len(p)][i] = [ord(c) for c in p]
        # Neighbours that occur within a piece; between any others a text can be cut.
        self.char_ids = np.zeros(0x110000, np.int16)
        for k, c in enumerate(sorted(self.inside), 1):
            self.char_ids[ord(c)] = k
        self.side = len(self.inside) + 1
        self.joined = np.zeros(self.side * self.side, bool)
        for p in self.lexicon:
            for x, y in zip(p, p[1:]):  # noqa: B905  neighbours
                self.joined[int(self.char_ids[ord(x)]) * self.side + int(self.char_ids[ord(y)])] = True

    MULTIPLIER = 0x9E3779B97F4A7C15

    def _hash(self, text: str) -> int:
        return sum(self.char_hash[c] * pow(self.MULTIPLIER, k, 1 << 64) for k, c in enumerate(reversed(text))) & (1 << 64) - 1

    def find(self, np, points, h):
        """Ids of the pieces whose code points are the rows of points (hashes h), -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == h, self.hash_ids[at], -1)
        hit = np.flatnonzero(ids >= 0)
        wrong = (self.points[points.shape[1]][ids[hit]] != points[hit]).any(axis=1)
        ids[hit[wrong]] = -1
        return ids

    # ---- BPE pair weights

    def merge(self, text: str) -> list[tuple[int, int]]:
        """Greedy merges of text: [(length, id)] of what is left; the best score first, leftmost of equals."""
        return self._merged(text)[0]

    def _merged(self, text: str):
        """(what is left, the last two parts that were merged)."""
        parts, last = list(text), None
        while True:
            best = None
            for i in range(len(parts) - 1):
                found = self.lexicon.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best[0]):
                    best = (self.scores[found], i)
            if best is None:
                return [(len(p), self.lexicon.get(p, -1)) for p in parts], last
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _compile_pairs(self, np) -> None:
        """Ranks in merge order (single characters first), how each piece was merged last, and all merges by their parts."""
        self.pair_weight: dict[int, bool] = {}
        self.reached = np.zeros(len(self.pieces), bool)
        self.runs = np.array([len(p) > 1 and len(set(p)) == 1 for p in self.pieces])
        order = sorted(self.lexicon, key=lambda p: (len(p) > 1, -self.scores[self.lexicon[p]]))
        rank = {p: r for r, p in enumerate(order)}
        self.rank = np.full(len(self.pieces), -1, np.int64)
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        merges = {}
        for p, i in self.lexicon.items():
            self.rank[i] = rank[p]
            done, last = self._merged(p)
            self.reached[i] = done == [(len(p), i)]
            if last and self.reached[i]:
                self.left[rank[p]], self.right[rank[p]] = rank[last[0]], rank[last[1]]
            for k in range(1, len(p)):
                if p[:k] in rank and p[k:] in rank:
                    merges[rank[p[:k]] * len(order) + rank[p[k:]]] = rank[p]
        self.merge_keys = np.array(sorted(merges), np.int64)
        self.merge_ranks = np.array([merges[k] for k in sorted(merges)], np.int64)

    def allowed(self, np, left, right):
        """Whether the arc from piece left to piece right has weight 0; left -1 is the start.

        The two pieces' merges are undone from the last one back. At each stage, if the parts at the seam would have
        merged before what was undone there, the pair cannot stand side by side.
        """
        ok = self.reached[right].copy()
        need = np.flatnonzero(ok & (left >= 0))
        n = len(self.left)
        distinct, back = np.unique(self.rank[left[need]] * n + self.rank[right[need]], return_inverse=True)
        a, b = distinct // n, distinct % n
        limit, result, live = np.full(len(a), 1 << 40), np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            clash = (self.merge_keys[at] == key) & (self.merge_ranks[at] < limit[live])
            result[live[clash]] = False
            go = ~clash
            live, x, y = live[go], x[go], y[go]
            first = x > y  # undo the later merge; on the left side if ranks say so
            can_x, can_y = self.right[x] != x, self.left[y] != y
            undo_x = (first & can_x) | (~first & ~can_y & can_x)
            undo_y = ~undo_x & can_y
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[live]))
            a[live], b[live] = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            live = live[undo_x | undo_y]
        ok[need] = result[back]
        # Runs of one character merge by position, not by rank alone: such pairs are merged out.
        for i in need[self.runs[left[need]]].tolist():
            key = int(left[i]) * len(self.pieces) + int(right[i])
            if key not in self.pair_weight:
                self.pair_weight[key] = self._pair(int(left[i]), int(right[i]))
            ok[i] = self.pair_weight[key]
        return ok

    def _pair(self, u: int, v: int) -> bool:
        a, b = self.pieces[u], self.pieces[v]
        return self.merge(a + b) == [(len(a), u), (len(b), v)]

    # ---- shortest paths

    def compose(self, words: list[str]) -> list[list[int]]:
        """Ids of words of lexicon characters, which share one length: shortest paths of all lattices, position by position."""
        import numpy as np

        n, m = len(words[0]), len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n)
        chars = mixed(points.astype(np.uint64))
        cost = np.full((m, n + 1), np.inf)
        cost[:, 0] = 0
        last, back = np.full((m, n + 1), -1, np.int64), np.zeros((m, n + 1), np.int64)
        scores = None if self.bpe else -np.array(self.scores)
        for i in range(1, n + 1):
            h, power, rows, ids, froms = np.zeros(m, np.uint64), 1, [], [], []
            for size in range(1, min(i, self.longest) + 1):
                h = h + chars[:, i - size] * np.uint64(power)
                power = power * self.MULTIPLIER & (1 << 64) - 1
                found = self.find(np, points[:, i - size : i], h)
                hit = np.flatnonzero((found >= 0) & np.isfinite(cost[:, i - size]))
                rows.append(hit)
                ids.append(found[hit])
                froms.append(np.full(len(hit), i - size))
            row, piece, start = np.concatenate(rows), np.concatenate(ids), np.concatenate(froms)
            weight = np.where(self.allowed(np, last[row, start], piece), 0.0, np.inf) if self.bpe else scores[piece]
            total = cost[row, start] + weight
            best = np.lexsort((-start, total, row))  # the least cost of each row; of equals the shorter last piece
            best = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])] if len(best) else best
            cost[row[best], i], last[row[best], i], back[row[best], i] = total[best], piece[best], start[best]
        out = []
        last, back = last.tolist(), back.tolist()
        for r in range(m):
            path, i, pieces, origin = [], n, last[r], back[r]
            while i > 0:
                path.append(pieces[i])
                i = origin[i]
            out.append(path[::-1])
        return out

    def compose_long(self, word: str) -> list[int]:
        """As compose, for one word of any length: a pass over its positions, arcs looked up one by one."""
        inf, n = float("inf"), len(word)
        cost, last, back = [0.0] + [inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                piece = self.lexicon.get(word[j:i])
                if piece is None or cost[j] == inf:
                    continue
                if self.bpe:
                    if not self.reached[piece]:
                        continue
                    key = last[j] * len(self.pieces) + piece
                    if last[j] >= 0 and key not in self.pair_weight:
                        self.pair_weight[key] = self._pair(last[j], piece)
                    total = cost[j] + (0.0 if last[j] < 0 or self.pair_weight[key] else inf)
                else:
                    total = cost[j] - self.scores[piece]
                if total < cost[i]:
                    cost[i], last[i], back[i] = total, piece, j
        path, i = [], n
        while i > 0:
            path.append(last[i])
            i = back[i]
        return path[::-1]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    # ---- texts

    def clear(self) -> None:
        import numpy as np

        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.size = self.used = 0
        self.starts, self.lengths, self.pool = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32)
        if self.bpe:
            self.pair_weight.clear()

    def learn(self, keys, words: list[str]) -> None:
        """keys: sorted hashes of words that are not known. A word is one character outside the lexicon, or all within."""
        import numpy as np

        def room(a, n):
            return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 3 * len(a) // 2) - len(a), a.dtype)])

        lists: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                lists[i] = [self.lexicon[w]] if w in self.lexicon else self.fallback(w)
            elif len(w) > LONG:
                lists[i] = self.compose_long(w)
            else:
                by_length.setdefault(len(w), []).append(i)
        for same in by_length.values():
            for k in range(0, len(same), 10_000):
                part = same[k : k + 10_000]
                for i, ids in zip(part, self.compose([words[i] for i in part]), strict=True):
                    lists[i] = ids
        flat = list(itertools.chain.from_iterable(lists))
        lengths = np.array(list(map(len, lists)), np.int32)
        n = len(words)
        self.starts, self.lengths, self.pool = room(self.starts, self.size + n), room(self.lengths, self.size + n), room(self.pool, self.used + len(flat))
        here = slice(self.size, self.size + n)
        self.starts[here], self.lengths[here] = self.used + np.cumsum(lengths) - lengths, lengths
        self.pool[self.used : self.used + len(flat)] = flat
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.place = np.insert(self.place, spot, self.size + np.arange(n, dtype=np.int32))
        self.size, self.used = self.size + n, self.used + len(flat)

    def encode(self, raw, offsets):
        """(flat ids, ids of each text) of texts given as UTF-8 bytes and offsets."""
        import numpy as np

        sizes = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets])  # in characters
        texts = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        full = sizes > 0
        shift = np.cumsum(full)
        data = np.full(len(texts) + int(full.sum()), ord(SPACE), np.uint32)  # the dummy prefix
        data[np.arange(len(texts)) + np.repeat(shift, sizes)] = np.where(texts == 32, ord(SPACE), texts)
        ends = np.cumsum(sizes) + shift
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        kind = self.char_ids[data].astype(np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[kind[:-1] * self.side + kind[1:]]
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(cut), len(data))
        lengths = np.diff(at)
        position = np.arange(len(data)) - np.repeat(at[:-1], lengths)
        hashes = mixed(np.add.reduceat(mixed((position.astype(np.uint64) << np.uint64(21)) + data + np.uint64(1)), at[:-1]) + lengths.astype(np.uint64))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.size > CACHE_WORDS:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, distinct), max(0, self.size - 1))
        known = self.keys[spot] == distinct if self.size else np.zeros(len(distinct), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            text, a, b = data.tobytes().decode("utf-32-le"), at[first[new]].tolist(), at[first[new] + 1].tolist()
            self.learn(distinct[new], [text[x:y] for x, y in zip(a, b, strict=True)])
            spot = np.searchsorted(self.keys, distinct)
        place = self.place[spot]
        lengths = self.lengths[place].astype(np.int64)[back]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.pool[np.repeat(self.starts[place][back] - upto[:-1], lengths) + np.arange(int(upto[-1]))]
        return flat.astype(np.uint32), np.diff(np.concatenate([[0], upto[np.searchsorted(at, ends)]]))

    def decode(self, ids: list[int]) -> str:
        """The output projection: what the pieces write, without the dummy prefix; broken UTF-8 is replaced."""
        out = b"".join(self.writes[i] for i in ids)
        return (out[1:] if out.startswith(b" ") else out).decode("utf-8", "replace")


def sentencepiece_kinds(spec) -> list[str]:
    kind = type(spec.pieces[0])
    names = {kind.NORMAL: "normal", kind.UNKNOWN: "unknown", kind.CONTROL: "control", kind.USER_DEFINED: "normal", kind.BYTE: "byte", kind.UNUSED: "unused"}
    return [names[p.type] for p in spec.pieces]


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    return _COMPILED.get(path) or _COMPILED.setdefault(path, Transducer(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids): the ids of each whole text; null and empty texts have none.

    One row per row, repeated rows too; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        fst = compiled(path)
        for batch in batches:
            for ids, texts in common.text_slices(batch.column("doc_id"), batch.column("text"), 1 << 21):
                flat, counts = fst.encode(*common.utf8_buffer(texts))
                o = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(o), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), lists], ["doc_id", "n_ids", "ids"])

    return common.source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    path = path or model_path()
    common.ship(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        fst = compiled(path)
        for batch in batches:
            texts = [fst.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and checksum of its ids, and length and SHA-256 of the text decoded from them."""
    path = model_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        fst = compiled(path)
        writes = np.array(fst.writes, object)
        for batch in batches:
            doc, ids, n = batch.column("doc_id"), batch.column("ids"), batch.column("n_ids")
            out: list[list] = [[], [], []]
            for i in range(len(batch)):
                one = ids[i].values.to_numpy() if ids[i].values is not None else np.zeros(0, np.int32)
                text = b"".join(writes[one])
                text = text[1:] if text.startswith(b" ") else text
                out[0].append(zlib.crc32(one.astype("<u4").tobytes()))
                out[1].append(len(text))
                out[2].append(hashlib_sha256(text))
            yield pa.RecordBatch.from_arrays([doc, n, *(pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "decoded_sha256"])

    return encode(common.table(spark, sf_dir, "documents"), path).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_bytes long, decoded_sha256 string")


def hashlib_sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
