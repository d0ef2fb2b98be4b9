"""Removal of byte strings that occur more than once, by suffix arrays.

A repeated string of LENGTH bytes is found where its anchor is: the anchor of a window of LENGTH bytes is its leftmost
gram (up to K bytes) of least hash, which depends on the window's content alone. So equal windows have equal anchors at
equal offsets, and the windows of one anchor occurrence are a run of starts; its context, the bytes these windows cover,
is all that has to meet the contexts of other occurrences of the same gram.

1. Documents are packed into blocks of about BLOCK bytes, the unit in which they are read again and joined.
2. Anchors are counted by their hash over all documents. Those that occur again are known by the digest of their
   context. Equal contexts are one, with a count; all its windows are repeated.
3. Anchors with differing contexts send each of these once. In a task they are joined to texts of TEXT bytes; a
   text's suffix array is built by Larsson-Sadakane refinement (each round compares as many ranks as fit 64 bits, groups
   that are unique stay as they are), and Kasai's common prefixes mark the windows that occur in another context.
4. A shard is at most SHARD bytes of contexts. An anchor with more has several shards. Each sorts its windows once and
   sends their digests, in runs by range of digest; a range's runs are merged by binary search. The work is linear in
   the anchor's windows.
Windows come back to their blocks as ranges of starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

LENGTH, K = 400, 64
#: Bytes of a passage of about fifty words: what op8 reports beside LENGTH, and what the pipeline cuts.
PASSAGE = 240
SHARD, BLOCK, TEXT = 1 << 20, 1 << 18, 60_000


# ---- anchors

_POWERS: list = []


def _powers(n: int):
    """An odd multiplier's powers and their inverses modulo 2**64."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(n - 1, 1 << 16).bit_length()
        base, out = 0x9E3779B97F4A7C15, []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        rng = np.random.default_rng(1)
        _POWERS[:] = [*out, rng.integers(1, 1 << 63, 256, dtype=np.uint64)]
    return _POWERS


def gram_hashes(raw, k: int = K):
    """A 64-bit hash of the k bytes from each position: a polynomial over the bytes' random values, mixed; len(raw) - k + 1 of them."""
    import numpy as np

    powers, inverse, values = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * powers[: len(raw)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * inverse[: len(raw) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def sliding_least(v, span: int):
    """Minimum of each run of span values, by runs of doubled length."""
    import numpy as np

    size = 1
    while 2 * size <= span:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (span - size)], v[span - size :]) if span > size else v


def anchors(raw, offsets, length: int = LENGTH, k: int = K):
    """(document, first window start, number of starts, anchor's place after the first start, hash) of the documents' windows.

    raw holds the documents end to end, cut at offsets. A window's anchor is found by the upper half of the hash, the
    leftmost of equal ones.
    """
    import numpy as np

    z = np.zeros(0, np.int64)
    if len(raw) < length:
        return z, z, z, z, np.zeros(0, np.uint64)
    h = gram_hashes(raw, k)
    place = np.arange(len(h), dtype=np.uint64)
    low = sliding_least((h & np.uint64(0xFFFFFFFF00000000)) | place, length - k + 1) & np.uint64(0xFFFFFFFF)
    low = low.astype(np.int64)  # for each window start; those that run into the next document are left out
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    inside = np.arange(len(low)) + length <= offsets[1:][document]
    fresh = inside.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh)
    starts = np.add.reduceat(inside.astype(np.int64), first) if len(first) else z
    document = document[first]
    return document, first - offsets[document], starts, low[first] - first, h[low[first]]


# ---- suffix arrays


def suffix_array(text, context=None, rest=None):
    """The suffix array of text (uint8) and its inverse; suffixes end with their context.

    context numbers the contexts of the text and rest is the number of bytes from each position to its context's end;
    without them the text is one. An end comes before all bytes, ends of earlier contexts first, so no two suffixes are
    equal. Larsson-Sadakane: ranks by the first 7 bytes, then by as many neighbouring ranks as fit 64 bits, which
    multiplies the depth, until all are unique; suffixes whose rank is unique are left in place.
    """
    import numpy as np

    n = len(text)
    if context is None:
        context, rest = np.zeros(n, np.int64), n - np.arange(n)
    ends = int(context[-1]) + 1 if n else 1
    bits = (n + ends).bit_length()
    ways = 64 // bits
    if ways < 2:
        raise ValueError("a text of a suffix array has less than 2**31 bytes")
    held = np.minimum(rest, 7)
    keep = np.array([((1 << 8 * r) - 1) << (64 - 8 * r) for r in range(8)], np.uint64)
    key = (byte_words(text)[:n] & keep[held]) | held.astype(np.uint64)
    order = np.argsort(key)
    s = key[order]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    # Ranks of the ends come first, and stand behind those of the suffixes.
    rank = np.empty(n + ends, np.uint64)
    rank[n:] = np.arange(ends)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + ends
    stop, past = np.arange(n) + rest, n + context
    shift, done = np.uint64(bits), 7
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in order whose group has more than one suffix
    while len(slots):
        at = order[slots]
        key, upto, end = rank[at], stop[at], past[at]
        for way in range(1, ways):
            after = at + way * done
            key <<= shift
            key |= rank[np.where(after < upto, after, end)]
        place = np.argsort(key)
        at, key = at[place], key[place]
        order[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + ends
        slots = slots[~(head & np.append(head[1:], True))]
        done *= ways
    return order, rank[:n].astype(np.int64) - ends


def common_prefixes(text, order, rank, starts, sizes, limit: int, rest=None, fresh=()):
    """Kasai's array, capped at limit: common prefix of each suffix in order with the one before it.

    The suffixes in order are those that begin in the runs of `sizes` positions from each of `starts`; rank gives their
    places. The prefix shrinks by at most one from a position to the next, if the suffix before it moves on within the
    runs too. The runs are walked at once, in lanes; a lane's prefix carries over, and is extended 8 bytes at a time.
    rest is the number of bytes to a context's end (default: the text's); the places `fresh` begin new arrays.
    """
    import numpy as np

    n = len(text)
    words, powers = byte_words(text), np.array(BYTE_POWERS, np.uint64)
    rest = n - np.arange(n) if rest is None else rest
    lcp, before = np.zeros(len(order), np.int64), np.full(n + 1, -1)
    before[order[1:]] = order[:-1]
    before[order[np.asarray(fresh, np.int64)]] = -1
    walked = np.zeros(n + 1, bool)
    walked[order] = True
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    h, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), n - 1)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -step, "left"))  # lanes longer than step
        i = starts[:m] + step
        j = before[i]
        most = np.where(j >= 0, np.minimum(limit, np.minimum(rest[i], rest[j])), 0)
        now = np.where(walked[last[:m] + 1], np.maximum(h[:m] - 1, 0), 0)
        now = np.minimum(now, most)
        live, width = np.flatnonzero(now < most), 1
        while len(live):
            # The next words of each lane, clamped to the text's end; the first that differs has the leading bytes that agree.
            ahead = now[live][:, None] + 8 * np.arange(width)
            x = words[np.minimum(i[live][:, None] + ahead, n)] ^ words[np.minimum(j[live][:, None] + ahead, n)]
            same = x == 0
            full = same.all(axis=1)
            which = np.where(full, width - 1, np.argmin(same, axis=1))
            now[live] += 8 * which + 8 - np.searchsorted(powers, x[np.arange(len(live)), which], "right")
            live = live[full & (now[live] < most[live])]
            width = 8
        h[:m] = np.minimum(now, most)
        last[:m] = np.where(j >= 0, j, n - 1)
        lcp[rank[i]] = h[:m]
    return lcp


BYTE_POWERS = [1 << (8 * k) for k in range(8)]


def byte_words(text):
    """The 8 bytes from each position as a big-endian number, zeros after the end."""
    import numpy as np

    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text) + 1, np.uint64)
    for j in range(8):
        out |= wide[j : j + len(out)] << np.uint64(56 - 8 * j)
    return out


class Shard:
    """Distinct contexts of anchors, joined to texts of about text_bytes with a suffix array each.

    starts[i] windows of each length begin at the first positions of context i; windows never cross contexts. Contexts
    of one anchor (`groups`, in order) are in one text.
    """

    def __init__(self, contexts: list, starts: list, groups: list, text_bytes: int = TEXT):
        import numpy as np

        self.sizes = np.array([len(c) for c in contexts], np.int64)
        self.starts = np.array(starts, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(contexts), np.uint8)
        self.context = np.repeat(np.arange(len(contexts)), self.sizes)
        at = np.arange(len(self.text))
        self.place = at - self.begins[self.context]
        self.rest = self.sizes[self.context] - self.place
        member = self.place < self.starts[self.context]
        orders, self.fresh, size, since = [], [], 0, 0
        for i in range(len(contexts)):
            size += len(contexts[i])
            last = i + 1 == len(contexts)
            if last or (groups[i + 1] != groups[i] and size + len(contexts[i + 1]) > text_bytes):
                a = self.begins[since]
                b = a + size
                order, _ = suffix_array(self.text[a:b], self.context[a:b] - since, self.rest[a:b])
                order += a
                orders.append(order[member[order]])
                size, since = 0, i + 1
        self.order = np.concatenate(orders) if orders else np.zeros(0, np.int64)  # windows only
        self.fresh = np.cumsum([0, *(len(o) for o in orders[:-1])]) if orders else self.fresh
        self.rank = np.zeros(len(self.text), np.int64)
        self.rank[self.order] = np.arange(len(self.order))

    def prefixes(self, limit: int):
        return common_prefixes(self.text, self.order, self.rank, self.begins, self.starts, limit, self.rest, self.fresh)

    def runs(self, lcp, length: int):
        """(places in order of the windows of length bytes, number of the run of equal ones each is in)."""
        import numpy as np

        windows = np.flatnonzero(self.rest[self.order] >= length)
        return windows, np.cumsum(lcp < length)[windows]

    def repeated(self, lcp, length: int):
        """For each position, whether its window also starts elsewhere in the shard."""
        import numpy as np

        windows, run = self.runs(lcp, length)
        out = np.zeros(len(self.text), bool)
        out[self.order[windows]] = np.bincount(run)[run] > 1 if len(run) else False
        return out

    def digests(self, lcp, length: int):
        """(sorted digests of the distinct windows, their context, their place in it)."""
        import hashlib

        import numpy as np

        windows, run = self.runs(lcp, length)
        at = self.order[windows[np.unique(run, return_index=True)[1]]]
        raw = self.text.tobytes()
        # 15 bytes and a last one that is not 0: numpy's byte strings end at zeros.
        keys = np.array([hashlib.blake2b(raw[i : i + length], digest_size=15).digest() + b"\1" for i in at.tolist()], "S16")
        by = np.argsort(keys)
        return keys[by], self.context[at[by]], self.place[at[by]]


def runs_of(flags):
    """(start, end) of the maximal runs of True."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def could_repeat(contexts: list, starts: list, places: list, length: int, k: int) -> list[int]:
    """Of the differing contexts of one anchor, those that can share a window.

    A window has half of its bytes beside the anchor's gram on one side of it, so that half must be the same in another context.
    """
    from collections import Counter

    half = (length - k + 1) // 2
    sides = []
    for c, n, at in zip(contexts, starts, places, strict=True):
        right = c[at : at + k + half] if n - 1 + length >= at + k + half else None
        left = c[at - half : at + k] if at >= half else None
        sides.append((right, left))
    rights, lefts = Counter(r for r, _ in sides), Counter(s for _, s in sides)
    return [i for i, (r, s) in enumerate(sides) if (r is not None and rights[r] > 1) or (s is not None and lefts[s] > 1)]


# ---- stages


def _pack_blocks(batches):
    """Rows (rid, doc_id, text[, others]) as blocks of about BLOCK bytes, each a row of lists; a longer text is a block of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            part = batch.slice(at, to - at)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
            yield pa.RecordBatch.from_arrays([part.column("rid").slice(0, 1), *lists], ["block", *batch.schema.names])
            at = to


def _documents(batch, i: int):
    """(bytes end to end, offsets) of the texts of block i of a batch."""
    import pyarrow as pa

    return common.utf8_buffer(batch.column("text")[i].values.cast(pa.large_string()))


def _anchor_rows(length: int, k: int):
    """(block, h, n, spots) for each anchor of a block; spots are (document, first, starts, place) of its occurrences, as int32."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                raw, offsets = _documents(batch, i)
                *spots, h = anchors(raw, offsets, length, k)
                if not len(h):
                    continue
                by = np.argsort(h, kind="stable")
                h = h[by]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                packed = np.stack([s[by] for s in spots], axis=1).astype("<i4")
                ends = np.append(first, len(h)).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * np.int32(16)), pa.py_buffer(packed.tobytes())])
                block = pa.array(np.full(len(first), batch.column("block")[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([block, pa.array(h[first].view(np.int64)), pa.array(np.diff(ends)), binary], ["block", "h", "n", "spots"])

    return run


PLACES = "block long, h long, digest binary, n int, size int, starts int, place int, document int, first int, spots binary"


def _place_rows(longest: int, length: int):
    """For each context of a block that may be repeated: its digest, where it first occurs, and all (document, first) as int32.

    A context reaches `longest` bytes from its last start, or to its document's end.
    """

    def run(batches):
        from struct import pack

        import numpy as np
        import pyarrow as pa
        import xxhash

        names = [c.split()[0] for c in PLACES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 6, pa.binary()]
        for batch in batches:
            for i in range(len(batch)):
                raw, offsets = _documents(batch, i)
                data = raw.tobytes()
                block = batch.column("block")[i].as_py()
                found = batch.column("found")[i].values
                out = [[] for _ in names]
                hashes, blobs = found.field("h").to_pylist(), found.field("spots").to_pylist()
                owner = np.repeat(np.arange(len(blobs)), [len(b) // 16 for b in blobs])
                spots = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 4)
                begin = offsets[spots[:, 0]] + spots[:, 1]
                end = np.minimum(begin + spots[:, 2] - 1 + longest, offsets[spots[:, 0] + 1])
                here = {}
                for o, a, b, (d, first, starts, place) in zip(owner.tolist(), begin.tolist(), end.tolist(), spots.tolist(), strict=True):
                    key = (o, xxhash.xxh3_128_digest(data[a:b], starts))
                    if key in here:
                        here[key][-1] += (d, first)
                    else:
                        here[key] = [b - a, starts, place, d, first, [d, first]]
                for (o, digest), (*facts, at) in here.items():
                    for c, v in zip(out, (block, hashes[o], digest, len(at) // 2, *facts, pack(f"<{len(at)}i", *at)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, kind) for o, kind in zip(out, kinds, strict=True)], names)

    return run


CONTEXTS = "h long, shard long, shards long, digest binary, starts int, place int, context binary"


def _context_rows(batches):
    """The wanted contexts of each block."""
    import pyarrow as pa

    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    for batch in batches:
        for i in range(len(batch)):
            raw, offsets = _documents(batch, i)
            data, ends = raw.tobytes(), offsets.tolist()
            rows = batch.column("want")[i].values
            spots = zip(*(rows.field(c).to_pylist() for c in ("document", "first", "size")), strict=True)
            contexts = [data[ends[d] + a : ends[d] + a + size] for d, a, size in spots]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names[:-1]), pa.array(contexts, pa.binary())], names)


#: ranges: (length's number, a, b) as int32, window starts a to b - 1 of a context. keys and the rest: sorted windows of a
#: shard whose anchor has more, for the merge; spots: (context's number in digests, place) as int32.
FOUND = "h long, digest binary, ranges binary, which int, slice int, keys binary, spots binary, digests binary"


def _found_batch(rows: list):
    import pyarrow as pa

    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    full = [r if len(r) == len(names) else (*r, *[None] * (len(names) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], kind) for i, kind in enumerate(kinds)], names)


def _shards(lengths: tuple, k: int, shard_bytes: int):
    """Rows sorted by (h, shard): suffix arrays of some whole (h, shard) groups at a time.

    A task holds about 75 bytes for each byte of contexts, so groups are gathered up to half of shard_bytes only.
    """

    def solve(groups):
        import numpy as np

        h, shards, digests, contexts, starts = ([r[i] for g in groups for r in g] for i in (0, 1, 2, 4, 3))
        shard = Shard(contexts, starts, h)
        lcp = shard.prefixes(max(lengths))
        parts = {}
        for which, length in enumerate(lengths):
            a, b = runs_of(shard.repeated(lcp, length))
            c = shard.context[a] if len(a) else a
            for i, x, y in zip(c.tolist(), (a - shard.begins[c]).tolist(), (b - shard.begins[c]).tolist(), strict=True):
                parts.setdefault(i, []).extend((which, x, y))
        rows = [(h[i], digests[i], np.array(p, "<i4").tobytes()) for i, p in parts.items()]
        if shards[0] > 1:  # then the group is alone
            table = b"".join(digests)
            for which, length in enumerate(lengths):
                keys, c, place = shard.digests(lcp, length)
                piece = keys.view("u1").reshape(-1, 16)[:, :4].copy().view(">u4")[:, 0].astype(np.int64) * shards[0] >> 32
                cuts = np.searchsorted(piece, np.arange(shards[0] + 1))
                for s in range(shards[0]):
                    x, y = cuts[s], cuts[s + 1]
                    if x < y:
                        used, number = np.unique(c[x:y], return_inverse=True)
                        names = b"".join(table[16 * u : 16 * u + 16] for u in used.tolist())
                        spots = np.stack([number, place[x:y]], axis=1).astype("<i4").tobytes()
                        rows.append((h[0], None, None, which, s, keys[x:y].tobytes(), spots, names))
        return rows

    def ready(group):
        """The contexts of a group that can share a window of the shortest length, unless the anchor has other shards."""
        if group[0][1] > 1:
            return group
        return [group[i] for i in could_repeat([r[4] for r in group], [r[3] for r in group], [r[5] for r in group], min(lengths), k)]

    def run(batches):
        held, size, group, now = [], 0, [], None

        def close():
            nonlocal held, size, group
            done, group = ready(group) if group else [], []
            alone = bool(done) and done[0][1] > 1
            if held and (alone or size > shard_bytes // 2):
                yield _found_batch(solve(held))
                held, size = [], 0
            if done:
                held.append(done)
                size += sum(len(r[4]) for r in done)
            if alone:
                yield _found_batch(solve(held))
                held, size = [], 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "shard", "shards", "digest", "starts", "context", "place")), strict=True):
                if row[:2] != now:
                    yield from close()
                    now = row[:2]
                group.append((row[0], *row[2:]))
        yield from close()
        if held:
            yield _found_batch(solve(held))

    return run


def merged(runs: list):
    """(keys, owner, row, whether the key is in more than one run) of sorted runs of distinct keys, by binary search of one half in the other."""
    import numpy as np

    if len(runs) == 1:
        keys, owner = runs[0]
        return keys, np.full(len(keys), owner), np.arange(len(keys)), np.zeros(len(keys), bool)
    mid = len(runs) // 2
    a, b = merged(runs[:mid]), merged(runs[mid:])
    for x, y in ((a, b), (b, a)):
        at = np.searchsorted(y[0], x[0])
        inside = at < len(y[0])
        x[3][inside] |= y[0][at[inside]] == x[0][inside]
    at = np.searchsorted(a[0], b[0])
    return [np.insert(x, at, y) for x, y in zip(a, b, strict=True)]


def _merge(batches):
    """Rows sorted by (h, slice, which): the shards' runs of sorted windows; those that several shards hold, as ranges."""
    import numpy as np

    def solve(which, rows):
        keys = [(np.frombuffer(r[0], "S16"), i) for i, r in enumerate(rows)]
        _, owner, row, hit = merged(keys)
        parts = {}
        for o, r in zip(owner[hit].tolist(), row[hit].tolist(), strict=True):
            number, place = spots[o][r]
            parts.setdefault((o, int(number)), []).extend((which, int(place), int(place) + 1))
        return parts

    now, rows = None, []
    for batch in [*batches, None]:
        listed = zip(*(batch.column(c).to_pylist() for c in ("h", "slice", "which", "keys", "spots", "digests")), strict=True) if batch is not None else [(None,) * 6]
        for h, piece, which, *row in listed:
            if (h, piece, which) != now:
                if rows:
                    spots = [np.frombuffer(r[1], "<i4").reshape(-1, 2) for r in rows]
                    found = solve(now[2], rows)
                    if found:
                        yield _found_batch([(now[0], rows[o][2][16 * c : 16 * c + 16], np.array(p, "<i4").tobytes()) for (o, c), p in found.items()])
                now, rows = (h, piece, which), []
            if h is not None:
                rows.append(row)


def covered_bytes(rows, offsets, lengths: tuple) -> list:
    """For each length, the bytes of a block that its repeated windows cover; rows are the block's contexts that have any."""
    import numpy as np

    total = int(offsets[-1])
    if not len(rows):
        return [np.zeros(total, bool) for _ in lengths]
    spots = rows.field("spots")
    counts = np.diff(np.frombuffer(spots.buffers()[1], np.int32)[spots.offset : spots.offset + len(spots) + 1]) // 8
    packed = np.frombuffer(b"".join(spots.to_pylist()), "<i4").reshape(-1, 2)
    base = offsets[packed[:, 0]] + packed[:, 1]
    first = np.cumsum(counts) - counts
    whole = rows.field("whole").to_numpy(zero_copy_only=False)
    size, starts = (rows.field(c).to_numpy() for c in ("size", "starts"))
    parts = [(i, np.frombuffer(b"".join(r), "<i4").reshape(-1, 3)) for i, r in enumerate(rows.field("ranges").to_pylist()) if r and not whole[i]]
    owner = np.repeat([i for i, _ in parts], [len(r) for _, r in parts]).astype(np.int64)
    ranges = np.concatenate([r for _, r in parts]) if parts else np.zeros((0, 3), np.int32)
    covered = []
    for which, length in enumerate(lengths):
        ends = np.where(whole, np.minimum(starts, size - length + 1), 0)  # equal contexts: all their windows
        a, b = [base], [base + np.repeat(ends, counts)]
        mine = ranges[:, 0] == which
        here, times = owner[mine], counts[owner[mine]]
        at = np.repeat(first[here] - (np.cumsum(times) - times), times) + np.arange(times.sum())  # each range at each place of its context
        for ends_, column in ((a, 1), (b, 2)):
            ends_.append(base[at] + np.repeat(ranges[mine, column], times))
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = a[b > a], b[b > a] + length - 1
        covered.append(np.cumsum(np.bincount(a, minlength=total + 1) - np.bincount(b, minlength=total + 1))[:-1] > 0)
    return covered


RESULT = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(lengths: tuple, keep_text: bool):
    """The documents of each block without what is covered by repeated windows of the first length; of others, the bytes covered."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(f"n_repeated_{n}" for n in lengths[1:])] + ["kept"] * keep_text
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * (len(lengths) - 1) + [pa.string()] * keep_text
        for batch in batches:
            found = batch.column("found")
            for i in range(len(batch)):
                raw, offsets = _documents(batch, i)
                rows = found[i].values if found[i].is_valid else found.values.slice(0, 0)
                covered = covered_bytes(rows, offsets, lengths)
                gone = covered[0]
                keeps, data = ~gone, raw.tobytes()
                sums = [np.concatenate([[0], np.cumsum(c)]) for c in covered]
                inner = np.zeros(len(raw) + 1, np.int64)
                if len(raw):
                    begin = gone.copy()
                    begin[1:] &= ~gone[:-1]
                    heads = offsets[:-1][offsets[:-1] < len(raw)]
                    begin[heads] = gone[heads]
                    inner[1:] = np.cumsum(begin)
                a, b = offsets[:-1], offsets[1:]
                removed = sums[0][b] - sums[0][a]
                kept = []
                for x, y, r in zip(a.tolist(), b.tolist(), removed.tolist(), strict=True):
                    kept.append(raw[x:y][keeps[x:y]].tobytes() if r else data[x:y])
                here = [batch.column(c) for c in ("rid", "doc_id")]
                here = [c[i].values for c in here]
                columns = [*here, b - a, removed, inner[b] - inner[a], [hashlib.sha256(k).hexdigest() for k in kept], *(s[b] - s[a] for s in sums[1:])]
                if keep_text:  # characters that lost some of their bytes go as a whole
                    columns.append([k.decode("utf-8", "ignore") for k in kept])
                made = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                if keep_text:
                    made.append(batch.column("others")[i].values)
                yield pa.RecordBatch.from_arrays(made, names + ["others"] * keep_text)

    return run


def _bucketed(df: DataFrame, parts: int, tag: str) -> DataFrame:
    """df as a table of the warehouse, bucketed by block, so that joins on block leave the texts where they are."""
    import uuid

    spark = df.sparkSession
    name = f"parlance_{tag}_{uuid.uuid4().hex}"
    df.repartition(parts, "block").write.bucketBy(parts, "block").sortBy("block").option("path", common.shared_path(spark, tag)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, shard_bytes: int = SHARD, also: int | None = None
) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte is removed that is covered by a string of `length` bytes that also starts anywhere else, in the same
    document or another; matches never cross documents and overlaps count. With `also`, a lesser length, a column
    n_repeated_<also> counts the bytes that are covered by repeated strings of that length; nothing else changes. With
    keep_text also kept, the remaining text, and others, a struct of docs' other columns.

    Null counts as empty. Repeated rows remove each other; ids decide nothing and may be null or repeated; other columns
    are ignored, whatever their names; a very long text is a block of its own; an empty table gives no rows.
    """
    import pyspark.sql.types as T

    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    lengths = (length,) if also is None else (length, also)
    least = min(lengths)
    k = max(1, min(K, least // 4))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    carried = [F.struct(*others).alias("others") if others else F.lit(None).cast("string").alias("others")] if keep_text else []
    source = common.source(docs, id_col, text_col, F.monotonically_increasing_id().alias("rid"), *carried)
    source = source.withColumn("text", F.coalesce("text", F.lit("")))
    listed = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in source.schema)])
    blocks = _bucketed(source.mapInArrow(_pack_blocks, listed), parts, "suffix_texts")
    texts = blocks.select("block", "text")

    anchored = common.materialise(texts.mapInArrow(_anchor_rows(least, k), "block long, h long, n int, spots binary"), "suffix-anchors")
    again = anchored.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).filter("n > 1").select("h", "blocks")
    again = common.materialise(again, "suffix-again")
    spots = common.join_classes(anchored.select("block", "h", "spots"), again, ["h"], "blocks", anchored.count())
    spots = spots.groupBy("block").agg(F.collect_list(F.struct("h", "spots")).alias("found"))
    places = texts.join(spots, "block").mapInArrow(_place_rows(length, least), PLACES)
    places = common.materialise(places, "suffix-places")
    common.discard(anchored, again)

    rep = F.min(F.struct("block", "document", "first")).alias("rep")
    copies = places.groupBy("h", "digest").agg(F.sum("n").alias("copies"), F.count("*").alias("blocks"), *(F.max(c).alias(c) for c in ("size", "starts", "place")), rep)
    copies = common.materialise(copies, "suffix-copies")
    mixed = copies.groupBy("h").agg(F.count("*").alias("variants"), F.sum("size").alias("bytes")).filter("variants > 1")
    mixed = mixed.select("h", F.ceil(F.col("bytes") / shard_bytes).alias("shards"))
    wanted = copies.join(mixed, "h").withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")))
    fields = ["h", "shard", "shards", "digest", "starts", "place", F.col("rep.document").alias("document"), F.col("rep.first").alias("first"), "size"]
    wanted = wanted.groupBy(F.col("rep.block").alias("block")).agg(F.collect_list(F.struct(*fields)).alias("want"))
    contexts = texts.join(wanted, "block").mapInArrow(_context_rows, CONTEXTS)
    within = contexts.repartition(parts, "h", "shard").sortWithinPartitions("h", "shard").mapInArrow(_shards(lengths, k, shard_bytes), FOUND)
    within = common.materialise(within, "suffix-shards")
    ranges = within.filter("ranges is not null").select("h", "digest", "ranges")
    windows = within.filter("keys is not null")
    if not windows.isEmpty():
        windows = windows.repartition(parts, "h", "slice").sortWithinPartitions("h", "slice", "which")
        ranges = ranges.unionByName(windows.mapInArrow(_merge, FOUND).select("h", "digest", "ranges"))

    # Back to the blocks: a context has few ranges, and a block names it once, whatever its occurrences.
    ranges = ranges.groupBy("h", "digest").agg(F.collect_list("ranges").alias("ranges"))
    by_context = copies.select("h", "digest", "blocks", "size", "starts", (F.col("copies") > 1).alias("whole")).join(ranges, ["h", "digest"], "left")
    by_context = by_context.filter("whole or ranges is not null")
    by_context = common.materialise(by_context, "suffix-found")
    common.discard(copies, within)
    spans = common.join_classes(places.select("block", "h", "digest", "spots"), by_context, ["h", "digest"], "blocks", places.count())
    spans = spans.groupBy("block").agg(F.collect_list(F.struct("whole", "size", "starts", "ranges", "spots")).alias("found"))
    kind = RESULT + "".join(f", n_repeated_{n} long" for n in lengths[1:])
    if keep_text:
        kind += f", kept string, others {blocks.schema['others'].dataType.elementType.simpleString()}"
    return blocks.join(spans, "block", "left").mapInArrow(_cut(lengths, keep_text), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8, and beside it how many bytes are in repeated strings of PASSAGE bytes."""
    return remove_repeats(common.table(spark, sf_dir, "documents"), also=PASSAGE).drop("rid")


def cut_documents(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with what repeats cut from the text, and size_col, if docs has it, counted anew; all rows and columns stay.

    Null texts become empty; ids, nulls and repeats among them included, stay as they are.
    """
    cut = remove_repeats(docs, length, id_col, text_col, keep_text=True)
    own = {id_col: F.col("doc_id"), text_col: F.col("kept"), size_col: F.length("kept").cast("bigint")}
    return cut.select(*(own.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns))
