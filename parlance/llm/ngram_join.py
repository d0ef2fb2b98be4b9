"""Exact Jaccard self-join of word n-gram sets, by prefix trees.

1. Documents with one n-gram set are one class; only classes are joined.
2. Pruning: map tasks cut their classes into blocks and send each distinct n-gram of a block once to the n-gram's owner;
   owners tell the blocks which n-grams occur elsewhere too. The overlap of two sets lies in those, so a class with fewer
   than threshold * n of them has no partner and ends here. A frequent n-gram is one entry per block, never one per row.
3. Owners also tell how many classes have an n-gram. The others order their n-grams globally, rare ones first (ties by
   hash), so that what unlike documents share comes last, and meet in candidate groups: components over shared prefix
   n-grams.
4. Each group, in chunks of bounded size, is joined by a prefix tree: sets are paths, a query walks the tree carrying
   the overlap that all sets below a node share, and leaves a subtree when the remaining lengths cannot reach the
   required overlap, or when all below it is linked to the query already. Groups of several chunks take two more
   rounds: representatives of the chunks' components, then everything outside the largest component against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Distinct n-grams of a block; a larger document is a block of its own.
BLOCK = 1_500_000
#: A chunk of a candidate group, in n-grams and in sets.
CHUNK_GRAMS, CHUNK_SETS = 2_000_000, 4096
#: Stands for the class of an n-gram that several classes of its block have.
ALONE = 0xFFFFFFFF


# ---- n-gram sets


def gram_sets(texts, n: int = 5):
    """(distinct n-gram hashes of all texts, sorted within each text, number for each text); a uint64 stands for an n-gram."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    raw, offsets = common.utf8_buffer(texts)
    low = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    lowered = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low)])
    words, counts = common.words_of(lowered)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    coded = words.dictionary_encode()
    seeds = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    h = seeds[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    step = np.uint64(0x9E3779B97F4A7C15)
    grams = np.zeros(0, np.uint64)
    if len(h) >= n:
        grams = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            grams = grams * step + h[k : len(h) - n + 1 + k]
        inside = doc[: len(grams)] == doc[n - 1 :]
        grams, owner = grams[inside], doc[: len(inside)][inside]
    else:
        owner = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the whole sequence is one n-gram, of its own kind for each length
        whole = []
        for d in short.tolist():
            g = np.uint64(counts[d] + 1)
            for x in h[ends[d] - counts[d] : ends[d]]:
                g = np.uint64((int(g) * int(step) + int(x)) & (1 << 64) - 1)
            whole.append(g)
        grams, owner = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    grams = mixed(grams)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.bincount(owner[keep], minlength=len(counts))


def mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_ids(grams, sizes):
    """A signed 64-bit id for each set: two equal sets have one id."""
    import numpy as np

    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mixed((upto[ends] - upto[ends - sizes]) * np.uint64(3) + sizes.astype(np.uint64)).view(np.int64)


def _sets(n: int):
    """(every column but the text, n, cid) of rows with a text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = [c for c in batch.schema.names if c != "text"]
            for rows, texts in common.text_slices(pa.array(np.arange(len(batch))), batch.column("text")):
                grams, sizes = gram_sets(texts, n)
                own = [batch.column(c).slice(rows[0].as_py(), len(rows)) for c in ids]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(set_ids(grams, sizes), pa.int64())], [*ids, "n", "cid"])

    return run


# ---- pruning


def _press(*arrays) -> bytes:
    """Arrays of equal length as byte planes, compressed."""
    import numpy as np
    import pyarrow as pa

    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpress(data: bytes, *kinds):
    import numpy as np
    import pyarrow as pa

    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = size // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


PARTS = "bucket int, block long, classes binary, grams binary"
_NAMES = ["bucket", "block", "classes", "grams"]


def _batch(rows, names=_NAMES, kinds=None):
    import pyarrow as pa

    kinds = kinds or [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _blocks(n: int, buckets: int, block_grams: int):
    """Rows to owners (classes null: grams are n-gram step, class or ALONE, number of classes) and one row of each block."""

    def flush(held, block):
        import numpy as np

        cids, sizes, grams = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first = np.unique(cids, return_index=True)
        fresh = np.zeros(len(cids), bool)
        fresh[first] = True
        fresh &= sizes > 0
        grams = grams[np.repeat(fresh, sizes)]
        cids, sizes = cids[fresh], sizes[fresh]
        ref = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        order = np.argsort(grams, kind="stable")
        grams, ref = grams[order], ref[order]
        start = np.ones(len(grams), bool)
        start[1:] = grams[1:] != grams[:-1]
        at = np.flatnonzero(start)
        count = np.diff(np.append(at, len(grams)))
        shared = np.repeat(count > 1, count)
        yield block % buckets, block, _press(cids, sizes.astype(np.int64)), _press(ref[shared], grams[shared])
        single = np.where(count == 1, ref[at], np.uint32(ALONE)).astype(np.uint32)
        number, tokens = count.astype(np.uint32), grams[at]
        bucket = bucket_of(tokens, buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            t = tokens[cuts[b] : cuts[b + 1]]
            if len(t):
                yield b, block, None, _press(np.diff(t, prepend=np.uint64(0)), single[cuts[b] : cuts[b + 1]], number[cuts[b] : cuts[b + 1]])

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        block, held, size = (context.partitionId() if context else 0) << 32, [], 0
        for batch in batches:
            for _, texts in common.text_slices(batch.column("doc_id"), batch.column("text")):
                grams, sizes = gram_sets(texts, n)
                held.append((set_ids(grams, sizes), sizes, grams))
                size += len(grams)
                if size >= block_grams:
                    for row in flush(held, block):
                        yield _batch([row])
                    block, held, size = block + 1, [], 0
        if size:
            for row in flush(held, block):
                yield _batch([row])

    return run


def bucket_of(tokens, buckets: int):
    import numpy as np

    return ((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _owners(batches):
    """For each bucket: tells each block which of its n-grams other blocks have as well, and how many classes have them."""

    def answer(rows):
        import numpy as np

        blocks, steps, refs, numbers = [], [], [], []
        for block, data in rows:
            step, ref, number = _unpress(data, np.uint64, np.uint32, np.uint32)
            blocks.append(block)
            steps.append(np.cumsum(step, dtype=np.uint64))
            refs.append(ref)
            numbers.append(number)
        tokens, ref, number = np.concatenate(steps), np.concatenate(refs), np.concatenate(numbers)
        row = np.repeat(np.arange(len(rows)), [len(s) for s in steps])
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        head = np.ones(len(t), bool)
        head[1:] = t[1:] != t[:-1]
        at = np.flatnonzero(head)
        sizes = np.diff(np.append(at, len(t)))
        total = np.repeat(np.add.reduceat(number[order].astype(np.int64), at), sizes)
        again = np.repeat(sizes > 1, sizes)
        hit, total = order[again], np.minimum(total[again], ALONE).astype(np.uint32)
        by_row = np.argsort(row[hit], kind="stable")
        hit, total = hit[by_row], total[by_row]
        cuts = np.searchsorted(row[hit], np.arange(len(rows) + 1))
        for i, block in enumerate(blocks):
            own = hit[cuts[i] : cuts[i + 1]]
            if len(own):
                yield 0, block, None, _press(ref[own], tokens[own], total[cuts[i] : cuts[i + 1]])

    now, held = None, []
    for batch in batches:
        for bucket, block, classes, grams in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            if classes is not None:
                yield _batch([(0, block, classes, grams)])
                continue
            if bucket != now and held:
                for row in answer(held):
                    yield _batch([row])
                held = []
            now = bucket
            held.append((block, grams))
    if held:
        for row in answer(held):
            yield _batch([row])


def _survivors(percent: int):
    """For each block: its classes with at least percent of their n-grams shared, with those n-grams as sort keys."""

    def emit(rows):
        import numpy as np
        import pyarrow as pa

        own = [r for r in rows if r[0] is not None]
        if not own:
            return
        cids, sizes = _unpress(own[0][0], np.int64, np.int64)
        here_ref, here = _unpress(own[0][1], np.uint32, np.uint64)
        parts = [_unpress(r[1], np.uint32, np.uint64, np.uint32) for r in rows if r[0] is None]
        none = [np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
        far_ref, far, far_total = (np.concatenate([p[i] for p in [*parts, none]]) for i in range(3))
        alone = far_ref == ALONE
        tokens, back, count = np.unique(here, return_inverse=True, return_counts=True)
        spot = np.searchsorted(tokens, far[alone])  # told of n-grams that several classes of this block have
        count[spot] = far_total[alone]
        ref = np.concatenate([here_ref, far_ref[~alone]]).astype(np.int64)
        keys = sort_keys(np.concatenate([here, far[~alone]]), np.concatenate([count[back], far_total[~alone].astype(np.int64)]))
        shared = np.bincount(ref, minlength=len(cids))
        stays = 100 * shared >= percent * sizes
        keep = stays[ref]
        ref, keys = ref[keep], keys[keep]
        order = np.lexsort((keys, ref))
        which = np.flatnonzero(stays)
        o = np.concatenate([[0], np.cumsum(shared[which])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(o), pa.array(keys[order].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(cids[which]), pa.array(sizes[which]), lists], ["cid", "n", "grams"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for block, classes, grams in zip(*(batch.column(c).to_pylist() for c in _NAMES[1:]), strict=True):
                if block != now and held:
                    yield from emit(held)
                    held = []
                now = block
                held.append((classes, grams))
        if held:
            yield from emit(held)

    return run


# ---- candidate groups


def sort_keys(grams, number):
    """n-grams in the global order: 8 bits of the logarithm of the number of classes that have it, 56 of hash."""
    import numpy as np

    level = np.floor(8 * np.log2(np.maximum(number, 1).astype(np.float64))).astype(np.uint64)
    return (level << np.uint64(56)) | (grams & np.uint64((1 << 56) - 1))


def _prefixes(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out_key, out_cid = [], []
            for cid, n, grams in zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist(), batch.column("grams"), strict=True):
                key = grams.values.to_numpy()
                prefix = key[: len(key) - (-(-percent * n // 100)) + 1]
                out_key.append(prefix)
                out_cid.append(np.full(len(prefix), cid))
            if out_key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_cid), pa.int64())], ["gram", "cid"])

    return run


# ---- the prefix tree


class Node:
    __slots__ = ("seg", "kids", "ends", "deepest", "least", "most", "tag")

    def __init__(self, seg, deepest, n, tag):
        self.seg, self.kids, self.ends = seg, {}, []
        self.deepest, self.least, self.most, self.tag = deepest, n, n, tag


class PrefixTree:
    """Sets of ranks, sorted in the global order, as paths. tags are ids of what is linked already, joined by `find`."""

    def __init__(self, percent: int, find):
        self.percent, self.find, self.root = percent, find, None

    def insert(self, ranks, n: int, member: int) -> None:
        import numpy as np

        if self.root is None:
            self.root = Node(ranks[:0], len(ranks), n, member)
        node, at = self.root, 0
        while True:
            node.deepest, node.least, node.most = max(node.deepest, len(ranks)), min(node.least, n), max(node.most, n)
            if node.tag >= 0 and self.find(node.tag) != self.find(member):
                node.tag = -1
            if at == len(ranks):
                node.ends.append((member, n))
                return
            kid = node.kids.get(int(ranks[at]))
            if kid is None:
                leaf = Node(ranks[at:], len(ranks), n, member)
                leaf.ends.append((member, n))
                node.kids[int(ranks[at])] = leaf
                return
            rest = ranks[at : at + len(kid.seg)]
            same = rest == kid.seg[: len(rest)]
            common_length = len(rest) if same.all() else int(np.argmin(same))
            if common_length < len(kid.seg):  # split the edge
                upper = Node(kid.seg[:common_length], kid.deepest, kid.least, kid.tag)
                upper.most = kid.most
                kid.seg = kid.seg[common_length:]
                upper.kids[int(kid.seg[0])] = kid
                node.kids[int(ranks[at])] = upper
                kid = upper
            node, at = kid, at + common_length

    def linked(self, ranks, n: int, member: int, mark):
        """Yields members within the threshold that are not linked to member when their node is reached.

        mark: a scratch array over all ranks, 0 outside calls.
        """
        if self.root is None:
            return
        mark[ranks] = 1
        percent, find, total = self.percent, self.find, len(ranks)
        stack = [(self.root, 0, 0)]  # node, depth above it, overlap above it
        try:
            while stack:
                node, depth, overlap = stack.pop()
                if node.tag >= 0 and find(node.tag) == find(member):
                    continue
                if 100 * node.least * percent > 10000 * n or 100 * n * percent > 10000 * node.most:
                    continue
                need = -(-percent * (n + node.least) // (100 + percent))
                if overlap + min(node.deepest - depth, total) < need:
                    continue
                seg = node.seg
                if len(seg):
                    overlap += int(mark[seg].sum())
                    depth += len(seg)
                    left = total - int(ranks.searchsorted(seg[-1], "right"))
                    if overlap + min(node.deepest - depth, left) < need:
                        continue
                for other, m in node.ends:
                    if (100 + percent) * overlap >= percent * (n + m) and find(other) != find(member):
                        yield other
                stack += [(k, depth, overlap) for k in node.kids.values()]
        finally:
            mark[ranks] = 0


def join_group(members, queries, percent: int):
    """Links (pairs of cids) that connect what the threshold connects among members, and from queries to members.

    Both yield (cid, n, sorted keys, tag); equal tags are linked already. Queries are streamed.
    """
    import numpy as np

    if not members:
        return
    vocabulary = np.unique(np.concatenate([m[2] for m in members]))
    mark, parent, by_tag = np.zeros(len(vocabulary), np.int8), [], {}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def entry(tag):
        me = len(parent)
        parent.append(find(by_tag[tag]) if tag in by_tag else me)
        by_tag.setdefault(tag, me)
        return me

    tree, cids = PrefixTree(percent, find), {}
    for role, rows in ((0, members), (1, queries)):
        for cid, n, keys, tag in rows:
            me = entry(tag)
            cids[me] = cid
            at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
            ranks = at[vocabulary[at] == keys]
            for other in tree.linked(ranks, n, me, mark):
                if find(other) != find(me):
                    parent[find(me)] = find(other)
                    yield cid, cids[other]
            if role == 0:
                tree.insert(ranks, n, me)


def _joined(percent: int):
    """Rows sorted by (grp, chunk, role): members (role 0), then queries (role 1), of one tree after another."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows():
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("grp", "chunk", "role", "cid", "n", "tag")]
                for i, (grp, chunk, role, cid, n, tag) in enumerate(zip(*cols, strict=True)):
                    yield (grp, chunk), role, (cid, n, batch.column("grams")[i].values.to_numpy().view(np.uint64), tag)

        source = rows()
        row = next(source, None)
        while row is not None:
            key, members = row[0], []
            while row is not None and row[0] == key and row[1] == 0:
                members.append(row[2])
                row = next(source, None)

            def queries(key=key):
                nonlocal row
                while row is not None and row[0] == key:
                    yield row[2]
                    row = next(source, None)

            rest = queries()
            links = list(join_group(members, rest, percent))
            for _ in rest:
                pass
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _tree_round(rows: DataFrame, parts: int, percent: int, tag: str) -> DataFrame:
    cols = ["grp", "chunk", "role", "cid", "n", "grams", "tag"]
    dealt = rows.select(*cols).repartition(parts, "grp", "chunk").sortWithinPartitions("grp", "chunk", "role", "n", "cid")
    return common.materialise(dealt.mapInArrow(_joined(percent), "a long, b long"), tag)


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, block_grams: int = BLOCK, chunk_grams: int = CHUNK_GRAMS, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """links(a, b) between set ids whose components are those of the similarity graph; docs has doc_id and text."""
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    blocks = docs.mapInArrow(_blocks(n, 2 * parts, block_grams), PARTS)
    told = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_owners, PARTS)
    kept = told.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_survivors(percent), "cid long, n long, grams array<long>")
    sets = common.materialise(kept.groupBy("cid").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "ngram-sets")

    prefix = common.materialise(sets.mapInArrow(_prefixes(percent), "gram long, cid long"), "ngram-prefixes")
    lead = prefix.groupBy("gram").agg(F.min("cid").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    edges = prefix.join(lead, "gram").filter("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct()
    groups = common.connected_components(edges, "ngram-groups").withColumnsRenamed({"node": "cid", "component": "grp"})
    candidates = common.materialise(sets.join(groups, "cid"), "ngram-candidates")
    sizes = candidates.groupBy("grp").agg(F.greatest(F.ceil(F.sum(F.size("grams")) / chunk_grams), F.ceil(F.count("*") / chunk_sets)).alias("chunks"))
    rows = candidates.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks"))).withColumns({"role": F.lit(0), "tag": F.col("cid")})
    rows = common.materialise(rows, "ngram-chunks")
    links = _tree_round(rows, parts, percent, "ngram-links")
    many = rows.filter("chunks > 1").drop("tag")
    common.discard(sets, candidates)
    if many.isEmpty():
        common.discard(prefix, rows)
        return links

    def labelled(links):
        label = common.connected_components(links, "ngram-labels").select(F.col("node").alias("cid"), F.col("component"))
        return common.materialise(many.join(label, "cid", "left").withColumn("tag", F.coalesce("component", "cid")).drop("component"), "ngram-labelled")

    now = labelled(links)
    heads = now.filter("cid = tag")
    counts = heads.groupBy("grp").agg(F.greatest(F.ceil(F.sum(F.size("grams")) / chunk_grams), F.ceil(F.count("*") / chunk_sets)).alias("heads"))
    heads = heads.join(counts, "grp").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("heads")))
    links = common.materialise(links.unionByName(_tree_round(heads, parts, percent, "ngram-links")), "ngram-links")
    now = labelled(links)
    largest = now.groupBy("grp", "tag").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max(F.struct("size", "tag")).tag.alias("largest"))
    outside = now.join(largest, "grp").filter("tag <> largest").drop("largest")
    # Linked sets share a prefix n-gram, so a class asks the chunks that hold one of its own, but not the chunk it is in.
    holding = prefix.join(now.select("cid", "chunk"), "cid").select("gram", "chunk").distinct()
    asks = prefix.join(outside.select("cid", F.col("chunk").alias("home")), "cid").join(holding, "gram").filter("chunk <> home")
    asked = outside.drop("chunk").join(asks.select("cid", "chunk").distinct(), "cid").withColumn("role", F.lit(1))
    last = _tree_round(now.unionByName(asked.select(*now.columns)), parts, percent, "ngram-links")
    common.discard(prefix, rows)
    return links.unionByName(last)


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when their sets of n-word shingles have a Jaccard similarity of at least percent/100; the
    component is named by its smallest doc_id. Fewer than n words are one shingle; null, empty and blank texts have
    none, link with nothing, and are components of their own. Repeated rows are linked by their equal sets. Other columns
    are ignored, whatever their names; an empty table gives no rows; long texts are read whole.
    """
    source = common.source(docs, id_col, text_col)
    rows = common.materialise(source.mapInArrow(_sets(n), "doc_id long, n long, cid long"), "ngram-docs")
    total = rows.count()
    links = similar_classes(source, n, percent, **sizes)
    label = common.connected_components(links, "ngram-components")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    named = classes.join(label.withColumnRenamed("node", "cid"), "cid")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = common.materialise(named.join(least, "component").select("cid", "least"), "ngram-named")
    classes = classes.join(named, "cid", "left").select("cid", "copies", F.coalesce("least", "first").alias("component_id"))
    found = common.join_classes(rows.filter("n > 0"), classes, ["cid"], "copies", total)
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return found.select(*cols).unionByName(alone.select(*cols))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, **sizes) -> DataFrame:
    """docs with one document, that of the smallest id, of each group of similar ones; all columns stay.

    A group is one of rows, whatever their ids: of repeated ids one row stays in a group, rows of a null id come last.
    Rows without shingles are groups of their own and stay.
    """
    rid = next(c for c in ("rid" + "_" * k for k in range(len(docs.columns) + 1)) if c.lower() not in {x.lower() for x in docs.columns})
    numbered = common.materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "ngram-numbered")
    source = common.source(numbered, id_col, text_col, F.col(rid).alias("rid"))
    rows = common.materialise(source.mapInArrow(_sets(n), "rid long, doc_id long, n long, cid long"), "ngram-rows")
    links = similar_classes(source.drop("rid"), n, percent, **sizes)
    label = common.connected_components(links, "ngram-components").withColumnRenamed("node", "cid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = rows.filter("n > 0").groupBy("cid").agg(first.alias("first"))
    heads = classes.join(label, "cid", "left").groupBy(F.coalesce("component", "cid").alias("component")).agg(F.min("first").alias("first"))
    stay = heads.select("first.rid").unionByName(rows.filter("n = 0").select("rid"))
    stay = common.materialise(stay.withColumnRenamed("rid", rid), "ngram-stay")
    common.discard(rows)
    return numbered.join(stay, rid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(common.table(spark, sf_dir, "documents"))
