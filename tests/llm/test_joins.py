"""N-gram join and suffix-array dedup against brute force, on whole small tables and on forced chunks and shards."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import common, ngram_join, suffix_dedup
from parlance.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_join(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(i)
    pairs = {(i, j) for ids in lists.values() for i in ids for j in ids if i < j}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(sets[i][0]), find(sets[j][0])
            parent[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets}


def brute_cut(docs, length):
    seen = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def family(rng, copies, words=120, edits=4, vocabulary=500):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        yield " ".join(text)


def fixture(rng):
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "a b c d e f", "A B c d e f", "É é é é é é"]
    passage = " ".join(f"p{i}" for i in range(80))
    for _ in range(6):
        texts += family(rng, rng.randrange(1, 12))
    for _ in range(20):
        texts.append(" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))) + " " + passage)
    texts += ["Orre " * 300, "Orre " * 500, "orre " * 300]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return docs + [docs[0], docs[5]]


@pytest.mark.parametrize("sizes", [{}, {"block_grams": 300, "chunk_sets": 3, "chunk_grams": 400}])
def test_join_fixture(spark, sizes):
    docs = fixture(random.Random(3))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = {tuple(r) for r in ngram_join.similar_documents(df.withColumn("cid", df.text), **sizes).collect()}
    assert got == brute_join(docs)


def test_join_one_large_group(spark):
    """Hundreds of classes that share prefix n-grams, in chunks of 3: near copies of one text, and a chain that drifts away from it."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = []
    for _ in range(250):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    for at in range(0, 60, 2):
        base[at] = f"y{at}"
        texts.append(" ".join(base))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = {tuple(r) for r in ngram_join.similar_documents(df, chunk_sets=3).collect()}
    assert got == brute_join(docs) and len({c for _, _, c in got}) > 1


def test_join_edges(spark):
    """Null ids and texts, repeated rows, clashing column names, a text of a million bytes, an empty table."""
    long = " ".join(f"t{i}" for i in range(150_000))
    rows = [(1, long, 0), (2, long + " end", 0), (None, "a b c d e f", 0), (None, None, 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (4, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cid int").withColumns({"grams": F.lit("x"), "component_id": F.lit(9)})
    got = Counter(tuple(r) for r in ngram_join.similar_documents(df).collect())
    assert got == Counter([(1, 149_996, 1), (2, 149_997, 1), (None, 2, 3), (None, 0, None), (3, 2, 3), (3, 2, 3), (4, 0, 4)])
    assert ngram_join.similar_documents(df.filter("false")).collect() == []


def test_one_of_each_ids(spark):
    """Null ids stay unless a row with an id is similar; of repeated ids only the row chosen for its group stays."""
    rng = random.Random(8)
    x, y, z = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "xyz")
    rows = [(1, x), (7, x + " end"), (7, y), (None, z), (None, ""), (None, None), (None, "End " + x), (9, ""), (7, y), (None, "q w"), (None, "q w")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit("r")).repartition(3)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, x), (7, y), (None, z), (None, ""), (None, None), (9, ""), (None, "q w")])
    assert ngram_join.one_of_each(df.filter("false")).collect() == []


def test_join_empty(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_join_table(spark, sf):
    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = QUERIES["op3_ngram_jaccard_join"](spark, sf).collect()
    assert len(rows) == len(docs) and {tuple(r) for r in rows} == brute_join(docs)


@pytest.mark.parametrize("shard", [4_000_000, 700])
def test_cut_fixture(spark, shard):
    rng = random.Random(5)
    docs = fixture(rng)
    docs += [(1000, "ab" * 300), (1001, "é" * 200), (1002, docs[30][1] or "x" * 90)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = sorted(tuple(r)[1:] for r in suffix_dedup.remove_repeats(df.withColumn("spots", df.text), length=64, shard_bytes=shard).collect())
    assert got == brute_cut(docs, 64)


@pytest.mark.parametrize("shard", [1 << 21, 900])
def test_cut_also(spark, shard):
    """Bytes of a lesser length are counted beside those removed, whether an anchor has one shard or many."""
    docs = fixture(random.Random(6))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    rows = suffix_dedup.remove_repeats(df, length=96, also=48, shard_bytes=shard).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == brute_cut(docs, 96)
    assert sorted((r.doc_id, r.n_repeated_48) for r in rows) == sorted((r[0], r[2]) for r in brute_cut(docs, 48))


def test_cut_edges(spark):
    """Null ids and texts, repeated rows, clashing column names, a text of a million bytes, bytes of value 0."""
    rng = random.Random(9)
    long = " ".join(f"t{rng.randrange(10**9)}" for _ in range(100_000))
    rows = [(1, long), (2, "start " + long[500_000:500_600] + " stop"), (None, None), (None, "x" * 399), (3, "\0" * 800), (3, "\0" * 800), (4, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rid": F.lit("r"), "block": F.lit(1), "h": F.lit(None).cast("int")})
    got = Counter(tuple(r)[1:4] for r in suffix_dedup.remove_repeats(df).collect())
    assert got == Counter([(1, len(long), 600), (2, 611, 600), (None, 0, 0), (None, 399, 0), (3, 800, 800), (3, 800, 800), (4, 0, 0)])
    cut = suffix_dedup.cut_documents(df)
    assert cut.columns == df.columns and Counter(r.text for r in cut.collect() if r.doc_id != 1) == Counter(["start  stop", "", "x" * 399, "", "", ""])


def test_cut_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cut_table(spark, sf):
    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op8_suffix_array_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_cut(docs, 400)


def test_suffix_array_and_kasai():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, low in ((1, 97), (2, 97), (9, 0), (50, 0), (700, 0), (700, 97)):
        t = rng.integers(low, low + 2, n).astype(np.uint8)
        t[-min(n, 5) :] = low
        b = t.tobytes()
        order, rank = suffix_dedup.suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:]) and (order[rank] == np.arange(n)).all()
        starts = np.unique(np.append(0, rng.integers(0, n, 3)))
        lcp = suffix_dedup.common_prefixes(t, order, rank, starts, np.diff(np.append(starts, n)), 40)

        def shared(x, y):
            return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905

        assert lcp.tolist() == [0] + [min(40, shared(b[order[k] :], b[order[k - 1] :])) for k in range(1, n)]
