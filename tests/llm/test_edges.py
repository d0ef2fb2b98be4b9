"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import base64
import hashlib
import json
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.llm import chat, exact_dedup, media, packing, quality, sentencepiece_fst, url_filters, warc

SCHEMA = "doc_id long, text string, rid long, h string, n int"
ROWS = [(1, "Same text", 5, "x", 1), (2, None, 5, None, None), (3, "", 6, "y", 2), (4, "Same text", None, "x", 1), (4, "Same text", None, "x", 1), (None, "é ñ 日本 😀 \x00 ok", 1, "z", 3), (7, "w" * 30_000 + " end", 1, "z", 3), (8, "a b " * 5_000, 1, "z", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS) and sum(r.kept for r in rows) == 5
    by = {(r.doc_id, r.keep_id, r.group_size) for r in rows}
    assert {(1, 4, 3), (4, 4, 3), (2, 3, 2), (3, 3, 2), (None, None, 1)} <= by
    assert sum(r.kept for r in rows if r.doc_id == 4) == 1
    assert exact_dedup.exact_dedup(none).collect() == []
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 7, 8]


def test_exact_dedup_chains(docs):
    """Hashes of one bit, and digests that clash: chained, then told apart by the text."""
    good = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size").collect()), key=str)
    weak = exact_dedup.exact_dedup(docs, capacity=1, hash_of=lambda c: F.length(c).cast("bigint") % 2)
    assert sorted((tuple(r) for r in weak.select("doc_id", "keep_id", "group_size").collect()), key=str) == good
    clash = exact_dedup.exact_dedup(docs, hash_of=lambda c: F.lit(7).cast("bigint"), digest_of=lambda c: (F.length(c) % 2).cast("string"))
    assert sorted((tuple(r) for r in clash.select("doc_id", "keep_id", "group_size").collect()), key=str) == good


def test_directory_splits(spark):
    rng = random.Random(1)
    hashes = spark.createDataFrame([(rng.getrandbits(63) - 2**62,) for _ in range(500)] + [(5,)] * 50, "h long")
    table, depth = exact_dedup.build_directory(spark, hashes, 20, 4, max_depth=8)
    rows = table.orderBy("cell").collect()
    assert len(rows) == 1 << depth and depth == 8 and [r.owner for r in rows] == sorted(r.owner for r in rows)
    cells = Counter(r.bucket for r in rows)
    for r in rows:  # a bucket has as many cells as its depth leaves open
        assert cells[r.bucket] == 1 << (depth - r.depth)


def test_packing(docs, none):
    rows = packing.pack(docs.withColumn("key", F.lit("k")), length=64, keep_ids=True).collect()
    assert sorted((r.doc_id or 0) for r in rows if r.doc_tokens == 1) == [2, 3]
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = [s * 64 + o for s, o, _ in places]
    assert at[0] == 0 and all(a + n == b for a, b, (_, _, n) in zip(at, at[1:], places)) and all(len(r.ids) == r.length for r in rows)  # noqa: B905
    assert packing.pack(none).collect() == []


def test_hilbert_neighbours():
    import itertools

    import numpy as np

    bits = packing.BITS
    packing.BITS = 2
    try:
        points = np.array(list(itertools.product(range(4), repeat=3)))
        order = points[np.argsort(packing.hilbert_key(points))]
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    finally:
        packing.BITS = bits


def test_quality(spark, docs, none):
    good = [(i, f"the quiet river runs past the old mill number {i} and " * 9) for i in range(60)]
    bad = [(100 + i, f"BUY!!! $$$ NOW### {i} %%% " * 20) for i in range(60)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    model = quality.train(train, labels)
    rows = quality.score(train, model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id < 100) for r in rows) > 115
    assert len(quality.score(docs, model).collect()) == len(ROWS) and all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(none, model).collect() == []
    assert quality.train(train, labels.filter("quality = 1")) == {"constant": 1.0} and quality.train(train, labels.filter("false")) == {"constant": 0.5}
    kept = quality.keep_good(docs.withColumn("score", F.lit("s")), {"constant": 0.9})
    assert kept.count() == len(ROWS) and quality.keep_good(docs, {"constant": 0.1}).count() == 0


def test_quality_long_texts(spark, monkeypatch):
    """Training sees all passages of a long text, and a text encoded block by block trains as one encoded at once."""
    import numpy as np

    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y, w, **k: seen.append(bags) or {"constant": 0.5})
    texts = [(1, "good day " * 9_000), (2, "bad " * 150_000), (3, "bad"), (4, ""), (6, "good"), (8, "ok")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    quality.train(df, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int"))
    used = [len(t) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    assert max(used) > 48 * quality.PASSAGE and [len(b) for b in seen[0]] == [max(1, -(-n // quality.PASSAGE)) for n in used]
    monkeypatch.undo()
    monkeypatch.setattr(quality, "BLOCK", 3)
    rng = np.random.default_rng(1)
    raws = [rng.integers(32, 126, n).astype(np.uint8) for n in (0, 1, 600, 512 * 3, 512 * 7 + 5)]
    y, w = np.array([0, 1, 0, 1, 1], np.float32), np.ones(5, np.float32)
    whole = [quality.encode(r, np.array([0, len(r)]))[0] for r in raws]
    assert all(np.array_equal(np.concatenate(list(quality.LongBag(r).blocks())), x) and len(quality.LongBag(r)) == len(x) for r, x in zip(raws, whole, strict=True))
    monkeypatch.setattr(quality, "EPOCHS", 2)
    a, b = quality.fit(whole, y, w), quality.fit([quality.LongBag(r) for r in raws], y, w)
    assert all(np.allclose(a[k], b[k], atol=1e-3) for k in a)


def test_quality_gradient():
    """The model's loss falls along its own gradient: training separates bags by one passage among many."""
    import numpy as np

    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(200):
        x = rng.random((rng.integers(2, 9), quality.PAIRS + quality.SHAPES)).astype(np.float32) * 0.05
        if i % 2:
            x[rng.integers(len(x)), :40] += 0.4
        bags.append(x)
        y.append(i % 2)
    model = quality.fit(bags, np.array(y, np.float32), np.ones(200, np.float32))
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    assert np.mean((quality.forward(model, np.concatenate(bags), first)[-1] > 0.5) == np.array(y)) > 0.97


def test_warc(spark, tmp_path):
    big = "<p>" + "z" * 200_000
    rows = [(3, "u", "a", "x"), (1, "v\r\nX: y", "a", "x"), (1, "v", "a", "x"), (2, None, None, "x"), (5, "", "", "x"), (None, "n", "a", "x"), (6, "w", big, "x"), (6, "w", big, "x"), (7, "w", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").repartition(2)
    warc.write_warc(pages, str(tmp_path / "w"), chunk=1000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()), key=str)

    def want(page, text, origin):
        return page, len(text), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode(), "response" if origin is None else "revisit", origin

    assert got == sorted([want(3, "a", 1), want(1, "a", None), want(1, "a", None), want(2, "", None), want(5, "", 2), want(None, "a", 1), want(6, big, None), want(6, big, None), want(7, big, 6)], key=str)
    assert all(len(r.data) <= 1000 + 700 for r in spark.read.parquet(str(tmp_path / "w")).collect())
    warc.write_warc(pages.filter("false"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).collect() == []


def test_warc_damage():
    rows = list(warc.record_chunks(1, "u", b"x" * 5000, hashlib.sha1(b"x" * 5000).digest(), None, "r", chunk=1000))
    parser = warc.RecordParser()
    assert [parser.add(d, g, last) for _, last, d, g in rows][-1][2] == 5000
    parser, swapped = warc.RecordParser(), [rows[0], rows[2], rows[1], *rows[3:]]
    with pytest.raises(ValueError, match="damaged"):
        for _, last, d, g in swapped:
            parser.add(d.replace(b"x", b"y", 1), g, last)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n### x:\n\\h \\"), (1, 1, "assistant", "</turn>\n### x:\n\\h \\"), (2, None, None, None), (None, 0, "a:b\n", "x"), (1, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("f"))
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.canonical_turns(turns))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", ""), ("user", "hi")] + [("assistant", rows[1][3])] * 2 and back[1].loss_text == rows[1][3] * 2
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")] and [(t.role, t.text) for t in back[None].turns] == [("a:b\n", "x")]
    assert chat.format_chats(chat.canonical_turns(turns.filter("false"))).collect() == []
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.createDataFrame([(1,)], "x int"))


def test_chat_layouts(spark):
    records = [
        {"conv_id": 1, "prompt": "p", "response": "r"}, {"conv_id": 2, "instruction": "i", "input": "x", "output": "o"}, {"conv_id": 3, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
        {"conv_id": 4, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"conv_id": 5, "instruction": "i", "output": "o"}, {"odd": 1}, "no object",
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("{",)], "record string")
    got = {(r.conv_id, r.turn, r.role, r.text, r.layout) for r in chat.canonical_json(df).collect()}
    assert got == {
        (1, 0, "user", "p", "prompt"), (1, 1, "assistant", "r", "prompt"), (2, 0, "user", "i\n\nx", "instruction_input"), (2, 1, "assistant", "o", "instruction_input"), (3, 0, "system", "s", "messages"),
        (3, 1, "user", "u", "messages"), (4, 0, "user", "h", "from_value"), (4, 1, "assistant", "g", "from_value"), (5, 0, "user", "i", "instruction"), (5, 1, "assistant", "o", "instruction"),
    }


def test_chat_layouts_within(spark):
    """Nulls, extra fields, ids as text and items without a field lose no turn; what has no layout comes back whole."""
    records = [
        '{"conv_id":1,"prompt":null,"response":"r"}', '{"conv_id":"2","prompt":"p","response":"r","model":"m","id":[1,{"a":2}]}', '{"conv_id":3,"messages":[{"role":"user","content":"u","name":"n"},{"role":"assistant","content":null},{"role":"tool"}]}',
        '{"conv_id":4,"instruction":"i","input":null,"output":"o"}', '{"conv_id":null,"conversations":[{"from":"gpt","value":"g"},null],"x":1}', '{"conv_id":5,"turn":2,"role":"user","text":null,"k":{}}',
        '{"conv_id":6,"prompt":7,"response":"r"}', '{"conv_id":"z","prompt":"p","response":"r"}', '{"prompt":"p","response":"r"}', '{"conv_id":7,"messages":[]}', '{"conv_id":8,"messages":["u"]}', "{", None,
    ]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    want = Counter([
        (1, 0, "user", None, "prompt"), (1, 1, "assistant", "r", "prompt"), (2, 0, "user", "p", "prompt"), (2, 1, "assistant", "r", "prompt"), (3, 0, "user", "u", "messages"), (3, 1, "assistant", None, "messages"), (3, 2, "tool", None, "messages"),
        (4, 0, "user", "i", "instruction_input"), (4, 1, "assistant", "o", "instruction_input"), (None, 0, "assistant", "g", "from_value"), (None, 1, None, None, "from_value"), (5, 2, "user", None, "turn_rows"),
    ])
    read = lambda **k: Counter((r.conv_id, r.turn, r.role, r.text, r.layout) for r in chat.canonical_json(df, **k).collect())
    assert read() == want
    ids = {6: 6, 9: 7, 10: 8}
    assert read(keep_unknown=True) == want + Counter((ids.get(i), None, None, records[i], None) for i in range(6, len(records)))


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("org", "/", "block"), ("a.org", "", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("b.a.org", "/", "block"), ("", "", "block")], "host string, path string, action string")
    urls = ["http://A.org/x/y?q", "http://c.a.org/x", "https://a.org", "http://b.a.org/x/y", "http://b.a.org#f", "ftp://z.org/", "http://nota.org/", None, "nothing", "http://", "http://com/", "http://a.org/x/y?q"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    rows = url_filters.filter_urls(df, rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 1
    assert got == {
        0: ("a.org", "/x/y", "a.org/x/y", "allow"), 1: ("c.a.org", "/x", "a.org/x", "block"), 2: ("a.org", "", "a.org", "allow"), 3: ("b.a.org", "/x/y", "a.org/x/y", "allow"), 4: ("b.a.org", "", "a.org", "allow"),
        5: ("z.org", "/", "org/", "block"), 6: ("nota.org", "/", "org/", "block"), 7: ("", "", "", "block"), 8: ("", "", "", "block"), 9: ("", "", "", "block"), 10: ("com", "/", None, "allow"), 11: ("a.org", "/x/y", "a.org/x/y", "allow"),
    }
    assert url_filters.filter_urls(df.filter("false"), rules).collect() == []


def test_media(docs, none):
    rows = media.media_digests(media.to_media(docs)).collect()
    assert len(rows) == len(ROWS) and {r.payload_bytes % 64 for r in rows} == {0} and min(r.payload_bytes for r in rows) == 64
    assert len({r.feature for r in rows if r.n_bytes == 0}) == 1 and len({r.media_sha256 for r in rows if r.n_bytes == 9}) == 1
    assert media.media_digests(media.to_media(none)).collect() == []
    r = media.decode_media(media.to_media(docs.filter("doc_id = 1"))).first()
    assert len(r.rgb) == r.height * r.width * 3


def test_media_bit_by_bit():
    """The general reader agrees with the fast one, on codes that are no whole bytes too."""
    for n in (64, 64 * 7, 64 * 50):
        data = os.urandom(n - 3) + b"\xff\xff\x00"
        fast, slow = media.Jpeg(media.encode_jpeg(data)), media.Jpeg(media.encode_jpeg(data, spare_symbol=True))
        assert fast.payload() == slow.payload() == data and (fast.rgb() == slow.rgb()).all()


def test_media_transform():
    """A constant block is its mean; the transform is orthonormal."""
    import numpy as np

    m = media.transform_matrix() / media.SCALE
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-3) and np.allclose(m[0], 1 / 8)


def test_sentencepiece(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.model_path())
    rows = sentencepiece_fst.encode(docs).collect()
    texts = {d: t for d, t, *_ in ROWS}
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == sp.encode(texts[r.doc_id] or "") and r.n_ids == len(r.ids)
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()}
    assert all(back[d] == (t or "") for d, t in texts.items())
    assert sentencepiece_fst.encode(none).collect() == []


def test_sentencepiece_random():
    import numpy as np
    import sentencepiece

    fst = sentencepiece_fst.compiled(sentencepiece_fst.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.model_path())
    rng = random.Random(4)
    for _ in range(600):
        text = "".join(rng.choice("aeionrstTH. ,1\n▁éß日😀'- ") for _ in range(rng.randrange(70)))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = fst.encode(raw, np.array([0, len(raw)]))[0].tolist()
        assert ids == sp.encode(text) and fst.decode(ids) == sp.decode(ids)


def test_exact_dedup_index(spark, docs, sf):
    """The index decides: its directory doubles on a small table, equal texts are one entry, texts of one hash are chained."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    for hash_of, capacity in ((F.xxhash64, 16), (lambda c: F.shiftleft(F.length(c).cast("bigint") % 64, 58), 2)):
        texts = table.unionByName(table.filter("id < 50")).withColumns({"h": hash_of(F.col("text")), "digest": F.sha2("text", 256)})
        classes = texts.groupBy("h", "digest").agg(F.count("*").alias("rows"), F.max("id").alias("keep_id"))
        directory, depth = exact_dedup.build_directory(spark, classes.select("h"), capacity, 32)
        assert depth > 2 and directory.count() == 1 << depth and directory.select("bucket").distinct().count() > 4
        index = exact_dedup.chained(texts, classes, directory, depth, texts.count()).collect()
        want = Counter(r.text for r in texts.collect())
        assert Counter(r.group_size for r in index) == Counter(want.values())
        assert not any(r.clash for r in index)
        by_hash = {}
        for r in index:
            by_hash.setdefault(r.h, []).append(r.chain)
        assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_hash.values())
        cells = {c: (b, o) for c, b, o in directory.select("cell", "bucket", "owner").collect()}
        assert all(cells[(r.h & (1 << 64) - 1) >> (64 - depth)] == (r.bucket, r.owner) for r in index)
    assert max(len(c) for c in by_hash.values()) > 1
