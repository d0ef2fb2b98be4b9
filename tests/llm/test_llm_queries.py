"""The op queries against DuckDB, libraries or plain Python over whole tables."""

import base64
import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from parlance.llm import common
from parlance.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op7_exact_dedup", "op10_url_filters"])
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_op1_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = QUERIES["op1_quality_classifier"](spark, big).join(common.table(spark, big, "labels"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_op2(spark, sf):
    pages = common.table(spark, sf, "pages").collect()
    got = {r.page_id: r for r in QUERIES["op2_warc"](spark, sf).collect()}
    assert len(got) == len(pages)
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        data = (p.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        r, origin = got[p.page_id], first.setdefault(digest, p.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest)
        assert (r.record_type, r.refers_to) == (("response", None) if origin == p.page_id else ("revisit", origin))


def test_op5(spark, sf, docs):
    rows = QUERIES["op5_media_columns"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and r.feature


def test_op5_reads_stored_media(spark, sf):
    from parlance.llm.media import Jpeg

    result = QUERIES["op5_media_columns"](spark, sf)
    files = result.inputFiles()
    assert files and not any("documents" in f for f in files)
    stored = {r.doc_id: bytes(r.media) for r in spark.read.parquet(*files).collect()}
    for r in result.collect():
        assert r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest()
        assert r.payload_sha256 == hashlib.sha256(Jpeg(stored[r.doc_id]).payload()).hexdigest()


def test_op6(spark, sf, docs):
    import sentencepiece

    from parlance.llm.sentencepiece_fst import model_path

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for r in QUERIES["op6_sentencepiece"](spark, sf).collect():
        ids = sp.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        back = sp.decode(ids).encode()
        assert (r.decoded_bytes, r.decoded_sha256) == (len(back), hashlib.sha256(back).hexdigest())


def test_op9(spark, sf, docs):
    from tokenizers import Tokenizer

    from parlance.llm.packing import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = {}, {}
    for r in QUERIES["op9_packing"](spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, rows in pieces.items():
        ids, at = [*tok.encode(docs[doc_id], add_special_tokens=False).ids, 2], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    fill = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fill.append(at)
    assert sorted(fill)[1:] == [4096] * (len(fill) - 1) and min(fill) <= 4096
