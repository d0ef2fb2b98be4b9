"""The pipeline, stage by stage, against brute force on what each stage was given."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from parlance.llm import suffix_dedup
from test_joins import brute_cut, brute_join


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before[name] = given
        if name != "packing":
            assert docs.columns == columns
            rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            assert 0.7 * len(given) < len(rows) < len(given)
        if name == "exact dedup":
            last = {}
            for d, t in given:
                last[t or ""] = max(d, last.get(t or "", d))
            assert set(rows) == set(last.values())
        if name == "n-gram Jaccard join":
            assert set(rows) == {d for d, _, c in brute_join(given) if d == c}
        if name == "suffix-array dedup":
            want = {r[0]: r for r in brute_cut(given, suffix_dedup.PASSAGE)}
            assert set(rows) == set(want)
            texts = dict(given)
            for d, t in rows.items():
                if want[d][2] == 0:
                    assert t == texts[d]
                elif hashlib.sha256(t.encode()).hexdigest() != want[d][4]:  # only characters cut in part may differ
                    assert 0 <= want[d][1] - want[d][2] - len(t.encode()) < 4 * want[d][3] * 2
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(rows)


def test_stage_edges(spark, sf):
    """Every stage on nulls, empty texts, repeated rows, a text of a million bytes, clashing column names and no rows."""
    import corpus_pipeline

    rng = random.Random(2)
    words = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    long, shared = words(140_000), words(60)
    near = words(80)
    texts = [(1, long), (2, None), (None, ""), (None, words(50)), (3, words(30) + " " + shared), (4, shared + " " + words(30)), (5, near), (6, near + " end"), (7, "twice"), (7, "twice"), (8, "twice")]
    clash = {"rid": F.lit(1), "h": F.lit("h"), "cid": F.lit(2), "block": F.lit("b"), "digest": F.lit(None).cast("string"), "score": F.lit(0.5), "kept": F.lit(True), "others": F.lit("o"), "n_chars": F.length("text").cast("bigint")}
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns(clash)
    sha = lambda c: sorted(hashlib.sha256((r[c] or "").encode()).hexdigest() for r in found)
    hashed = lambda kept: sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in kept)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.filter("false"), sf).collect() == []
        result = stage(spark, docs, sf)
        assert result.columns == docs.columns
        found = result.collect()
        if name == "exact dedup":
            assert Counter(r.doc_id for r in found) == Counter([1, 2, None, 3, 4, 5, 6, 8])
        if name == "n-gram Jaccard join":
            assert Counter(r.doc_id for r in found) == Counter([1, 2, None, None, 3, 4, 5, 7])
        if name == "suffix-array dedup":
            gone = {t for _, t in texts[4:8]}
            assert Counter(r.doc_id for r in found) == Counter(d for d, _ in texts)
            assert set(hashed(t for _, t in texts if t not in gone)) <= set(sha("text"))
            assert not any(shared in r.text or near in r.text for r in found) and all(r.n_chars == len(r.text) for r in found)
    good, pack = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[4][1]
    assert good(spark, docs.filter("false"), sf).collect() == [] and good(spark, docs, sf).columns == docs.columns
    table = spark.read.parquet(f"{sf}/documents.parquet")
    both = table.unionByName(table.filter("doc_id < 20")).unionByName(docs, allowMissingColumns=True)
    kept = Counter(r.text for r in good(spark, both, sf).select("text").collect())
    given = Counter(r.text for r in both.select("text").collect())
    assert all(given[t] == n for t, n in kept.items())  # rows of one text stay or go together
    assert pack(spark, docs.filter("false"), sf).collect() == []
    pieces = pack(spark, docs, sf).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(d for d, _ in texts)


def test_run(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 0
