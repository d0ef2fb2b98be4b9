"""The queries on whole sentences of documents: against plain Python on a small table."""

import re

import pytest

from parlance.queries import ORACLES, QUERIES

DOCS = [
    (1, "We ship the new parser on Monday. We ship the old parser never.\nBob calls Ann!", "a"),
    (2, "we ship the new parser on monday. We ship the new parser on Monday, maybe. Bob", "a"),
    (3, None, "a"), (4, "", "b"), (5, "We ship the new parser on Monday. ... ?", "b"), (6, "We ship the new parser on Monday?", "b"),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def items():
    return [(t, d, k, s) for d, text, t in DOCS for k, s in enumerate(x.strip() for x in re.split(r"(?<=[.!?])\s+", text or "") if x.strip())]


def form(s):
    return re.sub(r"[^a-z0-9_\s]", "", s.lower()).strip()


def test_dedupe(spark, small):
    first = {}
    for row in items():
        first.setdefault((row[0], form(row[3])), row)
    for name in ("document_dedupe_actions", "document_dedupe_decisions"):
        assert sorted(tuple(r) for r in QUERIES[name](spark, small).collect()) == sorted(first.values())
    assert {(r.transcript_id, r.label) for r in QUERIES["document_dedupe_topics"](spark, small).collect()} == {(r[0], max((x for x in items() if x[0] == r[0] and form(x[3]) == form(r[3])), key=lambda x: (x[1] * 37 + x[2] * 11) % 100)[3]) for r in first.values()}


@pytest.mark.parametrize(("name", "threshold"), [("semantic_actions", 0.75), ("semantic_decisions", 0.75), ("cluster_topics", 0.5)])
def test_leaders(spark, small, name, threshold):
    groups = {}
    for t, d, k, s in items():
        tokens, led = set(form(s).split()), groups.setdefault(t, [])
        for lead, members in led:
            if (len(tokens & lead) / len(tokens | lead) if tokens | lead else 1) >= threshold:
                members.append(s)
                break
        else:
            led.append((tokens, [s]))
    rows = QUERIES[f"document_{name}"](spark, small).collect()
    got = [(r.transcript_id, r[-1] if name != "cluster_topics" else r.label) for r in rows]
    assert len(got) == sum(map(len, groups.values()))
    for t, led in groups.items():
        for _, members in led:
            assert sum(g == (t, s) for g in got for s in set(members)) == 1


def test_read(spark, small):
    for name in ("merge_concat_items", "topics_by_relevance"):
        assert sorted((r.transcript_id, r[-1] if "merge" in name else r.label) for r in QUERIES[f"document_{name}"](spark, small).collect()) == sorted((t, s) for t, _, _, s in items())
    assert sorted(tuple(r) for r in QUERIES["document_actions_by_status"](spark, small).collect()) == sorted(r for r in items() if r[2] % 2)


def test_sql_is_on_documents():
    for name in (n for n in ORACLES if n.startswith("document_")):
        assert "FROM documents" in ORACLES[name] and "conversations" not in ORACLES[name]
