"""Golden vectors and properties of the engine's operators, sources, planner and adapters."""

import io
import json
import os
import random
import sys

import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import chunk, clean, deidentify, extract, merge, redact, segment
from parlance.plans.config import build_config, load_config
from parlance.plans.errors import AdapterError, PipelineConfigError, PluginRegistrationError
from parlance.plans.pipeline import Engine
from parlance.plans.registry import Registry
from parlance.plans.steps import CleanText, ColumnStep, RowStep, SplitSegments, Step, register_deterministic_steps, register_model_steps
from parlance.sources import synthetic
from parlance.sources.adapters import AdapterResponses, HostedHttpAdapter, LocalHttpAdapter, Request, Response, ResponseTable, generate_with_retry
from parlance.sources.transcripts import from_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
GOOD = {"schemaVersion": "1.0.0", "pipeline": {"steps": [{"name": "parse", "plugin": "default-parser"}]}}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hash(spark):
    want = {"": "811c9dc5", "a": "e40c292c", "abc": "1a47e90c", "0|0|Alice: hello there": "b3d78157", "Prepare release notes": "1720fd78", "Adopt PostgreSQL": "7fd26a88"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", X.fnv(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == want


def test_redaction(spark):
    want = {
        "Contact john@example.com today.": "Contact [Email] today.", "Email: bob@test.org, Card: 1234-5678-9012-3456.": "Email: [Email], Card: [Card].",
        "SSN is 123-45-6789 on file.": "SSN is [SSN] on file.", "Alice and Bob discussed the project timeline.": "Alice and Bob discussed the project timeline.",
        "+1 4111 1111 1111 1111": "[Phone] 1111", "+5551234567@x.com": "[Phone]@x.com", "12345678901234567890": "12345[Phone]", "1234 5678 9012 3456 7890": "[Card] 7890",
        "fiscal 2023-2024 plan": "fiscal [Phone] plan", "": "",
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string").withColumn("text", F.col("t"))
    rows = redact.pii_redact(df, matches=True).collect()
    assert {r.t: r.text for r in rows} == {**want, None: None}
    m = next(r.pii_matches for r in rows if r.t and r.t.startswith("Contact"))
    assert [(x.type, x.start, x.end, x.replacement) for x in m] == [("email", 8, 24, "[Email]")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1234567890-+. @x😀()", max_size=60))
def test_redaction_matches_do_not_overlap(text):
    out, matches = redact.redact_text(text, redact._compiled(redact.Labels()))
    units = text.encode("utf-16-le")
    at, rebuilt = 0, b""
    for _, start, end, label in matches:
        assert start >= at
        rebuilt += units[2 * at : 2 * start] + label.encode("utf-16-le")
        at = end
    assert (rebuilt + units[2 * at :]).decode("utf-16-le") == out


def chunk_plainly(text, size, overlap):
    import re

    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    chunks, held, n = [], [], 0
    for s in sents:
        w = len(s.split())
        if n and n + w > size:
            chunks.append(held)
            held, n = [], 0
        held.append(s)
        n += w
    out = []
    for c in chunks + ([held] if held else []):
        lead = " ".join(out[-1].split()[-overlap:]) + " " if out and overlap else ""
        out.append(lead + " ".join(c))
    return out


def test_chunks(spark):
    rng = random.Random(1)
    texts = ["", "one two three. four five six. seven eight nine.", "No end", "A b.\nC d! E"] + [
        " ".join(rng.choice(["a", "bb", "c.", "d!", "e?\n", "ff"]) for _ in range(rng.randrange(80))) for _ in range(60)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap in ((3, 0), (5, 2), (10, 7), (2000, 100)):
        rows = chunk.chunk_text(df, "text", size, overlap).orderBy("id", "chunk_index").collect()
        got = {}
        for r in rows:
            got.setdefault(r.id, []).append(r.chunk_text)
            assert r.chunk_index == len(got[r.id]) - 1
        for i, t in enumerate(texts):
            assert got.get(i, []) == chunk_plainly(t, size, overlap), (t, size, overlap)


def test_cleaning(spark):
    assert value(spark, clean.clean_text(F.lit(" [00:00:05] Alice: um   hello   uh there 10:03:22 "))) == "Alice: hello there"
    assert value(spark, clean.clean_text(F.lit("(a) [b] umbrella"), clean.CleanOptions(remove_fillers=False))) == "(a) [b] umbrella"
    assert value(spark, clean.source_text(F.lit(""), F.lit("raw"))) == "raw"


def test_segments(spark):
    rows = value(spark, segment.segments_of(F.lit("Alice: We should. " + "x" * 300 + ". Bob\nBob:  ok\n\nAlice:\nИрина: да"), F.lit(0)))
    assert [(r.speaker_id, r.text[:9], len(r.text)) for r in rows] == [
        ("Alice", "We should", 10), ("Alice", "xxxxxxxxx", 301), ("Alice", "Bob", 3), ("Bob", "ok", 2), (None, "Alice:", 6), ("Ирина", "да", 2),
    ]
    alone = value(spark, segment.split_long(F.lit("x" * 600)))
    assert [len(x) for x in alone] == [280, 280, 40]
    # Lengths are in UTF-16 units; a pair that a cut would part stays in the earlier slice.
    assert [len(x) for x in value(spark, segment.split_long(F.lit("😀" * 300)))] == [140, 140, 20]
    assert [x for x in value(spark, segment.split_long(F.lit("x" + "😀" * 200)))] == ["x" + "😀" * 140, "😀" * 60]
    assert value(spark, segment.split_long(F.lit("😀" * 140))) == ["😀" * 140]
    assert value(spark, segment.split_long(F.lit("😀" * 100 + ". " + "b" * 78 + "."))) == ["😀" * 100 + ".", "b" * 78 + "."]
    assert value(spark, segment.split_long(F.lit("a\uffff😀\uffffb"))) == ["a\uffff😀\uffffb"]


def test_discard(spark):
    from parlance.shared import discard, materialise

    kept, gone, none = (materialise(spark.range(n), "discard-test") for n in (3, 4, 0))
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(gone, none)
    assert not os.path.exists(folder) and kept.count() == 3


def test_deidentification(spark):
    rows = [("t", 0, 0, "Alice asked Bob to check this item.", "Alice"), ("t", 1, 0, "alice and Bob Smith met bob smith. Алиса, Café", "Bob")]
    df = spark.createDataFrame(rows, "transcript_id string, chunk_index int, segment_index int, text string, speaker_id string")
    out = deidentify.deidentify(df).orderBy("chunk_index").collect()
    assert [r.speaker_id for r in out] == ["PARTICIPANT_01", "PARTICIPANT_02"]
    assert out[0].text == "PARTICIPANT_01 asked PARTICIPANT_02 to check this item."
    assert out[1].text == "alice and PARTICIPANT_03 met bob smith. Алиса, PARTICIPANT_04é"
    assert value(spark, deidentify.names_in(F.lit("Алиса встретила Боба."))) == []
    assert value(spark, deidentify.names_in(F.lit("Алиса встретила Боба."), True)) == ["Алиса", "Боба"]


ITEM = "transcript_id string, chunk_index int, ord int, text string, assignee string, due_date string, source_segment_id string, made_by string"


def test_merging(spark):
    rows = [("t", 0, 0, "Update project docs"), ("t", 1, 0, "Update project docs now"), ("t", 1, 1, "Обновить"), ("t", 2, 0, "Проверить"), ("t", 2, 1, "update  PROJECT docs!")]
    df = spark.createDataFrame([(*r, "alice" if i == 1 else None, None, None, None) for i, r in enumerate(rows)], ITEM)
    assert {(r.text, r.assignee) for r in merge.semantic_actions(df).collect()} == {("Update project docs now", "alice"), ("Обновить", None)}
    assert {r.text for r in merge.dedupe(df).collect()} == {"Update project docs", "Update project docs now", "Обновить"}
    assert {r.text for r in merge.dedupe(df, unicode_aware=True).collect()} == {"Update project docs", "Update project docs now", "Обновить", "Проверить"}
    t = spark.createDataFrame([("t", 0, 0, "1", "Budget Review", 0.7), ("t", 1, 0, "2", "Budget Review", 0.6), ("t", 1, 1, "3", "Hiring", 0.2)], "transcript_id string, chunk_index int, ord int, id string, label string, relevance double")
    assert {(r.label, r.relevance, r.position) for r in merge.cluster_topics(t).collect()} == {("Budget Review", 1.0, 0), ("Hiring", 0.2, 1)}
    assert {(r.id, r.position) for r in merge.dedupe_topics(t).collect()} == {("1", 0), ("3", 1)}
    s = spark.createDataFrame([("a", 0, "Part one. Same."), ("a", 1, "Same. Part two."), ("b", 0, None), ("c", 0, "")], "transcript_id string, chunk_index int, summary string")
    assert {tuple(r) for r in merge.summary_of_summaries(s).collect()} == {("a", "Part one. Same. Part two."), ("c", "")}
    assert {tuple(r) for r in merge.concat_summaries(s).collect()} == {("a", "Part one. Same.\n\nSame. Part two."), ("b", None), ("c", "")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=5, unique=True), max_size=12), st.sampled_from([0.5, 0.75, 0.8]))
def test_leaders_equal_nested_loop(sets, threshold):
    state = merge.Leaders(threshold)
    got = [state.place(s)[0] for s in sets]
    heads, want = [], []
    for s in sets:
        a = set(s)
        near = [i for i, h in enumerate(heads) if (len(a & h) / len(a | h) if a | h else 1) >= threshold]
        if not near:
            heads.append(a)
        want.append(near[0] if near else len(heads) - 1)
    assert got == want


def test_responses(spark):
    df = spark.createDataFrame([(0, '{"actions":[{"text":"A","assignee":"  "},{"text":"B","assignee":"","dueDate":"Fri"},{"text":"C","assignee":false,"dueDate":0}]}'), (1, "[1"), (2, None)], "k int, response_text string")
    assert [(r.text, r.assignee, r.due_date) for r in extract.parse_actions(df, ["k"]).orderBy("ord").collect()] == [("A", "", None), ("B", None, "Fri"), ("C", None, None)]
    s = spark.createDataFrame([('{"summary":" a  b "}',), ('{"summary":5}',), ("null",), ("{}",), ("x",)], "response_text string")
    assert [(r.summary, r.error is None) for r in extract.parse_summaries(s).collect()] == [("a b", True), (None, False), (None, False), (None, True), (None, False)]


@pytest.mark.parametrize(
    ("change", "told"),
    [
        ({"schemaVersion": None}, "schemaVersion"), ({"schemaVersion": "2.0.0"}, "unsupported"), ({"pipeline": []}, "pipeline"), ({"pipeline": {"steps": []}}, "non-empty"),
        ({"pipeline": {"steps": [{"name": "a"}]}}, "missing 'plugin'"), ({"output": {"mode": "x"}}, "output.mode"), ({"logging": {"level": "loud"}}, "logging.level"),
        ({"chunking": {"chunkSize": 0}}, "chunkSize"), ({"chunking": {"overlap": -1}}, "overlap"), ({"chunking": {"maxParallel": True}}, "maxParallel"),
        ({"privacy": {"piiRedaction": "yes"}}, "piiRedaction"), ({"privacy": {"replacements": {"email": "e"}}}, "replacements.phone"),
    ],
)
def test_config_faults(change, told):
    with pytest.raises(PipelineConfigError, match=told):
        build_config({**GOOD, **change})


def test_config(tmp_path):
    c = build_config({**GOOD, "chunking": {"chunkSize": 100.0}})
    assert (c.chunking.chunk_size, c.chunking.overlap, c.mode, c.privacy.replacements.name) == (100, 100, "simple", "[Person]")
    f = tmp_path / "pipeline.yaml"
    f.write_text("schemaVersion: 1.0.0\npipeline:\n  steps:\n    - {name: yes, plugin: on}\nchunking: {chunkSize: 1e3}\n")
    c = load_config(str(f))
    assert (c.steps[0].name, c.steps[0].plugin, c.chunking.chunk_size) == ("yes", "on", 1000)
    with pytest.raises(PipelineConfigError, match="not found"):
        load_config(str(tmp_path / "none.yaml"))
    f.write_text("a: [")
    with pytest.raises(PipelineConfigError, match="Failed to parse"):
        load_config(str(f))


def test_registry():
    r = Registry()
    r.register_step("c", CleanText())
    with pytest.raises(PluginRegistrationError, match="already"):
        r.register_step("c", CleanText())
    with pytest.raises(PluginRegistrationError, match="version"):
        r.register_detector("d", object())
    with pytest.raises(PluginRegistrationError, match=r"\[c\]"):
        r.step("x")
    with pytest.raises(PluginRegistrationError, match="name"):
        r.register_step("y", object())


def test_adapters():
    calls = []

    def transport(url, body, headers, timeout):
        calls.append((body, headers))
        return (500, "") if len(calls) == 1 else (200, json.dumps({"response": "yes", "output": "out"}))

    local = LocalHttpAdapter("http://x", "m", delay_ms=0, transport=transport)
    assert local.generate(Request("p", "summary")).text == "yes" and len(calls) == 2 and calls[0][0] == {"model": "m", "prompt": "p", "stream": False}
    hosted = HostedHttpAdapter("http://x", "key", "m", body_format="messages", transport=transport)
    assert hosted.generate(Request("p", "summary")).text == "out" and calls[-1][1]["authorization"] == "Bearer key"
    with pytest.raises(AdapterError, match="2 attempts"):
        generate_with_retry(LocalHttpAdapter("x", "m", attempts=1, transport=lambda *a: (500, "")), Request("p", "s"), delay_ms=0)


class Echo:
    def generate(self, request):
        if "seven" in request.prompt:
            raise ValueError("no")
        return Response('{"summary":"ok"}', "echo")


class Stop(Step):
    name, terminal = "stop", True

    def apply(self, chunks, run):
        return chunks.withColumn("_error", F.when(F.col("chunk_index") == 1, "kept on"))


class Hide:
    version = "1"

    def redact(self, c):
        return F.replace(c, F.lit("secret"), F.lit("***"))


def test_pipeline(spark):
    log = io.StringIO()
    src = from_texts(spark, ["one two secret. four five six. seven eight nine.", {"text": "", "metadata": {"a": 1}}])
    engine = Engine().configure({
        "schemaVersion": "1.0.0", "chunking": {"chunkSize": 3, "overlap": 0}, "privacy": {"piiDetectorPlugin": "hide"}, "logging": {"level": "debug"},
        "pipeline": {"steps": [{"name": n, "plugin": n} for n in ("split", "summarize", "note", "check", "boom", "stop", "late")]},
    }, log=log)
    with pytest.raises(PipelineConfigError, match="'split' .*'late'"):
        engine.transform(src)
    schema = {"type": "array", "items": {"type": "object", "properties": {"text": {"type": "number"}}}}
    topic = lambda: {"topics": F.array(F.struct(F.lit("1").alias("id"), F.element_at("segments", 1).text.alias("label"), F.lit(0.5).alias("relevance")))}
    engine.register("split", SplitSegments()).register("note", ColumnStep("note", topic)).register("check", ColumnStep("check", schema=schema)).register_detector("hide", Hide())
    engine.register("boom", RowStep("boom", lambda row: {"summary": row["summary"] + "!"} if row["summary"] else 1 / 0)).register("stop", Stop()).register("late", ColumnStep("late"))
    from parlance.plans.steps import Summarise

    engine.register("summarize", Summarise(AdapterResponses(Echo(), retries=0)))
    result = engine.transform(src, mode="model", context={"who": "x"})
    rows = {r.transcript_id: r for r in result.to_records().collect()}
    full = rows["0"]
    assert full.summary == "ok!\n\nok!" and [t.label for t in full.topics] == ["one two ***.", "four five six.", "seven eight nine."]
    assert {k: v.status for k, v in full.step_statuses.items()} == {"split": "success", "summarize": "failed", "note": "success", "check": "failed", "boom": "failed", "stop": "success", "late": "success"}
    assert full.step_statuses["check"].error == "Schema validation failed: segments[0].text: expected number, got string"
    assert rows["1"].summary is None and rows["1"].step_statuses == {}
    assert result.get_step_status("late").count() == 1
    events = [json.loads(x) for x in log.getvalue().splitlines()]
    assert events[0]["event"] == "pipeline.start" and "secret" not in log.getvalue()
    told = {(e["event"], e.get("step")): e.get("chunks") for e in events}
    assert told["step.complete", "split"] == 3 and told["step.failed", "boom"] == 1 and told["step.complete", "boom"] == 2
    assert told["step.skipped", "late"] == 2 and ("step.skipped", "split") not in told and events[-1]["event"] == "pipeline.complete"


def test_parallel_and_failing_plan(spark):
    """maxParallel bounds the calls of a task unless the responses say otherwise; a step that cannot be planned is logged without its message's tail."""
    assert AdapterResponses(Echo()).within(7).parallel == 7 and AdapterResponses(Echo(), parallel=2).within(7).parallel == 2

    class Broken(Step):
        name = "broken"

        def apply(self, chunks, run):
            assert run.max_parallel == 9
            raise ValueError("x" * 1000)

    log = io.StringIO()
    engine = Engine().configure({"schemaVersion": "1.0.0", "chunking": {"maxParallel": 9}, "pipeline": {"steps": [{"name": "b", "plugin": "broken"}]}}, log=log).register("broken", Broken())
    with pytest.raises(ValueError):
        engine.transform(from_texts(spark, ["a b."]))
    last = json.loads(log.getvalue().splitlines()[-1])
    assert last["event"] == "step.unplanned" and len(last["error"]) == 200


def test_chunks_of_a_long_text(spark):
    """20 000 words in one text, cut as the plain loop cuts them, in time linear in the text."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "bb", "ccc", "d.", "e!"]) for _ in range(20_000))
    got = [r.chunk_text for r in chunk.chunk_text(spark.createDataFrame([(1, text)], "id int, text string"), "text", 50, 10).orderBy("chunk_index").collect()]
    assert got == chunk_plainly(text, 50, 10)


def test_synthetic_and_builder(spark):
    r = synthetic.transcripts(spark, 2, 100, "mixed", True).first()
    assert r.text.startswith("Contact alice@example.com") and 95 <= len(r.text.split()) <= 115
    built = synthetic.ResultBuilder().with_summary("s").with_action("a", assignee="x").with_actions(2).with_decision("d").with_topic("t", 0.9).with_topic("u").with_success("ok").with_failure("no", ValueError("e")).build(spark)
    record = json.loads(built.to_json().first().json)
    assert [a["id"] for a in record["actions"]] == ["mock-1", "mock-2", "mock-3"] and record["stepStatuses"]["no"] == {"status": "failed", "durationMs": 0, "error": "e"}
    assert built.get_actions(assignee="x").count() == 1 and [t.label for t in built.get_topics().orderBy("rank").collect()] == ["t", "u"]


def test_engine_with_table(spark):
    engine = Engine().configure({**GOOD, "pipeline": {"steps": [{"name": "s", "plugin": "split-segments"}, {"name": "acts", "plugin": "extract-actions-llm"}]}})
    register_deterministic_steps(engine.registry)
    answers = spark.createDataFrame([("0", 0, "actions", '{"actions":[{"text":"Prepare release notes","assignee":"Ivan"},{"text":"Close old tickets","status":"done"}]}')], "transcript_id string, chunk_index int, schema_name string, response_text string")
    register_model_steps(engine.registry, ResponseTable(answers))
    row = engine.transform(from_texts(spark, ["Hello there."])).first()
    assert [(a.text, a.assignee, a.status) for a in row.actions] == [("Prepare release notes", "Ivan", "open"), ("Close old tickets", None, "done")]


def test_stream(spark, tmp_path):
    from parlance.streaming import read_transcripts, segment_stream

    spark.createDataFrame([("a", "Bob: hi 555-123-4567. um yes."), ("b", "")], "transcript_id string, text string").write.parquet(str(tmp_path / "in"))
    q = segment_stream(read_transcripts(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("segs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.transcript_id, r.segments[0].text) for r in spark.table("segs").collect()] == [("a", "hi Phone . yes.")]
