"""The planner: configuration and registry to one plan over a relation of transcripts."""

from __future__ import annotations

from typing import Any, TextIO

from pyspark.sql import DataFrame, functions as F

from ..operators import merge
from ..operators.chunk import chunk_text
from ..operators.read import Conversations, topics_by_relevance
from ..operators.redact import pii_redact
from ..shared import materialise
from .config import Config, build_config, load_config
from .errors import PipelineConfigError
from .events import EventLog, safe_message
from .registry import Registry
from .steps import ACTION, DECISION, KEYS, SEGMENT, TOPIC, Run
from .validate import validate_segments

STATUS = "struct<step:string,status:string,duration_ms:bigint,error:string,reason:string>"
KEY = "transcript_id"


class Engine:
    """Registered steps and detectors with a configuration; transform() plans a run over any number of transcripts."""

    def __init__(self, unicode_aware: bool = False, strict_status: bool = False):
        self.registry, self.config, self.out = Registry(), None, None
        self.unicode_aware, self.strict_status = unicode_aware, strict_status

    def register(self, name: str, step: Any) -> Engine:
        self.registry.register_step(name, step)
        return self

    def register_detector(self, name: str, detector: Any) -> Engine:
        self.registry.register_detector(name, detector)
        return self

    def configure(self, config: Config | dict | None = None, path: str | None = None, log: TextIO | None = None) -> Engine:
        self.out = log or self.out
        self.config = config if isinstance(config, Config) else build_config(config) if config is not None else load_config(path)
        return self

    def transform(self, transcripts: DataFrame, mode: str | None = None, validation: bool = True, context: dict | None = None) -> Conversations | DataFrame:
        """Conversations in mode 'model', one record per transcript in mode 'simple'.

        Chunks of transcripts(transcript_id, text) go through the steps in order; a step that fails on a chunk gives it a
        failed status, and the chunk goes on. Durations are not measured by row and are 0. transcript_id must be unique.
        Events of the run count chunks by step and status; error messages of rows stay in the statuses and are not logged.
        """
        if self.config is None:
            self.config = load_config()
        config, registry = self.config, self.registry
        missing = [f"'{s.plugin}' (used by step '{s.name}')" for s in config.steps if not registry.has_step(s.plugin)]
        if missing:
            raise PipelineConfigError(f"The following plugins are referenced in config but not registered: {', '.join(missing)}")
        steps = [(s.name, registry.step(s.plugin)) for s in config.steps]
        log = EventLog(config.log_level, self.out)
        log.write("debug", event="pipeline.start", steps=len(steps))

        source = transcripts.select(KEY, F.coalesce("text", F.lit("")).alias("text"))
        chunks = self._chunked(self._redacted(source), context)
        for name, step in steps:
            if step.branches:
                chunks = materialise(chunks, "chunks")
            try:
                chunks = self._step(chunks, name, step, validation)
            except Exception as e:
                log.write("error", event="step.unplanned", step=name, error=safe_message(e))
                raise
            log.write("debug", event="step.planned", step=name)
        done = materialise(chunks, "chunks")
        self._report(done, log, [name for name, _ in steps])
        result = self._merged(source, done)
        log.write("debug", event="merge.complete")
        log.write("info", event="pipeline.complete", steps=len(steps))
        return result if (mode or config.mode) == "model" else result.to_records()

    def _report(self, chunks: DataFrame, log: EventLog, names: list[str]) -> None:
        """step.complete, step.failed and step.skipped events, with the numbers of chunks; one small job, and none if nothing would be written."""
        if not log.wants("warn"):
            return
        counted = chunks.select(F.explode("statuses").alias("s")).groupBy("s.step", "s.status").count().collect()
        counts, total = {(r[0], r[1]): r[2] for r in counted}, chunks.count()
        for name in dict.fromkeys(names):
            done, failed = counts.get((name, "success"), 0), counts.get((name, "failed"), 0)
            if done:
                log.write("info", event="step.complete", step=name, chunks=done)
            if failed:
                log.write("warn", event="step.failed", step=name, chunks=failed)
            if done + failed < total:
                log.write("warn", event="step.skipped", step=name, chunks=total - done - failed)

    def _redacted(self, source: DataFrame) -> DataFrame:
        privacy = self.config.privacy
        if not privacy.pii_redaction:
            return source
        out = pii_redact(source, "text", privacy.replacements)
        if privacy.pii_detector_plugin:
            out = out.withColumn("text", self.registry.detector(privacy.pii_detector_plugin).redact(F.col("text")))
        return out

    def _chunked(self, source: DataFrame, context: dict | None) -> DataFrame:
        import json

        c = self.config.chunking
        return chunk_text(source, "text", c.chunk_size, c.overlap).withColumns({
            "cleaned_text": F.lit(None).cast("string"),
            "segments": F.array().cast(f"array<{SEGMENT}>"),
            "summary": F.lit(None).cast("string"),
            "actions": F.array().cast(f"array<{ACTION}>"),
            "decisions": F.array().cast(f"array<{DECISION}>"),
            "topics": F.array().cast(f"array<{TOPIC}>"),
            "meeting_context": F.parse_json(F.lit(json.dumps(context))) if context is not None else F.lit(None).cast("variant"),
            "statuses": F.array().cast(f"array<{STATUS}>"),
            "stopped": F.lit(False),
        })

    def _step(self, chunks: DataFrame, name: str, step: Any, validation: bool) -> DataFrame:
        kept = ["cleaned_text", "segments", "summary", "actions", "decisions", "topics"]
        held = chunks
        invalid = F.lit(None).cast("string")
        if validation and step.input_schema:
            errors = validate_segments(F.to_variant_object("segments"), step.input_schema)
            invalid = F.when(F.size(errors) > 0, F.concat(F.lit("Schema validation failed: "), F.array_join(errors, ", ")))
        held = held.withColumns({"_invalid": F.when(~F.col("stopped"), invalid), **{f"_was_{c}": F.col(c) for c in kept}})
        ran = step.apply(held, Run(len(self.config.steps), self.unicode_aware, self.config.chunking.max_parallel))
        aside = F.col("stopped") | F.col("_invalid").isNotNull()
        error = F.coalesce("_invalid", "_error")
        status = F.struct(
            F.lit(name).alias("step"), F.when(error.isNull(), "success").otherwise("failed").alias("status"),
            F.lit(0).cast("bigint").alias("duration_ms"), error.alias("error"), F.lit(None).cast("string").alias("reason"),
        ).cast(STATUS)
        # A name used twice keeps the earlier step's status, which is written last.
        known = F.exists("statuses", lambda s: s.step == name)
        out = ran.withColumns({c: F.when(aside, F.col(f"_was_{c}")).otherwise(F.col(c)) for c in kept})
        out = out.withColumn("statuses", F.when(F.col("stopped") | known, F.col("statuses")).otherwise(F.concat("statuses", F.array(status))))
        if step.terminal:
            out = out.withColumn("stopped", F.col("stopped") | error.isNull())
        return out.select(*chunks.columns)

    def _merged(self, source: DataFrame, chunks: DataFrame) -> Conversations:
        listed = [{"name": s.name, "merge": s.merge} for s in self.config.steps]
        aware = {"unicode_aware": self.unicode_aware}

        def items(column: str) -> DataFrame:
            return chunks.select(*KEYS, "total_chunks", F.posexplode(column).alias("ord", "i")).select(*KEYS, "total_chunks", "ord", "i.*")

        def by_strategy(rows: DataFrame, part: str, forms: dict) -> DataFrame:
            form = forms.get(merge.strategy_of(listed, part))
            if form is None:  # concat, and what a field has no form for
                return merge.concat_items(rows).drop("total_chunks", "chunk_index", "ord")
            one = merge.concat_items(rows.filter("total_chunks = 1"))
            many = form(rows.filter("total_chunks > 1"))
            if "position" not in many.columns:
                many = merge.concat_items(many)
            return one.unionByName(many.select(*one.columns)).drop("total_chunks", "chunk_index", "ord")

        actions = by_strategy(items("actions"), "action", {"deduplicate": lambda d: merge.dedupe(d, **aware), "semantic": lambda d: merge.semantic_actions(d, **aware)})
        decisions = by_strategy(items("decisions"), "decision", {"deduplicate": lambda d: merge.dedupe(d, **aware), "semantic": lambda d: merge.semantic_decisions(d, **aware)})
        topics = items("topics")
        ranked = topics_by_relevance(topics.withColumn("_chunk", F.concat_ws("|", KEY, "chunk_index")), "_chunk", ("ord",))
        topics = ranked.drop("_chunk", "ord").withColumnRenamed("rank", "ord").select(*topics.columns)
        topics = by_strategy(topics, "topic", {"deduplicate": lambda d: merge.dedupe_topics(d, **aware), "cluster": lambda d: merge.cluster_topics(d, **aware)})

        said = chunks.select(*KEYS, "total_chunks", "summary")
        folded = merge.strategy_of(listed, "summar") == "summarize-of-summaries"
        if folded:
            one = said.filter("total_chunks = 1").select(KEY, "summary", F.lit(False).alias("degraded"))
            many = merge.summary_of_summaries(said.filter("total_chunks > 1"), **aware).withColumn("degraded", F.lit(True))
            summaries = one.unionByName(many)
        else:
            summaries = merge.concat_summaries(said).withColumn("degraded", F.lit(False))
        whole = source.select(KEY).join(summaries, KEY, "left").select(KEY, "summary", F.coalesce("degraded", F.lit(False)).alias("degraded"))
        statuses = chunks.select(*KEYS, F.explode("statuses").alias("s")).select(*KEYS, "s.*")
        return Conversations(whole, actions, decisions, topics, merge.last_status(statuses, strict=self.strict_status), KEY)
