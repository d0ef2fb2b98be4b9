"""Steps: transformations of the chunk relation.

A chunk row has transcript_id, chunk_index, total_chunks, chunk_text, cleaned_text, segments, summary, actions,
decisions, topics, meeting_context, statuses and stopped. A step's apply(chunks, run) returns the same rows with columns
changed and `_error` added: null where it succeeded, else the message. A row's failure is that row's alone.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import clean, deidentify, extract, segment
from ..shared import materialise
from ..shipping import ship

SEGMENT = "struct<id:string,text:string,speaker_id:string>"
ACTION = "struct<id:string,text:string,assignee:string,due_date:string,status:string,source_segment_id:string>"
DECISION = "struct<id:string,text:string,made_by:string,source_segment_id:string>"
TOPIC = "struct<id:string,label:string,relevance:double>"
KEYS = ["transcript_id", "chunk_index"]


@dataclass(frozen=True)
class Run:
    """What steps may read of the run."""

    total_steps: int
    unicode_aware: bool = False
    max_parallel: int = 4


class Step(ABC):
    name: str = ""
    version: str = "1.0.0"
    #: JSON Schema of `segments` that a chunk must fit.
    input_schema: dict | None = None
    #: Later steps are left out, without a status, where a terminal step succeeds.
    terminal: bool = False
    #: The step reads the chunks more than once, so they are written before it.
    branches: bool = False

    @abstractmethod
    def apply(self, chunks: DataFrame, run: Run) -> DataFrame: ...


def source_text() -> Column:
    return clean.source_text(F.col("cleaned_text"), F.col("chunk_text"))


@dataclass
class CleanText(Step):
    options: clean.CleanOptions = clean.CleanOptions()
    name = "clean-text"

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        out = chunks.withColumn("cleaned_text", clean.clean_text(source_text(), self.options))
        if self.options.collapse_whitespace:
            out = out.withColumn("segments", clean.collapse_segments(F.col("segments")))
        return out.withColumn("_error", F.lit(None).cast("string"))


@dataclass
class SplitSegments(Step):
    max_length: int = segment.MAX_LENGTH
    name = "split-segments"

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        return segment.split_segments(chunks, source_text(), self.max_length).withColumn("_error", F.lit(None).cast("string"))


@dataclass
class DeIdentify(Step):
    speakers: bool = True
    in_text: bool = True
    name = "de-identify"
    branches = True

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        done = chunks.withColumn("_error", F.lit(None).cast("string"))
        if not (self.speakers or self.in_text):
            return done
        rows = segment.explode_segments(chunks.filter("not stopped"), *KEYS)
        aliases = deidentify.participants(rows, speakers=self.speakers, in_text=self.in_text, unicode_aware=run.unicode_aware)
        joined = done.join(deidentify.alias_map(aliases), "transcript_id", "left").withColumn("_aliases", F.coalesce("_aliases", F.create_map().cast("map<string,string>")))

        def change(s: Column) -> Column:
            speaker, text = s.speaker_id, s.text
            if self.speakers:
                speaker = F.when(deidentify.truthy(s.speaker_id), deidentify.alias_of(F.col("_aliases"), s.speaker_id))
            if self.in_text:
                text = deidentify.replace_names(s.text, F.col("_aliases"), run.unicode_aware)
            return F.struct(s.id.alias("id"), text.alias("text"), speaker.alias("speaker_id"))

        return joined.withColumn("segments", F.transform("segments", change)).drop("_aliases")


@dataclass
class _ModelStep(Step):
    responses: Any = None
    max_segments: int = extract.MAX_SEGMENTS
    kind = ""
    branches = True

    @property
    def prompt_version(self) -> str:
        return extract.PROMPT_VERSION

    @property
    def output_schema_version(self) -> str:
        return extract.SCHEMA_VERSION

    def answered(self, chunks: DataFrame, run: Run) -> DataFrame:
        """(keys, response_text, error), written once: the answers of outside calls must not be asked for twice."""
        responses = self.responses.within(run.max_parallel) if hasattr(self.responses, "within") else self.responses
        asked = extract.requests(chunks.filter("not stopped and _invalid is null"), (self.kind,), self.max_segments)
        return materialise(responses.respond(asked).select(*KEYS, "response_text", "error"), f"{self.kind}-responses")

    def finish(self, chunks: DataFrame, values: DataFrame, column: str) -> DataFrame:
        """chunks with column from values(keys, _value, _error), appended to what an array column holds."""
        joined = chunks.join(values, KEYS, "left")
        now = F.col("_value") if column == "summary" else F.concat(F.col(column), F.coalesce("_value", F.array().cast(dict(chunks.dtypes)[column])))
        return joined.withColumn(column, F.coalesce(now, F.col(column))).drop("_value")


@dataclass
class Summarise(_ModelStep):
    name = "summarize-llm"
    kind = "summary"

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        answered = self.answered(chunks, run).withColumnRenamed("error", "_asked")
        parsed = extract.parse_summaries(answered)
        return self.finish(chunks, parsed.select(*KEYS, F.col("summary").alias("_value"), F.coalesce("_asked", "error").alias("_error")), "summary")


@dataclass
class _ItemStep(_ModelStep):
    item = ""
    parse: Callable = None

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        answered = self.answered(chunks, run)
        items = type(self).parse(answered, KEYS)
        fields = [f.split(":")[0] for f in self.item.removeprefix("struct<").removesuffix(">").split(",")]
        one = F.struct(*(F.col(f) if f in items.columns else F.lit(None).cast("string").alias(f) for f in fields))
        listed = items.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("i")))), lambda x: x.i).cast(f"array<{self.item}>").alias("_value"))
        error = extract.parse_response(F.col("response_text"), self.kind)[1]
        bad = extract.failed_items(answered, KEYS, self.kind)
        told = answered.join(bad, KEYS, "left").select(*KEYS, F.coalesce("error", error, "_bad").alias("_error"))
        return self.finish(chunks, told.join(listed, KEYS, "left"), self.kind)


@dataclass
class ExtractActions(_ItemStep):
    name = "extract-actions-llm"
    kind = "actions"
    item = ACTION
    parse = staticmethod(extract.parse_actions)


@dataclass
class ExtractDecisions(_ItemStep):
    name = "extract-decisions-llm"
    kind = "decisions"
    item = DECISION
    parse = staticmethod(extract.parse_decisions)


@dataclass
class ColumnStep(Step):
    """A native custom step: columns(run) gives new columns, error(run) the message of rows that fail."""

    step_name: str = "custom"
    columns: Callable[[], dict[str, Column]] = dict
    error: Callable[[], Column] | None = None
    schema: dict | None = None
    ends: bool = False

    def __post_init__(self) -> None:
        self.name, self.input_schema, self.terminal = self.step_name, self.schema, self.ends

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        error = self.error() if self.error else F.lit(None).cast("string")
        return chunks.withColumns({**self.columns(), "_error": error})


@dataclass
class RowStep(Step):
    """A custom step in Python: f(chunk as a dict) returns changed columns; what it raises is the row's error."""

    step_name: str = "custom"
    function: Callable[[dict], dict | None] = lambda row: None
    schema: dict | None = None
    ends: bool = False

    def __post_init__(self) -> None:
        self.name, self.input_schema, self.terminal = self.step_name, self.schema, self.ends

    def apply(self, chunks: DataFrame, run: Run) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StringType, StructField, StructType

        ship(chunks.sparkSession)
        function = self.function
        plain = chunks.withColumn("meeting_context", F.to_json("meeting_context"))
        schema = StructType([*plain.schema.fields, StructField("_error", StringType())])
        arrow = to_arrow_schema(schema)

        def work(batches):
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    error = None
                    try:
                        if not row["stopped"]:
                            row.update(function(dict(row)) or {})
                    except Exception as e:  # noqa: BLE001  reported as the row's status
                        error = str(e)
                    row["_error"] = error
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return plain.mapInArrow(work, schema).withColumn("meeting_context", F.try_parse_json("meeting_context"))


def register_model_steps(registry: Any, responses: Any, max_segments: int = extract.MAX_SEGMENTS) -> None:
    """The three model steps under their own names, with one source of responses."""
    for kind in (Summarise, ExtractActions, ExtractDecisions):
        registry.register_step(kind.name, kind(responses, max_segments))


def register_deterministic_steps(registry: Any) -> None:
    for step in (CleanText(), SplitSegments(), DeIdentify()):
        registry.register_step(step.name, step)
