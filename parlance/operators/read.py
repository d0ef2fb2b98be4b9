"""The result of a run: relations keyed by transcript, and their JSON form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


def actions(df: DataFrame, status: str | None = None, assignee: str | None = None) -> DataFrame:
    """Actions by exact status and assignee; None does not filter."""
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df if assignee is None else df.filter(F.col("assignee") == assignee)


def topics_by_relevance(df: DataFrame, key: str = "transcript_id", order: tuple[str, ...] = ("chunk_index", "ord")) -> DataFrame:
    """Topics with `rank` by falling relevance, ties in their order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("relevance"), *order)))


ACTION = "array<struct<id:string,text:string,assignee:string,dueDate:string,status:string,sourceSegmentId:string>>"
DECISION = "array<struct<id:string,text:string,madeBy:string,sourceSegmentId:string>>"
TOPIC = "array<struct<id:string,label:string,relevance:double>>"
STATUS = "array<struct<key:string,value:struct<status:string,durationMs:bigint,error:string,reason:string>>>"


@dataclass(frozen=True)
class Conversations:
    """Merged results: transcripts(key, summary, degraded) and item relations with `position`."""

    transcripts: DataFrame
    actions: DataFrame
    decisions: DataFrame
    topics: DataFrame
    statuses: DataFrame
    key: str = "transcript_id"

    def get_summary(self) -> DataFrame:
        return self.transcripts.select(self.key, "summary")

    def get_actions(self, status: str | None = None, assignee: str | None = None) -> DataFrame:
        return actions(self.actions, status, assignee)

    def get_decisions(self) -> DataFrame:
        return self.decisions

    def get_topics(self) -> DataFrame:
        return topics_by_relevance(self.topics, self.key, ("position",))

    def get_step_status(self, step: str) -> DataFrame:
        return self.statuses.filter(F.col("step") == step)

    def is_degraded(self) -> DataFrame:
        return self.transcripts.select(self.key, "degraded")

    def to_records(self) -> DataFrame:
        """A row per transcript: key, summary, actions, decisions, topics, step_statuses, degraded."""
        key = self.key

        def listed(df: DataFrame, name: str, kind: str, order: list, *fields) -> DataFrame:
            packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item"))))
            return df.groupBy(key).agg(F.transform(packed, lambda x: x.item).cast(kind).alias(name))

        at = [F.col("position")]
        parts = [
            listed(self.actions, "actions", ACTION, at, "id", "text", "assignee", "due_date", "status", "source_segment_id"),
            listed(self.decisions, "decisions", DECISION, at, "id", "text", "made_by", "source_segment_id"),
            listed(self.topics, "topics", TOPIC, [(-F.col("relevance")).alias("r"), *at], "id", "label", "relevance"),
        ]
        value = F.struct("status", F.col("duration_ms").alias("durationMs"), "error", "reason")
        parts.append(self.statuses.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("step").alias("key"), value.alias("value")))).cast(STATUS)).alias("step_statuses")))
        out = self.transcripts
        for p in parts:
            out = out.join(p, key, "left")
        empty = {"actions": ACTION, "decisions": DECISION, "topics": TOPIC}
        out = out.withColumns({n: F.coalesce(n, F.array().cast(k)) for n, k in empty.items()})
        out = out.withColumn("step_statuses", F.coalesce("step_statuses", F.map_from_entries(F.array().cast(STATUS))))
        return out.select(key, "summary", "actions", "decisions", "topics", "step_statuses", "degraded")

    def to_json(self) -> DataFrame:
        """(key, json): the record as one JSON text; absent optional fields are left out, a null summary is kept."""
        record = F.struct("summary", "actions", "decisions", "topics", F.col("step_statuses").alias("stepStatuses"), "degraded")
        text = F.to_json(record, {"ignoreNullFields": "true"})
        return self.to_records().select(self.key, F.when(F.col("summary").isNull(), F.concat(F.lit('{"summary":null,'), F.substring(text, 2, 2**31 - 1))).otherwise(text).alias("json"))
