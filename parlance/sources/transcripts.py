"""Transcript relations (transcript_id, text, metadata) from tables, files and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def from_table(df: DataFrame, id_col: str, text_col: str, metadata: list[str] | None = None) -> DataFrame:
    """A transcript per row; metadata columns become one variant, which no step reads."""
    meta = F.to_variant_object(F.struct(*metadata)) if metadata else F.lit(None).cast("variant")
    return df.select(F.col(id_col).cast("string").alias("transcript_id"), F.coalesce(text_col, F.lit("")).alias("text"), meta.alias("metadata"))


def from_texts(spark: SparkSession, texts: list[str | dict]) -> DataFrame:
    """Transcripts in memory: strings, or mappings with text and metadata."""
    import json

    rows = [(str(i), t, None) if isinstance(t, str) else (str(i), t["text"], json.dumps(t.get("metadata"))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "transcript_id string, text string, metadata string").withColumn("metadata", F.try_parse_json("metadata"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """A transcript per file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("transcript_id"), F.col("value").alias("text"), F.lit(None).cast("variant").alias("metadata"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with transcript_id, text and any metadata object."""
    df = spark.read.schema("transcript_id string, text string, metadata string").json(path)
    return df.withColumn("metadata", F.try_parse_json("metadata"))


def from_turns(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """A transcript per conversation: turns in order, each a line `speaker: text`."""
    line = F.concat(F.coalesce(speaker, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line"))))
    joined = F.array_join(F.transform(ordered, lambda t: t.line), "\n")
    return df.groupBy(F.col(id_col).cast("string").alias("transcript_id")).agg(joined.alias("text")).withColumn("metadata", F.lit(None).cast("variant"))
