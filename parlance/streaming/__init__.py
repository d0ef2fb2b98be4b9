"""The row-local part of a run over a stream of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean, segment
from ..operators.chunk import chunk_text
from ..operators.redact import Labels, redact_chained, redactor
from ..shipping import ship


def read_transcripts(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of Parquet files of (transcript_id, text)."""
    return spark.readStream.schema("transcript_id string, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def segment_stream(transcripts: DataFrame, size: int = 2000, overlap: int = 100, labels: Labels = Labels(), exact: bool = True) -> DataFrame:
    """Redacted, chunked, cleaned and segmented transcripts: no state, so it runs in append mode without watermarks."""
    if exact:
        ship(transcripts.sparkSession)
        text = redactor(labels)(F.col("text")).redacted
    else:
        text = redact_chained(F.col("text"), labels)
    chunks = chunk_text(transcripts.select("transcript_id", text.alias("text")), "text", size, overlap)
    cleaned = chunks.withColumn("cleaned_text", clean.clean_text(F.col("chunk_text")))
    return segment.split_segments(cleaned, clean.source_text(F.col("cleaned_text"), F.col("chunk_text")))
