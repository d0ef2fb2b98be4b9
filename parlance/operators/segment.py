"""Segments of chunk texts: lines, speakers, long lines cut at sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WS, collapse, fnv, js_trim, sentences

MAX_LENGTH = 280
#: Stands behind each character above U+FFFF while lengths are taken, so that they count UTF-16 units. A noncharacter.
SECOND_UNIT, TWO_UNITS = "\uffff", r"[\x{10000}-\x{10FFFF}]"
#: A speaker is a letter and up to 30 letters, digits, _ - . or spaces before the first colon that has text after it.
SPEAKER = rf"^{WS}*([\p{{L}}][\p{{L}}0-9_\- .]{{0,30}}):{WS}*([^\n\r\x{{2028}}\x{{2029}}]+)\z"


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n+"), js_trim), lambda s: s != "")


def speaker_of(line: Column) -> Column:
    """struct<speaker, text> of a line; without a speaker prefix speaker is null and text the whole line."""
    name = js_trim(F.regexp_extract(line, SPEAKER, 1))
    hit = line.rlike(SPEAKER)
    return F.struct(F.when(hit, name).alias("speaker"), F.when(hit, js_trim(F.regexp_extract(line, SPEAKER, 2))).otherwise(line).alias("text"))


def split_long(c: Column, limit: int = MAX_LENGTH) -> Column:
    """array<string>: the text itself up to `limit` UTF-16 units, else its sentences packed up to limit.

    A sentence above limit is cut into slices, but only when no shorter text is waiting before it; then it is emitted
    whole, as the original does. A character of two units that a cut would part stays whole in the earlier slice.
    """
    c = F.regexp_replace(c, TWO_UNITS, "$0" + SECOND_UNIT)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("held"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc.held == "", s).otherwise(F.concat(acc.held, F.lit(" "), s))
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda k: F.substring(s, k * limit + 1, F.lit(limit)))
        fits = F.length(joined) <= limit
        return (
            F.when(fits, F.struct(acc.parts.alias("parts"), joined.alias("held")))
            .when(acc.held != "", F.struct(F.concat(acc.parts, F.array(acc.held)).alias("parts"), s.alias("held")))
            .otherwise(F.struct(F.concat(acc.parts, slices).alias("parts"), F.lit("").alias("held")))
        )

    done = F.aggregate(sentences(c), start, step, lambda acc: F.when(acc.held == "", acc.parts).otherwise(F.concat(acc.parts, F.array(acc.held))))
    return F.transform(F.when(F.length(c) <= limit, F.array(c)).otherwise(done), lambda s: F.regexp_replace(s, f"({TWO_UNITS}){SECOND_UNIT}|^{SECOND_UNIT}", "$1"))


def segments_of(text: Column, chunk_index: Column, limit: int = MAX_LENGTH) -> Column:
    """array<struct<id, text, speaker_id>> of a chunk's text."""
    pieces = F.flatten(
        F.transform(
            F.transform(lines(text), speaker_of),
            lambda p: F.transform(split_long(p.text, limit), lambda t: F.struct(p.speaker.alias("speaker"), t.alias("text"))),
        )
    )

    def build(p: Column, i: Column) -> Column:
        t = collapse(p.text)
        at = chunk_index.cast("string")
        key = F.concat(at, F.lit("|"), i.cast("string"), F.lit("|"), t)
        return F.struct(
            F.concat(F.lit("seg-"), at, F.lit("-"), i.cast("string"), F.lit("-"), fnv(key)).alias("id"),
            t.alias("text"), F.nullif(p.speaker, F.lit("")).alias("speaker_id"),
        )

    return F.transform(pieces, build)


def split_segments(chunks: DataFrame, source: Column, limit: int = MAX_LENGTH) -> DataFrame:
    """chunks with a `segments` array, replacing any that exists."""
    return chunks.withColumn("_source", source).withColumn("segments", segments_of(F.col("_source"), F.col("chunk_index"), limit)).drop("_source")


def explode_segments(chunks: DataFrame, *keys: str) -> DataFrame:
    """The segments relation: keys, segment_index, id, text, speaker_id, start_ms, end_ms, language."""
    return chunks.select(*keys, F.posexplode("segments").alias("segment_index", "s")).select(
        *keys, "segment_index", "s.id", "s.text", "s.speaker_id",
        F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"), F.lit(None).cast("string").alias("language"),
    )
