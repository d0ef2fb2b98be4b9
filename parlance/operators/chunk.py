"""Sentence-aligned chunks with word overlap, row by row of the input and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import last_words, sentences, words


def chunk_starts(counts: Column, size: int = 2000) -> Column:
    """array<struct<first, before>>: for each chunk its first sentence and the words before it, from the sentences' word counts.

    Sentences are packed greedily up to `size` words; one longer sentence is a chunk of its own.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("filled"), F.lit(0).alias("words"),
        F.array().cast("array<struct<first:int,before:int>>").alias("starts"),
    )

    def step(acc: Column, n: Column) -> Column:
        fits = (acc.filled > 0) & (acc.filled + n <= size)
        return F.struct(
            (acc.at + 1).alias("at"),
            F.when(fits, acc.filled + n).otherwise(n).alias("filled"),
            (acc.words + n).alias("words"),
            F.when(fits, acc.starts).otherwise(F.concat(acc.starts, F.array(F.struct(acc.at.alias("first"), acc.words.alias("before"))))).alias("starts"),
        )

    return F.aggregate(counts, start, step).starts


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later expressions name them.

    The optimiser merges neighbouring projections and so puts an expression in the place of its name, also inside
    functions of higher order, where it is then evaluated for every element. It does not merge through a generator.
    """
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.select("*", made.alias("_staged")).select(*df.columns, *(F.col(f"_staged.{name}").alias(name) for name in columns))


def chunk_text(df: DataFrame, text: str = "text", size: int = 2000, overlap: int = 100) -> DataFrame:
    """df's other columns with chunk_index, total_chunks and chunk_text, a row per chunk; empty texts have no chunks.

    Every chunk but the first begins with the last `overlap` words of all sentences before it, which equal those of the
    chunk before it. A text is split into sentences and words once, and each chunk takes its slices of them.
    """
    others = [c for c in df.columns if c != text]
    split = staged(df, _sents=sentences(F.col(text))).select(*others, "_sents")
    split = staged(split, _words=F.transform("_sents", words))
    split = staged(split, _flat=F.flatten("_words"), _starts=chunk_starts(F.transform("_words", lambda w: F.size(w)), size))
    one = split.select(*others, "_sents", "_flat", "_starts", F.posexplode("_starts").alias("chunk_index", "_start"))
    first, before = F.col("_start.first"), F.col("_start.before")
    until = F.coalesce(F.get("_starts", F.col("chunk_index") + 1).first, F.size("_sents"))
    made = F.array_join(F.slice("_sents", first + 1, until - first), " ")
    if overlap > 0:
        lead = F.array_join(F.slice("_flat", F.greatest(before - overlap + 1, F.lit(1)), F.least(before, F.lit(overlap))), " ")
        made = F.when(before > 0, F.concat(lead, F.lit(" "), made)).otherwise(made)
    return one.select(*others, "chunk_index", F.size("_starts").alias("total_chunks"), made.alias("chunk_text"))


def overlap_prefix(previous: Column, n: int) -> Column:
    """The last n words of a chunk's text."""
    return last_words(previous, n)
