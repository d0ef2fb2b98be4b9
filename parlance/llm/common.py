"""Helpers shared by the training-data operators: tables in the shared folder, skew-safe joins, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import discard, materialise, shared_dir, shared_path  # noqa: F401  used by the operators
from ..shipping import ship

#: A class with more rows than total/HOT_CLASSES is hot; there can be no more than HOT_CLASSES such classes.
HOT_CLASSES = 20_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int, merge: bool = False) -> DataFrame:
    """rows joined with classes (unique on keys; column `size` = number of rows of the class).

    Classes above total/HOT_CLASSES rows are at most HOT_CLASSES many, so they can be broadcast and their rows never
    move; what remains has no hot key and takes an ordinary shuffle join. With merge that join is a sort-merge join at
    every size, also where the classes would be few enough to be broadcast.
    """
    limit = max(total // HOT_CLASSES, 64)
    hot = F.broadcast(classes.filter(F.col(size) > limit))
    cold = classes.filter(F.col(size) <= limit)
    cold = cold.hint("merge") if merge else cold
    return (
        rows.join(hot, keys)
        .unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
    )


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Large-star / small-star rounds, each written to the shared folder and deleted after the next. A hub's edges are only
    ever aggregated with min(), which Spark combines before the shuffle; no neighbour list is collected anywhere.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialise(e, tag)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a node goes to the node's minimum
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), tag)
        discard(e)
        # small star: every smaller neighbour, and the node, goes to the minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        e = (
            star.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        e = materialise(e, tag)
        discard(large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = materialise(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), tag)
    discard(e)
    return out


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(*more, doc_id, text) of docs for Python stages, with the package sent to the workers."""
    ship(docs.sparkSession)
    return docs.select(*more, F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod5(col: str = "doc_id"):
    """crc32(doc_id as text) mod 5; 0 marks a held-out row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(ids, texts, max_bytes: int = 1 << 20):
    """(ids, texts) as string arrays without nulls, cut into runs of about max_bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield ids.slice(at, to - at), texts.slice(at, to - at)
        at = to


def utf8_buffer(texts):
    """(bytes as uint8, offsets) of a large_string array, without a copy."""
    import numpy as np

    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def words_of(texts):
    """(flat words, word count of each text); words are maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy()
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(mask)])
    counts = np.diff(before[offsets - offsets[0]])
    flat = flat.filter(full)
    return (flat if isinstance(flat, pa.Array) else flat.combine_chunks()), counts
