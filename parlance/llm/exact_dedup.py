"""Exact dedup over an extendible-hash index on shared files, with DataFrame functions only.

Directory: texts are hashed to 64 bits and counted by the first MAX_DEPTH bits; starting from one bucket, the directory
doubles and every bucket above `capacity` splits, until all fit or MAX_DEPTH is reached, beyond which buckets grow. It
has at most 2^MAX_DEPTH entries whatever the input. Buckets, in key order, are dealt in contiguous ranges to owners.

Index: rows that share hash and digest with none are entries of their own. The texts of all others go to the owner of
their bucket, which sorts them by (bucket, hash) and compares the bytes of neighbours: equal ones are one entry, others
are chained. Before that, copies collapse within SALTS groups of tasks, so that a text with a third of all rows reaches
its owner in SALTS rows at most. Entries (owner, bucket, hash, digest, chain number) are written to the shared folder,
and rows take keep_id and group size from there; where two texts have one hash and one digest, by the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

MAX_DEPTH = 16
#: Entries of a bucket, about a page of 16 KB.
CAPACITY = 256
#: Into so many rows at most do the copies of a text collapse before they meet at their owner.
SALTS = 64
#: Owners for each shuffle partition, so that partitions even out.
OWNERS = 4


def build_directory(spark: SparkSession, hashes: DataFrame, capacity: int, owners: int, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """(directory(cell, bucket, depth, owner), its global depth) for hashes(h). At most 2^max_depth counts reach the driver."""
    cell = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    counts = {r[0]: r[1] for r in hashes.groupBy(cell.alias("cell")).agg(F.count("*")).collect()}
    size = 1 << max_depth
    prefix = [0]
    for c in range(size):
        prefix.append(prefix[-1] + counts.get(c, 0))
    leaves, open_buckets, depth = [], [(0, 0)], 0
    while open_buckets:  # buckets as (depth, index)
        split = []
        for d, i in open_buckets:
            span = size >> d
            n = prefix[(i + 1) * span] - prefix[i * span]
            if n <= capacity or d == max_depth:
                leaves.append((i * span, span, d, n))
            else:
                split += [(d + 1, 2 * i), (d + 1, 2 * i + 1)]
                depth = max(depth, d + 1)
        open_buckets = split
    leaves.sort()
    total, before, rows = max(1, prefix[-1]), 0, []
    for number, (first, span, d, n) in enumerate(leaves):
        step = 1 << (max_depth - depth)
        rows += [(c >> (max_depth - depth), number, d, min(owners - 1, before * owners // total)) for c in range(first, first + span, step)]
        before += n
    return spark.createDataFrame(rows, "cell int, bucket int, depth int, owner int"), depth


def chained(texts: DataFrame, classes: DataFrame, directory: DataFrame, depth: int, total: int) -> DataFrame:
    """The index: (owner, bucket, h, chain, digest, keep_id, group_size, clash), an entry for each distinct text.

    texts has id, h, text and digest; classes(h, digest, rows, keep_id) counts its rows. clash marks entries whose hash
    and digest another text has too.
    """
    parts = common.shuffle_partitions(texts.sparkSession)
    cell = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("cell", cell).join(F.broadcast(directory.select("cell", "bucket", "owner")), "cell").drop("cell").repartition(parts, "owner")

    several = classes.filter("rows > 1").select("h", "digest", "rows")
    met = common.join_classes(texts, several, ["h", "digest"], "rows", total, merge=True)
    met = met.groupBy("h", "text", "digest", (F.spark_partition_id() % SALTS).alias("salt")).agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    chain = Window.partitionBy("owner", "bucket", "h").orderBy("text")
    fresh = F.when(F.col("text") == F.lag("text").over(chain), 0).otherwise(1)
    met = dealt(met).withColumn("fresh", fresh).withColumn("link", F.sum("fresh").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.groupBy("owner", "bucket", "h", "link").agg(F.first("digest").alias("digest"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    alone = dealt(classes.filter("rows = 1").select("h", F.lit(0).cast("bigint").alias("link"), "digest", "keep_id", F.col("rows").alias("group_size")))
    entries = met.unionByName(alone, allowMissingColumns=True).repartition(parts, "owner")
    place = Window.partitionBy("owner", "bucket", "h")
    same = F.count("*").over(Window.partitionBy("owner", "bucket", "h", "digest"))
    entries = entries.withColumns({"clash": same > 1, "chain": F.row_number().over(place.orderBy("digest", "link"))})
    return entries.select("owner", "bucket", "h", "chain", "digest", "keep_id", "group_size", "clash").sortWithinPartitions("owner", "bucket", "h", "chain")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    hash_of: Callable[[Column], Column] = F.xxhash64,
    digest_of: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest; the row with the largest id of equal texts stays.

    Null texts count as empty. Of repeated rows with that id exactly one has kept = true (if their digests clash with
    another text's, each has). A null id is smaller than any other. Other columns are ignored, whatever their names;
    an empty table gives no rows. hash_of and digest_of can be weakened in tests to force chains.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", hash_of(F.col("text")).alias("h"))
    rows = common.materialise(base.select("id", "h", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("rid")), "dedup-rows")
    total = rows.count()

    owners = OWNERS * common.shuffle_partitions(spark)
    classes = rows.groupBy("h", "digest").agg(F.count("*").alias("rows"), F.max("id").alias("keep_id"))
    classes = common.materialise(classes, "dedup-classes")
    directory, depth = build_directory(spark, classes.select("h", "digest"), capacity, owners)
    index = chained(base.withColumn("digest", digest_of(F.col("text"))), classes, directory, depth, total)
    index = common.materialise(index, "dedup-index")

    once = rows.groupBy("h", "digest").agg(F.max(F.struct("id", "rid")).alias("last"))
    plain = index.filter("not clash").join(once.select("h", "digest", F.col("last.rid").alias("keep_rid")), ["h", "digest"])
    plain = plain.select("h", "digest", "keep_id", "group_size", "keep_rid")
    out = common.join_classes(rows, plain, ["h", "digest"], "group_size", total)
    out = out.select("id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest")

    clashes = index.filter("clash").select("h", "digest").distinct()
    if not clashes.isEmpty():  # equal hash and digest, different bytes: the text itself is the key
        far = base.withColumn("digest", digest_of(F.col("text"))).join(clashes, ["h", "digest"], "left_semi")
        by_text = far.groupBy("h", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(
            far.join(by_text, ["h", "text"]).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
        )
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay."""
    found = common.materialise(exact_dedup(docs, id_col, text_col), "dedup-result")
    key = [F.col(id_col).alias("k_id"), F.col("text_sha256").alias("k_digest")]
    kept = found.filter("kept").select(*key)
    at = lambda other: docs[id_col].eqNullSafe(other["k_id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == other["k_digest"])
    again = found.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    if again.isEmpty():
        return docs.join(kept, at(kept), "left_semi")
    # Repeated rows of one id and text: one of them stays.
    once = kept.join(again, ["k_id", "k_digest"], "left_semi")
    rest = kept.join(again, ["k_id", "k_digest"], "left_anti")
    return docs.join(rest, at(rest), "left_semi").unionByName(docs.join(once, at(once), "left_semi").dropDuplicates([id_col, text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
