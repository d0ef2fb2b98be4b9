"""Merging the items of a transcript's chunks.

Items are rows (transcript, ordinal, ...); the ordinal orders them by chunk and place. Strategies of one row per group
(deduplication) are window functions. Order-dependent ones (leaders, summaries) fold a transcript's items in one Arrow
group: their result depends on all earlier items of the transcript, and a transcript is their unit of parallelism.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import norm, sentences, token_set, truthy
from ..shipping import ship

SEMANTIC, CLUSTER, SENTENCE = 0.75, 0.5, 0.8
STRATEGIES = ("concat", "deduplicate", "semantic", "cluster", "summarize-of-summaries")


def concat_summaries(summaries: DataFrame, key: str = "transcript_id") -> DataFrame:
    """(key, summary): the summaries that are not null, in chunk order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("summary").isNotNull(), F.struct("chunk_index", "summary"))))
    joined = F.array_join(F.transform(ordered, lambda s: s.summary), "\n\n")
    return summaries.groupBy(key).agg(F.when(F.count("summary") > 0, joined).alias("summary"))


def concat_items(items: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Items numbered along their transcript: (chunk_index, ord) order as `position`."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("chunk_index", "ord")) - 1)


def dedupe(items: DataFrame, field: str = "text", key: str = "transcript_id", unicode_aware: bool = False) -> DataFrame:
    """The first item of each comparison form of `field`; copies are reduced before the shuffle."""
    first = F.min_by(F.struct(*items.columns), F.struct("chunk_index", "ord"))
    return items.groupBy(key, norm(F.col(field), unicode_aware).alias("_form")).agg(first.alias("_i")).select("_i.*")


def dedupe_topics(topics: DataFrame, key: str = "transcript_id", unicode_aware: bool = False) -> DataFrame:
    """The topic of greatest relevance of each label (the earliest of equals), at the place where the label first occurs."""
    best = F.max_by(F.struct(*topics.columns), F.struct(F.col("relevance"), -F.col("chunk_index"), -F.col("ord")))
    grouped = topics.groupBy(key, norm(F.col("label"), unicode_aware).alias("_form")).agg(best.alias("_i"), F.min(F.struct("chunk_index", "ord")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1
    return grouped.withColumn("position", place).select("_i.*", "position")


class Leaders:
    """Items join the earliest leader whose token set is similar enough, else become leaders themselves.

    Leaders are found by shared tokens, whose counts are the overlaps; empty sets, equal to each other only, are apart.
    """

    def __init__(self, threshold: float):
        self.threshold, self.sizes, self.by_token, self.empty = threshold, [], defaultdict(list), None

    def place(self, tokens: list[str]) -> tuple[int, bool]:
        if not tokens:
            if self.empty is None:
                self.empty = self._add(tokens)
                return self.empty, True
            return self.empty, False
        shared = Counter(x for t in tokens for x in self.by_token[t])
        near = [x for x, n in shared.items() if n / (self.sizes[x] + len(tokens) - n) >= self.threshold]
        return (min(near), False) if near else (self._add(tokens), True)

    def _add(self, tokens: list[str]) -> int:
        for t in tokens:
            self.by_token[t].append(len(self.sizes))
        self.sizes.append(len(tokens))
        return len(self.sizes) - 1


def leaders(items: DataFrame, field: str, threshold: float, key: str = "transcript_id", unicode_aware: bool = False) -> DataFrame:
    """items with `leader`, the number of the leader each belongs to, by transcript in (chunk_index, ord) order."""
    ship(items.sparkSession)
    staged = items.withColumn("_tokens", token_set(F.col(field), unicode_aware))
    slim = staged.select(key, "chunk_index", "ord", "_tokens")
    schema = f"`{key}` {dict(items.dtypes)[key]}, chunk_index {dict(items.dtypes)['chunk_index']}, ord {dict(items.dtypes)['ord']}, leader int"

    def fold(pdf):
        pdf = pdf.sort_values(["chunk_index", "ord"], kind="stable")
        state = Leaders(threshold)
        pdf["leader"] = [state.place(list(t))[0] for t in pdf["_tokens"]]
        return pdf[[key, "chunk_index", "ord", "leader"]]

    placed = slim.groupBy(key).applyInPandas(fold, schema)
    return items.join(placed, [key, "chunk_index", "ord"])


def _score(columns: list[str]) -> Column:
    return sum((F.when(truthy(F.col(c)), 1).otherwise(0) for c in columns), F.lit(0))


def semantic(items: DataFrame, metadata: list[str], key: str = "transcript_id", threshold: float = SEMANTIC, unicode_aware: bool = False) -> DataFrame:
    """One item of each group of similar texts: the one with most metadata, the earliest of equals; groups by leader."""
    best = Window.partitionBy(key, "leader").orderBy(F.desc("_score"), "chunk_index", "ord")
    grouped = leaders(items, "text", threshold, key, unicode_aware).withColumn("_score", _score(metadata))
    chosen = grouped.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return chosen.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("leader")) - 1).drop("_n", "_score", "leader")


def semantic_actions(actions: DataFrame, key: str = "transcript_id", **options) -> DataFrame:
    return semantic(actions, ["assignee", "due_date", "source_segment_id"], key, **options)


def semantic_decisions(decisions: DataFrame, key: str = "transcript_id", **options) -> DataFrame:
    return semantic(decisions, ["made_by", "source_segment_id"], key, **options)


def cluster_topics(topics: DataFrame, key: str = "transcript_id", threshold: float = CLUSTER, unicode_aware: bool = False) -> DataFrame:
    """One topic of each group of similar labels: the most relevant; relevance is the group's sum in order, at most 1."""
    grouped = leaders(topics, "label", threshold, key, unicode_aware)
    best = Window.partitionBy(key, "leader").orderBy(F.desc("relevance"), "chunk_index", "ord")
    chosen = grouped.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("relevance", "_n")
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", "ord", "relevance")))
    total = grouped.groupBy(key, "leader").agg(F.least(F.lit(1.0), F.aggregate(in_order, F.lit(0.0), lambda acc, x: acc + x.relevance)).alias("relevance"))
    out = chosen.join(total, [key, "leader"])
    return out.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("leader")) - 1).drop("leader").select(*topics.columns, "position")


def summary_of_summaries(summaries: DataFrame, key: str = "transcript_id", threshold: float = SENTENCE, unicode_aware: bool = False) -> DataFrame:
    """(key, summary): all summaries' sentences without those similar to one kept before."""
    ship(summaries.sparkSession)
    joined = concat_summaries(summaries, key).filter("summary is not null")
    rows = joined.select(key, F.posexplode(sentences(F.col("summary"))).alias("pos", "sentence")).withColumn("_tokens", token_set(F.col("sentence"), unicode_aware))

    def fold(pdf):
        pdf, state = pdf.sort_values("pos"), Leaders(threshold)
        kept = [s for s, t in zip(pdf["sentence"], pdf["_tokens"], strict=True) if state.place(list(t))[1]]
        return pdf.head(1)[[key]].assign(summary=" ".join(kept))

    folded = rows.groupBy(key).applyInPandas(fold, f"`{key}` {dict(summaries.dtypes)[key]}, summary string")
    blank = joined.join(folded.select(key), key, "left_anti").select(key, F.lit("").alias("summary"))
    return folded.unionByName(blank)


def last_status(statuses: DataFrame, key: str = "transcript_id", strict: bool = False) -> DataFrame:
    """(key, step, ...): each step's status in the last chunk; with strict a failed status in any chunk wins."""
    rank = F.struct((F.col("status") == "failed").cast("int") if strict else F.lit(0), F.col("chunk_index"))
    rest = [c for c in statuses.columns if c not in (key, "step")]
    return statuses.groupBy(key, "step").agg(F.max_by(F.struct(*rest), rank).alias("s")).select(key, "step", *(f"s.{c}" for c in rest if c != "chunk_index"))


def strategy_of(steps: list[dict], part: str) -> str:
    """The merge strategy of the first step whose name contains `part`; concat without one."""
    return next((s.get("merge") for s in steps if part in s["name"].lower()), None) or "concat"
