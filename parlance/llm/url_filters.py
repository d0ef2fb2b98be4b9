"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits its host and every subdomain when the URL's path starts with the rule's path. A URL is
turned into one probe per host suffix; a probe's canonical key is the reversed suffix, a 0 byte, and the path. Under
such a key the path prefix of a rule is the interval [key, key + U+10FFFF), and the intervals of one reversed host are
nested or disjoint. One sorted sweep per reversed host therefore knows the innermost open rule at each point from the
latest event alone: a start opens its rule, an end returns to the rule below it on the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sweeps of one reversed host are dealt over so many salts, or the shuffle's partitions if these are more; rule events
#: are repeated in each.
SALTS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def rule_events(rules: DataFrame) -> DataFrame:
    """Start and end events (rhost, at, order, active) of rules(host, path, action); active: the rule open from there.

    The stack below a rule is found from the rules alone: the longest other rule of the same host whose path is a
    proper prefix. Of rules with equal host and path the one that blocks counts.
    """
    r = rules.groupBy(_reversed(F.col("host")).alias("rhost"), "host", "path").agg(F.max("action").alias("action"))
    r = r.withColumn("entry", F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("hlen"), F.concat("host", "path").alias("rule"), "action"))
    prefixes = r.select(
        "rhost", "path", "entry",
        F.explode(F.when(F.length("path") > 0, F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n))).otherwise(F.array().cast("array<string>"))).alias("shorter"),
    )
    below = (
        prefixes.join(r.select("rhost", F.col("path").alias("shorter"), F.col("entry").alias("outer")), ["rhost", "shorter"])
        .groupBy("rhost", "path").agg(F.max("outer").alias("below"))
    )
    r = r.join(below, ["rhost", "path"], "left")
    start = r.select("rhost", F.col("path").alias("at"), F.lit(1).alias("order"), F.length("path").alias("depth"), F.col("entry").alias("active"))
    end = r.select("rhost", F.concat("path", F.lit("\U0010ffff")).alias("at"), F.lit(0).alias("order"), (-F.length("path")).alias("depth"), F.col("below").alias("active"))
    return start.unionByName(end)


def filter_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", salts: int = SALTS) -> DataFrame:
    """One row per row of urls: key, host, path, rule, verdict.

    rules has host, path and action ('allow' or 'block'). The longest fitting rule (host and path together, then the
    longer host) wins; without one, rule is null and verdict is `default`. Null URLs and URLs without :// have an
    empty host and path and fit no rule, except one with an empty host. Repeated keys and repeated rows each keep
    their row; columns other than key and url are ignored, so their names cannot clash; an empty table gives none.
    """
    salts = max(salts, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    host, path = url_parts(F.col(url))
    base = urls.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.reverse(F.slice(labels, n - i + 1, i))))
    events = rule_events(rules)
    probes = base.select("k", "host", "path", "rid", F.explode(suffixes).alias("rhost")).select(
        "rhost", F.col("path").alias("at"), F.lit(2).alias("order"), F.lit(0).alias("depth"), F.lit(None).cast(events.schema["active"].dataType).alias("active"),
        F.pmod(F.xxhash64("k", "path"), F.lit(salts)).alias("salt"), "k", "host", "path", "rid",
    )
    blank = {c: F.lit(None).cast(t) for c, t in base.dtypes}
    dealt = events.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).withColumns(blank)
    # At one point: ends (inner first), then starts (outer first), then probes.
    sweep = Window.partitionBy("rhost", "salt").orderBy("at", "order", "depth").rowsBetween(Window.unboundedPreceding, 0)
    # An end to the empty stack is an event whose rule is null, so events are boxed before the last one is taken.
    swept = probes.unionByName(dealt).withColumn("open", F.last(F.when(F.col("order") < 2, F.struct("active")), ignorenulls=True).over(sweep))
    found = swept.filter("order = 2").groupBy("rid", "k", "host", "path").agg(F.max("open.active").alias("won"))
    return found.select(
        F.col("k").alias(key), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict")
    )


#: The rules of the query, as (host, path, action).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH r(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
w AS (SELECT page_id, h || p AS rule, action FROM v JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM w GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM v LEFT JOIN best USING (page_id)
"""
