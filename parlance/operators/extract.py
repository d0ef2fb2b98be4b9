"""Model-backed extraction: prompts, responses and the items in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse, fnv, truthy

PROMPT_VERSION = SCHEMA_VERSION = "v1"
MAX_SEGMENTS = 100
#: The lines of the prompts.
OPENING = "You are a meeting analysis assistant."
SHAPES = {
    "summary": ('Return only JSON object: {"summary": string}.', "The summary must be concise and factual."),
    "actions": ('Return only JSON object: {"actions": [{"text": string, "assignee"?: string, "dueDate"?: string, "status"?: "open"|"done"}]}.', "Include only explicit action items."),
    "decisions": ('Return only JSON object: {"decisions": [{"text": string, "madeBy"?: string}]}.', "Include only explicit decisions."),
}
CLOSING = "Transcript segments:"


def render_segments(segments: Column, limit: int = MAX_SEGMENTS) -> Column:
    """Numbered lines of the first `limit` segments; a marker if there are none."""
    line = lambda s, i: F.concat(
        (i + 1).cast("string"), F.lit(". [id="), s.id, F.when(truthy(s.speaker_id), F.concat(F.lit(" speaker="), s.speaker_id)).otherwise(""), F.lit("] "), s.text
    )
    return F.when(F.size(segments) == 0, F.lit("(no segments)")).otherwise(F.array_join(F.transform(F.slice(segments, 1, limit), line), "\n"))


def prompt(kind: str, segments: Column, limit: int = MAX_SEGMENTS) -> Column:
    return F.concat_ws("\n", F.lit(OPENING), *map(F.lit, SHAPES[kind]), F.lit(CLOSING), render_segments(segments, limit))


def requests(chunks: DataFrame, kinds: tuple[str, ...] = ("summary", "actions", "decisions"), limit: int = MAX_SEGMENTS, key: str = "transcript_id") -> DataFrame:
    """(key, chunk_index, schema_name, schema_version, prompt): a row per chunk and kind."""
    rows = F.array(*(F.struct(F.lit(k).alias("schema_name"), prompt(k, F.col("segments"), limit).alias("prompt")) for k in kinds))
    return chunks.select(key, "chunk_index", F.explode(rows).alias("r")).select(key, "chunk_index", "r.schema_name", F.lit(SCHEMA_VERSION).alias("schema_version"), "r.prompt")


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def parse_response(response: Column, kind: str) -> tuple[Column, Column]:
    """(document as a variant, error): strict JSON; no Markdown fences are stripped."""
    doc = F.try_parse_json(response)
    error = (
        F.when(doc.isNull(), F.concat(F.lit(f"{kind}: adapter response is not valid JSON ("), F.substring(F.coalesce(response, F.lit("")), 1, 40), F.lit(")")))
        .when(_type(doc) == "VOID", F.lit(f"{kind}: response is null"))
    )
    return doc, error


def parse_summaries(df: DataFrame, response: str = "response_text") -> DataFrame:
    """df with summary and error. A missing, null or blank summary is none; one that is no string is an error."""
    doc, error = parse_response(F.col(response), "summary")
    staged = df.withColumns({"_doc": doc, "_error": error}).withColumn("_value", _field(F.col("_doc"), "summary"))
    kind = _type(F.col("_value"))
    text = F.when(kind == "STRING", F.nullif(collapse(_string(F.col("_value"))), F.lit("")))
    wrong = F.when(~kind.isin("STRING", "VOID", "MISSING"), F.lit("summary: value is not a string"))
    return staged.withColumns({"summary": F.when(F.col("_error").isNull(), text), "error": F.coalesce("_error", wrong)}).drop("_doc", "_error", "_value")


def _items(df: DataFrame, response: str, name: str) -> DataFrame:
    doc, error = parse_response(F.col(response), name)
    listed = df.withColumns({"_doc": doc, "error": error}).filter("error is null").withColumn("_list", _field(F.col("_doc"), name))
    listed = listed.filter(_type(F.col("_list")).startswith("ARRAY"))
    return listed.select(*df.columns, F.posexplode(F.try_variant_get("_list", "$", "array<variant>")).alias("ord", "_item")).withColumn("_text", _field(F.col("_item"), "text"))


def _usable(df: DataFrame, optional: list[str]) -> DataFrame:
    """Items with a text. From the first item on whose optional value is truthy but no string, a response gives none."""
    text = F.when(_type(F.col("_text")) == "STRING", collapse(_string(F.col("_text"))))
    return df.withColumn("text", text).filter(truthy(F.col("text"))).withColumns({f"_{o}": _field(F.col("_item"), o) for o in optional})


def _bad(c: str) -> Column:
    """Truthy in the original's sense, and no string."""
    kind, value = _type(F.col(c)), F.try_variant_get(c, "$", "double")
    false = kind.isin("VOID", "MISSING") | ((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(c, "$", "boolean"), F.lit(False))) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (value == 0))
    return (kind != "STRING") & ~false


def _truthy_string(c: str) -> Column:
    raw = _string(F.col(c))
    return F.when((_type(F.col(c)) == "STRING") & (raw != ""), collapse(raw))


def _before_failure(df: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    first = df.filter(bad).groupBy(*keys).agg(F.min("ord").alias("_stop"))
    return df.join(first, keys, "left").filter("_stop is null or ord < _stop").drop("_stop")


def parse_actions(df: DataFrame, keys: list[str], response: str = "response_text") -> DataFrame:
    """(keys, ord, id, text, assignee, due_date, status): the actions of each response.

    Items that are no objects with a text are passed over; status is done only if it says so; a due date is kept only
    without an assignee; ids count all items of the list. Keys must be unique.
    """
    items = _usable(_items(df.select(*keys, response), response, "actions"), ["assignee", "dueDate", "status"])
    blank = _truthy_string("_assignee").isNull()
    items = _before_failure(items, keys, _bad("_assignee") | (blank & _bad("_dueDate")))
    done = F.coalesce((_type(F.col("_status")) == "STRING") & (_string(F.col("_status")) == "done"), F.lit(False))
    return items.select(
        *keys, "ord", F.concat(F.lit("act-"), (F.col("ord") + 1).cast("string"), F.lit("-"), fnv(F.col("text"))).alias("id"), "text",
        _truthy_string("_assignee").alias("assignee"), F.when(blank, _truthy_string("_dueDate")).alias("due_date"), F.when(done, "done").otherwise("open").alias("status"),
    )


def parse_decisions(df: DataFrame, keys: list[str], response: str = "response_text") -> DataFrame:
    """(keys, ord, id, text, made_by): the decisions of each response, by the rules of parse_actions."""
    items = _before_failure(_usable(_items(df.select(*keys, response), response, "decisions"), ["madeBy"]), keys, _bad("_madeBy"))
    return items.select(
        *keys, "ord", F.concat(F.lit("dec-"), (F.col("ord") + 1).cast("string"), F.lit("-"), fnv(F.col("text"))).alias("id"), "text", _truthy_string("_madeBy").alias("made_by")
    )


def failed_items(df: DataFrame, keys: list[str], kind: str, response: str = "response_text") -> DataFrame:
    """(keys, _bad): responses whose items end at an optional value that is no string."""
    optional = ["assignee", "dueDate"] if kind == "actions" else ["madeBy"]
    items = _usable(_items(df.select(*keys, response), response, kind), optional)
    bad = _bad("_assignee") | (_truthy_string("_assignee").isNull() & _bad("_dueDate")) if kind == "actions" else _bad("_madeBy")
    return items.filter(bad).select(*keys, F.lit(f"{kind}: an optional field is not a string").alias("_bad")).distinct()
