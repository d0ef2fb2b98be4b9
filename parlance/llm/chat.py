"""Chat formatting with DataFrame functions only.

Layouts differ between data sets: rows by turn, a prompt with a response, an instruction with an optional input, a
list of messages. A layout is known by its fingerprint, the SHA-256 of its sorted nested field paths with their types,
which selects a declarative mapping (SQL expressions) to canonical turns (conv_id, turn, role, text). For a table the
paths come from its schema; in a column of JSON records each record is asked for the paths of the layouts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TURN_END = "</turn>\n"
HEAD = "### "
#: Fixed escapes: after them no text holds a backslash, #, < or : of its own, so no control string either.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Sorted nested paths of a schema, such as messages[].role:string."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    kind = schema.simpleString()
    return [f"{at}:{'int' if kind in ('bigint', 'smallint', 'tinyint') else kind}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """paths: what a table of this layout has at least; turns: SQL for array<struct<turn, role, text>>; conv_id: SQL."""

    name: str
    paths: tuple[str, ...]
    turns: str
    conv_id: str = "conv_id"

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))


def _pair(user: str, assistant: str) -> str:
    return f"array(struct(0L AS turn, 'user' AS role, {user} AS text), struct(1L AS turn, 'assistant' AS role, {assistant} AS text))"


LAYOUTS = (
    Layout("turn_rows", ("conv_id:int", "role:string", "text:string", "turn:int"), "array(struct(CAST(turn AS BIGINT) AS turn, role, text))"),
    Layout("prompt", ("conv_id:int", "prompt:string", "response:string"), _pair("prompt", "response")),
    Layout("instruction", ("conv_id:int", "instruction:string", "output:string"), _pair("instruction", "output")),
    Layout(
        "instruction_input", ("conv_id:int", "input:string", "instruction:string", "output:string"),
        _pair("if(coalesce(input, '') = '', instruction, concat(coalesce(instruction, ''), '\\n\\n', input))", "output"),
    ),
    Layout(
        "messages", ("conv_id:int", "messages[].content:string", "messages[].role:string"),
        "transform(coalesce(messages, array()), (m, i) -> struct(CAST(i AS BIGINT) AS turn, m.role AS role, m.content AS text))",
    ),
    Layout(
        "from_value", ("conv_id:int", "conversations[].from:string", "conversations[].value:string"),
        "transform(coalesce(conversations, array()), (m, i) -> struct(CAST(i AS BIGINT) AS turn, "
        "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END AS role, m.value AS text))",
    ),
)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout.

    The fingerprint of all columns is looked up first; if extra columns are present, that of the largest layout whose
    paths the table contains. Extra columns are ignored. An unknown layout raises ValueError with the paths found.
    """
    have = field_paths(df.schema)
    by_print = {x.fingerprint: x for x in layouts}
    inside = sorted((x for x in layouts if set(x.paths) <= set(have)), key=lambda x: -len(x.paths))
    layout = by_print.get(fingerprint(have)) or (inside[0] if inside else None)
    if layout is None:
        raise ValueError(f"no layout for the field paths {have}")
    return df.selectExpr(f"CAST({layout.conv_id} AS BIGINT) AS conv_id", f"inline({layout.turns})").select("conv_id", "turn", "role", "text")


def canonical_json(df: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, keep_unknown: bool = False) -> DataFrame:
    """(conv_id, turn, role, text, layout) of a column of JSON records whose layouts differ by row.

    A record has the largest layout whose field paths it contains: extra fields are ignored, a null stands for a string
    or a number, and a string of digits for a number. Fields of list items are looked for in all items together, an item
    without one reads as null. Records that are null, not JSON, of no layout, or with an empty list give no turns; with
    keep_unknown each gives one row of null layout, its text the record.
    """
    kinds = {"int": "BIGINT", "string": "STRING"}

    def fits(at: str, kind: str) -> str:
        shown = f"schema_of_variant({at})"
        return f"{shown} IN ('VOID', 'STRING')" if kind == "string" else f"({shown} IN ('VOID', 'BIGINT') OR {shown} = 'STRING' AND try_variant_get({at}, '$', 'bigint') IS NOT NULL)"

    def shape(x: Layout) -> tuple[str, str]:
        tests, fields, lists = [], [], {}
        for p in x.paths:
            path, _, kind = p.rpartition(":")
            name, _, inner = path.partition("[].")
            if inner:
                lists.setdefault(name, []).append((inner, kind))
            else:
                at = f"try_variant_get(v, '$.{name}', 'variant')"
                tests.append(f"{at} IS NOT NULL AND {fits(at, kind)}")
                fields.append(f"`{name}`: {kinds[kind]}")
        for name, inner in lists.items():
            many = f"try_variant_get(v, '$.{name}', 'array<variant>')"
            tests.append(f"forall({many}, e -> schema_of_variant(e) = 'VOID' OR schema_of_variant(e) LIKE 'OBJECT<%')")
            for field, kind in inner:
                at = f"try_variant_get(e, '$.{field}', 'variant')"
                tests.append(f"exists({many}, e -> {at} IS NOT NULL) AND forall({many}, e -> {at} IS NULL OR {fits(at, kind)})")
            fields.append(f"`{name}`: ARRAY<STRUCT<{', '.join(f'`{f}`: {kinds[k]}' for f, k in inner)}>>")
        return " AND ".join(f"coalesce({t}, false)" for t in tests), f"STRUCT<{', '.join(fields)}>"

    ordered = [(x, *shape(x)) for x in sorted(layouts, key=lambda x: -len(x.paths))]
    chosen = " ".join(f"WHEN {test} THEN '{x.name}'" for x, test, _ in ordered)
    typed = df.select(F.col(column).alias("record"), F.try_parse_json(column).alias("v")).selectExpr("record", "v", f"CASE {chosen} END AS layout")
    parts = []
    for x, _, ddl in ordered:
        parts.append(
            typed.filter(F.col("layout") == x.name).selectExpr(f"variant_get(v, '$', '{ddl}') AS r").select("r.*")
            .selectExpr(f"CAST({x.conv_id} AS BIGINT) AS conv_id", f"inline({x.turns})").withColumn("layout", F.lit(x.name))
        )
    if keep_unknown:
        empty = "CAST(NULL AS BIGINT) AS turn", "CAST(NULL AS STRING) AS role", "record AS text", "layout"
        parts.append(typed.filter("layout IS NULL").selectExpr("try_variant_get(v, '$.conv_id', 'bigint') AS conv_id", *empty))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) from canonical turns, one row per conversation.

    A turn is `### role:` newline text `</turn>` newline, role and text escaped. loss_spans has the 0-based start and
    the length, in code points, of each text whose role is in `learn`. Turns are ordered by turn, then role, then text,
    so ties and repeated rows have a defined order; null roles and texts count as empty, a null conv_id is a
    conversation of its own. An empty table gives no rows. A conversation is one value, so its turns meet in one row.
    """
    one = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    seqs = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    cut = seqs.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(F.concat(F.lit(HEAD), escape(t.role), F.lit(":\n")).alias("head"), escape(t.text).alias("body"), t.role.isin(*learn).alias("learn")),
        ).alias("ps"),
    )
    size = lambda p: F.length(p.head) + F.length(p.body) + len(TURN_END)
    return cut.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p.head, p.body, F.lit(TURN_END))), "").alias("formatted"),
        F.aggregate(
            "ps",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda acc, p: F.struct(
                (acc.at + size(p)).alias("at"),
                F.when(p.learn, F.concat(acc.spans, F.array(F.struct((acc.at + F.length(p.head)).alias("start"), F.length(p.body).alias("length"))))).otherwise(acc.spans).alias("spans"),
            ),
        ).spans.alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text) read back from format_chats' output alone."""
    pieces = F.filter(F.split("formatted", TURN_END), lambda p: p != "")
    return formatted.select(
        "conv_id", "formatted",
        F.transform(
            pieces,
            lambda p: F.struct(
                unescape(F.substring(F.substring_index(p, ":\n", 1), len(HEAD) + 1, 2**31 - 1)).alias("role"),
                unescape(F.substring(p, F.instr(p, ":\n") + F.lit(2), F.length(p))).alias("text"),
            ),
        ).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s.start + 1, s.length))), "").alias("loss_text"),
    )


CONTROL = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rows by turn, and conversation -7, a record in the prompt layout."""
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    extra = canonical_turns(spark.createDataFrame([(-7, CONTROL, CONTROL)], "conv_id bigint, prompt string, response string"))
    back = read_chats(format_chats(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(replace(text, '\', ''), '#', ''), '<', ''), ':', '')) AS escaped,
             length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS role_escaped FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(4 + role_escaped + 2 + escaped + 8) AS formatted FROM u GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""
