"""Redaction of personal data in whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import BOUNDARY, NO_WORD_AFTER, NO_WORD_BEFORE, WS_SET
from ..shipping import ship

#: The patterns, in the order that decides ties, with \s for white space; labels of None are configured.
PATTERNS = (
    ("financial", r"\b(?:\d{4}[-\s]){3}\d{4}\b", "[Card]", False),
    ("financial", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]", False),
    ("email", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", None, True),
    ("phone", r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{4}\b", None, False),
)
MATCH = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())])
RESULT = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("matches", T.ArrayType(MATCH))])


@dataclass(frozen=True)
class Labels:
    email: str = "[Email]"
    phone: str = "[Phone]"
    name: str = "[Person]"


def _compiled(labels: Labels) -> list[tuple[str, re.Pattern, str]]:
    spelled = lambda p: p.replace(r"[-\s]", f"[-{WS_SET}]").replace(r"[-.\s]", f"[-.{WS_SET}]")
    return [(kind, re.compile(spelled(p), re.ASCII | (re.IGNORECASE if fold else 0)), label or getattr(labels, kind)) for kind, p, label, fold in PATTERNS]


def redact_text(text: str, compiled: list) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(redacted text, matches): each pattern scans the whole text; the leftmost start wins, then the earlier pattern."""
    found = sorted(((m.start(), k, m.end()) for k, (_, p, _) in enumerate(compiled) for m in p.finditer(text)), key=lambda m: m[:2])
    out, matches, at = [], [], 0
    wide = not text.isascii() and any(ord(c) > 0xFFFF for c in text)
    unit = (lambda i: len(text[:i].encode("utf-16-le")) // 2) if wide else (lambda i: i)
    for start, k, end in found:
        if start < at:
            continue
        out += [text[at:start], compiled[k][2]]
        matches.append((compiled[k][0], unit(start), unit(end), compiled[k][2]))
        at = end
    return "".join([*out, text[at:]]), matches


def redactor(labels: Labels = Labels()) -> Callable[[Column], Column]:
    """An Arrow-batched function text -> struct<redacted, matches>; offsets are UTF-16 units of the original text."""
    @F.pandas_udf(RESULT)
    def redact(texts: pd.Series) -> pd.DataFrame:
        compiled = _compiled(labels)
        rows = [redact_text(t, compiled) if t is not None else (None, None) for t in texts]
        names = MATCH.fieldNames()
        return pd.DataFrame({"redacted": [r for r, _ in rows], "matches": [None if m is None else [dict(zip(names, x, strict=True)) for x in m] for _, m in rows]})

    return redact


def pii_redact(df: DataFrame, text: str = "text", labels: Labels = Labels(), matches: bool = False) -> DataFrame:
    """df with `text` redacted, and a `pii_matches` column if asked for. Exact for overlapping matches."""
    ship(df.sparkSession)
    out = df.withColumn("_pii", redactor(labels)(F.col(text))).withColumn(text, F.col("_pii.redacted"))
    return (out.withColumn("pii_matches", F.col("_pii.matches")) if matches else out).drop("_pii")


def redact_chained(c: Column, labels: Labels = Labels()) -> Column:
    """The fast native form: patterns applied one after another. Differs from pii_redact where matches overlap."""
    for kind, pattern, label, fold in PATTERNS:
        java = pattern.replace(r"[-\s]", f"[-{WS_SET}]").replace(r"[-.\s]", f"[-.{WS_SET}]")
        # A boundary beside a digit needs to look to one side only.
        java = re.sub(r"^\\b(?=\\d|\(\?:\\d)", lambda _: NO_WORD_BEFORE, java)
        java = re.sub(r"(\\d\{\d\})\\b$", lambda m: m[1] + NO_WORD_AFTER, java).replace(r"\b", BOUNDARY)
        done = F.regexp_replace(c, ("(?i)" if fold else "") + java, (label or getattr(labels, kind)).replace("\\", "\\\\").replace("$", "\\$"))
        c = F.when(c.contains("@"), done).otherwise(c) if kind == "email" else done
    return c
