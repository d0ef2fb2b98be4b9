"""Cleaning of chunk texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.text import BOUNDARY, NO_WORD_AFTER, NO_WORD_BEFORE, collapse

#: Fillers that are removed by default.
FILLERS = ("um", "uh", "erm", "hmm")
_TIME = r"(\d{1,2}:)?\d{1,2}:\d{2}(\.\d+)?"


@dataclass(frozen=True)
class CleanOptions:
    remove_timestamps: bool = True
    collapse_whitespace: bool = True
    remove_fillers: bool = True
    fillers: tuple[str, ...] = FILLERS


def drop_timestamps(c: Column) -> Column:
    """Times in brackets, then bare ones, become spaces."""
    return F.regexp_replace(F.regexp_replace(c, rf"\[{_TIME}\]", " "), NO_WORD_BEFORE + _TIME + NO_WORD_AFTER, " ")


def drop_fillers(c: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Filler words (regular expressions, any case) and brackets become spaces."""
    # Plain words cannot overlap between word boundaries, so they go in one pass.
    plain = [f for f in fillers if re.fullmatch(r"\w+", f, re.ASCII)]
    if len(plain) == len(fillers) and plain:
        c = F.regexp_replace(c, f"(?i){NO_WORD_BEFORE}(?:{'|'.join(plain)}){NO_WORD_AFTER}", " ")
    else:
        for filler in fillers:
            c = F.regexp_replace(c, f"(?i){BOUNDARY}{filler}{BOUNDARY}", " ")
    return F.regexp_replace(c, r"[()\[\]]", " ")


def clean_text(c: Column, options: CleanOptions = CleanOptions()) -> Column:
    if options.remove_timestamps:
        c = drop_timestamps(c)
    if options.remove_fillers:
        c = drop_fillers(c, options.fillers)
    return collapse(c) if options.collapse_whitespace else c


def source_text(cleaned: Column, raw: Column) -> Column:
    """What later steps read: the cleaned text unless it is empty, else the raw one."""
    return F.coalesce(F.nullif(cleaned, F.lit("")), raw, F.lit(""))


def collapse_segments(segments: Column) -> Column:
    """Segments that exist already only get their white space collapsed."""
    return F.transform(segments, lambda s: s.withField("text", collapse(s.text)))
