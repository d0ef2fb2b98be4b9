"""Text functions as native Column expressions.

White space, word boundaries and word characters follow ECMAScript: white space is a fixed Unicode set, `\\b` and `\\w`
are ASCII, and hashes run over UTF-16 code units.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: ECMAScript white space, as code points, as the inside of a Java character class and as a class. The
#: class first asks for a low or a high code point, so that a letter is turned down by one test and not by twenty.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
WS_SET = r"\t\n\x0B\f\r\x20\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = rf"[\t\n\x0B\f\r\x20\xA0\u1680-\uFEFF&&[{WS_SET}]]"
#: An ASCII word boundary in Java.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What the boundary is before and after something that begins and ends with an ASCII word character.
NO_WORD_BEFORE, NO_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return js_trim(F.regexp_replace(c, f"{WS}+", " "))


def norm(c: Column, unicode_aware: bool = False) -> Column:
    """Comparison form: lower case, single spaces, only ASCII word characters (all letters and digits if unicode_aware)."""
    drop = rf"[^\p{{L}}\p{{N}}_{WS_SET}]" if unicode_aware else rf"[^A-Za-z0-9_{WS_SET}]"
    return js_trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"{WS}+", " "), drop, ""))


def token_set(c: Column, unicode_aware: bool = False) -> Column:
    return F.array_distinct(F.filter(F.split(norm(c, unicode_aware), f"{WS}+"), lambda t: t != ""))


def jaccard_sets(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; two empty ones are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! or ? before white space, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"(?<=[.!?]){WS}+"), js_trim), lambda s: s != "")


def words(c: Column) -> Column:
    return F.split(js_trim(c), f"{WS}+")


def word_count(c: Column) -> Column:
    """Words between white space; 1 for an empty text."""
    return F.size(words(c))


def last_words(c: Column, n: int) -> Column:
    """The last n words, joined by spaces."""
    w = F.filter(words(c), lambda x: x != "")
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(max(n, 0))), " ")


def fnv(c: Column) -> Column:
    """Eight hex digits of the hash that ids carry: FNV-1a whose product is rounded to a double before it is cut to 32 bits."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"), F.lit(1))

    def step(acc: Column, unit: Column) -> Column:
        x = acc.bitwiseXOR(F.conv(unit, 16, 10).cast("bigint"))
        signed = F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
        return (signed.cast("double") * F.lit(float(FNV_PRIME))).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))

    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(FNV_OFFSET).cast("bigint"), step))), 8, "0")


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def pad2(n: Column) -> Column:
    return F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def person_key(c: Column) -> Column:
    return F.lower(collapse(c))


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""
