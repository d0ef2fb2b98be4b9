"""Consistent pseudonyms for speakers and names within a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import BOUNDARY, NO_WORD_AFTER, NO_WORD_BEFORE, WS, escape_regex, pad2, person_key, truthy
from ..shared import materialise

#: A name is one or two capitalised words. ASCII boundaries are what the original has, so Cyrillic names are only
#: found where unicode_aware gives them boundaries of their own.
_LATIN = rf"[A-Z][a-z]{{1,30}}(?:{WS}+[A-Z][a-z]{{1,30}})?"
_CYRILLIC = rf"[А-ЯЁ][а-яё]{{1,30}}(?:{WS}+[А-ЯЁ][а-яё]{{1,30}})?"
NAME = f"{BOUNDARY}({_LATIN}|{_CYRILLIC}){BOUNDARY}"
_EDGE = r"(?<![\p{L}\p{N}_])"
NAME_UNICODE = rf"{_EDGE}({_LATIN}|{_CYRILLIC})(?![\p{{L}}\p{{N}}_])"


def names_in(text: Column, unicode_aware: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME_UNICODE if unicode_aware else NAME), F.lit(1))


def mentions(segments: DataFrame, key: str = "transcript_id", speakers: bool = True, in_text: bool = True, unicode_aware: bool = False) -> DataFrame:
    """(key, person, chunk_index, segment_index, pos): speakers at pos -1, names of the text from 0."""
    at = [key, "chunk_index", "segment_index"]
    parts = []
    if speakers:
        parts.append(segments.filter(truthy(F.col("speaker_id"))).select(*at, F.lit(-1).alias("pos"), person_key(F.col("speaker_id")).alias("person")))
    if in_text:
        found = segments.select(*at, F.posexplode(names_in(F.col("text"), unicode_aware)).alias("pos", "name"))
        parts.append(found.select(*at, "pos", person_key(F.col("name")).alias("person")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def participants(segments: DataFrame, key: str = "transcript_id", **options) -> DataFrame:
    """(key, person, alias): PARTICIPANT_ and the person's rank by first mention in the transcript.

    Mentions are reduced to one row a person before the ranking; a transcript's persons, not its mentions, meet in a task.
    """
    first = mentions(segments, key, **options).groupBy(key, "person").agg(F.min(F.struct("chunk_index", "segment_index", "pos")).alias("first"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return first.select(key, "person", F.concat(F.lit("PARTICIPANT_"), pad2(number)).alias("alias"))


def alias_map(aliases: DataFrame, key: str = "transcript_id") -> DataFrame:
    """(key, _aliases): a map from person to alias for each transcript."""
    return aliases.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("person", "alias"))).alias("_aliases"))


def alias_of(aliases: Column, name: Column) -> Column:
    return F.try_element_at(aliases, person_key(name))


def replace_names(text: Column, aliases: Column, unicode_aware: bool = False) -> Column:
    """text with each name found in the original text replaced everywhere, in order of the finds, by its alias in the map `aliases`."""
    found = F.transform(F.array_distinct(names_in(text, unicode_aware)), lambda n: F.struct(n.alias("name"), alias_of(aliases, n).alias("alias")))

    def step(acc: Column, n: Column) -> Column:
        name = escape_regex(n["name"])
        if unicode_aware:
            pattern = F.concat(F.lit(_EDGE), name, F.lit(r"(?![\p{L}\p{N}_])"))
        else:
            pattern = F.when(n["name"].rlike("^[A-Z]"), F.concat(F.lit(NO_WORD_BEFORE), name, F.lit(NO_WORD_AFTER))).otherwise(F.concat(F.lit(BOUNDARY), name, F.lit(BOUNDARY)))
        return F.regexp_replace(acc, pattern, n["alias"])

    return F.aggregate(F.filter(found, lambda n: n["alias"].isNotNull()), text, step)


def deidentify(segments: DataFrame, key: str = "transcript_id", speakers: bool = True, in_text: bool = True, unicode_aware: bool = False) -> DataFrame:
    """segments(key, chunk_index, segment_index, text, speaker_id, ...) with pseudonyms, numbered by first mention.

    The segments are written once and read for the mentions and for the replacement.
    """
    if not (speakers or in_text):
        return segments
    segments = materialise(segments, "segments")
    maps = alias_map(participants(segments, key, speakers=speakers, in_text=in_text, unicode_aware=unicode_aware), key)
    out = segments.join(maps, key, "left").withColumn("_aliases", F.coalesce("_aliases", F.create_map().cast("map<string,string>")))
    if speakers:
        out = out.withColumn("speaker_id", F.when(truthy(F.col("speaker_id")), alias_of(F.col("_aliases"), F.col("speaker_id"))))
    if in_text:
        out = out.withColumn("text", replace_names(F.col("text"), F.col("_aliases"), unicode_aware))
    return out.drop("_aliases")
