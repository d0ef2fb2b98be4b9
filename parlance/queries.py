"""The engine's queries over the driver's tables, each with SQL that DuckDB can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import text as X
from .operators import chunk, clean, deidentify, extract, merge, read, redact, segment
from .plans.pipeline import Engine
from .plans.steps import ColumnStep, register_deterministic_steps, register_model_steps
from .plans.validate import validate_segments as segment_errors
from .sources.adapters import ResponseTable
from .sources.transcripts import from_table, from_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- inputs


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts of one chunk: transcript_id, chunk_index, text."""
    return from_turns(turns(spark, sf)).select(F.col("transcript_id").cast("bigint").alias("transcript_id"), F.lit(0).alias("chunk_index"), "text")


def conversation_segments(spark: SparkSession, sf: str) -> DataFrame:
    chunks = segment.split_segments(conversation_lines(spark, sf), F.col("text"))
    return segment.explode_segments(chunks, "transcript_id", "chunk_index").select("transcript_id", "chunk_index", "segment_index", "id", "text", "speaker_id")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of conversations: the whole sentences of each turn, with metadata on some."""
    rows = turns(spark, sf).select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("chunk_index"), F.posexplode(X.sentences(F.col("text"))).alias("ord", "s"))
    return with_metadata(rows, F.col("s"))


def document_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of documents: whole sentences, with their source as the transcript and the document as the chunk."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select(F.col("source").alias("transcript_id"), F.col("doc_id").alias("chunk_index"), F.posexplode(X.sentences(F.col("text"))).alias("ord", "s"))
    return with_metadata(rows, F.col("s"))


def with_metadata(rows: DataFrame, text: Column) -> DataFrame:
    every = lambda k, of: F.when((F.col("chunk_index") + F.col("ord")) % of == k, F.concat(F.lit("p"), (F.col("ord") % 4).cast("string")))
    return rows.select(
        "transcript_id", "chunk_index", "ord", text.alias("text"),
        every(0, 3).alias("assignee"), every(1, 5).alias("due_date"), F.when(F.col("ord") % 2 == 0, "open").otherwise("done").alias("status"),
        every(2, 7).alias("source_segment_id"), every(3, 4).alias("made_by"),
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return as_topics(items(spark, sf))


def as_topics(rows: DataFrame) -> DataFrame:
    rel = (F.col("chunk_index") * 37 + F.col("ord") * 11) % 100 / F.lit(100.0)
    return rows.select("transcript_id", "chunk_index", "ord", F.concat(F.lit("t-"), F.col("ord").cast("string")).alias("id"), F.col("text").alias("label"), rel.alias("relevance"))


# ---- SQL pieces

_W = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_IN = _W[1:-1]


def q_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def q_collapse(x: str) -> str:
    return q_trim(f"regexp_replace({x}, '{_W}+', ' ', 'g')")


def q_norm(x: str) -> str:
    return q_trim(f"regexp_replace(regexp_replace(lower({x}), '{_W}+', ' ', 'g'), '[^A-Za-z0-9_{_IN}]', '', 'g')")


def q_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({q_norm(x)}, '{_W}+'), lambda t: t <> ''))"


def q_words(x: str) -> str:
    return f"regexp_split_to_array({q_trim(x)}, '{_W}+')"


def q_sentences(x: str) -> str:
    cut = rf"string_split(regexp_replace({x}, '([.!?]){_W}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {q_trim('s')}), lambda s: s <> '')"


def q_lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n+'), lambda s: {q_trim('s')}), lambda s: s <> '')"


def q_redact(x: str, email: str = "[Email]", phone: str = "[Phone]", patterns: int = 4) -> str:
    for (_, pattern, label, fold), named in list(zip(redact.PATTERNS, (None, None, email, phone), strict=True))[:patterns]:
        pattern = pattern.replace(r"[-\s]", rf"[-{_IN}]").replace(r"[-.\s]", rf"[-.{_IN}]")
        x = f"regexp_replace({x}, '{pattern}', '{label or named}', '{'gi' if fold else 'g'}')"
    return x


def q_fnv(x: str) -> str:
    step = "CASE WHEN xor(a, c) >= 2147483648 THEN xor(a, c) - 4294967296 ELSE xor(a, c) END"
    units = f"list_transform(list_filter(string_split({x}, ''), lambda z: z <> ''), lambda z: unicode(z)::BIGINT)"
    return f"printf('%08x', list_reduce({units}, lambda a, c: (({step})::DOUBLE * 16777619)::BIGINT & 4294967295, 2166136261::BIGINT))"


_SPEAKER = rf"^{_W}*([\p{{L}}][\p{{L}}\d_\- .]{{0,30}}):{_W}*([^\n\r\x{{2028}}\x{{2029}}]+)$"


def q_segments(source: str) -> str:
    """transcript_id, segment_index, id, text, speaker_id from `source`, SQL for (transcript_id, text) of single chunks."""
    return f"""
    lines AS (SELECT transcript_id, unnest({q_lines('text')}) AS line, generate_subscripts({q_lines('text')}, 1) AS lp FROM ({source})),
    said AS (SELECT transcript_id, lp, CASE WHEN regexp_matches(line, '{_SPEAKER}') THEN {q_trim(f"regexp_extract(line, '{_SPEAKER}', 1)")} END AS speaker,
             CASE WHEN regexp_matches(line, '{_SPEAKER}') THEN {q_trim(f"regexp_extract(line, '{_SPEAKER}', 2)")} ELSE line END AS text FROM lines),
    cut AS (SELECT transcript_id, lp, speaker, {q_split_long('text')} AS parts FROM said),
    part AS (SELECT transcript_id, lp, speaker, unnest(parts) AS p, generate_subscripts(parts, 1) AS pp FROM cut),
    numbered AS (SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY lp, pp) - 1 AS segment_index, {q_collapse('p')} AS text, nullif(speaker, '') AS speaker_id FROM part),
    segs AS (SELECT transcript_id, segment_index, 'seg-0-' || segment_index || '-' || {q_fnv("('0|' || segment_index || '|' || text)")} AS id, text, speaker_id FROM numbered)"""


def q_split_long(x: str, limit: int = 280) -> str:
    slices = f"list_transform(range(0, ((length(x.s) - 1) // {limit} + 1)::BIGINT), lambda k: substr(x.s, (k * {limit} + 1)::BIGINT, {limit}))"
    joined = "CASE WHEN a.held = '' THEN x.s ELSE a.held || ' ' || x.s END"
    fold = f"""list_reduce(list_transform({q_sentences(x)}, lambda z: {{'parts': []::VARCHAR[], 'held': '', 's': z}}),
      lambda a, x: CASE WHEN length({joined}) <= {limit} THEN {{'parts': a.parts, 'held': {joined}, 's': ''}}
        WHEN a.held <> '' THEN {{'parts': list_append(a.parts, a.held), 'held': x.s, 's': ''}}
        ELSE {{'parts': list_concat(a.parts, {slices}), 'held': '', 's': ''}} END, {{'parts': []::VARCHAR[], 'held': '', 's': ''}})"""
    return f"CASE WHEN length({x}) <= {limit} THEN [{x}] ELSE (SELECT CASE WHEN f.held = '' THEN f.parts ELSE list_append(f.parts, f.held) END FROM (SELECT {fold} AS f)) END"


CONV = "SELECT conv_id AS transcript_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
DOCS = "SELECT doc_id AS transcript_id, coalesce(text, '') AS text FROM documents"


def q_chunks(source: str, size: int, overlap: int) -> str:
    """CTEs up to chunked(transcript_id, chunk_index, total_chunks, chunk_text)."""
    fits = f"(a.filled > 0 AND a.filled + x.n <= {size})"
    return f"""
    sents AS (SELECT transcript_id, {q_sentences('text')} AS ss FROM ({source})),
    counts AS (SELECT transcript_id, ss, list_transform(ss, lambda s: len({q_words('s')})::BIGINT) AS ns FROM sents WHERE len(ss) > 0),
    folded AS (SELECT transcript_id, ss, ns, list_reduce(list_transform(ns, lambda n: {{'n': n, 'filled': 0::BIGINT, 'chunk': 0::BIGINT, 'o': []::BIGINT[]}}),
      lambda a, x: {{'n': 0::BIGINT, 'filled': CASE WHEN {fits} THEN a.filled + x.n ELSE x.n END, 'chunk': CASE WHEN {fits} THEN a.chunk ELSE a.chunk + 1 END,
                    'o': list_append(a.o, CASE WHEN {fits} THEN a.chunk ELSE a.chunk + 1 END)}}, {{'n': 0::BIGINT, 'filled': 0::BIGINT, 'chunk': -1::BIGINT, 'o': []::BIGINT[]}}).o AS o FROM counts),
    laid AS (SELECT transcript_id, unnest(ss) AS s, unnest(ns) AS n, unnest(o) AS chunk_index, generate_subscripts(ss, 1) AS pos FROM folded),
    bodies AS (SELECT transcript_id, chunk_index, string_agg(s, ' ' ORDER BY pos) AS body, sum(n)::BIGINT AS n FROM laid GROUP BY ALL),
    before AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY transcript_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wb, count(*) OVER (PARTITION BY transcript_id) AS total_chunks FROM bodies),
    allw AS (SELECT transcript_id, flatten(list_transform(ss, lambda s: {q_words('s')})) AS ws FROM counts),
    chunked AS (SELECT transcript_id, chunk_index, total_chunks,
      CASE WHEN chunk_index = 0 OR {overlap} = 0 THEN body ELSE array_to_string(ws[greatest(wb - {overlap} + 1, 1) : wb], ' ') || ' ' || body END AS chunk_text
      FROM before JOIN allw USING (transcript_id))"""


def q_items() -> str:
    every = lambda k, of: f"CASE WHEN (turn + ord) % {of} = {k} THEN 'p' || (ord % 4) END"
    ss = q_sentences("text")
    return f"""
    sent AS (SELECT conv_id, turn, unnest({ss}) AS s, generate_subscripts({ss}, 1) - 1 AS ord FROM conversations),
    items AS (SELECT conv_id AS transcript_id, turn AS chunk_index, ord, s AS text,
      {every(0, 3)} AS assignee, {every(1, 5)} AS due_date, CASE WHEN ord % 2 = 0 THEN 'open' ELSE 'done' END AS status, {every(2, 7)} AS source_segment_id, {every(3, 4)} AS made_by,
      ((turn * 37 + ord * 11) % 100) / 100.0::DOUBLE AS relevance FROM sent)"""


def q_document_items() -> str:
    """q_items on whole sentences of documents."""
    every = lambda k, of: f"CASE WHEN (doc_id + ord) % {of} = {k} THEN 'p' || (ord % 4) END"
    ss = q_sentences("text")
    return f"""
    sent AS (SELECT source, doc_id, unnest({ss}) AS s, generate_subscripts({ss}, 1) - 1 AS ord FROM documents),
    items AS (SELECT source AS transcript_id, doc_id AS chunk_index, ord, s AS text,
      {every(0, 3)} AS assignee, {every(1, 5)} AS due_date, CASE WHEN ord % 2 = 0 THEN 'open' ELSE 'done' END AS status, {every(2, 7)} AS source_segment_id, {every(3, 4)} AS made_by,
      ((doc_id * 37 + ord * 11) % 100) / 100.0::DOUBLE AS relevance FROM sent)"""


def q_leaders(field: str, threshold: float) -> str:
    """CTEs up to led: items with pos and the pos of their leader."""
    return f"""
    placed AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY chunk_index, ord) AS pos, {q_tokens(field)} AS toks FROM items),
    near AS (SELECT b.transcript_id, b.pos, list(a.pos ORDER BY a.pos) FILTER (a.pos IS NOT NULL) AS sims FROM placed b LEFT JOIN placed a ON a.transcript_id = b.transcript_id AND a.pos < b.pos AND
      CASE WHEN len(a.toks) = 0 AND len(b.toks) = 0 THEN 1.0 ELSE len(list_intersect(a.toks, b.toks))::DOUBLE / greatest(len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)), 1) END >= {threshold} GROUP BY ALL),
    rows_ AS (SELECT transcript_id, list({{'pos': pos::BIGINT, 'sims': coalesce(sims, [])::BIGINT[], 'leaders': []::BIGINT[], 'o': []::BIGINT[]}} ORDER BY pos) AS l FROM near GROUP BY transcript_id),
    fold AS (SELECT transcript_id, list_reduce(l, lambda a, x: {{'pos': 0::BIGINT, 'sims': []::BIGINT[],
        'leaders': CASE WHEN len(list_intersect(a.leaders, x.sims)) = 0 THEN list_append(a.leaders, x.pos) ELSE a.leaders END,
        'o': list_append(a.o, coalesce(list_min(list_intersect(a.leaders, x.sims)), x.pos))}},
        {{'pos': 0::BIGINT, 'sims': []::BIGINT[], 'leaders': []::BIGINT[], 'o': []::BIGINT[]}}).o AS o FROM rows_),
    led AS (SELECT p.*, f.leader FROM placed p JOIN (SELECT transcript_id, unnest(o) AS leader, generate_subscripts(o, 1) AS pos FROM fold) f USING (transcript_id, pos))"""


def q_semantic(score: list[str]) -> str:
    total = " + ".join(f"(coalesce({c}, '') <> '')::INT" for c in score)
    return f"SELECT transcript_id, chunk_index, ord, text FROM led QUALIFY row_number() OVER (PARTITION BY transcript_id, leader ORDER BY {total} DESC, pos) = 1"


# ---- redaction and chunks


@query(f"SELECT doc_id, {q_redact('text')} AS redacted FROM documents")
def pii_redact(spark, sf):
    return redact.pii_redact(documents(spark, sf)).select("doc_id", F.col("text").alias("redacted"))


_PAT = [p.replace(r"[-\s]", rf"[-{_IN}]").replace(r"[-.\s]", rf"[-.{_IN}]") for _, p, _, _ in redact.PATTERNS]


@query(f"""
SELECT * FROM (
  SELECT doc_id, 'financial' AS kind, len(regexp_extract_all(text, '{_PAT[0]}')) + len(regexp_extract_all(text, '{_PAT[1]}')) AS n FROM documents
  UNION ALL SELECT doc_id, 'email', len(regexp_extract_all(text, '(?i){_PAT[2]}')) FROM documents
  UNION ALL SELECT doc_id, 'phone', len(regexp_extract_all({q_redact('text', patterns=3)}, '{_PAT[3]}')) FROM documents) WHERE n > 0""")
def pii_matches(spark, sf):
    found = redact.pii_redact(documents(spark, sf), matches=True).select("doc_id", F.explode("pii_matches").alias("m"))
    return found.groupBy("doc_id", F.col("m.type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {q_redact('text', '<E>', '<P>')} AS redacted FROM documents")
def pii_custom_labels(spark, sf):
    return redact.pii_redact(documents(spark, sf), labels=redact.Labels("<E>", "<P>")).select("doc_id", F.col("text").alias("redacted"))


@query(f"SELECT doc_id, {q_redact('text')} AS redacted FROM documents")
def pii_redact_native(spark, sf):
    return documents(spark, sf).select("doc_id", redact.redact_chained(F.col("text")).alias("redacted"))


@query(f"SELECT doc_id, unnest({q_sentences('text')}) AS sentence, generate_subscripts({q_sentences('text')}, 1) - 1 AS pos FROM documents")
def sentence_split(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, len({q_words('text')}) AS n_words FROM documents")
def word_count(spark, sf):
    return documents(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query(f"WITH {q_chunks(DOCS, 50, 10)} SELECT transcript_id AS doc_id, chunk_index, total_chunks, chunk_text FROM chunked")
def chunk_text(spark, sf):
    return chunk.chunk_text(documents(spark, sf), "text", 50, 10)


@query(f"""WITH {q_chunks(DOCS, 50, 0)}, prev AS (SELECT transcript_id, chunk_index, lag(chunk_text) OVER (PARTITION BY transcript_id ORDER BY chunk_index) AS p FROM chunked)
SELECT transcript_id AS doc_id, chunk_index, array_to_string(({q_words('p')})[-10:], ' ') AS overlap FROM prev WHERE p IS NOT NULL""")
def chunk_overlap(spark, sf):
    chunks = chunk.chunk_text(documents(spark, sf), "text", 50, 0)
    before = F.lag("chunk_text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("p", before).filter("p is not null").select("doc_id", "chunk_index", chunk.overlap_prefix(F.col("p"), 10).alias("overlap"))


# ---- cleaning and segments

_TIME = r"(\d{1,2}:)?\d{1,2}:\d{2}(\.\d+)?"


def q_no_times(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\[{_TIME}\]', ' ', 'g'), '\b{_TIME}\b', ' ', 'g')"


def q_fillers(x: str) -> str:
    for filler in clean.FILLERS:
        x = rf"regexp_replace({x}, '\b{filler}\b', ' ', 'gi')"
    return rf"regexp_replace({x}, '[()\[\]]', ' ', 'g')"


@query(f"SELECT page_id, {q_no_times('html')} AS cleaned FROM pages")
def clean_timestamps(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", clean.drop_timestamps(F.col("html")).alias("cleaned"))


@query(f"SELECT page_id, {q_fillers('html')} AS cleaned FROM pages")
def clean_fillers(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", clean.drop_fillers(F.col("html")).alias("cleaned"))


@query(f"SELECT doc_id, {q_collapse(q_fillers(q_no_times('text')))} AS cleaned FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", clean.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, unnest({q_lines('text')}) AS line, generate_subscripts({q_lines('text')}, 1) - 1 AS pos FROM documents")
def split_lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(segment.lines(F.col("text"))).alias("pos", "line"))


@query(f"""WITH c AS ({CONV}), l AS (SELECT transcript_id, unnest({q_lines('text')}) AS line, generate_subscripts({q_lines('text')}, 1) - 1 AS pos FROM c), m AS (SELECT *, regexp_matches(line, '{_SPEAKER}') AS hit FROM l)
SELECT transcript_id, pos, CASE WHEN hit THEN {q_trim(f"regexp_extract(line, '{_SPEAKER}', 1)")} END AS speaker, CASE WHEN hit THEN {q_trim(f"regexp_extract(line, '{_SPEAKER}', 2)")} ELSE line END AS text FROM m""")
def speaker_prefix(spark, sf):
    rows = conversation_lines(spark, sf).select("transcript_id", F.posexplode(segment.lines(F.col("text"))).alias("pos", "line"))
    return rows.select("transcript_id", "pos", segment.speaker_of(F.col("line")).alias("s")).select("transcript_id", "pos", "s.speaker", "s.text")


@query(f"""WITH l AS (SELECT doc_id, unnest({q_lines('text')}) AS line, generate_subscripts({q_lines('text')}, 1) - 1 AS pos FROM documents), p AS (SELECT doc_id, pos, {q_split_long('line')} AS parts FROM l)
SELECT doc_id, pos, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS part_pos FROM p""")
def split_long_lines(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(segment.lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.posexplode(segment.split_long(F.col("line"))).alias("part_pos", "part"))


@query(f"WITH {q_segments(CONV)} SELECT transcript_id, segment_index, id, text, speaker_id FROM segs")
def segments(spark, sf):
    return conversation_segments(spark, sf).drop("chunk_index")


@query(f"SELECT conv_id, turn, {q_fnv('text')} AS hash FROM conversations")
def fnv_hash(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", X.fnv(F.col("text")).alias("hash"))


# ---- participants

_NAME = rf"\b([A-Z][a-z]{{1,30}}(?:{_W}+[A-Z][a-z]{{1,30}})?)\b"
_ALIASES = f"""
    found AS (SELECT transcript_id, segment_index, unnest(regexp_extract_all(text, '{_NAME}', 1)) AS name, generate_subscripts(regexp_extract_all(text, '{_NAME}', 1), 1) - 1 AS pos FROM segs),
    mention AS (SELECT transcript_id, segment_index, -1 AS pos, lower({q_collapse('speaker_id')}) AS person FROM segs WHERE coalesce(speaker_id, '') <> ''
                UNION ALL SELECT transcript_id, segment_index, pos, lower({q_collapse('name')}) FROM found),
    firsts AS (SELECT transcript_id, person, min(segment_index * 100000 + pos) AS first FROM mention GROUP BY ALL),
    aliases AS (SELECT transcript_id, person, row_number() OVER (PARTITION BY transcript_id ORDER BY first) AS k FROM firsts),
    named AS (SELECT transcript_id, person, 'PARTICIPANT_' || CASE WHEN k < 100 THEN lpad(k::VARCHAR, 2, '0') ELSE k::VARCHAR END AS alias FROM aliases)"""


@query(f"WITH {q_segments(CONV)}, {_ALIASES} SELECT * FROM named")
def participants(spark, sf):
    return deidentify.participants(conversation_segments(spark, sf))


@query(rf"""WITH {q_segments(CONV)}, {_ALIASES},
    uses AS (SELECT f.transcript_id, f.segment_index, list({{'t': '', 'n': f.name, 'a': n.alias}} ORDER BY f.pos) AS l FROM found f JOIN named n ON n.transcript_id = f.transcript_id AND n.person = lower({q_collapse('f.name')}) GROUP BY ALL)
SELECT s.transcript_id, s.segment_index, CASE WHEN l IS NULL THEN s.text ELSE list_reduce(l, lambda a, x: {{'t': regexp_replace(a.t, '\b' || x.n || '\b', x.a, 'g'), 'n': '', 'a': ''}}, {{'t': s.text, 'n': '', 'a': ''}}).t END AS text
FROM segs s LEFT JOIN uses u USING (transcript_id, segment_index)""")
def deidentify_text(spark, sf):
    return deidentify.deidentify(conversation_segments(spark, sf)).select("transcript_id", "segment_index", "text")


@query(f"WITH {q_segments(CONV)}, {_ALIASES} SELECT s.transcript_id, s.segment_index, n.alias AS speaker_id FROM segs s LEFT JOIN named n ON n.transcript_id = s.transcript_id AND n.person = lower({q_collapse('s.speaker_id')})")
def deidentify_speakers(spark, sf):
    return deidentify.deidentify(conversation_segments(spark, sf)).select("transcript_id", "segment_index", "speaker_id")


# ---- prompts and responses

_RENDER = "string_agg((segment_index + 1) || '. [id=' || id || CASE WHEN coalesce(speaker_id, '') <> '' THEN ' speaker=' || speaker_id ELSE '' END || '] ' || text, chr(10) ORDER BY segment_index)"


def _chunks_of_conversations(spark, sf):
    return segment.split_segments(conversation_lines(spark, sf), F.col("text"))


@query(f"WITH {q_segments(CONV)} SELECT transcript_id, {_RENDER} AS rendered FROM segs WHERE segment_index < 100 GROUP BY transcript_id")
def render_segments(spark, sf):
    return _chunks_of_conversations(spark, sf).select("transcript_id", extract.render_segments(F.col("segments")).alias("rendered"))


_HEADS = ", ".join("('{}', '{}')".format(k, "\n".join((extract.OPENING, *v, extract.CLOSING)).replace("'", "''")) for k, v in extract.SHAPES.items())


@query(f"WITH {q_segments(CONV)}, r AS (SELECT transcript_id, {_RENDER} AS rendered FROM segs WHERE segment_index < 100 GROUP BY transcript_id) SELECT transcript_id, h.k AS schema_name, h.t || chr(10) || rendered AS prompt FROM r, (VALUES {_HEADS}) h(k, t)")
def build_prompts(spark, sf):
    return extract.requests(_chunks_of_conversations(spark, sf)).select("transcript_id", "schema_name", "prompt")


_SUMMARY = """CASE doc_id % 7 WHEN 0 THEN '{"summary":"  Doc   ' || doc_id || ' done "}' WHEN 1 THEN 'no json ' || doc_id WHEN 2 THEN '{"summary":5}' WHEN 3 THEN '{"summary":null}' WHEN 4 THEN '{}' WHEN 5 THEN '{"summary":"  "}' ELSE 'null' END"""


def _responses(spark, sf, sql: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.expr(sql).alias("response_text"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Doc ' || doc_id || ' done' END AS summary, doc_id % 7 IN (1, 2, 6) AS failed FROM documents")
def parse_summary(spark, sf):
    return extract.parse_summaries(_responses(spark, sf, _SUMMARY)).select("doc_id", "summary", F.col("error").isNotNull().alias("failed"))


_ACTIONS = """CASE doc_id % 5 WHEN 0 THEN '{"actions":[{"text":"Do   ' || doc_id || '","assignee":"Ann","dueDate":"d"},7,{"text":" "},{"text":"b","status":"done","dueDate":" Fri  day "},{"text":"c","status":"later"}]}' WHEN 1 THEN '{"actions":"x"}' WHEN 2 THEN 'oops' WHEN 3 THEN '{"actions":[{"text":"first"},{"text":"x","assignee":5},{"text":"y"}]}' ELSE '[]' END"""


@query(f"""WITH a(k, ord, text, assignee, due_date, status) AS (VALUES (0, 0, NULL, 'Ann', NULL, 'open'), (0, 3, 'b', NULL, 'Fri day', 'done'), (0, 4, 'c', NULL, NULL, 'open'), (3, 0, 'first', NULL, NULL, 'open')),
r AS (SELECT doc_id, ord, coalesce(a.text, 'Do ' || doc_id) AS text, assignee, due_date, status FROM documents JOIN a ON a.k = doc_id % 5)
SELECT doc_id, ord, 'act-' || (ord + 1) || '-' || {q_fnv('text')} AS id, text, assignee, due_date, status FROM r""")
def parse_actions(spark, sf):
    return extract.parse_actions(_responses(spark, sf, _ACTIONS), ["doc_id"])


_DECISIONS = """CASE doc_id % 3 WHEN 0 THEN '{"decisions":[{"text":"Adopt ' || doc_id || '","madeBy":"Team"},{"text":"Next"}]}' WHEN 1 THEN '{"decisions":[{"text":"a"},{"text":"b","madeBy":["x"]}]}' ELSE '{"decisions":{}}' END"""


@query(f"""WITH a(k, ord, text, made_by) AS (VALUES (0, 0, NULL, 'Team'), (0, 1, 'Next', NULL), (1, 0, 'a', NULL)),
r AS (SELECT doc_id, ord, coalesce(a.text, 'Adopt ' || doc_id) AS text, made_by FROM documents JOIN a ON a.k = doc_id % 3)
SELECT doc_id, ord, 'dec-' || (ord + 1) || '-' || {q_fnv('text')} AS id, text, made_by FROM r""")
def parse_decisions(spark, sf):
    return extract.parse_decisions(_responses(spark, sf, _DECISIONS), ["doc_id"])


# ---- comparison and merging


@query(f"SELECT doc_id, {q_norm('text')} AS norm FROM documents")
def norm_text(spark, sf):
    return documents(spark, sf).select("doc_id", X.norm(F.col("text")).alias("norm"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({q_tokens('text')}), ' ') AS tokens FROM conversations")
def token_set(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(X.token_set(F.col("text"))), " ").alias("tokens"))


@query(f"""WITH t AS (SELECT conv_id, turn, {q_tokens('text')} AS b, lag({q_tokens('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), n AS (SELECT *, len(list_intersect(a, b)) AS i FROM t WHERE a IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE i::DOUBLE / (len(a) + len(b) - i) END, 6) AS similarity FROM n""")
def jaccard_pairs(spark, sf):
    rows = turns(spark, sf).select("conv_id", "turn", X.token_set(F.col("text")).alias("b"))
    rows = rows.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("a is not null")
    return rows.select("conv_id", "turn", F.round(X.jaccard_sets(F.col("a"), F.col("b")), 6).alias("similarity"))


def _summaries(spark, sf):
    return turns(spark, sf).select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("summary"))


@query("SELECT conv_id AS transcript_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def merge_concat_summary(spark, sf):
    return merge.concat_summaries(_summaries(spark, sf))


@query(f"WITH {q_items()} SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY chunk_index, ord) - 1 AS position, text FROM items")
def merge_concat_items(spark, sf):
    return merge.concat_items(items(spark, sf)).select("transcript_id", "position", "text")



def q_first(form: str) -> str:
    return f"SELECT transcript_id, chunk_index, ord, text FROM items QUALIFY row_number() OVER (PARTITION BY transcript_id, {form} ORDER BY chunk_index, ord) = 1"



@query(f"WITH {q_items()} {q_first(q_norm('text'))}")
def dedupe_actions(spark, sf):
    return merge.dedupe(items(spark, sf)).select("transcript_id", "chunk_index", "ord", "text")


@query(f"WITH {q_items()} {q_first(q_norm('text'))}")
def dedupe_decisions(spark, sf):
    return merge.dedupe(items(spark, sf)).select("transcript_id", "chunk_index", "ord", "text")


@query(f"""WITH {q_items()}, f AS (SELECT *, {q_norm('text')} AS form FROM items), p AS (SELECT transcript_id, form, min(chunk_index * 100000 + ord) AS place FROM f GROUP BY ALL),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY transcript_id, form ORDER BY relevance DESC, chunk_index, ord) = 1)
SELECT transcript_id, text AS label, relevance, row_number() OVER (PARTITION BY transcript_id ORDER BY place) - 1 AS position FROM b JOIN p USING (transcript_id, form)""")
def dedupe_topics(spark, sf):
    return merge.dedupe_topics(topics(spark, sf)).select("transcript_id", "label", "relevance", "position")


@query(f"WITH {q_items()}, {q_leaders('text', 0.75)} {q_semantic(['assignee', 'due_date', 'source_segment_id'])}")
def semantic_actions(spark, sf):
    return merge.semantic_actions(items(spark, sf)).select("transcript_id", "chunk_index", "ord", "text")


@query(f"WITH {q_items()}, {q_leaders('text', 0.75)} {q_semantic(['made_by', 'source_segment_id'])}")
def semantic_decisions(spark, sf):
    return merge.semantic_decisions(items(spark, sf)).select("transcript_id", "chunk_index", "ord", "text")


@query(f"""WITH {q_items()}, {q_leaders('text', 0.5)}, t AS (SELECT transcript_id, leader, round(least(1.0, sum(relevance)), 6) AS relevance FROM led GROUP BY ALL),
b AS (SELECT * EXCLUDE relevance FROM led QUALIFY row_number() OVER (PARTITION BY transcript_id, leader ORDER BY led.relevance DESC, pos) = 1)
SELECT transcript_id, text AS label, t.relevance, row_number() OVER (PARTITION BY transcript_id ORDER BY leader) - 1 AS position FROM b JOIN t USING (transcript_id, leader)""")
def cluster_topics(spark, sf):
    return merge.cluster_topics(topics(spark, sf)).select("transcript_id", "label", F.round("relevance", 6).alias("relevance"), "position")


@query(f"""WITH joined AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
items AS (SELECT conv_id AS transcript_id, 0 AS chunk_index, unnest({q_sentences('text')}) AS text, generate_subscripts({q_sentences('text')}, 1) AS ord FROM joined), {q_leaders('text', 0.8)}
SELECT transcript_id, string_agg(text, ' ' ORDER BY pos) AS summary FROM led WHERE leader = pos GROUP BY transcript_id""")
def summary_of_summaries(spark, sf):
    return merge.summary_of_summaries(_summaries(spark, sf))


_STATUSES = "SELECT conv_id AS transcript_id, role AS step, arg_max(CASE WHEN length(text) % 5 = 0 THEN 'failed' ELSE 'success' END, turn) AS status, arg_max(length(text)::BIGINT, turn) AS duration_ms FROM conversations GROUP BY ALL"


@query(_STATUSES)
def status_last_wins(spark, sf):
    status = F.when(F.length("text") % 5 == 0, "failed").otherwise("success")
    rows = turns(spark, sf).select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("step"), status.alias("status"), F.length("text").cast("bigint").alias("duration_ms"))
    return merge.last_status(rows)


# ---- reading and running


@query(f"WITH {q_items()} SELECT transcript_id, chunk_index, ord, text FROM items WHERE status = 'done'")
def actions_by_status(spark, sf):
    return read.actions(items(spark, sf), status="done").select("transcript_id", "chunk_index", "ord", "text")


@query(f"WITH {q_items()} SELECT transcript_id, chunk_index, ord, text FROM items WHERE assignee = 'p1' AND status = 'done'")
def actions_by_assignee(spark, sf):
    return read.actions(items(spark, sf), "done", "p1").select("transcript_id", "chunk_index", "ord", "text")


@query(f"WITH {q_items()} SELECT transcript_id, text AS label, relevance, row_number() OVER (PARTITION BY transcript_id ORDER BY relevance DESC, chunk_index, ord) AS rank FROM items")
def topics_by_relevance(spark, sf):
    return read.topics_by_relevance(topics(spark, sf)).select("transcript_id", "label", "relevance", "rank")


# ---- the same on documents


def on_documents(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    """Register document_<name>: what `name` does to items done to document_items, against the same SQL on them."""

    def whole(spark, sf):
        return run(document_items(spark, sf))

    whole.__name__ = f"document_{name}"
    query(ORACLES[name].replace(q_items(), q_document_items()))(whole)


_PLACE = ("transcript_id", "chunk_index", "ord", "text")
on_documents("merge_concat_items", lambda i: merge.concat_items(i).select("transcript_id", "position", "text"))
on_documents("dedupe_actions", lambda i: merge.dedupe(i).select(*_PLACE))
on_documents("dedupe_decisions", lambda i: merge.dedupe(i).select(*_PLACE))
on_documents("dedupe_topics", lambda i: merge.dedupe_topics(as_topics(i)).select("transcript_id", "label", "relevance", "position"))
on_documents("semantic_actions", lambda i: merge.semantic_actions(i).select(*_PLACE))
on_documents("semantic_decisions", lambda i: merge.semantic_decisions(i).select(*_PLACE))
on_documents("cluster_topics", lambda i: merge.cluster_topics(as_topics(i)).select("transcript_id", "label", F.round("relevance", 6).alias("relevance"), "position"))
on_documents("actions_by_status", lambda i: read.actions(i, status="done").select(*_PLACE))
on_documents("actions_by_assignee", lambda i: read.actions(i, "done", "p1").select(*_PLACE))
on_documents("topics_by_relevance", lambda i: read.topics_by_relevance(as_topics(i)).select("transcript_id", "label", "relevance", "rank"))


_SHAPE = """CASE doc_id % 4 WHEN 0 THEN '[{"id":"a","text":"t"}]' WHEN 1 THEN '[{"id":"a","text":123}]' WHEN 2 THEN '[{"id":"a"},{"text":"x"}]' ELSE '{"id":1}' END"""
_SCHEMA = {"type": "array", "items": {"type": "object", "required": ["id", "text"], "properties": {"text": {"type": "string"}}}}


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'segments[0].text: expected string, got number'
WHEN 2 THEN 'segments[0].text: expected string, got undefined (required), segments[1].id: expected required field, got undefined' ELSE 'segments: expected array, got object' END AS errors FROM documents""")
def validate_segments(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.parse_json(F.expr(_SHAPE)).alias("segments"))
    return rows.select("doc_id", F.array_join(segment_errors(F.col("segments"), _SCHEMA), ", ").alias("errors"))


@query(f"""WITH {q_items()}, n AS (SELECT transcript_id, count(*) AS n_actions, string_agg(text, '|' ORDER BY chunk_index, ord) AS said,
    coalesce(string_agg(text || '@' || made_by, '|' ORDER BY chunk_index, ord), '') AS decided,
    string_agg(text || '@' || (relevance * 100)::INT, '|' ORDER BY relevance DESC, chunk_index, ord) AS topics FROM items GROUP BY ALL),
st AS ({_STATUSES}), steps AS (SELECT transcript_id, string_agg(step || '=' || status || ':' || duration_ms, '|' ORDER BY step) AS steps FROM st GROUP BY ALL),
s AS (SELECT conv_id AS transcript_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id)
SELECT transcript_id, summary, coalesce(n_actions, 0) AS n_actions, coalesce(said, '') AS said, coalesce(decided, '') AS decided, coalesce(topics, '') AS topics, coalesce(steps, '') AS steps, false AS degraded
FROM s LEFT JOIN n USING (transcript_id) LEFT JOIN steps USING (transcript_id)""")
def conversation_json(spark, sf):
    """Records with all their parts, through JSON and back; a decision is a sentence with made_by, a topic any sentence."""
    acts = merge.concat_items(items(spark, sf)).withColumn("id", F.lit("a"))
    found = merge.concat_items(topics(spark, sf))
    status = status_last_wins(spark, sf).withColumns({"error": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    whole = merge.concat_summaries(_summaries(spark, sf)).withColumn("degraded", F.lit(False))
    record = read.Conversations(whole, acts, acts.filter("made_by is not null"), found, status).to_json()
    back = F.from_json("json", """summary string, actions array<struct<id:string,text:string>>, decisions array<struct<text:string,madeBy:string>>,
        topics array<struct<label:string,relevance:double>>, stepStatuses map<string,struct<status:string,durationMs:bigint>>, degraded boolean""")
    return record.select("transcript_id", back.alias("r")).select(
        "transcript_id", "r.summary", F.size("r.actions").cast("bigint").alias("n_actions"), F.array_join("r.actions.text", "|").alias("said"),
        F.array_join(F.transform("r.decisions", lambda d: F.concat(d.text, F.lit("@"), d.madeBy)), "|").alias("decided"),
        F.array_join(F.transform("r.topics", lambda t: F.concat(t.label, F.lit("@"), F.round(t.relevance * 100).cast("int"))), "|").alias("topics"),
        F.array_join(F.transform(F.array_sort(F.map_entries("r.stepStatuses")), lambda e: F.concat(e.key, F.lit("="), e.value.status, F.lit(":"), e.value.durationMs)), "|").alias("steps"),
        "r.degraded",
    )


@query(f"""WITH {q_chunks(DOCS.replace("coalesce(text, '')", q_redact("coalesce(text, '')")), 50, 10)}, r AS (SELECT transcript_id, string_agg('Chunk ' || chunk_index || ' done.', chr(10) || chr(10) ORDER BY chunk_index) AS summary, count(*) AS n FROM chunked GROUP BY ALL)
SELECT doc_id::VARCHAR AS transcript_id, summary, CASE WHEN n IS NULL THEN 0 ELSE 4 END AS n_statuses, coalesce(n, 0) AS n_actions, false AS degraded FROM documents d LEFT JOIN r ON r.transcript_id = d.doc_id""")
def pipeline_end_to_end(spark, sf):
    """Redaction, chunks, cleaning, segments and two model steps answered from a table, merged and read back."""
    source = from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", ["lang", "source"])
    engine = Engine().configure({
        "schemaVersion": "1.0.0", "chunking": {"chunkSize": 50, "overlap": 10}, "logging": {"level": "error"},
        "pipeline": {"steps": [
            {"name": "clean", "plugin": "clean-text"}, {"name": "split", "plugin": "split-segments"},
            {"name": "summarize", "plugin": "summarize-llm"}, {"name": "actions", "plugin": "extract-actions-llm"},
        ]},
    })
    register_deterministic_steps(engine.registry)
    register_model_steps(engine.registry, Scripted())
    out = engine.transform(source)
    return out.select("transcript_id", "summary", F.size("step_statuses").alias("n_statuses"), F.size("actions").cast("bigint").alias("n_actions"), "degraded")


class Scripted(ResponseTable):
    """Answers that follow from the request's chunk alone."""

    def __init__(self):
        super().__init__(None)

    def respond(self, requests: DataFrame, key: str = "transcript_id") -> DataFrame:
        at = F.col("chunk_index").cast("string")
        text = F.when(F.col("schema_name") == "summary", F.concat(F.lit('{"summary":"Chunk '), at, F.lit(' done."}'))).otherwise(F.concat(F.lit('{"actions":[{"text":"Do '), at, F.lit('"}]}')))
        return requests.select(key, "chunk_index", "schema_name", text.alias("response_text"), F.lit("scripted").alias("provider"), F.lit(None).cast("string").alias("error"))


# ---- positions, pieces of a transcript, options, and the engine's other paths


@query(rf"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '\b(?:\d{{4}}[-{_IN}]){{3}}\d{{4}}\b|\b\d{{3}}-\d{{2}}-\d{{4}}\b|(?i:\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b)|(?:\+?\d{{1,3}}[-.{_IN}]?)?(?:\(?\d{{2,4}}\)?[-.{_IN}]?)?\d{{3,4}}[-.{_IN}]?\d{{4}}\b') AS l FROM documents)
SELECT doc_id, unnest(l) AS found, generate_subscripts(l, 1) - 1 AS pos FROM f""")
def pii_offsets(spark, sf):
    """What stands at the offsets of each match; they count UTF-16 units of the original text."""
    both = documents(spark, sf).withColumn("original", F.encode("text", "UTF-16BE"))
    found = redact.pii_redact(both, matches=True).select("doc_id", "original", F.posexplode("pii_matches").alias("pos", "m"))
    there = F.col("original").substr(F.col("m.start") * 2 + 1, (F.col("m.end") - F.col("m.start")) * 2)
    return found.select("doc_id", F.decode(there, "UTF-16BE").alias("found"), "pos")


def _turn_segments(spark, sf) -> DataFrame:
    """conversation_segments with a chunk for each turn."""
    said = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    chunks = turns(spark, sf).select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("chunk_index"), said.alias("text"))
    return segment.explode_segments(segment.split_segments(chunks, F.col("text")), "transcript_id", "chunk_index").select("transcript_id", "chunk_index", "segment_index", "id", "text", "speaker_id")


@query(ORACLES["participants"])
def participants_by_turn(spark, sf):
    """Pseudonyms do not depend on how a transcript is cut: those of one chunk a turn are those of whole conversations."""
    return deidentify.participants(_turn_segments(spark, sf)).select("transcript_id", "person", "alias")


@query(ORACLES["deidentify_text"])
def deidentify_by_turn(spark, sf):
    done = deidentify.deidentify(_turn_segments(spark, sf))
    place = F.row_number().over(Window.partitionBy("transcript_id").orderBy("chunk_index", "segment_index")) - 1
    return done.select("transcript_id", place.alias("segment_index"), "text")


@query(f"""SELECT doc_id, {q_collapse(q_no_times('text'))} AS no_times, {q_fillers('text')} AS no_fillers, {q_collapse(r"regexp_replace(regexp_replace(text, '\b(the|a.)\b', ' ', 'gi'), '[()\[\]]', ' ', 'g')")} AS own_fillers,
coalesce(nullif({q_collapse(q_fillers(q_no_times('text')))}, ''), text, '') AS used FROM documents""")
def clean_options(spark, sf):
    text, options = F.col("text"), clean.CleanOptions
    return documents(spark, sf).select(
        "doc_id", clean.clean_text(text, options(remove_fillers=False)).alias("no_times"),
        clean.clean_text(text, options(remove_timestamps=False, collapse_whitespace=False)).alias("no_fillers"),
        clean.clean_text(text, options(remove_timestamps=False, fillers=("(the|a.)",))).alias("own_fillers"),
        clean.source_text(clean.clean_text(text), text).alias("used"),
    )


_REDACTED_CHUNKS = q_chunks(DOCS.replace("coalesce(text, '')", q_redact("coalesce(text, '')")), 50, 10)


@query(f"""WITH {_REDACTED_CHUNKS}, per AS (
    SELECT transcript_id, chunk_index, 'check' AS step, CASE WHEN length(chunk_text) % 3 = 0 THEN 'length ' || length(chunk_text) END AS error FROM chunked
    UNION ALL SELECT transcript_id, chunk_index, 'gate', CASE WHEN length(chunk_text) % 2 = 0 THEN 'even' END FROM chunked
    UNION ALL SELECT transcript_id, chunk_index, 'after', NULL FROM chunked WHERE length(chunk_text) % 2 = 0)
SELECT transcript_id::VARCHAR AS transcript_id, step, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error FROM per QUALIFY row_number() OVER (PARTITION BY transcript_id, step ORDER BY chunk_index DESC) = 1""")
def step_statuses(spark, sf):
    """A step that fails on some chunks, a terminal one that succeeds on some, and one after them that sees the rest."""
    size = F.length("chunk_text")
    engine = Engine().configure({
        "schemaVersion": "1.0.0", "chunking": {"chunkSize": 50, "overlap": 10}, "logging": {"level": "error"},
        "pipeline": {"steps": [{"name": "check", "plugin": "check"}, {"name": "gate", "plugin": "gate"}, {"name": "after", "plugin": "clean-text"}]},
    })
    register_deterministic_steps(engine.registry)
    engine.register("check", ColumnStep("check", error=lambda: F.when(size % 3 == 0, F.concat(F.lit("length "), size))))
    engine.register("gate", ColumnStep("gate", error=lambda: F.when(size % 2 == 0, "even"), ends=True))
    result = engine.transform(from_table(documents(spark, sf), "doc_id", "text", []), mode="model")
    found = [result.get_step_status(s) for s in ("check", "gate", "after")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("transcript_id", "step", "status", "error")


@query(f"""WITH {_REDACTED_CHUNKS}, r AS (SELECT transcript_id, count(*) AS n FROM chunked GROUP BY ALL), w AS (SELECT doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN r ON r.transcript_id = d.doc_id)
SELECT doc_id::VARCHAR AS transcript_id, CASE WHEN n > 0 THEN array_to_string(list_transform(range(0, least(n, 3)), lambda k: 'Chunk ' || k || ' done.'), ' ') END AS summary, n > 1 AS degraded,
array_to_string(list_transform(range(0, least(n, 3)), lambda k: 'Do ' || k), '|') AS actions, array_to_string(list_transform(range(0, n), lambda k: 'Adopt ' || (k % 3)), '|') AS decisions FROM w""")
def engine_merges(spark, sf):
    """Merge strategies by step: folded summaries (degraded), deduplicated actions, and decisions with a strategy they lack."""
    engine = Engine().configure({
        "schemaVersion": "1.0.0", "chunking": {"chunkSize": 50, "overlap": 10}, "logging": {"level": "error"},
        "pipeline": {"steps": [
            {"name": "summarize", "plugin": "summarize-llm", "merge": "summarize-of-summaries"},
            {"name": "actions", "plugin": "extract-actions-llm", "merge": "deduplicate"}, {"name": "decisions", "plugin": "extract-decisions-llm", "merge": "cluster"},
        ]},
    })
    register_model_steps(engine.registry, Repeating())
    result = engine.transform(from_table(documents(spark, sf), "doc_id", "text", []), mode="model")
    listed = lambda df, name: df.groupBy("transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text), "|").alias(name))
    out = result.get_summary().join(result.is_degraded(), "transcript_id")
    out = out.join(listed(result.get_actions(), "actions"), "transcript_id", "left").join(listed(result.get_decisions(), "decisions"), "transcript_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("actions", "decisions")})


class Repeating(ResponseTable):
    """Answers that every third chunk repeats."""

    def __init__(self):
        super().__init__(None)

    def respond(self, requests: DataFrame, key: str = "transcript_id") -> DataFrame:
        at = (F.col("chunk_index") % 3).cast("string")
        said = lambda before, after: F.concat(F.lit(before), at, F.lit(after))
        text = F.when(F.col("schema_name") == "summary", said('{"summary":"Chunk ', ' done."}')).when(F.col("schema_name") == "actions", said('{"actions":[{"text":"Do ', '"}]}'))
        text = text.otherwise(said('{"decisions":[{"text":"Adopt ', '"}]}'))
        return requests.select(key, "chunk_index", "schema_name", text.alias("response_text"), F.lit("scripted").alias("provider"), F.lit(None).cast("string").alias("error"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, redacted and chunked."""
    return chunk.chunk_text(redact.pii_redact(documents(spark, sf)), "text", 50, 10).select("doc_id", "chunk_index", "chunk_text")
