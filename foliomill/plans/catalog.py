"""Queries by name over the stored tables, and what DuckDB should say to them.

Every query runs over its whole tables. Redelivered rows are reduced to the newest
of each key where the engine's tables have unique keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import rules as R
from foliomill.functions import text as X
from foliomill.operators import chunking, classify, ingest, keys, layers, reports, search
from foliomill.settings import Settings
from foliomill.sources import tables as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

QUESTIONS = [
    ("q1", "water channel network", [], ["network"]),
    ("q2", "swelling of the membrane", ["10.1000/none"], ["membrane"]),
    ("q3", "the solid-electrolyte interphase", [], ["Interphase", "electrolyte"]),
    ("q4", "in the third round", [], ["third round"]),
    ("q5", "мембраны", [], ["мембран"]),
    ("q6", "离子交换容量", [], ["离子交换"]),
    ("q7", "no such phrase xyzzy", [], []),
    ("q8", "the", [], ["the"]),
    ("q9", "impedance arc, Raman-line", [], ["raman"]),
    ("q10", "100 %", [], ["%"]),
]
TOP_K = 10


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------------------- SQL of shared parts

WS, W = X.WS, r"\p{L}\p{N}_"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q('^' + WS + '+')}, ''), {q(WS + '+$')}, '')"


def newest(table: str, by: str, order: str = "created_at DESC NULLS LAST, id DESC", where: str = "true") -> str:
    return f"(SELECT * FROM {table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) = 1)"


PAGES = newest("pages", "article_id, page_number")
CHUNKS = newest("chunks", "article_id, chunk_index")
LAYERS = newest("page_text_layers", "article_id, page_number, layer_type", where="layer_type IN ('original', 'ocr')")


def re2(pattern: str) -> str:
    """A rule's pattern for RE2: borders of words and white space are written out."""
    if r"wt\s*%|mol" in pattern:  # a border behind "%" asks for a word character
        pattern = pattern.replace(r"(?:wt\s*%|mol|S\s*cm|mS\s*cm|°C|K)\b", rf"(?:wt\s*%[{W}]|(?:mol|S\s*cm|mS\s*cm|°C|K)(?:$|[^{W}]))")
    if pattern.startswith(r"\b"):
        pattern = rf"(?:^|[^{W}])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + rf"(?:$|[^{W}])"
    return "(?i)" + pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


COUNTS = f"""length(n) AS n_chars, length(regexp_replace(n, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS alnum, length(regexp_replace(n, '[^\\p{{L}}]+', '', 'g')) AS alpha,
    length(regexp_replace(n, '\\p{{C}}+', '', 'g')) AS printable, length(n) - length(replace(n, chr(65533), '')) AS replaced, len(regexp_extract_all(n, {q(X.MOJIBAKE)})) AS mojibake"""
USABLE = "(n_chars >= 80 AND alnum::DOUBLE / greatest(n_chars, 1) >= 0.25::DOUBLE)"
QUALITY = """CASE WHEN n_chars = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.35::DOUBLE * least(n_chars::DOUBLE / 320, 1::DOUBLE) + 0.30::DOUBLE * least((alnum::DOUBLE / n_chars) / 0.55::DOUBLE, 1::DOUBLE)
    + 0.25::DOUBLE * least((alpha::DOUBLE / n_chars) / 0.45::DOUBLE, 1::DOUBLE) + 0.10::DOUBLE * (printable::DOUBLE / n_chars) - 2.0::DOUBLE * (replaced::DOUBLE / n_chars) - 4.0::DOUBLE * (mojibake::DOUBLE / n_chars))) END"""
PAIRS = f"""(SELECT article_id, page_number, max(CASE WHEN layer_type = 'original' THEN 1 END) AS o, max(CASE WHEN layer_type = 'ocr' THEN 1 END) AS s,
    bool_or(CASE WHEN layer_type = 'original' THEN coalesce(has_usable_text, false) END) AS ou, bool_or(CASE WHEN layer_type = 'ocr' THEN coalesce(has_usable_text, false) END) AS su,
    max(CASE WHEN layer_type = 'original' THEN coalesce(quality_score, 0) END) AS oq, max(CASE WHEN layer_type = 'ocr' THEN coalesce(quality_score, 0) END) AS sq,
    max(CASE WHEN layer_type = 'original' THEN text END) AS ot, max(CASE WHEN layer_type = 'ocr' THEN text END) AS st FROM {LAYERS} GROUP BY ALL)"""
CHOICE = "CASE WHEN s IS NULL THEN 'original' WHEN o IS NULL THEN 'ocr' WHEN ou THEN CASE WHEN su AND sq > oq + 0.20::DOUBLE THEN 'ocr' ELSE 'original' END WHEN su THEN 'ocr' WHEN sq > oq THEN 'ocr' ELSE 'original' END"


# ---------------------------------------------------------------------------------------- text functions

@query(f"SELECT id, md5({norm('text')}) AS digest, length({norm('text')}) AS n FROM pages WHERE text IS NOT NULL")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.normalize(F.col("text"))
    return S.pages(spark, sf_dir).where("text is not null").select("id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


@query(f"SELECT id, {COUNTS} FROM (SELECT id, {norm('text')} AS n FROM page_text_layers)")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    counts = {"n_chars": F.length(n), "alnum": X.alnum(n), "alpha": X.alpha(n), "printable": X.printable(n), "replaced": X.replacement_marks(n), "mojibake": X.mojibake(n)}
    return S.layers(spark, sf_dir).select("id", X.normalize(F.col("text")).alias("n")).select("id", *[c.cast("long").alias(k) for k, c in counts.items()])


@query(f"SELECT id, {USABLE} AS usable, round({QUALITY}, 9) AS score FROM (SELECT id, {COUNTS} FROM (SELECT id, {norm('text')} AS n FROM page_text_layers))")
def layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.scored(S.layers(spark, sf_dir)).select("id", F.col("has_usable_text").alias("usable"), F.round("quality_score", 9).alias("score"))


@query(r"""SELECT id, CASE WHEN d <> '' THEN lower(regexp_replace(d, '[.,;]+$', '')) END AS doi
    FROM (SELECT id, regexp_extract(text, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b') AS d FROM chunks)""")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(spark, sf_dir).select("id", X.doi(F.col("text")).alias("doi"))


@query(f"SELECT id, CASE WHEN n = '' THEN 1 ELSE len(string_split(n, ' ')) END AS tokens FROM (SELECT id, {norm('text')} AS n FROM chunks)")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(spark, sf_dir).select("id", X.token_count(F.col("text")).cast("long").alias("tokens"))


@query(r"""WITH a AS (SELECT id, checksum_sha256 AS c, regexp_extract(pdf_original_path, '[^/]*$') AS name FROM articles),
    b AS (SELECT *, regexp_extract(name, '[^.](\.[^.]+)$', 1) AS suffix FROM a),
    d AS (SELECT *, left(replace(trim(left(name, length(name) - length(suffix))), ' ', '_'), 80) AS stem FROM b)
    SELECT id, left(c, 16) || '_' || CASE WHEN stem = '' THEN 'document' ELSE stem END || CASE WHEN suffix = '' THEN '.pdf' ELSE lower(suffix) END AS name FROM d""")
def stable_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles(spark, sf_dir).select("id", X.stable_name(F.col("checksum_sha256"), F.col("pdf_original_path")).alias("name"))


@query(f"""SELECT id, CASE WHEN length(n) <= 500 THEN n ELSE rtrim(left(n, 500)) || '...' END AS short FROM (SELECT id, {norm("coalesce(text, '')")} AS n FROM pages)""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pages(spark, sf_dir).select("id", X.truncate(F.col("text")).alias("short"))


@query("""SELECT id, replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM articles""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles(spark, sf_dir).select("id", X.escape_html(F.col("title")).alias("html"))


@query("SELECT id, right(error_message, 20) AS tail FROM ingestion_jobs")
def message_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.jobs(spark, sf_dir).select("id", X.tail(F.col("error_message"), 20).alias("tail"))


@query("SELECT id, replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') AS text FROM chunks")
def ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(spark, sf_dir).select("id", X.spell_ligatures(F.col("text")).alias("text"))


# ------------------------------------------------------------------------------------------------ layers

@query(f"SELECT article_id, page_number, {CHOICE} AS selected FROM {PAIRS}")
def layer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.pages_of(S.layers(spark, sf_dir), ()).select("article_id", "page_number", layers.choice().alias("selected"))


@query(f"""SELECT article_id, page_number, selected AS selected_text_layer, md5(coalesce(t, '')) AS digest, {norm("coalesce(t, '')")} <> '' AS has_text_layer, selected = 'ocr' AS ocr_used
    FROM (SELECT *, {CHOICE} AS selected, CASE WHEN selected = 'ocr' THEN st ELSE ot END AS t FROM {PAIRS})""")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.selected_pages(S.layers(spark, sf_dir)).select(
        "article_id", "page_number", "selected_text_layer", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "has_text_layer", "ocr_used")


@query(f"""SELECT l.article_id, l.page_number, l.layer_type, coalesce(l.has_usable_text, false) AS has_usable_text, round(coalesce(l.quality_score, 0), 6) AS quality_score, p.selected = l.layer_type AS selected
    FROM {LAYERS} l JOIN (SELECT article_id, page_number, {CHOICE} AS selected FROM {PAIRS}) p USING (article_id, page_number)""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_summary(S.layers(spark, sf_dir)).withColumn("quality_score", F.round("quality_score", 6))


@query(f"""SELECT l.id, l.article_id, l.page_number, l.layer_type, printf('%.3f', round(coalesce(l.quality_score, 0), 3)) AS quality, coalesce(p.selected_text_layer = l.layer_type, false) AS selected
    FROM {LAYERS} l LEFT JOIN {PAGES} p USING (article_id, page_number)""")
def layer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers against the selection that is stored with the pages."""
    rows = keys.newest(S.layers(spark, sf_dir).where(F.col("layer_type").isin("original", "ocr")).drop("text"), ["article_id", "page_number", "layer_type"])
    pages = S.newest_pages(spark, sf_dir, text=False).select("article_id", "page_number", "selected_text_layer")
    return rows.join(pages, ["article_id", "page_number"], "left").select(
        "id", "article_id", "page_number", "layer_type", F.format_string("%.3f", F.round(F.coalesce("quality_score", F.lit(0.0)), 3)).alias("quality"), F.coalesce(F.col("selected_text_layer") == F.col("layer_type"), F.lit(False)).alias("selected"))


_USABLE_PAGES = f"""(SELECT article_id, count(*) AS pages, sum({USABLE}::INT)::BIGINT AS usable_pages FROM (SELECT article_id, {COUNTS} FROM (SELECT article_id, {norm("coalesce(text, '')")} AS n
    FROM {newest("page_text_layers", "article_id, page_number", where="layer_type = 'original'")})) GROUP BY article_id)"""


@query(f"SELECT article_id, pages, usable_pages, usable_pages >= greatest(1, pages // 2) AS usable, NOT usable_pages >= greatest(1, pages // 2) AS ocr_required FROM {_USABLE_PAGES}")
def document_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.document_usable(S.layers(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- chunking

_PARAGRAPHS = f"""WITH p AS (SELECT article_id, page_number, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10) || chr(10)) AS parts FROM {PAGES}),
    s AS (SELECT article_id, page_number, list_filter(list_transform(parts, lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM p)
    SELECT article_id, page_number, unnest(range(len(parts)))::INT AS paragraph_no, unnest(parts) AS text FROM s"""


@query(_PARAGRAPHS)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(S.newest_pages(spark, sf_dir))


def _chunks_sql(target: int, overlap: int) -> str:
    """The chunker as a recursion over an article's paragraphs: ``s`` is the first paragraph held, ``size`` the characters held;
    a step adds paragraph k and closes up to two chunks (a: before it, b: behind it). ``cum`` holds the running length of paragraphs."""
    def carry(first: str, last: str) -> str:
        """The first paragraph kept behind a chunk: the last whose characters to the end reach the overlap, else the chunk's first."""
        return f"greatest({first}, len(list_filter(cum[:{last}], lambda x: x <= cum[{last} + 1] - {overlap})))" if overlap else f"{last} + 1"

    full = f"k > s AND size + l > {target}"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT article_id, page_number, text, length(text) AS l, row_number() OVER (PARTITION BY article_id ORDER BY page_number, paragraph_no) AS k FROM ({_PARAGRAPHS})),
        c AS MATERIALIZED (SELECT article_id, list_prepend(0::HUGEINT, list(t ORDER BY k)) AS cum, count(*) AS n FROM (SELECT *, sum(l) OVER (PARTITION BY article_id ORDER BY k) AS t FROM p) GROUP BY article_id),
        r AS (SELECT article_id, 0::BIGINT AS k, 1::BIGINT AS s, 0::BIGINT AS a0, 0::BIGINT AS a1, 0::BIGINT AS b0, 0::BIGINT AS b1 FROM c
            UNION ALL SELECT article_id, k, CASE WHEN l >= {target} THEN {carry('s1', 'k')} ELSE s1 END, CASE WHEN {full} THEN s ELSE 0 END, CASE WHEN {full} THEN k - 1 ELSE 0 END,
                CASE WHEN l >= {target} THEN s1 ELSE 0 END, CASE WHEN l >= {target} THEN k ELSE 0 END
            FROM (SELECT *, CASE WHEN {full} THEN {carry('s', '(k - 1)')} ELSE s END AS s1 FROM (SELECT r.article_id, p.k, r.s, p.l, c.cum, c.cum[r.k + 1] - c.cum[r.s] AS size
                FROM r JOIN p ON p.article_id = r.article_id AND p.k = r.k + 1 JOIN c ON c.article_id = r.article_id))),
        f AS (SELECT article_id, a0 AS i, a1 AS j, 2 * k AS o FROM r WHERE a0 > 0 UNION ALL SELECT article_id, b0, b1, 2 * k + 1 FROM r WHERE b0 > 0
            UNION ALL SELECT r.article_id, r.s, c.n, 2 * c.n + 2 FROM r JOIN c ON c.article_id = r.article_id AND r.k = c.n WHERE r.s <= c.n),
        t AS (SELECT f.article_id, f.o, min(p.page_number) AS page_start, max(p.page_number) AS page_end, string_agg(p.text, chr(10) || chr(10) ORDER BY p.k) AS text
            FROM f JOIN p ON p.article_id = f.article_id AND p.k BETWEEN f.i AND f.j GROUP BY ALL)
        SELECT article_id, (row_number() OVER (PARTITION BY article_id ORDER BY o) - 1)::INT AS chunk_index, page_start, page_end, 'main_text' AS source_type, text, length(text)::INT AS char_count,
            greatest(1, len(string_split({norm('text')}, ' ')))::INT AS token_count FROM t"""


@query(_chunks_sql(4500, 0))
def chunks_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(S.newest_pages(spark, sf_dir), 4500, 0)


@query(_chunks_sql(4500, 600))
def chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(S.newest_pages(spark, sf_dir), 4500, 600)


@query(f"""SELECT c.article_id, c.chunk_index, CASE WHEN min(p.selected_text_layer) IS NULL THEN 'original' WHEN min(p.selected_text_layer) = max(p.selected_text_layer) THEN min(p.selected_text_layer) ELSE 'mixed' END AS text_layer
    FROM {CHUNKS} c LEFT JOIN {PAGES} p ON c.article_id = p.article_id AND p.page_number BETWEEN c.page_start AND c.page_end GROUP BY ALL""")
def chunk_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_layers(S.newest_chunks(spark, sf_dir, text=False), S.newest_pages(spark, sf_dir, text=False))


# ---------------------------------------------------------------------------------------- classification

_TAGGED: dict[tuple[str, str], list[str]] = {}
for _, _kind, _value, _pattern in R.rule_rows():
    _TAGGED.setdefault((_kind, _value), []).append(_pattern)
ARTICLE_TEXT = f"(SELECT article_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_index) AS text FROM {CHUNKS} GROUP BY article_id)"
_HITS = "SELECT article_id, tag_type, tag_value, hits FROM (" + " UNION ALL ".join(
    f"SELECT article_id, {q(kind)} AS tag_type, {q(value)} AS tag_value, " + " + ".join(f"regexp_matches(text, {q(re2(p))})::INT" for p in patterns) + " AS hits FROM article_text"
    for (kind, value), patterns in _TAGGED.items()) + ") WHERE hits > 0"
TAGS = f"WITH article_text AS MATERIALIZED {ARTICLE_TEXT} {_HITS}"


@query(TAGS)
def tag_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.tag_hits(S.newest_chunks(spark, sf_dir))


@query(f"SELECT article_id, tag_type, tag_value, round(least(1.0::DOUBLE, 0.55::DOUBLE + 0.15::DOUBLE * hits), 6) AS confidence, 'rule_based' AS source FROM ({TAGS})")
def tags_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.tags(S.newest_chunks(spark, sf_dir)).select("article_id", "tag_type", "tag_value", F.round("confidence", 6).alias("confidence"), "source")


_LINES = f"string_split_regex(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), {q(X.LINE_BREAK)})"
_KIND = f"""CASE WHEN regexp_matches(text, {q(re2(R.TABLE_MARK))}) THEN 'table' WHEN n >= 4 AND k >= 4 AND k::DOUBLE / n >= 0.35::DOUBLE THEN 'table'
    WHEN regexp_matches(text, {q('(?im)' + re2(R.CAPTION_MARK)[4:])}) THEN 'figure_caption' WHEN regexp_matches(text, {q(re2(R.METHOD_MARK))}) THEN 'method' ELSE 'main_text' END"""


@query(f"""WITH l AS (SELECT id, text, list_filter(list_transform({_LINES}, lambda x: {strip('x')}), lambda x: x <> '') AS lines FROM chunks),
    c AS (SELECT id, text, len(lines) AS n, len(list_filter(lines, lambda x: len(regexp_extract_all(x, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?')) >= 4 AND len(string_split_regex(x, {q(WS + '{2,}|' + chr(9) + '+')})) >= 4)) AS k FROM l)
    SELECT id, {_KIND} AS source_type FROM c""")
def source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(spark, sf_dir).select("id", classify.source_type(F.col("text")).alias("source_type"))


_HEADING = "CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(name, {q(re2(p))})" for p in ps) + f" THEN {q(k)}" for k, ps in R.SECTIONS.items()) + " END"
STARTS = f"""(WITH l AS (SELECT article_id, page_number, unnest(range(len({_LINES})))::INT AS line_no, unnest({_LINES}) AS line FROM {PAGES}),
    h AS (SELECT *, {norm('line')} AS name FROM l), f AS (SELECT *, {_HEADING} AS normalized_name FROM h WHERE length(name) <= 80)
    SELECT article_id, page_number, line_no, normalized_name, name FROM f WHERE normalized_name IS NOT NULL
    QUALIFY coalesce(lag(normalized_name) OVER (PARTITION BY article_id ORDER BY page_number, line_no) <> normalized_name, true))"""


@query(f"FROM {STARTS}")
def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.section_starts(S.newest_pages(spark, sf_dir))


SECTIONS = f"""(WITH b AS (SELECT article_id, min(page_number) AS f, max(page_number) AS l FROM {PAGES} GROUP BY article_id),
    s AS (SELECT *, row_number() OVER w - 1 AS no, lead(page_number) OVER w AS nx FROM {STARTS} WINDOW w AS (PARTITION BY article_id ORDER BY page_number, line_no))
    SELECT b.article_id, coalesce(no, 0)::INT AS section_no, coalesce(normalized_name, 'full_text') AS normalized_name, coalesce(name, 'Full text') AS name, coalesce(page_number, f) AS page_start,
    CASE WHEN page_number IS NULL THEN l ELSE greatest(page_number, CASE WHEN coalesce(nx, l) > page_number THEN coalesce(nx, l) - 1 ELSE coalesce(nx, l) END) END AS page_end, 'main_text' AS source_type
    FROM b LEFT JOIN s USING (article_id))"""


@query(f"FROM {SECTIONS}")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.sections(S.newest_pages(spark, sf_dir))


@query(f"""SELECT c.article_id, c.chunk_index, s.section_no FROM {CHUNKS} c LEFT JOIN {SECTIONS} s ON c.article_id = s.article_id AND c.page_start <= s.page_end AND c.page_end >= s.page_start
    QUALIFY row_number() OVER (PARTITION BY c.article_id, c.chunk_index ORDER BY least(c.page_end, s.page_end) - greatest(c.page_start, s.page_start) DESC NULLS LAST, s.page_start, s.section_no) = 1""")
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.chunk_sections(S.newest_chunks(spark, sf_dir, text=False), classify.sections(S.newest_pages(spark, sf_dir)))


@query(f"SELECT article_id, count(*) AS chunks, sum(length(coalesce(text, '')))::BIGINT + 2 * (count(*) - 1) AS n_chars FROM {CHUNKS} GROUP BY article_id")
def article_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each article's text as its tags see it, without putting it together."""
    return S.newest_chunks(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("chunks"), (F.sum(F.length(F.coalesce("text", F.lit("")))) + 2 * (F.count("*") - 1)).alias("n_chars"))


# --------------------------------------------------------------------------------------------- retrieval

def _terms_sql(text: str) -> str:
    words = f"list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_-]+'), lambda w: regexp_replace(regexp_replace(w, '^-+', ''), '-+$', ''))"
    return f"list_filter({words}, lambda w: length(w) >= 2 AND lower(w) NOT IN ({', '.join(map(q, X.STOPWORDS))}))"


_ASKED = "(SELECT qid, query, " + _terms_sql("query") + " AS terms FROM (VALUES " + ", ".join(f"({q(i)}, {q(t)})" for i, t, _, _ in QUESTIONS) + ") v(qid, query))"
_SCORE = """((CASE WHEN contains(lower(text), lower(query)) THEN 1000 ELSE 0 END) + coalesce(list_sum(list_transform(CASE WHEN len(terms) > 0 THEN terms ELSE [query] END, lambda t: length(lower(text)) - length(replace(lower(text), lower(t), '')))), 0))::DOUBLE"""
_MATCHES = "(contains(lower(text), lower(query)) OR len(list_filter(terms, lambda t: contains(lower(text), lower(t)))) > 0)"
_N = "trim(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), " + q(WS + "+") + ", ' ', 'g'))"
HITS = f"(SELECT a.qid, a.query, a.terms, c.id, c.article_id, c.chunk_index, c.page_start, c.page_end, c.text, {_SCORE} AS score FROM chunks c, {_ASKED} a WHERE {_MATCHES})"
RANKED = f"(SELECT h.*, r.title, r.doi, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_index, h.article_id, h.id) AS rank FROM {HITS} h JOIN articles r ON r.id = h.article_id)"
_SNIPPET = """CASE WHEN length(n) = 0 THEN '' WHEN hit IS NULL THEN trim(left(n, 280)) ELSE (CASE WHEN greatest(0, hit.p - 141) > 0 THEN '...' ELSE '' END)
    || trim(substring(n, greatest(0, hit.p - 141) + 1, least(length(n), hit.p - 1 + hit.l + 140) - greatest(0, hit.p - 141))) || (CASE WHEN least(length(n), hit.p - 1 + hit.l + 140) < length(n) THEN '...' ELSE '' END) END"""
FOUND = f"""(SELECT qid, query, rank::INT AS rank, article_id, id AS chunk_id, title, doi, chunk_index, page_start, page_end, {_SNIPPET} AS snippet, score, 'exact_ilike' AS retrieval_method
    FROM (SELECT *, {_N} AS n, list_filter(list_transform(list_concat([query], terms), lambda t: {{'p': strpos(lower({_N}), lower(t)), 'l': length(t)}}), lambda x: x.p > 0)[1] AS hit FROM {RANKED} WHERE rank <= {TOP_K}))"""


@query(f"SELECT qid, query, array_to_string(terms, '|') AS terms FROM {_ASKED}")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(i, t) for i, t, _, _ in QUESTIONS], "qid string, query string")
    return asked.select("qid", "query", F.array_join(X.query_terms(F.col("query")), "|").alias("terms"))


@query(f"FROM {FOUND}")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.batch_search(S.chunks(spark, sf_dir), S.articles(spark, sf_dir), [(i, t) for i, t, _, _ in QUESTIONS], TOP_K)


@query(f"SELECT qid, count(*) AS hits, sum((score >= 1000)::INT)::BIGINT AS with_phrase, max(score) AS best FROM {HITS} GROUP BY qid")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each question hits, over all chunks."""
    asked = F.array(*[F.struct(F.lit(i).alias("qid"), F.lit(t).alias("query")) for i, t, _, _ in QUESTIONS])
    tried = S.chunks(spark, sf_dir).select("text", F.explode(asked).alias("a")).select("text", "a.qid", "a.query", X.query_terms(F.col("a.query")).alias("terms"))
    hits = tried.where(X.matches(F.col("text"), F.col("query"), F.col("terms"))).select("qid", X.score(F.col("text"), F.col("query"), F.col("terms")).cast("double").alias("score"))
    return hits.groupBy("qid").agg(F.count("*").alias("hits"), F.sum((F.col("score") >= 1000).cast("long")).alias("with_phrase"), F.max("score").alias("best"))


def _single(name: str, qid: str) -> None:
    text = next(t for i, t, _, _ in QUESTIONS if i == qid)
    where = f"qid = {q(qid)}"
    inner = FOUND.replace(_ASKED, f"(FROM {_ASKED} WHERE {where})")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(S.chunks(spark, sf_dir), S.articles(spark, sf_dir), text, TOP_K)

    run.__name__ = name
    query(f"SELECT * EXCLUDE (qid, query, rank) FROM {inner}")(run)


_single("search_topk", "q2")
_single("search_phrase_bonus", "q4")
_single("search_no_terms", "q8")
_single("snippet", "q5")

_FIRST_COLLECTION = "(SELECT id FROM collections ORDER BY name LIMIT 1)"


@query(f"""SELECT article_id, id AS chunk_id, score FROM (SELECT h.*, row_number() OVER (ORDER BY score DESC, chunk_index, article_id, id) AS rank FROM {HITS} h
    WHERE qid = 'q4' AND article_id IN (SELECT id FROM articles WHERE collection_id = {_FIRST_COLLECTION})) WHERE rank <= {TOP_K}""")
def search_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in one collection, named."""
    collections = S.collections(spark, sf_dir)
    name = collections.agg(F.min("name")).collect()[0][0]
    articles = search.collection_articles(S.articles(spark, sf_dir), collections, name)
    return search.search(S.chunks(spark, sf_dir), articles, "in the third round", TOP_K).select("article_id", "chunk_id", "score")


_EXPECTED = "(VALUES " + ", ".join(f"({q(i)}, {d or '[]::VARCHAR[]'}, {k or '[]::VARCHAR[]'})" for i, _, d, k in QUESTIONS) + ") e(qid, dois, keywords)"
VERDICTS = f"""(WITH f AS MATERIALIZED {FOUND}, r AS (SELECT qid, list(lower(doi)) FILTER (doi <> '') AS got, lower(string_agg(snippet, chr(10) ORDER BY rank)) AS txt, count(*) AS n FROM f GROUP BY qid),
    m AS (SELECT e.qid, a.query, list_filter(e.dois, lambda d: NOT list_contains(coalesce(got, []::VARCHAR[]), lower(d))) AS md, list_filter(e.keywords, lambda k: NOT contains(coalesce(txt, ''), lower(k))) AS mk, coalesce(n, 0) AS result_count
    FROM {_EXPECTED} JOIN {_ASKED} a USING (qid) LEFT JOIN r USING (qid))
    SELECT qid, query, len(md) = 0 AND len(mk) = 0 AND result_count > 0 AS passed, array_to_string(md, '|') AS missing_dois, array_to_string(mk, '|') AS missing_keywords, result_count FROM m)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(QUESTIONS, "qid string, query string, expected_dois array<string>, expected_keywords array<string>")
    return search.evaluate(batch_search(spark, sf_dir), asked)


@query(f"FROM {VERDICTS}")
def eval_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).withColumn("missing_dois", F.array_join("missing_dois", "|")).withColumn("missing_keywords", F.array_join("missing_keywords", "|"))


@query(f"SELECT count(*) AS total, sum(passed::INT)::BIGINT AS passed, sum((NOT passed)::INT)::BIGINT AS failed, sum((result_count = 0)::INT)::BIGINT AS empty_result_queries FROM {VERDICTS}")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(_verdicts(spark, sf_dir))


# ----------------------------------------------------------------------------------------------- reports

@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("articles", "pages", "chunks", "page_text_layers")))
def dash_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(articles=S.articles(spark, sf_dir), pages=S.pages(spark, sf_dir), chunks=S.chunks(spark, sf_dir), page_text_layers=S.layers(spark, sf_dir))


@query("SELECT selected_text_layer, count(*) AS n FROM pages GROUP BY ALL")
def dash_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(S.pages(spark, sf_dir), "selected_text_layer")


@query("SELECT source_type, count(*) AS n FROM chunks GROUP BY ALL")
def dash_by_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(S.chunks(spark, sf_dir), "source_type")


@query("SELECT text_layer, count(*) AS n FROM chunks GROUP BY ALL")
def dash_by_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(S.chunks(spark, sf_dir), "text_layer")


def _counters_sql(table: str, column: str) -> str:
    return f"(SELECT article_id, string_agg({column} || '=' || n, ', ' ORDER BY {column}) AS c FROM (SELECT article_id, {column}, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY article_id)"


def _tags_sql(most: str = "") -> str:
    return f"(SELECT article_id, string_agg(tag_type || ': ' || v, '; ' ORDER BY tag_type) AS c FROM (SELECT article_id, tag_type, array_to_string(list_sort(list(DISTINCT tag_value)){most}, ', ') AS v FROM tags GROUP BY ALL) GROUP BY article_id)"


_WITH = f"WITH tags AS MATERIALIZED ({TAGS}), ch AS MATERIALIZED {CHUNKS}, pg AS MATERIALIZED {PAGES}"
_COUNT = "(SELECT article_id, count(*) AS c FROM {} GROUP BY ALL)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.tags(S.newest_chunks(spark, sf_dir))


@query(f"""{_WITH} SELECT a.id AS article_id, a.title, a.doi, coalesce(p.c, 0) AS page_count, coalesce(c.c, 0) AS chunk_count, coalesce(l.c, '') AS page_layers, coalesce(t.c, '') AS tags FROM articles a
    LEFT JOIN {_COUNT.format('pg')} p ON p.article_id = a.id LEFT JOIN {_COUNT.format('ch')} c ON c.article_id = a.id LEFT JOIN {_counters_sql('pg', 'selected_text_layer')} l ON l.article_id = a.id LEFT JOIN {_tags_sql('[1:6]')} t ON t.article_id = a.id""")
def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.article_list(S.articles(spark, sf_dir), S.newest_pages(spark, sf_dir, text=False), S.newest_chunks(spark, sf_dir, text=False), _tags(spark, sf_dir))


@query(f"WITH tags AS MATERIALIZED ({TAGS}) SELECT article_id, c AS tags FROM {_tags_sql('[1:6]')}")
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tag_lists(_tags(spark, sf_dir), 6)


@query(f"""{_WITH}, se AS MATERIALIZED {SECTIONS} SELECT a.id AS article_id, a.title, a.doi, coalesce(p.c, 0) AS page_count, coalesce(c.c, 0) AS chunk_count, coalesce(s.n, 0) AS section_count, coalesce(s.c, '') AS sections,
    coalesce(t.c, '') AS tags, coalesce(k.c, '') AS chunks_by_source_type, coalesce(y.c, '') AS chunks_by_text_layer, coalesce(l.c, '') AS pages_by_layer FROM articles a
    LEFT JOIN {_COUNT.format('pg')} p ON p.article_id = a.id LEFT JOIN {_COUNT.format('ch')} c ON c.article_id = a.id
    LEFT JOIN (SELECT article_id, count(*) AS n, string_agg(normalized_name || ' ' || page_start || '-' || page_end, '; ' ORDER BY page_start, normalized_name, section_no) AS c FROM se GROUP BY article_id) s ON s.article_id = a.id
    LEFT JOIN {_tags_sql()} t ON t.article_id = a.id LEFT JOIN {_counters_sql('ch', 'source_type')} k ON k.article_id = a.id LEFT JOIN {_counters_sql('ch', 'text_layer')} y ON y.article_id = a.id
    LEFT JOIN {_counters_sql('pg', 'selected_text_layer')} l ON l.article_id = a.id""")
def report_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = classify.sections(S.newest_pages(spark, sf_dir))
    return reports.article_report(S.articles(spark, sf_dir), S.newest_pages(spark, sf_dir, text=False), S.newest_chunks(spark, sf_dir, text=False), _tags(spark, sf_dir), sections)


_OF = "JOIN articles a ON a.id = x.article_id GROUP BY ALL"


@query(f"""{_WITH}, se AS MATERIALIZED {SECTIONS}
    SELECT collection_id, 'articles' AS metric, 'all' AS name, count(*) AS n FROM articles GROUP BY ALL
    UNION ALL SELECT a.collection_id, 'tags', x.tag_type, count(*) FROM (SELECT DISTINCT article_id, tag_type, tag_value FROM tags) x {_OF}
    UNION ALL SELECT a.collection_id, 'chunks by source type', x.source_type, count(*) FROM ch x {_OF} UNION ALL SELECT a.collection_id, 'chunks by text layer', x.text_layer, count(*) FROM ch x {_OF}
    UNION ALL SELECT a.collection_id, 'sections', coalesce(nullif(x.normalized_name, ''), 'unknown'), count(*) FROM se x {_OF}""")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All collections at once."""
    return reports.collection_report(S.articles(spark, sf_dir), S.newest_chunks(spark, sf_dir, text=False), _tags(spark, sf_dir), classify.sections(S.newest_pages(spark, sf_dir)))


# --------------------------------------------------------------------------------------------- ingestion

@query("SELECT count(*) AS total, sum((status = 'indexed')::INT)::BIGINT AS indexed, sum((status = 'failed')::INT)::BIGINT AS failed, sum((status = 'processing')::INT)::BIGINT AS processing, count(DISTINCT input_path) AS distinct_inputs FROM ingestion_jobs")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.job_summary(S.jobs(spark, sf_dir))


@query("SELECT input_path, arg_max(status, {'c': coalesce(created_at, TIMESTAMP '0001-01-01'), 'i': id}) AS status, count(*) AS attempts, sum((status = 'failed')::INT)::BIGINT AS failures FROM ingestion_jobs GROUP BY input_path")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_jobs(S.jobs(spark, sf_dir))


@query("SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def checksum_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_by_content(S.documents(spark, sf_dir), "text", "doc_id")


_FIRST = """(SELECT article_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_number) AS t FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY page_number) AS pos FROM {}) WHERE pos <= 3 GROUP BY article_id)"""
_KIND_LAYERS = [newest("page_text_layers", "article_id, page_number", where=f"layer_type = '{k}'") for k in ("original", "ocr")]


@query(f"""SELECT article_id, CASE WHEN d <> '' THEN lower(regexp_replace(d, '[.,;]+$', '')) END AS doi FROM (SELECT article_id, regexp_extract(CASE WHEN {norm("coalesce(o.t, '')")} <> '' THEN o.t ELSE coalesce(s.t, '') END,
    '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b') AS d FROM {_FIRST.format(_KIND_LAYERS[0])} o FULL JOIN {_FIRST.format(_KIND_LAYERS[1])} s USING (article_id))""")
def first_pages_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [keys.newest(S.layers(spark, sf_dir).where(F.col("layer_type") == k).select("id", "article_id", "page_number", "text", "created_at"), ["article_id", "page_number"]) for k in ("original", "ocr")]
    return ingest.first_doi(*kinds)


@query("""WITH new AS (SELECT * FROM page_text_layers WHERE layer_type = 'ocr')
    SELECT id, article_id, page_number, layer_type, md5(text) AS digest FROM (SELECT * FROM page_text_layers o WHERE NOT EXISTS (FROM new n WHERE n.article_id = o.article_id AND n.page_number = o.page_number)
    UNION ALL FROM new)""")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages delivered again as OCR layers take the place of all layers of theirs."""
    old = S.layers(spark, sf_dir)
    return keys.replace_by_key(old, old.where("layer_type = 'ocr'"), ["article_id", "page_number"]).select("id", "article_id", "page_number", "layer_type", F.md5("text").alias("digest"))


@query(f"SELECT id, article_id, page_number, layer_type FROM {LAYERS}")
def newest_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.layers(spark, sf_dir).where(F.col("layer_type").isin("original", "ocr")).select("id", "article_id", "page_number", "layer_type", "created_at")
    return keys.newest(rows, ["article_id", "page_number", "layer_type"]).drop("created_at")


@query("""SELECT checksum_sha256, coalesce(nullif(a.doi, ''), 'added') AS doi, CASE WHEN n.c IS NULL THEN a.status ELSE 'indexed' END AS status, coalesce(n.c, a.collection_id) AS collection_id
    FROM articles a LEFT JOIN (SELECT checksum_sha256, 'moved' AS c FROM articles WHERE status = 'needs_review') n USING (checksum_sha256)""".replace("coalesce(nullif(a.doi, ''), 'added')", "coalesce(nullif(a.doi, ''), CASE WHEN n.c IS NULL THEN NULL ELSE 'added' END)"))
def article_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles to be reviewed come again, indexed and in another collection."""
    old = S.articles(spark, sf_dir).select("id", "collection_id", "title", "doi", "pdf_original_path", "pdf_ocr_path", "checksum_sha256", "status", "indexed_at", "updated_at")
    new = old.where("status = 'needs_review'").select("checksum_sha256", F.lit("moved").alias("collection_id"), F.lit("added").alias("doi"), F.lit("indexed").alias("status"))
    return ingest.upsert_articles(old, new).select("checksum_sha256", "doi", "status", "collection_id")


_KEYED = {"articles": "checksum_sha256", "pages": "article_id, page_number", "chunks": "article_id, chunk_index", "page_text_layers": "article_id, page_number, layer_type"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in _KEYED.items()))
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_violations({t: (S.table(spark, sf_dir, t), k.split(", ")) for t, k in _KEYED.items()})


@query("""SELECT a.id, (SELECT count(*) FROM pages p WHERE p.article_id = a.id) AS pages, (SELECT count(*) FROM chunks c WHERE c.article_id = a.id) AS chunks FROM articles a""")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a duplicate answers with: the pages and chunks its article has."""
    n_pages = S.pages(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("p"))
    n_chunks = S.chunks(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("c"))
    found = reduce(lambda a, b: a.join(b, a["id"] == b["article_id"], "left").drop("article_id"), (n_pages, n_chunks), S.articles(spark, sf_dir).select("id"))
    return found.select("id", F.coalesce("p", F.lit(0)).alias("pages"), F.coalesce("c", F.lit(0)).alias("chunks"))


_ORIGINAL, _OCR = (newest("page_text_layers", "article_id, page_number", where=f"layer_type = '{k}'") for k in ("original", "ocr"))


def _usable_sql(rows: str) -> str:
    return f"(SELECT article_id, count(*) AS pages, sum({USABLE}::INT) >= greatest(1, count(*) // 2) AS ok FROM (SELECT article_id, {COUNTS} FROM (SELECT article_id, {norm("coalesce(text, '')")} AS n FROM {rows})) GROUP BY article_id)"


@query(f"""WITH o AS {_usable_sql(_ORIGINAL)}, s AS {_usable_sql(_OCR)}, b AS (SELECT article_id, count(DISTINCT page_number) AS pages FROM page_text_layers WHERE layer_type IN ('original', 'ocr') GROUP BY article_id),
    p AS (SELECT article_id, count(*) AS pages FROM pages GROUP BY article_id), k AS (SELECT *, status = 'indexed' AS known FROM articles)
    SELECT k.checksum_sha256, CASE WHEN known THEN 'duplicate' WHEN o.ok OR coalesce(s.ok, false) THEN 'indexed' ELSE 'failed' END AS status, NOT known AND NOT o.ok AS ocr_required,
        CASE WHEN known THEN coalesce(p.pages, 0) WHEN o.ok THEN o.pages WHEN coalesce(s.ok, false) THEN b.pages ELSE 0 END AS page_count
    FROM k JOIN o ON o.article_id = k.id JOIN b ON b.article_id = k.id LEFT JOIN s ON s.article_id = k.id LEFT JOIN p ON p.article_id = k.id""")
def ingest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored layers come as files once more: those of indexed articles are duplicates, the others are ingested, their OCR layers being what OCR reads."""
    articles = S.articles(spark, sf_dir)
    about = articles.select(F.col("id").alias("article_id"), "checksum_sha256", F.col("pdf_original_path").alias("path"))

    def rows(kind: str) -> DataFrame:
        newest_ = keys.newest(S.layers(spark, sf_dir).where(F.col("layer_type") == kind).select("id", "article_id", "page_number", "text", "created_at"), ["article_id", "page_number"])
        return newest_.join(about, "article_id").select("path", "checksum_sha256", F.col("path").alias("stored_path"), "page_number", "text", F.lit(None).cast("string").alias("error"))

    def ocr(needed: DataFrame) -> DataFrame:
        return needed.select("checksum_sha256").join(rows("ocr"), "checksum_sha256").withColumn("ocr_path", F.col("path"))

    counts = S.pages(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("page_count")).withColumn("chunk_count", F.lit(0).cast("bigint"))
    made = ingest.ingest(rows("original"), articles.where("status = 'indexed'"), "literature", Settings(), ocr, counts=counts)
    return made.results.select("checksum_sha256", "status", "ocr_required", "page_count")


@query("SELECT id AS article_id, title FROM articles")
def articles_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of articles: by title, those without one last."""
    return S.articles(spark, sf_dir).select("id", "title").orderBy(*reports.by_title()).withColumnRenamed("id", "article_id")


@query(f"SELECT article_id, page_number, layer_type, id FROM {LAYERS}")
def layers_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of layers: by article, page and type."""
    return newest_layers(spark, sf_dir).select("article_id", "page_number", "layer_type", "id").orderBy("article_id", "page_number", "layer_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
