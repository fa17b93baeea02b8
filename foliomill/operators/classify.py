"""Tags, kinds of chunks, sections, and the section a chunk belongs to; all by rule tables."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import rules as R
from foliomill.functions import text as X
from foliomill.operators.keys import previous_value
from foliomill.sources.staging import stored

#: Letters that match others when case doesn't count, and what they match, so that literals are looked for like patterns.
ODD_CASE = ("ſıİK", "siik")


def unicode_spaces(pattern: str) -> str:
    """The pattern with white space as everywhere here."""
    return pattern.replace(r"\s", X.WS)


def needed(pattern: str) -> str:
    """The longest run of letters that every match of a pattern must have, in lower case; "" if there is none for sure."""
    if "|" in re.sub(r"\(\?:[^()]*\)", "", pattern):
        return ""
    plain = re.sub(r"\\[A-Za-z]|\\.|\[[^]]*\]", "\0", re.sub(r"\(\?:[^()]*\)[?*]?", "\0", pattern))
    plain = re.sub(r".[?*{]", "\0", plain)
    return max(re.findall("[A-Za-z]+", plain), key=len, default="").lower()


def folded(c: Column) -> Column:
    """Text in lower case for literals of patterns."""
    return F.lower(F.translate(c, *ODD_CASE))


def spelled_out(pattern: str) -> list[str]:
    """The pattern without alternatives that hold white space: one pattern for each of them."""
    for group in re.finditer(r"\(\?:([^()]*)\)(?![?*+{])", pattern):
        if r"\s" in group.group(1):
            return [p for part in group.group(1).split("|") for p in spelled_out(pattern[:group.start()] + part + pattern[group.end():])]
    return [pattern]


def segments(pattern: str) -> list[str]:
    """The parts of a pattern (even places) and the runs of white space between them, which alone can hold a line break: there a match
    may go on in the next chunk."""
    return re.split(r"(\\s[*+])", pattern)


def _found(text: Column, low: Column, pattern: str) -> Column:
    literal = needed(pattern)
    found = text.rlike(R.FLAGS + unicode_spaces(pattern))
    return F.contains(low, F.lit(literal)) & found if literal else found


def _opening(part: str) -> str:
    """Letters and digits that a text matching a pattern must begin with, in lower case; "" if there are none for sure."""
    found = re.match(r"(?:\\b)?([A-Za-z0-9]+)(.?)", part)
    return (found.group(1)[:-1] if found.group(2) in set("?*{") else found.group(1)).lower() if found else ""


def _closing(part: str) -> str:
    """Letters and digits that a text matching a pattern must end with, in lower case; "" if there are none for sure."""
    found = re.search(r"(\\?)([A-Za-z0-9]+)$", part.removesuffix(r"\b"))
    return found.group(2)[bool(found.group(1)):].lower() if found else ""


def _ids(flags: dict[int, Column]) -> Column:
    """The numbers whose condition holds."""
    if not flags:
        return F.array().cast("array<int>")
    return F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in flags.items()]), lambda i: i.isNotNull())


@functools.lru_cache(maxsize=8)
def _inside(rules: tuple[tuple, ...]) -> Column:
    """The numbers of the patterns that match ``text`` (with ``low``, its folded form)."""
    return _ids({i: _found(F.col("text"), F.col("low"), pattern) for i, _, _, pattern in rules})


@dataclass(frozen=True)
class Cuts:
    """Patterns cut at white space, over ``text`` and its folded form without white space at the start (``head``) and end (``tail``):
    numbers of the cuts that the text ends or begins with, and of the middles it is; the rule of each cut; from which cut to which a
    middle leads; the most cuts of a pattern."""

    ends: Column
    begins: Column
    middles: Column
    rule_of: tuple[int, ...]
    moves: tuple[tuple[int, int], ...]
    deepest: int


@functools.lru_cache(maxsize=8)
def _cuts(rules: tuple[tuple, ...]) -> Cuts:
    ends: dict[int, Column] = {}
    begins: dict[int, Column] = {}
    middles: dict[int, Column] = {}
    rule_of: list[int] = []
    moves: list[tuple[int, int]] = []
    deepest = 0

    def matched(pattern: str, first: str | None, last: str | None) -> Column:
        tests = [F.col("text").rlike(R.FLAGS + unicode_spaces(pattern))]
        if last:
            tests.insert(0, F.col("tail").endswith(last))
        if first:
            tests.insert(0, F.col("head").startswith(first))
        return reduce(lambda a, b: a & b, tests)

    for rule, _, _, pattern in rules:
        for one in spelled_out(pattern):
            parts = segments(one)
            base, n = len(rule_of), len(parts) // 2
            deepest = max(deepest, n)
            for cut in range(1, n + 1):
                before, behind = "".join(parts[:2 * cut - 1]), "".join(parts[2 * cut:])
                ends[len(rule_of)] = matched(before + r"\s*\z", None, _closing(before))
                begins[len(rule_of)] = matched(r"\A\s*" + behind, _opening(behind), None)
                rule_of.append(rule)
            for cut in range(1, n):
                for to in range(cut + 1, n + 1):
                    middle = "".join(parts[2 * cut:2 * to - 1])
                    middles[len(moves)] = matched(r"\A\s*" + middle + r"\s*\z", _opening(middle), _closing(middle))
                    moves.append((base + cut - 1, base + to - 1))
    return Cuts(_ids(ends), _ids(begins), _ids(middles), tuple(rule_of), tuple(moves), deepest)


def _within(chunks: DataFrame, rules: tuple[tuple, ...]) -> DataFrame:
    """``article_id, rule`` of matches inside a chunk."""
    tried = chunks.select("article_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", folded(F.col("text")))
    return tried.select("article_id", F.explode(_inside(rules)).alias("rule"))


def _across(chunks: DataFrame, rules: tuple[tuple, ...]) -> DataFrame:
    """``article_id, rule`` of matches that begin in one chunk and end in a later one.

    Such a match is cut by the white space between chunks, so each chunk tells, for every place a pattern may be cut at, whether
    it ends with what stands before the cut, begins with what stands behind it, or (for patterns with several) is just what
    stands between two. Only these numbers meet, over the few chunks before; a text is never put together, and no
    part of a pattern is bounded in length. Blank chunks are white space and drop out.
    """
    cuts = _cuts(rules)
    if not cuts.rule_of:
        return chunks.select("article_id", F.lit(0).alias("rule")).limit(0)
    inked = chunks.select("article_id", "chunk_index", "text", folded(F.col("text")).alias("low")).withColumns(
        {"head": F.regexp_replace("low", rf"\A{X.WS}+", ""), "tail": F.regexp_replace("low", rf"{X.WS}+\z", "")}).where(F.col("head") != "")
    rows = inked.select("article_id", "chunk_index", cuts.ends.alias("ends"), cuts.begins.alias("begins"), cuts.middles.alias("middles"))
    none = F.array().cast("array<int>")
    rows = stored(rows).withColumn("open", none)  # a few numbers a chunk, read again for each step
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cuts.moves]) if cuts.moves else None
    for turn in range(cuts.deepest):
        # cuts that are open behind a chunk: its own ends, and those of the chunk before that a middle carries on
        carried = F.col("ends")
        if turn and moves is not None:
            led = F.filter(F.transform("middles", lambda m: F.element_at(moves, m + 1)), lambda s: F.array_contains("open", s["a"]))
            carried = F.array_union("ends", F.transform(led, lambda s: s["b"]))
        rows = previous_value(rows, "article_id", "chunk_index", carried, "before").withColumn("open", F.coalesce("before", none)).drop("before")
    met = rows.select("article_id", F.explode(F.array_intersect("open", "begins")).alias("cut"))
    numbers = F.array(*[F.lit(i) for i in cuts.rule_of])
    return met.select("article_id", F.element_at(numbers, F.col("cut") + 1).alias("rule"))


def tag_hits(chunks: DataFrame, terms: dict[str, dict[str, list[str]]] = R.TERMS) -> DataFrame:
    """``article_id, tag_type, tag_value, hits``: how many of a tag's patterns match the article's text, its chunks joined
    by blank lines in order (``article_id, chunk_index, text``, one row an index).

    The text is never put together: each chunk is matched by itself, and what goes on in the next chunk by numbers of cut
    patterns. All patterns are tested in one pass, each only where a literal it needs is in the text; what is shuffled are numbers.
    Null texts count as empty.
    """
    rules = tuple(R.rule_rows(terms))
    ids = _within(chunks, rules).union(_across(chunks, rules)).distinct()
    names = F.array(*[F.struct(F.lit(kind).alias("tag_type"), F.lit(value).alias("tag_value")) for _, kind, value, _ in rules])
    named = ids.withColumn("tag", F.element_at(names, F.col("rule") + 1))
    return named.groupBy("article_id", F.col("tag.tag_type").alias("tag_type"), F.col("tag.tag_value").alias("tag_value")).agg(F.count("*").cast("int").alias("hits"))


def tags(chunks: DataFrame, terms: dict[str, dict[str, list[str]]] = R.TERMS) -> DataFrame:
    """tag_hits with the confidence of each tag and its source."""
    confidence = F.least(F.lit(1.0), F.lit(R.BASE_CONFIDENCE) + F.lit(R.CONFIDENCE_STEP) * F.col("hits"))
    return tag_hits(chunks, terms).withColumn("confidence", confidence).withColumn("source", F.lit("rule_based"))


def source_type(text: Column) -> Column:
    """table, figure_caption, method or main_text."""
    compact = F.filter(F.transform(X.lines(text), X.strip), lambda x: x != "")
    rows = F.filter(compact, lambda x: (F.regexp_count(x, F.lit(r"\d+(?:\.\d+)?")) >= 4) & (F.size(F.split(x, f"{X.WS}{{2,}}|\\t+")) >= 4))
    n, k = F.size(compact), F.size(rows)
    return (
        F.when(text.rlike(R.FLAGS + unicode_spaces(R.TABLE_MARK)), "table")
        .when((n >= 4) & (k >= 4) & (k / F.greatest(n, F.lit(1)) >= F.lit(0.35)), "table")
        .when(text.rlike(R.FLAGS + unicode_spaces(R.CAPTION_MARK)), "figure_caption")
        .when(text.rlike(R.FLAGS + unicode_spaces(R.METHOD_MARK)), "method").otherwise("main_text")
    )


def section_starts(pages: DataFrame, headings: dict[str, list[str]] = R.SECTIONS) -> DataFrame:
    """``article_id, page_number, line_no, normalized_name, name``: heading lines, repeats of the heading just before left
    out. Only heading lines (a few an article, without texts) reach the window."""
    exploded = pages.select("article_id", "page_number", F.posexplode(X.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line")).withColumn("name", X.normalize(F.col("line")))
    kind = F.lit(None).cast("string")
    for normalized, patterns in reversed(headings.items()):
        kind = F.when(reduce(lambda a, b: a | b, [F.col("name").rlike(R.FLAGS + unicode_spaces(p)) for p in patterns]), normalized).otherwise(kind)
    found = exploded.where(F.length("name") <= R.HEADING_CHARS).withColumn("normalized_name", kind).where("normalized_name is not null")
    order = Window.partitionBy("article_id").orderBy("page_number", "line_no")
    return found.withColumn("__before", F.lag("normalized_name").over(order)).where("__before is null or __before <> normalized_name").select("article_id", "page_number", "line_no", "normalized_name", "name")


def sections(pages: DataFrame, headings: dict[str, list[str]] = R.SECTIONS) -> DataFrame:
    """``article_id, section_no, normalized_name, name, page_start, page_end, source_type``.

    A section ends on the page before the next one's start, the last on the page before the article's last unless it starts there.
    An article without headings is one section "Full text"; without pages it has none.
    """
    starts = section_starts(pages, headings)
    bounds = pages.groupBy("article_id").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    order = Window.partitionBy("article_id").orderBy("page_number", "line_no")
    numbered = starts.withColumn("section_no", F.row_number().over(order) - 1).withColumn("next_page", F.lead("page_number").over(order))
    following = F.coalesce("next_page", "last_page")
    cut = bounds.join(numbered, "article_id", "left")
    return cut.select(
        "article_id", F.coalesce("section_no", F.lit(0)).alias("section_no"), F.coalesce("normalized_name", F.lit("full_text")).alias("normalized_name"), F.coalesce("name", F.lit("Full text")).alias("name"),
        F.coalesce("page_number", "first_page").alias("page_start"),
        F.when(F.col("page_number").isNull(), F.col("last_page")).otherwise(F.greatest("page_number", F.when(following > F.col("page_number"), following - 1).otherwise(following))).alias("page_end"),
        F.lit("main_text").alias("source_type"),
    )


def chunk_sections(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``article_id, chunk_index, section_no``: the section that shares most pages with a chunk, the first of equals by its
    start; null for none. Takes one row a chunk and the columns page_start, page_end of both. Chunks and sections meet page by page, so
    an article of any length joins evenly."""
    c = chunks.select("article_id", "chunk_index", F.col("page_start").alias("cs"), F.col("page_end").alias("ce"))
    s = found.where("page_start is not null and page_end is not null").select("article_id", "section_no", F.col("page_start").alias("ss"), F.col("page_end").alias("se"))
    asked = c.where("cs is not null and ce is not null").withColumn("page", F.explode(F.sequence(F.least("cs", "ce"), F.greatest("cs", "ce"))))
    there = s.where("ss <= se").withColumn("page", F.explode(F.sequence("ss", "se")))
    shared = F.least("ce", "se") - F.greatest("cs", "ss")
    best = F.max(F.struct(shared.alias("shared"), (-F.col("ss")).alias("start"), (-F.col("section_no")).alias("no")))
    met = asked.join(there, ["article_id", "page"]).where("cs <= se and ce >= ss").groupBy("article_id", "chunk_index").agg(best.alias("best"))
    return c.select("article_id", "chunk_index").join(met, ["article_id", "chunk_index"], "left").select("article_id", "chunk_index", (-F.col("best.no")).alias("section_no"))
