"""Splitting oversized texts at natural boundaries (problem 7).

Agglomerative merging: a text is cut into atomic segments at every boundary there
is, adjacent pairs wait in a heap ordered by the strength of the boundary between
them, and the weakest is merged first as long as the result, with the overlap in
front of it, stays within the limit. What is left are the strongest boundaries
that can be kept.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrays import map_arrow
from foliomill.llm.tokenize import _arrow_type

LIMIT = 4500
OVERLAP = 600
#: An overlap may start up to this many characters later, to start at a boundary.
SLACK = 120
HEAD = 80

# strengths of boundaries: paragraph, line after a sentence, sentence, line or clause, word
_BOUNDARY = re.compile(
    r"(?P<p>\n[^\S\n]*\n\s*|\n(?=[ \t　]{2,}))|(?P<l>(?<=[.!?…。！？\"”»」)])[^\S\n]*\n)"
    r"|(?P<s>[.!?…][\"”»')\]]*\s+|[。！？][”」』）]*)|(?P<c>\n|[,;:]\s+|[，、；：])|(?P<w>\s+)")
_STRENGTH = {"p": 4.0, "l": 3.0, "s": 2.0, "c": 1.0, "w": 0.5}


def boundaries(text: str) -> list[tuple[int, float]]:
    """(offset, strength) of all places where a piece may start, white space before it belonging to the left."""
    return [(m.end(), _STRENGTH[m.lastgroup]) for m in _BOUNDARY.finditer(text) if 0 < m.end() < len(text)]


def _atoms(text: str, most: int, found: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Starts of atomic segments, each with the strength of the boundary before it: sentences, cut
    further at weaker boundaries or, for want of any, anywhere, where they are too long."""
    starts = [(0, 9.0)]
    weak: list[tuple[int, float]] = []

    def fill(end: int) -> None:
        while end - starts[-1][0] > most:
            at = starts[-1][0]
            near = [b for b in weak if at < b[0] <= at + most]
            if near:
                top = max(s for _, s in near)
                starts.append(max(b for b in near if b[1] == top))
            else:
                starts.append((at + most, 0.0))

    for offset, strength in found:
        if strength >= 2:
            fill(offset)
            starts.append((offset, strength))
            weak.clear()
        else:
            weak.append((offset, strength))
    fill(len(text))
    return starts


def segments(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of the pieces of a text; one piece if it is within the limit."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    found = boundaries(text)
    room = limit - overlap
    atoms = _atoms(text, room, found)
    begin = [a for a, _ in atoms]
    finish = [*begin[1:], len(text)]
    strength = [s for _, s in atoms]  # of the boundary before the segment
    after = [*range(1, len(begin)), -1]
    before = [-1, *range(len(begin) - 1)]
    alive = [True] * len(begin)
    heap = [(strength[i + 1], finish[i + 1] - begin[i], i, i + 1, finish[i + 1]) for i in range(len(begin) - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, end = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or finish[j] != end or finish[j] - begin[i] != size:
            continue
        if size > (limit if begin[i] == 0 else room):
            continue
        finish[i] = finish[j]
        after[i] = after[j]
        alive[j] = False
        if after[j] >= 0:
            before[after[j]] = i
            k = after[j]
            heapq.heappush(heap, (strength[k], finish[k] - begin[i], i, k, finish[k]))
        if before[i] >= 0:
            h = before[i]
            heapq.heappush(heap, (strength[i], finish[i] - begin[h], h, i, finish[i]))
    out: list[tuple[int, int, int]] = []
    for i in range(len(begin)):
        if alive[i]:
            start = begin[i]
            if start and overlap:
                lowest = max(out[-1][0], start - overlap)
                near = [b for b in found if lowest <= b[0] <= min(lowest + SLACK, start - 1)]
                lowest = max(near, key=lambda b: (b[1], -b[0]))[0] if near else lowest
            else:
                lowest = start
            out.append((lowest, start, finish[i]))
    return out


def _page_starts(text: str, pages: list[dict]) -> list[tuple[int, int]]:
    """(offset, page_number) of the pages found in the text, in order. A page cut short or blank may be missing."""
    at, out = 0, []
    for p in pages:
        head = (p["head"] or "").strip()
        if not head:
            continue
        found = text.find(head, at)
        if found < 0 and len(text) - at < len(head):
            found = at if head.startswith(text[at:].strip()) and text[at:].strip() else -1
        if found < 0:
            continue
        out.append((found, p["page_number"]))
        at = found + max(1, min(p["length"], len(text) - found) - 1)
    return out


def pieces(chunks: DataFrame, pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``article_id, chunk_index, piece, page_start, page_end, char_start, overlap_chars, char_count, text``.

    A text within the limit is one piece as it is; char_count is the real length whatever the table says. A longer one is cut into
    pieces of at most ``limit`` characters, each but the first repeating ``overlap`` characters at most (fewer by up to SLACK to
    start at a boundary) of the one before. Pages of a piece are those its characters stand on, found by the pages' own texts; the first
    piece starts with the chunk's first page and the last ends with its last (which may be blank), and where no page is found those of the chunk hold. Null texts give no pieces; an empty text is one empty piece. Chunks ask for their pages by number,
    so an article with very many pages makes no large group.
    """
    given = chunks.select("article_id", "chunk_index", "page_start", "page_end", "text").where("text is not null")
    long = given.where(F.length("text") > limit)
    asked = long.where("page_start <= page_end").select("article_id", "chunk_index", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    # a page delivered twice counts once
    heads = pages.where("text is not null").select("article_id", "page_number", F.length("text").alias("length"), F.substring(F.ltrim("text"), 1, HEAD).alias("head")).groupBy("article_id", "page_number").agg(
        F.min(F.struct("length", "head")).alias("p"))
    listed = asked.join(heads, ["article_id", "page_number"]).groupBy("article_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("page_number", F.col("p.length").alias("length"), F.col("p.head").alias("head")))).alias("pages"))
    both = given.join(listed, ["article_id", "chunk_index"], "left")
    kinds = {f.name: f.dataType for f in given.schema}
    schema = (f"article_id {kinds['article_id'].simpleString()}, chunk_index {kinds['chunk_index'].simpleString()}, piece int, page_start int, page_end int, "
              "char_start int, overlap_chars int, char_count int, text string")

    def run(columns: dict) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        for article, index, first, last, text, found in zip(*(columns[c] for c in ("article_id", "chunk_index", "page_start", "page_end", "text", "pages"))):
            starts = _page_starts(text, found or []) if len(text) > limit else []
            cut = segments(text, limit, overlap)
            for n, (low, start, end) in enumerate(cut):
                here = [p for o, p in starts if o < end]
                begun = [p for o, p in starts if o <= low]
                values = (article, index, n, begun[-1] if begun and n else first, last if n == len(cut) - 1 or not starts else here[-1] if here else first, low, start - low, end - low, text[low:end])
                for column, v in zip(out, values):
                    column.append(v)
        types = [_arrow_type(kinds["article_id"]), _arrow_type(kinds["chunk_index"]), *[pa.int32()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["article_id", "chunk_index", "piece", "page_start", "page_end", "char_start", "overlap_chars", "char_count", "text"])

    return both.mapInArrow(map_arrow(run), schema)
