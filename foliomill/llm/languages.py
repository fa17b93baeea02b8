"""Languages of documents and of their segments (problem 5).

Prediction by partial matching: each language has a tree of byte contexts of
variable order, and a text costs in each language the bits that its bytes take
under the frozen counts, escapes to shorter contexts included. Contexts don't
reach over the borders of words (in scripts without spaces: over two characters),
so a word always costs the same and every distinct word is coded once per worker;
costs of lines are sums by word. Lines are joined to segments of one language by
dynamic programming with a price on every change.

The trees are trained here on pages whose articles carry a label, in rounds: the
first uses the labels as they are, the next what the trees themselves say of each
line, so that wrong labels and foreign passages leave the training text.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm import arrays as A
from foliomill.llm.common import sampled, stored
from foliomill.llm.tokenize import _arrow_type

# The codes and names of the languages in use (ISO 639 and plain names).
SPELLINGS = {
    "en": ["en", "eng", "english"],
    "ru": ["ru", "rus", "russian", "русский"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français"],
    "es": ["es", "spa", "spanish", "español", "castellano"],
    "zh": ["zh", "zho", "chi", "chinese", "cn", "中文"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語"],
}
LANGUAGES = list(SPELLINGS)
ORDER = 5
#: Most pages the trees are trained on, and characters used of each, in training only.
TRAINING_PAGES = 1400
TRAINING_CHARS = 3000
ROUNDS = 3
#: Bits a change of language must save, and bits by which a line or segment must be cheaper to be sure.
CHANGE_BITS = 30.0
SURE_BITS = 12.0
#: A segment counts as a whole paragraph from so many letters on; those of scripts without spaces count three.
SEGMENT_LETTERS = 45
#: Bits a letter up to which a segment is running text of its language: lists of names, figures and
#: garbled characters cost more in every language.
TEXT_BITS = 2.75
CACHE_UNITS = 300_000

#: Scripts of letters, and the one that each language is written in.
LATIN, CYRILLIC, WIDE = range(3)
SCRIPT_OF = np.array([CYRILLIC if code == "ru" else WIDE if code in ("zh", "ja") else LATIN for code in LANGUAGES])
#: A segment counts as sentences of a language if so much of its letters is in that language's script.
OWN_SCRIPT = 0.5

_END = np.zeros(A.TABLE_SIZE, bool)
_END[[ord(c) for c in ".!?…"]] = True
_WIDE_END = np.zeros(A.TABLE_SIZE, bool)
_WIDE_END[[ord(c) for c in "。！？"]] = True


def label_of(column: Column) -> Column:
    """The language a label names, or null: regions and spellings are ignored."""
    first = F.regexp_extract(F.lower(F.trim(column)), r"^([^-_\s(]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(first.isin(names), code).otherwise(out)
    return out


class Tree:
    """Contexts of one language, with the bytes seen in each; frozen, with their code lengths."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, dict[int, float]] = {}

    def add(self, context: bytes, unit: bytes, times: int) -> None:
        whole = context + unit
        nodes = self.nodes
        for i in range(len(context), len(whole)):
            c = whole[i]
            for order in range(min(ORDER, i) + 1):
                node = nodes.setdefault(whole[i - order:i], {})
                node[c] = node.get(c, 0) + times

    def freeze(self) -> "Tree":
        """Counts become bits: a byte's share, or that of escapes (as many as there are different
        bytes, under -1)."""
        for node in self.nodes.values():
            total = sum(node.values()) + len(node)
            escape = log2(total / len(node))
            for c, n in node.items():
                node[c] = log2(total / n)
            node[-1] = escape
        return self

    def bits(self, context: bytes, c: int) -> float:
        """Code length of a byte behind a context: escapes to shorter contexts until one knows the byte;
        256 equal bytes at the end."""
        nodes, cost = self.nodes, 0.0
        for start in range(len(context) + 1):
            node = nodes.get(context[start:])
            if node is not None:
                known = node.get(c)
                if known is not None:
                    return cost + known
                cost += node[-1]
        return cost + 8.0


class Units:
    """The units of a batch: words, and characters of scripts without spaces with the one before."""

    def __init__(self, texts: list[str]):
        self.batch = batch = A.TextBatch(texts)
        codes, classes = batch.lower, batch.classes
        self.wide = (classes == A.HAN) | (classes == A.KANA)
        letters = (classes == A.LATIN) | (classes == A.CYRILLIC) | (classes == A.GREEK) | (classes == A.LETTER) | (classes == A.MARK)
        starts, ends = A.runs(letters)
        at = np.flatnonzero(self.wide)
        before = np.where((at > 0) & self.wide[np.maximum(at - 1, 0)], codes[np.maximum(at - 1, 0)], 32).astype(np.uint64)
        with np.errstate(over="ignore"):
            pairs = A.mix((before << np.uint64(24)) + codes[at].astype(np.uint64) + np.uint64(1 << 60))
        self.key = np.concatenate([A.span_hashes(codes, starts, ends), pairs])
        self.start = np.concatenate([starts, at])
        self.end = np.concatenate([ends, at + 1])
        self.is_wide = np.concatenate([np.zeros(len(starts), bool), np.ones(len(at), bool)])
        self.letters = np.where(self.is_wide, 3, self.end - self.start)
        first = classes[self.start] if len(self.start) else np.zeros(0, np.uint8)
        self.script = np.where(self.is_wide, WIDE, np.where(first == A.CYRILLIC, CYRILLIC, np.where(first == A.LATIN, LATIN, 3)))

    def text(self, i: int) -> tuple[bytes, bytes]:
        """Context and bytes of a unit."""
        s, e = int(self.start[i]), int(self.end[i])
        unit = self.batch.joined[s:e].lower().encode("utf-8", "replace")
        if self.is_wide[i] and s and self.wide[s - 1]:
            return self.batch.joined[s - 1].encode("utf-8", "replace"), unit
        return b" ", unit


class Coder:
    """Frozen trees with the costs of the units met so far.

    A byte's cost depends on itself and the few bytes before it, so these short strings are coded once,
    and new units are sums over them; both caches are emptied when full, which changes no result.
    """

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.index: dict[int, int] = {}
        self.costs = np.zeros((1024, len(trees)), np.float32)
        self.memo: dict[bytes, int] = {}
        self.short: dict[bytes, int] = {}
        self.contexts = set().union(*(t.nodes for t in trees))
        self.byte_costs = np.zeros((1024, len(trees)), np.float32)

    def _new(self, strings: list[tuple[bytes, bytes]]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 2 * CACHE_UNITS:
            memo.clear()
            self.short.clear()
        rows, first, done = [], [], len(self.short)
        for context, unit in strings:
            whole = context + unit
            first.append(len(rows))
            for i in range(len(context), len(whole)):
                key = whole[i - ORDER if i > ORDER else 0:i + 1]
                row = memo.get(key)
                if row is None:
                    short = key
                    while len(short) > 1 and short[:-1] not in self.contexts:
                        short = short[1:]  # no tree knows this context: the shorter one decides in all
                    row = memo[key] = self.short.setdefault(short, len(self.short))
                    if row < done:
                        rows.append(row)
                        continue
                    done, key = row + 1, short
                    if row >= len(self.byte_costs):
                        self.byte_costs = np.concatenate([self.byte_costs, np.zeros_like(self.byte_costs)])
                    self.byte_costs[row] = [t.bits(key[:-1], key[-1]) for t in self.trees]
                rows.append(row)
        return np.add.reduceat(self.byte_costs[rows], first, axis=0)

    def unit_costs(self, units: Units) -> np.ndarray:
        unique, first, where = np.unique(units.key, return_index=True, return_inverse=True)
        index = self.index
        if len(index) + len(unique) > CACHE_UNITS:
            index.clear()
        rows = np.empty(len(unique), np.int64)
        new = []
        for i, key in enumerate(unique.tolist()):
            row = index.get(key)
            if row is None:
                row = index[key] = len(index)
                new.append(i)
            rows[i] = row
        while len(index) > len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        if new:
            self.costs[rows[new]] = self._new([units.text(first[i]) for i in new])
        return self.costs[rows][where]

    def lines(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of each line: its text, bits by language, letters, and marks that may end sentences."""
        units = Units(texts)
        batch = units.batch
        starts, ends, owner = batch.line_bounds()
        n, k = len(starts), len(self.trees)
        bits = np.zeros((n, k), np.float32)
        letters = np.zeros(n)
        scripts = np.zeros((n, 4))
        if len(units.key):
            line = np.searchsorted(ends, units.start)
            order = np.argsort(line, kind="stable")
            cost = self.unit_costs(units)[order]
            line = line[order]
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            bits[line[first]] = np.add.reduceat(cost, first, axis=0)
            letters[line[first]] = np.add.reduceat(units.letters[order].astype(float), first)
            np.add.at(scripts, (line, units.script[order]), units.letters[order])
        following = np.concatenate([batch.classes[1:], [A.SPACE]])
        marks = np.flatnonzero((_END[batch.codes] & (following == A.SPACE)) | _WIDE_END[batch.codes])
        sentences = np.bincount(np.searchsorted(ends, marks), minlength=n)
        return {"owner": owner, "bits": bits, "letters": letters, "scripts": scripts, "sentences": sentences}


def segments(bits: np.ndarray, letters: np.ndarray, sentences: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Cuts the lines of one text into segments of one language: first line, end, language, bits saved
    against the next best language."""
    n, k = bits.shape
    if not n:
        return []
    if n == 1 or (bits.sum(0).argmin() == bits.argmin(1))[letters > 0].all():
        total = bits.sum(0)
        two = np.partition(total, 1)[:2] if k > 1 else np.array([total[0], total[0]])
        return [(0, n, int(total.argmin()), float(two[1] - two[0]))]
    cost, back = bits[0].astype(float), []
    for i in range(1, n):
        best = int(cost.argmin())
        change = cost[best] + CHANGE_BITS
        stay = cost <= change
        back.append(np.where(stay, np.arange(k), best))
        cost = np.where(stay, cost, change) + bits[i]
    at = int(cost.argmin())
    path = [at]
    for step in reversed(back):
        at = int(step[at])
        path.append(at)
    path.reverse()
    out, first = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[first]:
            total = bits[first:i].sum(0)
            rest = np.delete(total, path[first])
            out.append((first, i, path[first], float(rest.min() - total[path[first]]) if len(rest) else 0.0))
            first = i
    return out


def train(texts: list[str], labels: list[int]) -> list[Tree]:
    """Trees of all languages from texts with a (not always right) label."""
    texts = [A.plain(t[:TRAINING_CHARS]) for t in texts]
    trees: list[Tree] = [Tree().freeze() for _ in LANGUAGES]
    if not texts:
        return trees
    units = Units(texts)
    _, ends, owner = units.batch.line_bounds()
    line = np.searchsorted(ends, units.start)
    unique, first, where = np.unique(units.key, return_index=True, return_inverse=True)
    strings = [units.text(i) for i in first]
    of_line = np.array(labels)[owner]
    for turn in range(ROUNDS):
        trees = []
        for lang in range(len(LANGUAGES)):
            tree = Tree()
            counts = np.bincount(where[of_line[line] == lang], minlength=len(unique))
            for u in np.flatnonzero(counts):
                tree.add(*strings[u], int(counts[u]))
            trees.append(tree.freeze())
        if turn < ROUNDS - 1:
            found = Coder(trees).lines(texts)
            two = np.partition(found["bits"], 1, axis=1)
            sure = (two[:, 1] - two[:, 0] > 4) & (found["letters"] > 20)
            of_line = np.where(sure, found["bits"].argmin(1), -1)
    return trees


def learn(pages: DataFrame, articles: DataFrame, rows: int = TRAINING_PAGES) -> list[Tree]:
    """Trees fitted on at most ``rows`` pages of labelled articles, each language taking its part
    (bounded collects)."""
    marked = articles.select(F.col("id").alias("a"), label_of(F.col("language")).alias("l")).where("l is not null")
    each = max(1, rows // len(LANGUAGES))
    kept = None
    for code in LANGUAGES:
        some = sampled(marked.where(F.col("l") == code), "a", each)
        kept = some if kept is None else kept.union(some)
    chosen = stored(kept)  # at most ``rows`` articles
    text = pages.select(F.col("article_id").alias("a"), "page_number", F.substring("text", 1, TRAINING_CHARS).alias("t")).where(F.length(F.trim("t")) > 40)
    # one page of each chosen article and one more where there are few articles
    pick = text.join(F.broadcast(chosen), "a").groupBy("a", "l").agg(F.min(F.struct("page_number", "t")).alias("p"), F.max(F.struct("page_number", "t")).alias("q"))
    found = pick.select("a", "l", F.col("p.t").alias("p"), F.when(F.col("p.page_number") < F.col("q.page_number"), F.col("q.t")).alias("q")).collect()
    found.sort(key=lambda r: r.a)
    at = {code: i for i, code in enumerate(LANGUAGES)}
    pairs = [(t, at[r.l]) for r in found for t in (r.p, r.q) if t]
    return train([t for t, _ in pairs], [y for _, y in pairs])


SEGMENTS = T.StructType([
    T.StructField("article_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("line_from", T.IntegerType()),
    T.StructField("line_to", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("letters", T.IntegerType()), T.StructField("sentences", T.IntegerType()), T.StructField("bits_per_letter", T.DoubleType()),
])


def page_segments(pages: DataFrame, trees: list[Tree]) -> DataFrame:
    """SEGMENTS of every page: its lines (from 1) as segments of one language each.

    The confidence is the posterior of the language against the next best under equal priors, with a
    hundredth of the bits saved (lines aren't independent evidence). Null, blank and letterless pages
    give no rows.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(trees)
    coder: list[Coder] = []

    def run(columns: dict) -> pa.RecordBatch:
        if not coder:
            coder.append(Coder(shipped.value))
        found = coder[0].lines([A.plain(t or "") for t in columns["text"]])
        out: list[list] = [[] for _ in range(9)]
        bounds = np.searchsorted(found["owner"], np.arange(len(columns["text"]) + 1))
        for row in range(len(columns["text"])):
            a, b = bounds[row], bounds[row + 1]
            letters = found["letters"][a:b]
            if not letters.any():
                continue
            for first, end, lang, saved in segments(found["bits"][a:b], letters, found["sentences"][a:b]):
                n = int(letters[first:end].sum())
                if n:
                    own = found["scripts"][a + first:a + end, SCRIPT_OF[lang]].sum() >= OWN_SCRIPT * n
                    values = (columns["article_id"][row], columns["page_number"][row], first + 1, end, LANGUAGES[lang],
                              1 / (1 + 2 ** -min(50.0, saved / 8)), n, int(found["sentences"][a + first:a + end].sum()) if saved >= SURE_BITS and own else 0,
                              float(found["bits"][a + first:a + end, lang].sum()) / n)
                    for column, value in zip(out, values):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, _arrow_type(f.dataType)) for c, f in zip(out, SEGMENTS)], names=SEGMENTS.names)

    return pages.select("article_id", "page_number", "text").mapInArrow(A.map_arrow(run), SEGMENTS)


def assign(articles: DataFrame, pages: DataFrame, trees: list[Tree] | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, segments): ``id, label, language, confidence`` of every article, and SEGMENTS with the
    article's language as ``main``.

    An article has the language of most sentences of its pages (pages delivered twice count once);
    without any, that of most letters, then of its title, else null with confidence 0. Pages without
    an article are in neither result. Repeated article rows come out as often as they go in.
    """
    fitted = trees if trees is not None else learn(pages, articles)
    found = stored(page_segments(pages, fitted))
    by_page = found.groupBy("article_id", "page_number", "line_from", "language").agg(F.max("sentences").alias("s"), F.max("letters").alias("n"))
    # two steps, the first by page: an article with a third of all pages is summed in parts
    by_article = by_page.groupBy("article_id", "language").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    main = by_article.groupBy("article_id").agg(F.max(F.struct("s", "n", "language")).alias("m"), F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        F.col("article_id").alias("id"), F.col("m.language").alias("language"),
        F.when(F.col("s") > 0, F.col("m.s") / F.col("s")).otherwise(F.col("m.n") / F.col("n")).alias("confidence"))
    without = articles.join(main.select("id"), "id", "left_anti")
    titles = page_segments(without.select(F.col("id").alias("article_id"), F.lit(0).alias("page_number"), F.regexp_replace("title", r"[\r\n]+", " ").alias("text")), fitted)
    titles = titles.groupBy("article_id").agg(F.max(F.struct("letters", "language", "confidence")).alias("t"))
    whole = (
        articles.select("id", F.col("language").alias("label")).join(main, "id", "left").join(titles, F.col("id") == F.col("article_id"), "left")
        .select("id", "label", F.coalesce("language", "t.language").alias("language"), F.coalesce("confidence", F.col("t.confidence") / 2, F.lit(0.0)).alias("confidence"))
    )
    parts = found.join(main.select(F.col("id").alias("article_id"), F.col("language").alias("main")), "article_id")
    return whole, parts


def wrong_or_foreign(articles: DataFrame, pages: DataFrame, trees: list[Tree] | None = None) -> DataFrame:
    """``article_id, page_number, language``: articles whose label is missing or wrong (page 0), and pages
    with a paragraph in another language than the article's."""
    whole, parts = assign(articles, pages, trees)
    labels = whole.where("language is not null").where(~label_of(F.col("label")).eqNullSafe(F.col("language"))).select(
        F.col("id").alias("article_id"), F.lit(0).alias("page_number"), "language")
    foreign = parts.where(f"language <> main and letters >= {SEGMENT_LETTERS} and sentences > 0 and bits_per_letter <= {TEXT_BITS}").select("article_id", "page_number", "language")
    return labels.union(foreign).distinct()
