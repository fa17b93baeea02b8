"""Noise in text from scanned pages (problem 3).

An averaged perceptron is the character editor: for each place of a word where the
corpus offers an edit it predicts keep, replace, delete or insert, and at the end of a
line keep or join. It learns from pages that have both a clean and a scanned
layer, aligned with each other. The corpus offers as edits what leads to a more
frequent word that looks the same once characters confused with each other are
folded together; the editor's scores decide whether, and to which word, a word is
corrected. A second perceptron tells running heads and page numbers from text by their
position on the page, their likeness to the article's title and journal, and their
return on other pages.

Words are judged as rows of a table, each distinct word of the corpus once, against
the whole vocabulary. The scan of the texts leaves out words that are sure and hands
on the others, which are joined with the corrections.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm import arrays as A
from foliomill.llm.common import checked_broadcast, sampled, stored

#: A word is known from so many layers on (fewer in small corpora).
LEAST_LAYERS = 6
#: Words and trigrams that the scan leaves out without asking the tables: the most frequent ones. It bounds what
#: is broadcast and changes no result: all others are looked up in the whole tables.
SURE_WORDS = 200_000
SURE_TRIGRAMS = 500_000
#: Absolute counts in the features hold for so many layers and are scaled for more.
USUAL_LAYERS = 6000
#: Most pages with two layers for the editor, most edge lines for furniture, most words for what is common.
ALIGNED_PAGES = 1500
FURNITURE_LINES = 12000
COMMON_WORDS = 20_000
TRAINING_CHARS = 3000
EPOCHS = 4
#: An edit is offered if it leads to a word so many times as frequent.
TIMES = 3
CACHE_WORDS = 400_000
#: Inked lines from the top and from the bottom of a page, and characters of a line, that a running head may have.
EDGE = 3
HEAD_CHARS = 120

HYPHENS = "-‐‑¬\xad"
_NUMBER = r"(?:\d|[lIOo](?=\d)|(?<=\d)[lIOo]){1,5}"
_AROUND = r"[\s\-–—\[\]()|]*"
PAGE_NUMBER = re.compile(rf"{_AROUND}(?:(?:page|pages|p|pp|s|seite|стр|с|pág|página|第|页码)\.?\s*)?{_NUMBER}(?:\s*/\s*{_NUMBER})?\s*(?:页|頁|ページ)?{_AROUND}", re.I)
_VOLUME = re.compile(r"\bvol\b")
_LISTED = re.compile(r"(?m)^[ \t]*(?:\(\w{1,3}\) |\[\d+\] |[•‣▪–—*·-] (?!\d)|[^\W\d_]{2,8} [—=:–] |[^\W\d_]+(?:, \d+)+|\d+(?:\.\d+)* .*\.{4})")
_BROKEN = re.compile(rf"[{HYPHENS}]\n(?<=[^\W\d_][{HYPHENS}]\n)\s*(?=[^\W\d_])")
_BREAKS = [f"{c}\n" for c in HYPHENS]
_WIDE_BREAK = re.compile(r"\n(?<=[぀-鿿]\n)(?=[぀-鿿])")
_WIDE = re.compile("[぀-ヿ㐀-鿿]")


class Perceptron:
    """Averaged multi-class perceptron over string features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def rows(self, labels: tuple[str, ...]) -> dict[str, tuple[float, ...]]:
        """The weights of each feature for some labels, in their order."""
        return {f: tuple(w.get(k, 0.0) for k in labels) for f, w in self.weights.items()}

    def scores(self, features: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] = out.get(label, 0.0) + w
        return out

    def train(self, rows: list[tuple[list[str], str]], epochs: int = EPOCHS) -> "Perceptron":
        labels = sorted({y for _, y in rows})
        total: dict[tuple[str, str], float] = defaultdict(float)
        since: dict[tuple[str, str], int] = defaultdict(int)
        step = 0
        order = np.random.default_rng(11)

        def change(f: str, y: str, by: float) -> None:
            w = self.weights.setdefault(f, {})
            total[f, y] += (step - since[f, y]) * w.get(y, 0.0)
            since[f, y] = step
            w[y] = w.get(y, 0.0) + by

        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                features, y = rows[i]
                step += 1
                s = self.scores(features)
                best = max(labels, key=lambda k: (s.get(k, 0.0), k))
                if best != y:
                    for f in features:
                        change(f, y, 1.0)
                        change(f, best, -1.0)
        for f, w in self.weights.items():
            for y in w:
                w[y] = (total[f, y] + (step - since[f, y]) * w[y]) / max(1, step)
        return self


# ----------------------------------------------------------------------------------------------- editor

KEEP, REPLACE, DELETE, INSERT, JOIN = "keep", "replace", "delete", "insert", "join"


def edits(noisy: str, clean: str) -> list[tuple[int, str, str]]:
    """(place in the noisy word, operation, characters put there) of what turns one word into the other."""
    out = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, noisy, clean, autojunk=False).get_opcodes():
        if tag == "insert":
            out.append((max(0, i1 - 1), INSERT, clean[j1:j2]))
        elif tag == "delete":
            out += [(i, DELETE, "") for i in range(i1, i2)]
        elif tag == "replace":
            n, m = i2 - i1, j2 - j1
            out += [(i1 + k, REPLACE, clean[j1 + k] if k < min(n, m) - 1 or n >= m else clean[j1 + k:j2]) for k in range(min(n, m))]
            out += [(i1 + k, DELETE, "") for k in range(m, n)]
    return out


def edit_features(word: str, clean: str, edit: tuple[int, str, str], n: int, n_clean: float, many: int) -> list[str]:
    """Of one edit: its characters and those around it, how often both words stand (scaled), and the word's make."""
    i, operation, put = edit
    before, after = word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
    what = f"{word[i]}>{operation[0]}{put}"
    known = n_clean > 0
    ratio = min(8, int(np.log2(n_clean / (n + 1)) * 1.0001)) if known else -1
    seen, often = min(4, int(np.log2(n + 1))), min(12, int(np.log2(n_clean + 1)))
    make = "w" if word.isalpha() else "m" if any(c.isalpha() for c in word) else "d"
    size = min(len(word), 8)
    return ["bias", f"e={what}", f"e={what}|b={before}", f"e={what}|a={after}", f"x={before}{word[i]}{after}", f"e={what}|make={make}", f"ratio={ratio}", f"ratio={ratio}|make={make}", f"ratio={ratio}|size={size}",
            f"seen={seen}|ratio={ratio}", f"often={often}|size={size}", f"often={often}|make={make}|size={size}", f"e={what}|ratio={ratio}", f"many={min(many, 4)}", f"many={min(many, 4)}|size={size}|make={make}", f"edge={i == 0 or i == len(word) - 1}|e={what}"]


def joint_features(left: str, hyphen: str, right: str, known: tuple[bool, bool, bool]) -> list[str]:
    """Of the end of a line: the parts of the word on both sides of its hyphen; whether the left part, the right part
    and both together are known words."""
    case = "U" if right[:1].isupper() else "l" if right[:1].isalpha() else "0"
    size = f"{min(len(left), 5)},{min(len(right), 5)}"
    state = "".join("01"[k] for k in known)
    hyphen = "-" if hyphen == "-" else "other"
    return ["joint", f"j:h={hyphen}", f"j:h={hyphen}|c={case}", f"j:k={state}", f"j:k={state}|c={case}", f"j:k={state}|h={hyphen}|c={case}", f"j:s={size}|c={case}", f"j:up={left.isupper()}|c={case}"]


def _root(parent: dict[str, str], x: str) -> str:
    parent.setdefault(x, x)
    while parent[x] != x:
        x = parent[x]
    return x


class Editor:
    """The fitted character editor: its perceptron, the confusions seen in training with the classes they fall
    into, and confused wide characters. ``scale`` brings counts to USUAL_LAYERS."""

    def __init__(self, perceptron: Perceptron, units: list[tuple[str, str]], wide: dict[str, set[str]], scale: float):
        self.perceptron, self.units, self.wide, self.scale = perceptron, units, wide, scale
        parent: dict[str, str] = {}
        for noisy, clean in units:
            parent[_root(parent, noisy)] = _root(parent, clean)
        name = {x: _root(parent, x) for x in parent}
        code = {r: chr(0xE100 + i) for i, r in enumerate(sorted(set(name.values())))}
        self._single = {ord(x): code[r] for x, r in name.items() if len(x) == 1}
        self._double = {x: code[r] for x, r in name.items() if len(x) == 2}
        self._finder = re.compile("|".join(map(re.escape, sorted(self._double)))) if self._double else None
        self._marks = defaultdict(set)
        for noisy, clean in units:
            if len(noisy) == 1 and not noisy.isalpha() and clean.isalpha():
                self._marks[noisy].add(clean)

    def folds(self, word: str) -> set[str]:
        """Both ways to fold a word: its pairs first, or characters alone (a pair may be two letters after all)."""
        out = {word.translate(self._single)}
        if self._finder is not None:
            out.add(self._finder.sub(lambda m: self._double[m.group()], word).translate(self._single))
        return out

    def margin(self, word: str, clean: str, n: int, n_clean: int) -> float:
        """By how much the editor's scores of all edits that lead to ``clean`` beat keeping the characters."""
        found = edits(word, clean)
        out = 0.0
        for edit in found:
            s = self.perceptron.scores(edit_features(word, clean, edit, int(n * self.scale), n_clean * self.scale, len(found)))
            out += s.get(edit[1], 0.0) - s.get(KEEP, 0.0)
        return out

    def spelled(self, word: str, n: int) -> str | None:
        """A word that looks like no known one, a name perhaps, with the marks and digits between its letters that the
        editor replaces by letters; None if it keeps all."""
        if word.isalpha():
            return None
        out = list(word)
        for i in range(1, len(word) - 1):
            if not word[i].isalpha() and word[i - 1].isalpha() and word[i + 1].isalpha():
                best = 0.0
                for put in sorted(self._marks.get(word[i], ())):
                    edit = (i, REPLACE, put)
                    s = self.perceptron.scores(edit_features(word, word, edit, int(n * self.scale), 0, 1))
                    if s.get(REPLACE, 0.0) - s.get(KEEP, 0.0) > best:
                        best, out[i] = s.get(REPLACE, 0.0) - s.get(KEEP, 0.0), put
        return "".join(out) if out != list(word) else None

    def joins(self, left: str, hyphen: str, right: str, known: tuple[bool, bool, bool]) -> bool:
        """Whether the word at the end of a line goes on in the next one."""
        s = self.perceptron.scores(joint_features(left, hyphen, right, known))
        return s.get(JOIN, 0.0) > s.get(KEEP, 0.0)


def correctable(word: str) -> bool:
    return len(word) >= 2 and (word.isalpha() or sum(map(str.isalpha, word)) * 2 >= len(word))


def offered(word: str, clean: str, n: int, n_clean: int) -> bool:
    """Whether the corpus offers a word as a correction of another."""
    short = len(word) < 3 and word.isalpha() and word.isascii() and clean.isascii()
    return word != clean and not short and n_clean >= TIMES * (n + (1 if len(word) > 3 else 3) if n > 1 else 1)


def _is_wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


_IN_WORD = np.zeros(A.TABLE_SIZE, bool)
_IN_WORD[[ord("!"), ord("+")]] = True
_MARKED = "!+"


def find_words(batch: A.TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a batch: letters, digits and the marks that letters are misread as, with one letter
    at least, not of the scripts without spaces; and the masks of narrow letters and of digits."""
    classes = batch.classes
    narrow = (classes == A.LATIN) | (classes == A.CYRILLIC) | (classes == A.GREEK) | (classes == A.LETTER) | (classes == A.MARK)
    digit = classes == A.DIGIT
    starts, ends = A.runs(narrow | digit | _IN_WORD[batch.codes])
    total = np.zeros(len(narrow) + 1, np.int32)
    np.cumsum(narrow, out=total[1:])
    lettered = total[ends] > total[starts]
    return starts[lettered], ends[lettered], narrow, digit


def _trigrams(batch: A.TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of wide characters inside their text, and the codes of each with both neighbours (LF for none)."""
    wide = (batch.classes == A.HAN) | (batch.classes == A.KANA)
    at = np.flatnonzero(wide)
    codes = batch.raw.astype(np.uint64)
    before = np.where(at > 0, codes[np.maximum(at - 1, 0)], np.uint64(10))
    after = codes[np.minimum(at + 1, len(codes) - 1)]
    return at, (before << np.uint64(42)) | (codes[at] << np.uint64(21)) | after


def _triple(key: int) -> str:
    return chr(key >> 42) + chr(key >> 21 & 0x1FFFFF) + chr(key & 0x1FFFFF)


@functools.cache
def _upper_table() -> np.ndarray:
    table = np.zeros(A.TABLE_SIZE, bool)
    for c in range(0x2000):
        table[c] = chr(c).isupper()
    return table


def _distinct(owner: np.ndarray, key: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row for each owner and key, and whether any of their rows has the flag."""
    with np.errstate(over="ignore"):
        one = (A.mix(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(1)) | (~flag).astype(np.uint64)
    order = np.argsort(one)
    one = one[order] >> np.uint64(1)
    first = np.ones(len(order), bool)
    first[1:] = one[1:] != one[:-1]
    return order[first], flag[order[first]]


def unbroken(text: str) -> str:
    """The plain form with words put together that are broken over lines, and wide characters without line breaks."""
    return _put_together(A.plain(text))


def _put_together(text: str) -> str:
    """unbroken of a text in plain form."""
    if any(b in text for b in _BREAKS):
        text = _BROKEN.sub("", text)
    return text if text.isascii() else _WIDE_BREAK.sub("", text)


def count_words(texts: list[str], words: dict[int, list], wide: dict[int, int]) -> None:
    """Adds to ``words`` (by hash: word in lower case, layers with it, layers with it capitalised) and ``wide`` (by
    trigram: layers) what stands in texts, each once a text."""
    batch = A.TextBatch(list(map(_put_together, A.plain_texts(texts))))
    starts, ends, _, _ = find_words(batch)
    text = batch.joined
    # a mark behind a word may be one
    trailing = np.flatnonzero(_IN_WORD[batch.codes[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
    cut = ends[trailing].copy()
    for _ in range(3):
        cut -= _IN_WORD[batch.codes[cut - 1]]
    bare = cut > starts[trailing]
    starts, ends = np.concatenate([starts, starts[trailing][bare]]), np.concatenate([ends, cut[bare]])
    hashes = A.span_hashes(batch.lower, starts, ends)
    if len(starts):
        upper = _upper_table()[batch.codes]
        total = np.zeros(len(upper) + 1, np.int32)
        np.cumsum(upper, out=total[1:])
        capital = upper[starts] & (total[ends] - total[starts] == 1) & (ends - starts > 1)
        at, has = _distinct(np.searchsorted(batch.ends, starts), hashes, capital)
        unique, first, where = np.unique(hashes[at], return_index=True, return_inverse=True)
        n, capitals = np.bincount(where), np.bincount(where, weights=has).astype(int)
        for key, i, a, b in zip(unique.tolist(), at[first].tolist(), n.tolist(), capitals.tolist()):
            found = words.get(key)
            if found is None:
                words[key] = [text[starts[i]:ends[i]].lower(), a, b]
            else:
                found[1] += a
                found[2] += b
    at, keys = _trigrams(batch)
    if len(at):
        one, _ = _distinct(np.searchsorted(batch.ends, at), keys, np.zeros(len(at), bool))
        unique, n = np.unique(keys[one], return_counts=True)
        for key, a in zip(unique.tolist(), n.tolist()):
            wide[key] = wide.get(key, 0) + a


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kind, word, n, capital`` of a partition's texts, sent on whenever there are many."""
    words: dict[int, list] = {}
    wide: dict[int, int] = {}
    layers = 0

    def sent() -> pa.RecordBatch:
        rows = [("layers", "", layers, 0), *(("word", w, n, c) for w, n, c in words.values()), *(("wide", _triple(k), n, 0) for k, n in wide.items())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "word", "n", "capital"])

    for batch in batches:
        for part in A.parts(batch, 2_000_000):
            count_words(part.column(0).to_pylist(), words, wide)
            layers += part.num_rows
            if len(words) + len(wide) > CACHE_WORDS:
                yield sent()
                words, wide, layers = {}, {}, 0
    if layers:
        yield sent()


def least_layers(layers: int) -> float:
    return min(LEAST_LAYERS, max(3, 0.001 * layers))


@dataclass
class Corpus:
    """Counts over the whole texts of all layers: ``word, n, capital`` of every word (layers that hold it), ``word, n``
    of every trigram around a wide character, the number of layers, and from how many a word is known."""

    words: DataFrame
    wide: DataFrame
    layers: int
    least: float


def corpus_counts(layers: DataFrame) -> Corpus:
    counted = layers.where(F.length(F.trim("text")) > 0).select("text").mapInArrow(_counted, "kind string, word string, n bigint, capital bigint")
    every = stored(counted.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("capital").alias("capital")))
    total = every.where("kind = 'layers'").agg(F.sum("n")).first()[0] or 0
    return Corpus(every.where("kind = 'word'").select("word", "n", "capital"), every.where("kind = 'wide'").select("word", "n"), total, least_layers(total))


def _tokens(text: str) -> list[str]:
    batch = A.TextBatch([text])
    starts, ends, _, _ = find_words(batch)
    return [batch.joined[a:b].lower() for a, b in zip(starts, ends)]


def aligned_words(clean: str, scanned: str) -> list[tuple[str, str]]:
    """(clean, scanned) words that stand in the same place of both layers of a page, equal ones included."""
    a, b = _tokens(unbroken(clean)), _tokens(unbroken(scanned))
    matcher = SequenceMatcher(None, a, b, autojunk=False)
    out = []
    if a and b and matcher.quick_ratio() >= 0.6:
        for tag, i1, i2, j1, j2 in matcher.get_opcodes():
            if tag == "equal" or tag == "replace" and i2 - i1 == j2 - j1 <= 3:
                out += list(zip(a[i1:i2], b[j1:j2]))
    return out


def _line_ends(clean: str, scanned: str) -> Iterator[tuple[str, str, str, str | None]]:
    """Of the lines of a scanned layer that end in a hyphen: left part, hyphen, right part, and JOIN if the clean layer has
    both together, with or without a hyphen, KEEP if it has them apart, else None."""
    low = A.plain(clean).lower()
    words = set(_tokens(low))
    for left, hyphen, right in joints(scanned.split("\n")).values():
        a, b = A.plain(left).lower(), A.plain(right).lower()
        apart = re.search(rf"\b{re.escape(a)}[{HYPHENS}–—]?\s+{re.escape(b)}\b", low)
        yield left, hyphen, right, JOIN if a + b in words or f"{a}-{b}" in low else KEEP if apart or not (a in words or b in words) and right[:1].isupper() else None


_FIRST = re.compile(r"\s*([^\W_]+)")


def joints(lines: list[str]) -> dict[int, tuple[str, str, str]]:
    """By line, left part, hyphen and right part of the words that may be broken at its end."""
    out = {}
    for k in range(len(lines) - 1):
        line = lines[k].rstrip()
        if line[-1:] in HYPHENS and line and len(line) > 2:
            start = end = len(line) - 1
            while start and line[start - 1].isalnum():
                start -= 1
            b = _FIRST.match(lines[k + 1]) if start < end and line[end - 1].isalpha() else None
            if b and b.group(1)[0].isalpha():
                out[k] = line[start:end], line[end], b.group(1)
    return out


def fit_editor(aligned: list[tuple[str, str]], counts: dict[str, int], corpus_layers: int) -> Editor:
    """From (clean, scanned) texts of the same pages and counts of their words and of common ones (see Corpus)."""
    least, scale = least_layers(corpus_layers), min(1.0, USUAL_LAYERS / max(1, corpus_layers))
    units, wide_units, positive, equal, joint = Counter(), Counter(), [], set(), []
    for clean, scanned in aligned:
        clean, scanned = clean[:TRAINING_CHARS], scanned[:TRAINING_CHARS]
        joint += list(_line_ends(clean, scanned))
        a, b = unbroken(clean), unbroken(scanned)
        if sum(map(_is_wide, a)) * 3 > len(a):
            a, b = re.sub(r"\s+", "", a), re.sub(r"\s+", "", b)
            matcher = SequenceMatcher(None, a, b, autojunk=False)
            if len(a) < 2500 and matcher.quick_ratio() > 0.7:
                wide_units.update((b[j1], a[i1]) for tag, i1, i2, j1, j2 in matcher.get_opcodes() if tag == "replace" and i2 - i1 == j2 - j1 == 1 and _is_wide(a[i1]))
            continue
        for x, y in aligned_words(clean, scanned):
            if x == y:
                equal.add(x)
            elif counts.get(x, 0) >= least and counts.get(y, 0) * 5 < counts[x] and abs(len(x) - len(y)) <= 2 and SequenceMatcher(None, x, y).ratio() > 0.55:
                positive.append((y, x))
                units.update((y[i1:i2], x[j1:j2]) for tag, i1, i2, j1, j2 in SequenceMatcher(None, y, x, autojunk=False).get_opcodes() if tag == "replace" and i2 - i1 <= 2 and j2 - j1 <= 2)
    enough = max(2, len(positive) // 2000)
    kept = sorted(u for u, n in units.items() if n >= enough)
    wide = defaultdict(set)
    for (noisy, clean), n in wide_units.items():
        if n >= 2:
            wide[noisy].add(clean)
    editor = Editor(Perceptron(), kept, dict(wide), scale)
    by_fold = defaultdict(list)
    for w, n in counts.items():
        if n >= least:
            for f in editor.folds(w):
                by_fold[f].append(w)
    rows: list[tuple[list[str], str]] = []

    def learn(word: str, clean: str, n_clean: int, keep: bool) -> None:
        found, n = edits(word, clean), counts.get(word, 0)
        for e in found:
            rows.append((edit_features(word, clean, e, int(n * scale), n_clean * scale, len(found)), KEEP if keep else e[1]))

    for word, clean in positive:
        learn(word, clean, counts[clean], False)
        for other in {w for f in editor.folds(word) for w in by_fold[f]} - {clean}:
            if offered(word, other, counts.get(word, 0), counts[other]):
                learn(word, other, counts[other], True)
        # the same without the dictionary, for words that aren't in it
        for e in edits(word, clean):
            if e[1] == REPLACE and not word[e[0]].isalpha():
                rows.append((edit_features(word, word, e, int(counts.get(word, 0) * scale), 0, 1), REPLACE))
    misread = {y for y, _ in positive}
    for word in sorted(equal - misread):
        if correctable(word):
            for clean in {w for f in editor.folds(word) for w in by_fold[f]}:
                if offered(word, clean, counts.get(word, 0), counts[clean]):
                    learn(word, clean, counts[clean], True)
            for i in range(1, len(word) - 1):
                for put in editor._marks.get(word[i], ()) if word[i - 1].isalpha() and word[i + 1].isalpha() else ():
                    rows.append((edit_features(word, word, (i, REPLACE, put), int(counts.get(word, 0) * scale), 0, 1), KEEP))
    known = lambda w: counts.get(A.plain(w).lower(), 0) >= least
    rows += [(joint_features(left, hyphen, right, (known(left), known(right), known(left + right))), y) for left, hyphen, right, y in joint if y]
    editor.perceptron.train(rows)
    return editor


@dataclass
class Scanner:
    """What the scan of texts needs: the editor, corrections of words and of trigrams (whole tables), and
    what needn't be asked: sorted hashes of known words, of which ``sure`` are no misreadings, and sorted sure trigrams."""

    editor: Editor
    corrections: DataFrame
    wide_corrections: DataFrame
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    sure_wide: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def correct_words(corpus: Corpus, editor: Editor) -> DataFrame:
    """``word, clean, often_capital``: every word of the corpus that the editor corrects, with what it was. ``often_capital`` tells
    whether the right word is often written with a capital: names look like misread words. Each word meets the known ones
    that fold alike, by a join; no vocabulary is collected."""
    spark = corpus.words.sparkSession
    shipped = spark.sparkContext.broadcast(editor)

    def folded(columns: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for word, n, capital in zip(columns["word"], columns["n"], columns["capital"]):
            if correctable(word):
                for f in shipped.value.folds(word):
                    for column, v in zip(out, (f, word, n, capital)):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["fold", "word", "n", "capital"])

    def judged(columns: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for word, n, clean, n_clean, capital in zip(*(columns[c] for c in ("word", "n", "clean", "n_clean", "capital"))):
            if offered(word, clean, n, n_clean):
                margin = shipped.value.margin(word, clean, n, n_clean)
                if margin > 0:
                    for column, v in zip(out, (word, clean, margin, capital >= 0.05 * n_clean)):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.float64(), pa.bool_()))], names=["word", "clean", "margin", "often_capital"])

    def spelled(columns: dict) -> pa.RecordBatch:
        out: list[list] = [[], []]
        for word, n in zip(columns["word"], columns["n"]):
            clean = shipped.value.spelled(word, n) if correctable(word) else None
            if clean is not None:
                for column, v in zip(out, (word, clean)):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["word", "clean"])

    folds = stored(corpus.words.mapInArrow(A.map_arrow(folded), "fold string, word string, n bigint, capital bigint"))
    known = folds.where(F.col("n") >= corpus.least).select("fold", F.col("word").alias("clean"), F.col("n").alias("n_clean"), "capital")
    pairs = folds.select("fold", "word", "n").join(known, "fold").where(f"word <> clean and n_clean >= {TIMES} * n").select("word", "n", "clean", "n_clean", "capital").distinct()
    found = pairs.mapInArrow(A.map_arrow(judged), "word string, clean string, margin double, often_capital boolean")
    best = stored(found.groupBy("word").agg(F.max(F.struct("margin", "clean", "often_capital")).alias("b")).select("word", "b.clean", "b.often_capital"))
    marked = corpus.words.where(~F.col("word").rlike(r"^[\p{L}\p{M}]+$")).select("word", "n").mapInArrow(A.map_arrow(spelled), "word string, clean string")
    alone = marked.join(best.select("word"), "word", "left_anti").withColumn("often_capital", F.lit(True))
    return stored(best.union(alone))


def correct_trigrams(corpus: Corpus, editor: Editor) -> DataFrame:
    """``word, clean``: every trigram whose middle character should be another of those it is confused with, by how often both stand."""
    if not editor.wide:
        return corpus.words.sparkSession.createDataFrame([], "word string, clean string")
    confused = corpus.words.sparkSession.createDataFrame([(a, b) for a, bs in sorted(editor.wide.items()) for b in sorted(bs)], "middle string, right string")
    asked = corpus.wide.where(F.col("n") * editor.scale <= 1).withColumn("middle", F.substring("word", 2, 1)).join(F.broadcast(confused), "middle").withColumn(
        "clean", F.concat(F.substring("word", 1, 1), F.col("right"), F.substring("word", 3, 1)))
    both = asked.select("word", "n", "clean").join(corpus.wide.select(F.col("word").alias("clean"), F.col("n").alias("n_clean")), "clean").where("n_clean >= 5 * n")
    return stored(both.groupBy("word").agg(F.max(F.struct("n_clean", "clean")).alias("b")).select("word", "b.clean"))


def learn_scanner(layers: DataFrame) -> Scanner:
    """Counts over all layers; the editor is fitted on at most ALIGNED_PAGES pages (bounded collects), and what every word of the
    corpus is corrected to is a table."""
    spark = layers.sparkSession
    corpus = corpus_counts(layers)
    text = layers.select("id", "article_id", "page_number", "layer_type", F.col("text").alias("t")).where(F.length(F.trim("t")) > 0)
    # sampled by place, before any text is read
    some = stored(sampled(layers.where("layer_type = 'ocr' and text is not null").select("id", "article_id", "page_number"), "id", ALIGNED_PAGES))
    places = F.broadcast(some.select("article_id", "page_number").distinct())
    both = stored(text.where("layer_type in ('ocr', 'original')").join(places, ["article_id", "page_number"]).withColumn("t", F.substring("t", 1, TRAINING_CHARS)))
    scanned = both.where("layer_type = 'ocr'").join(F.broadcast(some.select("id")), "id").select("article_id", "page_number", F.col("t").alias("scan"))
    clean = both.where("layer_type = 'original'").select("article_id", "page_number", F.col("t").alias("clean"))
    pairs = sorted((r.clean, r.scan) for r in clean.join(scanned, ["article_id", "page_number"]).select("clean", "scan").distinct().limit(2 * ALIGNED_PAGES).collect())
    asked = sorted({w for clean, scan in pairs for t in (clean, scan) for w in _tokens(unbroken(t))} | {A.plain(left + right).lower() for _, scan in pairs for left, _, right in joints(scan.split("\n")).values()})
    counts: dict[str, int] = {}
    if asked:
        wanted = spark.createDataFrame([(w,) for w in asked], "word string")
        counts = {r.word: r.n for r in corpus.words.join(F.broadcast(wanted), "word").select("word", "n").collect()}
    counts |= {r.word: r.n for r in corpus.words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect()}
    editor = fit_editor(pairs, counts, corpus.layers)
    corrections, wide = correct_words(corpus, editor), correct_trigrams(corpus, editor)
    frequent = corpus.words.where(F.col("n") >= corpus.least).orderBy(F.desc("n"), "word").limit(SURE_WORDS)
    rows = frequent.join(checked_broadcast(corrections.select("word", F.lit(True).alias("bad"))), "word", "left").select("word", F.coalesce("bad", F.lit(False)).alias("bad")).collect()
    hashes = A.string_hashes([r.word for r in rows]) if rows else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    sure_wide: list[str] = []
    if editor.wide:
        sure = corpus.wide.where(F.col("n") * editor.scale > 1).where(F.substring("word", 2, 1).isin(sorted(editor.wide)))
        sure_wide = [r.word for r in sure.orderBy(F.desc("n"), "word").limit(SURE_TRIGRAMS).collect()]
    return Scanner(editor, corrections, wide, hashes[order], np.array([not r.bad for r in rows], bool)[order], np.sort(np.array([_key(w) for w in sure_wide], np.uint64)))


def _key(triple: str) -> int:
    return ord(triple[0]) << 42 | ord(triple[1]) << 21 | ord(triple[2])


# --------------------------------------------------------------------------------------------- furniture

_NO_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    return _NO_LETTERS.sub(" ", A.plain(text).lower()).strip()


@functools.lru_cache(maxsize=20_000)
def _pairs(s: str) -> tuple[tuple[str, ...], frozenset[str]]:
    """Neighbouring letters of a text without spaces, in order and as a set."""
    s = s.replace(" ", "")
    listed = tuple(s[i:i + 2] for i in range(len(s) - 1))
    return listed, frozenset(listed)


@functools.lru_cache(maxsize=20_000)
def _head_letters(s: str) -> str:
    return _letters(s)


def likeness(line: str, whole: str) -> float:
    """Share of a line's letter pairs that stand close together in a longer text (a title, a journal)."""
    line = line.replace(" ", "")
    return _likeness(line, set(map(operator.add, line, line[1:])), whole)


def _likeness(line: str, pairs: set[str], whole: str) -> float:
    """Likeness of a line without spaces, by its letter pairs."""
    n = len(pairs)
    if n < 4:
        return 0.0
    listed, every = _pairs(whole)
    if len(listed) < 3 or len(pairs & every) < 0.5 * n:
        return 0.0
    best, step, width = 0, max(1, len(line) // 4), len(line) + 3
    for start in range(0, max(1, len(listed) - len(line) + step), step):
        best = max(best, len(pairs.intersection(listed[start:start + width])))
        if best == n:
            break
    return best / n


def _body(line: str) -> str:
    """The letters of a line, without the word for volume."""
    letters = _letters(line)
    return _VOLUME.sub("", letters).strip() if "vol" in letters else letters


def _like(e: dict, body: str) -> float:
    line = body.replace(" ", "")
    pairs = set(map(operator.add, line, line[1:]))
    return max(_likeness(line, pairs, _head_letters(e["title"] or "")), _likeness(line, pairs, _head_letters(e["journal"] or "")))


def _numbered(line: str) -> bool:
    return len(line) < 40 and bool(PAGE_NUMBER.fullmatch(A.plain(line))) and not re.fullmatch(r"\d+[.,]", line)


_NUMBER_FIRST, _NUMBER_LAST = re.compile(r"\W*\d"), re.compile(r"\d\W*$")


def furniture_make(e: dict, like: float, body: str) -> tuple:
    """What the features of an edge line are made of but for its first word: ``text, from_top, from_bottom, lines, title,
    journal, returns, elsewhere``."""
    line = e["text"].strip()
    level = 0 if like < 0.5 else 1 if like < 0.7 else 2 if like < 0.82 else 3
    letters = sum(map(str.isalpha, line))
    upper = letters > 0 and sum(map(str.isupper, line)) > 0.6 * letters
    number = bool(_NUMBER_FIRST.match(line)) + 2 * bool(_NUMBER_LAST.search(line))
    ends = line[-1:] in ".!?。！？:;,、" and not line.endswith("Vol.")
    return (level, min(e["returns"], 3), e["elsewhere"] <= 2, min(e["from_top"], e["from_bottom"]), ends, upper, number, "top" if e["from_top"] <= e["from_bottom"] else "bottom",
            min(len(line) // 20, 5), "vol" in line.lower(), not line.isascii() and bool(_WIDE.search(line)), min(e["lines"], 6), _numbered(line))


def _made_features(make: tuple) -> tuple[list[str], list[str]]:
    """Features before and behind that of the first word."""
    level, returns, own, depth, ends, upper, number, where, size, vol, wide, lines, alone = make
    return (["bias", f"like={level}", f"like={level}|d={depth}", f"ret={returns}|own={own}", f"like={level}|ret={returns}|own={own}", f"like={level}|ret={returns}|own={own}|d={depth}", f"like={level}|ends={ends}", f"up={upper}", f"up={upper}|like={level}"],
            [f"num={number}", f"ends={ends}", f"d={depth}|w={where}", f"size={size}", f"vol={vol}", f"wide={wide}|like={level}", f"lines={lines}", f"alone={alone}", f"alone={alone}|d={depth}", f"alone={alone}|lines={lines}"])


def _first_feature(body: str) -> str:
    return f"first={body.split(' ', 1)[0][:12]}"


def furniture_features(e: dict, like: float, body: str) -> list[str]:
    """Features of an edge line."""
    before, behind = _made_features(furniture_make(e, like, body))
    return [*before, _first_feature(body), *behind]


def _weak_label(e: dict, like: float, body: str) -> str | None:
    line = e["text"].strip()
    if _numbered(line):
        return "page_no" if min(e["from_top"], e["from_bottom"]) == 0 and e["lines"] > 3 else None
    if like >= 0.9 and len(body) >= 8 and len(line) < 90:
        return "header"
    if e["returns"] >= 3 and e["elsewhere"] <= 2 and len(body) >= 8 and len(line) < 90 and not line.endswith("."):
        return "header"
    if like < 0.55 and (e["elsewhere"] > 2 or e["returns"] <= 1 and (line[-1:] in ".。,，" or (e["title"] or "").count(" ") > 3 or e["journal"])):
        return "text"  # letters that open or close pages of other articles too, or of no other page
    return None


def train_furniture(edges: list[dict]) -> Perceptron:
    """Fitted on the lines that are sure; without lines of more than one sort it stays empty and the sure ones alone count."""
    rows = []
    for e in edges:
        body = _body(e["text"].strip())
        like = _like(e, body)
        label = _weak_label(e, like, body)
        if label:
            rows.append((furniture_features(e, like, body), label))
    return Perceptron().train(rows) if len({y for _, y in rows}) > 1 else Perceptron()


_KINDS = ("text", "header", "page_no")
_NONE = (0.0, 0.0, 0.0)


def furniture_kind(e: dict, rows: dict[str, tuple[float, ...]], made: dict[tuple, tuple]) -> str | None:
    """header, page_no or None for text, by the weights of the model for _KINDS. ``made`` keeps the weights of lines alike."""
    line = e["text"].strip()
    if not line:
        return None
    body = _body(line)
    like = _like(e, body)
    if not rows:
        found = _weak_label(e, like, body)
    else:
        make = furniture_make(e, like, body)
        if make not in made:
            before, behind = ([rows.get(f, _NONE) for f in part] for part in _made_features(make))
            # added up one by one in their order, the first word's between them
            made[make] = tuple(functools.reduce(operator.add, column, 0.0) for column in zip(*before)), [w for w in behind if w != _NONE]
        (a, b, c), behind = made[make]
        for x, y, z in (rows.get(_first_feature(body), _NONE), *behind):
            a += x
            b += y
            c += z
        found = "text" if a >= b and a >= c else "header" if b >= c else "page_no"
    if found == "page_no" and not _numbered(line) or found == "header" and not body:
        return None
    return None if found == "text" else found


# ------------------------------------------------------------------------------------------------- lines

LINES = T.StructType([
    T.StructField("layer_id", T.StringType()), T.StructField("article_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("line_no", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("from_top", T.IntegerType()), T.StructField("from_bottom", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("key", T.StringType()),
])


def _isin(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether values are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def edge_key(line: str) -> str | None:
    """The letters of a line in lower case; None where they are too few to know a line by."""
    key = "".join(filter(str.isalpha, line.lower()))
    return key if len(key) >= 4 else None


def scan_lines(columns: dict, scanner: Scanner) -> pa.RecordBatch:
    """LINES of texts: ``hyphen`` lines (text: join, or keep for a hyphen that stays); ``word`` and ``wide``, words and trigrams to be
    looked up; ``broken``, words over two lines to be looked up (from_top: where the first line ends); ``edge``, lines at the
    edges of each page as candidates for furniture (key: their letters, by which they are known again)."""
    editor = scanner.editor
    raw = [t or "" for t in columns["text"]]
    texts = A.plain_texts(raw)
    batch = A.TextBatch(texts)
    codes, classes = batch.codes, batch.classes
    line_starts, line_ends, owner = batch.line_bounds()
    n = len(texts)
    first_line = np.searchsorted(owner, np.arange(n))
    starts, ends, narrow, digit = find_words(batch)
    line_of = np.searchsorted(line_ends, starts)
    is_known, at = _isin(A.span_hashes(batch.lower, starts, ends), scanner.known)
    sure = is_known & scanner.sure[at] if len(scanner.sure) else is_known
    text = batch.joined

    def known(words: list[str]) -> np.ndarray:
        return _isin(A.string_hashes(words), scanner.known)[0] if words else np.zeros(0, bool)

    # layers of junk: words, but hardly any known one
    of_text = owner[line_of] if len(line_of) else np.zeros(0, np.int64)
    long_enough = (ends - starts) >= 3
    words = np.bincount(of_text[long_enough], weights=(ends - starts)[long_enough], minlength=n)
    have = np.bincount(of_text[sure & long_enough], weights=(ends - starts)[sure & long_enough], minlength=n)
    wide = (classes == A.HAN) | (classes == A.KANA)

    bounds = list(zip(batch.starts.tolist(), batch.ends.tolist()))

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(mask[a:b]) for a, b in bounds], np.int64)

    lines_of = [r.split("\n") for r in raw]
    dark = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(classes != A.SPACE, out=dark[1:])
    ink = dark[batch.ends] - dark[batch.starts]
    n_wide, numbers, letters = per_text(wide), per_text(digit), per_text(narrow)
    junk = (n_wide * 4 < ink) & (ink > 0) & ((have < 0.4 * words) & (numbers < 0.25 * ink) | (letters + numbers < 0.35 * ink) | (words == 0) & (numbers < 0.25 * ink))
    for row in np.flatnonzero(junk):
        junk[row] = len(_LISTED.findall(raw[row])) < 0.4 * len(lines_of[row])
    junk |= np.array([r.count("(cid:") > 5 for r in raw])
    rows: list[tuple] = []

    def emit(row: int, k: int, kind: str, line: str | None, top: int = 0, bottom: int = 0, lines: int = 0, key: str | None = None) -> None:
        rows.append((row, k + 1, kind, line, top, bottom, lines, key))

    # words broken over two lines; soft hyphens are dropped by the plain form, so line ends are read in the text as stored
    in_broken = set()
    last_word_of, first_word_of = np.full(len(line_starts), -1), np.full(len(line_starts), -1)
    if len(starts):
        last_word_of[line_of] = np.arange(len(starts))
        first_word_of[line_of[::-1]] = np.arange(len(starts))[::-1]
    ends_of = [(row, k, *parts) for row in range(n) if not junk[row] and raw[row] for k, parts in joints(lines_of[row]).items()]
    plain_parts = [(A.plain(left).lower(), A.plain(right).lower()) for _, _, left, _, right in ends_of]
    state_of = known([w for x, y in plain_parts for w in (x, y, x + y)]).reshape(-1, 3).tolist()
    broken = []
    joined: dict[tuple, bool] = {}
    for (row, k, left, hyphen, right), state in zip(ends_of, state_of):
        like = tuple(joint_features(left, hyphen, right, tuple(state)))
        if like not in joined:
            joined[like] = editor.joins(left, hyphen, right, tuple(state))
        if joined[like]:
            emit(row, k, "hyphen", "keep" if state == [True, True, False] else "join")
            i, j = last_word_of[first_line[row] + k], first_word_of[first_line[row] + k + 1]
            if i >= 0 and j >= 0:
                in_broken.update((int(i), int(j)))
                broken.append((row, k, text[starts[i]:ends[i]].lower(), text[starts[j]:ends[j]].lower()))
    for (row, k, x, y), there in zip(broken, known([x + y for _, _, x, y in broken])):
        if not there:
            emit(row, k, "broken", x + y, len(x))
    # words not known for sure
    for i in np.flatnonzero(~sure & ~junk[of_text]).tolist() if len(starts) else ():
        w = text[starts[i]:ends[i]]
        if i in in_broken or len(w) <= 5 and w.isupper() and w.isascii() and w.isalpha():
            continue  # a code
        if w[-1] in "eE" and text[ends[i]:ends[i] + 1] == "-" and w[:-1].isdigit():
            continue  # a figure with an exponent
        name = w[:1].isupper() and w[1:].islower() and w.isalpha()
        row = int(of_text[i])
        k = int(line_of[i] - first_line[row])
        low = w.lower()
        if correctable(low):
            emit(row, k, "word", low, int(name))
        bare = low.rstrip(_MARKED)
        if bare != low and correctable(bare):
            emit(row, k, "word", bare, int(name))
    if editor.wide:
        confused = np.flatnonzero(wide)
        confused = confused[np.isin(batch.raw[confused], np.array([ord(c) for c in editor.wide], np.uint32))]
        if len(confused):
            codes = batch.raw
            # neighbours across a line break count as neighbours
            before = np.where((confused > 1) & (codes[confused - 1] == 10), confused - 2, confused - 1)
            after = np.where((codes[np.minimum(confused + 1, len(codes) - 1)] == 10) & (confused + 2 < len(codes)), confused + 2, confused + 1)
            first, middle, last = (codes[at].astype(np.uint64) for at in (np.maximum(before, 0), confused, np.minimum(after, len(codes) - 1)))
            keys = (first << np.uint64(42)) | (middle << np.uint64(21)) | last
            unsure = ~_isin(keys, scanner.sure_wide)[0]
            for i, key in zip(confused[unsure].tolist(), keys[unsure].tolist()):
                line = int(np.searchsorted(line_ends, i))
                row = int(owner[line])
                if not junk[row]:
                    emit(row, line - int(first_line[row]), "wide", _triple(key), i - int(line_starts[line]))
    # inked lines of texts that aren't junk, with their places among those of their text
    inked = np.flatnonzero((dark[line_ends] > dark[line_starts]) & ~junk[owner])
    of = owner[inked]
    count = np.bincount(of, minlength=n)
    top = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    bottom = count[of] - 1 - top
    at = np.flatnonzero(np.minimum(top, bottom) < EDGE)
    for row, k, a, b, many in zip(of[at].tolist(), (inked[at] - first_line[of[at]]).tolist(), top[at].tolist(), bottom[at].tolist(), count[of[at]].tolist()):
        line = lines_of[row][k]
        if len(line.strip()) <= HEAD_CHARS:
            emit(row, k, "edge", line, a, b, many, edge_key(line))
    row_of, *rest = zip(*rows) if rows else [()] * 8
    values = [*([columns[c][row] for row in row_of] for c in ("id", "article_id", "page_number")), *rest]
    return pa.RecordBatch.from_arrays([pa.array(c, {"string": pa.string(), "int": pa.int32()}[f.dataType.simpleString()]) for c, f in zip(values, LINES)], names=LINES.names)


def _furniture(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """``layer_id, line_no, kind`` of running heads and page numbers among the edge lines."""
    edges = lines.where("kind = 'edge'")
    # returns: pages of the article with the same letters at an edge; elsewhere: articles with them. Only heads that
    # return, and letters found in several articles, are kept: few rows, so the lines needn't be shuffled for them
    by_page = edges.where("key is not null").select("article_id", "key", "page_number").distinct()
    returns = stored(by_page.groupBy("article_id", "key").agg(F.count("*").alias("returns")))
    elsewhere = checked_broadcast(stored(returns.groupBy("key").agg(F.count("*").alias("elsewhere")).where("elsewhere > 2")))
    again = checked_broadcast(stored(returns.where("returns > 1")))
    about = checked_broadcast(stored(articles.select(F.col("id").alias("article_id"), "title", "journal").where("title is not null or journal is not null").dropDuplicates(["article_id"])))
    columns = ["layer_id", "article_id", "line_no", "text", "from_top", "from_bottom", "lines"]

    def described(rows: DataFrame) -> DataFrame:
        """Edge lines with what their features ask for. Lines without letters meet no counts, so they make no hot key."""
        one = F.lit(1)
        counted = rows.where("key is not null").join(again, ["article_id", "key"], "left").join(elsewhere, "key", "left")
        every = counted.select(*columns, F.coalesce("returns", one).cast("int").alias("returns"), F.coalesce("elsewhere", one).cast("int").alias("elsewhere")).union(
            rows.where("key is null").select(*columns, one.alias("returns"), one.alias("elsewhere")))
        return every.join(about, "article_id", "left").drop("article_id")

    full = stored(described(edges.where("least(from_top, from_bottom) < 2")))
    sample = [r.asDict() for r in sampled(full, F.concat_ws("/", "layer_id", "line_no"), FURNITURE_LINES).collect()]
    model = lines.sparkSession.sparkContext.broadcast(train_furniture(sample).rows(_KINDS))

    def furniture(columns: dict) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        names = list(columns)
        made: dict[tuple, tuple] = {}
        weights = model.value
        for values in zip(*columns.values()):
            e = dict(zip(names, values))
            kind = furniture_kind(e, weights, made)
            if kind:
                for column, v in zip(out, (e["layer_id"], e["line_no"], kind, e["from_top"], e["from_bottom"])):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["layer_id", "line_no", "kind", "from_top", "from_bottom"])

    def judged(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(A.map_arrow(furniture), "layer_id string, line_no int, kind string, from_top int, from_bottom int")

    outer = stored(judged(full))
    # the lines further in are furniture only where all lines outside them are, so they are judged only there
    found = outer.select("layer_id", "line_no", "kind")
    sides = [outer.groupBy("layer_id").agg(F.sum((F.col(side) < 2).cast("int")).alias("n")).where("n = 2").select("layer_id", F.lit(side).alias("side")) for side in ("from_top", "from_bottom")]
    both = checked_broadcast(stored(sides[0].union(sides[1]).withColumnRenamed("layer_id", "of")))
    for depth in range(2, EDGE):
        inner = edges.where(f"least(from_top, from_bottom) = {depth}").join(both, F.expr(f"layer_id = of and case side when 'from_top' then from_top else from_bottom end = {depth}"), "left_semi")
        found = found.union(judged(described(inner)).select("layer_id", "line_no", "kind"))
    return stored(found)


def _halves(columns: dict) -> pa.RecordBatch:
    """On which of its two lines a broken word was misread."""
    out: list[list] = [[], [], [], []]
    for layer, line, word, clean, cut in zip(*(columns[c] for c in ("layer_id", "line_no", "word", "clean", "from_top"))):
        places = [i for i, _, _ in edits(word, clean)]
        for there, k in ((any(i < cut for i in places), line), (any(i >= cut for i in places), line + 1)):
            if there:
                for column, v in zip(out, (layer, k, word, clean)):
                    column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["layer_id", "line_no", "word", "clean"])


def noise(layers: DataFrame, articles: DataFrame, scanner: Scanner) -> DataFrame:
    """``layer_id, line_no, kind, word, clean``: every noise of every line. ``misread`` rows tell the word (or trigram) and what it was,
    ``hyphen`` rows in clean whether the word keeps its hyphen."""
    spark = layers.sparkSession
    light = Scanner(scanner.editor, None, None, scanner.known, scanner.sure, scanner.sure_wide)
    shipped = spark.sparkContext.broadcast(light)

    def scan(columns: dict) -> pa.RecordBatch:
        return scan_lines(columns, shipped.value)

    lines = stored(layers.select("id", "article_id", "page_number", "text").where("text is not null").mapInArrow(A.map_arrow(scan, 2_000_000), LINES), "kind")
    found = _furniture(lines, articles)
    asked = lines.where("kind in ('word', 'broken', 'wide')").select("layer_id", "line_no", "kind", F.col("text").alias("word"), "from_top")
    right = checked_broadcast(scanner.corrections)
    words = asked.where("kind = 'word'").join(right, "word").where("from_top = 0 or often_capital").select("layer_id", "line_no", "word", "clean")
    wide = asked.where("kind = 'wide'").join(checked_broadcast(scanner.wide_corrections), "word").select("layer_id", "line_no", "word", "clean")
    broken = asked.where("kind = 'broken'").join(right, "word").select("layer_id", "line_no", "word", "clean", "from_top").mapInArrow(A.map_arrow(_halves), "layer_id string, line_no int, word string, clean string")
    misread = words.union(wide).union(broken).withColumn("kind", F.lit("misread"))
    hyphens = lines.where("kind = 'hyphen'").select("layer_id", "line_no", F.lit(None).cast("string").alias("word"), F.col("text").alias("clean"), "kind")
    text = misread.union(hyphens).join(found.select("layer_id", "line_no"), ["layer_id", "line_no"], "left_anti")
    none = F.lit(None).cast("string")
    columns = ["layer_id", "line_no", "kind", "word", "clean"]
    return text.select(*columns).union(found.select("layer_id", "line_no", "kind", none.alias("word"), none.alias("clean")))


def noisy_lines(layers: DataFrame, articles: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``layer_id, line_no, kind``: lines with scanning noise (kinds hyphen, header, page_no, misread).

    Lines are counted from 1 and split at LF. Null and blank texts and layers of junk have none. Rows
    delivered twice are separate layers. Article columns may be null or missing rows: running heads are then
    known by their return on other pages alone. Without pages in two layers nothing is learned of misread words.
    """
    return noise(layers, articles, scanner if scanner is not None else learn_scanner(layers)).select("layer_id", "line_no", "kind").distinct()


def repair(layers: DataFrame, articles: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``layer_id, text``: every layer (or page, with a scanner learned from layers) as continuous paragraphs: furniture dropped, broken
    words joined, misread words corrected, lines of a paragraph joined by spaces (by nothing between characters of
    scripts without spaces). Null stays null; tables and lists keep their lines."""
    scanner = scanner if scanner is not None else learn_scanner(layers)
    found = noise(layers, articles, scanner).groupBy("layer_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "clean")).alias("noise"))

    def mend(columns: dict) -> pa.RecordBatch:
        texts = [None if t is None else mended(t, [(r["line_no"], r["kind"], r["word"], r["clean"]) for r in rows or ()]) for t, rows in zip(columns["text"], columns["noise"])]
        return pa.RecordBatch.from_arrays([pa.array(columns["layer_id"], pa.string()), pa.array(texts, pa.string())], names=["layer_id", "text"])

    return layers.select(F.col("id").alias("layer_id"), "text").join(found, "layer_id", "left").mapInArrow(A.map_arrow(mend), "layer_id string, text string")


def _as_written(clean: str, word: str) -> str:
    return clean.upper() if word.isupper() and len(word) > 1 else clean[:1].upper() + clean[1:] if word[:1].isupper() else clean


_ANY_WORD = re.compile(r"[^\W_]*[!+]*[^\W_]+(?:[!+]+[^\W_]*)*")


def mended(text: str, noise: list[tuple[int, str, str | None, str | None]]) -> str:
    """A text with its noise (``line_no, kind, word, clean``) taken out."""
    lines = text.split("\n")
    kinds: dict[int, dict[str, str | None]] = defaultdict(dict)
    words: dict[int, dict[str, str]] = defaultdict(dict)
    for no, kind, word, clean in noise:
        if kind == "misread" and word:
            words[no][word] = clean
        else:
            kinds[no][kind] = clean
    paragraphs: list[str] = []
    current = ""
    width = max((len(x) for x in lines), default=0)
    joint: str | None = None
    broken: dict[str, str] = {}

    def corrected(part: str, known: dict[str, str]) -> str:
        def word(m: re.Match) -> str:
            w = A.plain(m.group())
            low = w.lower()
            clean = known.get(low) or known.get(low.rstrip(_MARKED))
            return _as_written(clean, w) if clean else m.group()

        if not known:
            return part
        for triple in (k for k in known if len(k) == 3 and _is_wide(k[1])):
            part = part.replace(triple, known[triple])
        return _ANY_WORD.sub(word, part)

    for no, line in enumerate(lines, 1):
        if "header" in kinds[no] or "page_no" in kinds[no]:
            continue
        bare = line.strip()
        if not bare or line.startswith("  ") and current and not joint:
            if current:
                paragraphs.append(current)
            current = ""
            if not bare:
                continue
        hyphen = kinds[no].get("hyphen")
        if hyphen:
            bare = bare[:-1]
        bare = corrected(bare, words[no])
        if not current:
            current = bare
        elif joint:
            head, tail = re.search(r"\S*$", current).start(), re.match(r"\S*", bare).end()
            whole = current[head:] + ("-" if joint == "keep" else "") + bare[:tail]
            current = current[:head] + corrected(whole, broken | words[no]) + bare[tail:]
        elif len(lines[no - 2]) < 0.6 * width or re.match(r"\[\d+\]|\([a-z]\)|[•–—-] ", bare) or "\t" in bare:
            paragraphs.append(current)
            current = bare
        else:
            current += ("" if _is_wide(current[-1]) and _is_wide(bare[0]) else " ") + bare
        joint, broken = hyphen, words[no]
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)
