"""Sentence boundaries in many languages and scripts (problem 4).

Every mark that may end a sentence is a candidate, with the closing quotes and
brackets behind it. A maximum-entropy model over neighbouring tokens, their
case, length, digits and script decides. It is trained on boundaries that are
reliable without any labels: marks at the end of a paragraph end sentences; marks
before a lower-case word that never opens a paragraph don't; tokens that stand
before a mark often and before a paragraph's end never are abbreviations. A
break between paragraphs, a heading included, is no candidate: it always counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrays import map_arrow, plain
from foliomill.llm.common import sampled
from foliomill.llm.tokenize import _arrow_type

#: Most texts that the model is fitted on.
TRAINING_TEXTS = 6000
#: Characters used of a text longer than this, in fitting only.
TRAINING_CHARS = 8000
DIMENSIONS = 1 << 17
EPOCHS = 6
OFTEN = 12

_CLOSING = "»”\"'’)\\]」』）］〉》"
CANDIDATE = re.compile(rf"(?:[.!?…。！？｡．]+)[​-‍⁠﻿\xad]*(?:[​-‍⁠﻿\xad \xa0  ]?»|[{_CLOSING}]|(?<=[.!?…])“)*")
_BREAK = re.compile(r"[^\S\n\r\x85  ]*[\n\r\x0b\x0c\x85  ]\s*")
_ENDED = re.compile(rf"(?:{CANDIDATE.pattern})$")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_OPENING = "«“„\"'‘(「『（¿¡[—–-"
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[぀-ヿ㐀-鿿]{1,2}|[^\W\d_぀-ヿ㐀-鿿]+|\S")


def _shape(token: str) -> str:
    """Digits as 0; a single capital as X."""
    if token[:1].isdigit():
        return "0.0" if "." in token or "," in token else "0"
    if len(token) == 1 and token.isupper():
        return "X"
    return token


def _candidates(text: str) -> list[tuple]:
    """Of each mark: start, end, start of what follows, its kind and the tokens around it."""
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        after = end
        n = len(text)
        while after < n and text[after].isspace():
            after += 1
        gap = text[end:after]
        before = _TOKEN.findall(plain(text[max(0, start - 32):start]))[-2:]
        ahead = _TOKEN.findall(plain(text[after:after + 40]))[:3]
        mark = _UNSEEN.sub("", m.group()).replace(" ", "").replace("\xa0", "")
        kind = "end" if after >= n else "line" if any(c in "\n\r\x0b\x0c\x85  " for c in gap) else "gap" if gap else "none"
        prev = before[-1] if before else "^"
        prev2 = before[-2] if len(before) > 1 else "^"
        if prev2 in "°№§":
            prev = prev2 + prev
        touching = start > 0 and not text[start - 1].isspace()
        opens = text.rfind("\n", 0, start) + 1 >= start - len(prev)  # the token before is the first of its line
        out.append((start, end, after, kind, prev, prev2, mark, ahead, touching, opens))
    return out


def _first_word(ahead: list[str]) -> tuple[str, str, str]:
    """The opening marks, the first word behind them, and the token after it."""
    opening = ""
    rest = list(ahead)
    while rest and rest[0] in _OPENING:
        opening += rest.pop(0)
    return opening, rest[0] if rest else "$", rest[1] if len(rest) > 1 else "$"


def _opener(word: str, after: str) -> str:
    """What may open a sentence: a word, or a number with the token behind it."""
    return f"{_shape(word)} {after}" if word[:1].isdigit() else _shape(word)


def _script(token: str) -> str:
    c = token[:1]
    if c.isdigit():
        return "0"
    if "぀" <= c <= "鿿":
        return "cj"
    if c.isalpha():
        return "U" if c.isupper() else "l"
    return c or "$"


def _features(c: tuple, known: dict) -> list[str]:
    _, _, _, kind, prev, prev2, mark, ahead, touching, opens = c
    opening, word, word2 = _first_word(ahead)
    p, w = _shape(prev), _opener(word, word2)
    ends, opens_paragraph = known["ends"], known["opens"]
    key = f"{p} {mark}"
    rate = ends.get(key, "new")
    start = opens_paragraph.get(w, "new")
    return [
        "bias", f"m={mark}", f"m={mark}|s={_script(word)}|g={kind != 'none'}", f"p={p.lower()}", f"p={p.lower()}|m={mark}", f"q={_shape(prev2).lower()}|p={p.lower()}",
        f"n={w}", f"n={w}|o={opening}", f"p={p.lower()}|s={_script(word)}", f"o={opening}|m={mark}", f"ps={_script(prev)}|pl={min(len(prev), 6)}|s={_script(word)}",
        f"r={rate}", f"b={start}", f"r={rate}|b={start}|m={mark}", f"b={start}|s={_script(word)}|m={mark}|g={kind != 'none'}", f"w2={_shape(word2)}|n={w}|m={mark}",
        f"t={touching}|m={mark}", f"f={opens}|ps={_script(prev)}|m={mark}",
    ]


def _hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) & (DIMENSIONS - 1) for f in features]


def train(texts: list[str]) -> dict:
    """The model: weights, and what is known of tokens before marks and at paragraph starts."""
    every = [_candidates(t[:TRAINING_CHARS]) for t in texts]
    ends, all_ends, starts, inside = Counter(), Counter(), Counter(), Counter()
    for text, found in zip(texts, every):
        text = text[:TRAINING_CHARS]
        for line in re.split(r"[\n\r\x0b\x0c\x85  ]+", text):
            tokens = _TOKEN.findall(plain(line))
            if not tokens:
                continue
            _, first, second = _first_word(tokens[:3])
            starts[_opener(first, second)] += 1
            inside.update(_opener(b, c) for a, b, c in zip(tokens, tokens[1:], [*tokens[2:], "$"]) if a not in ".!?…。！？»”“")
        for c in found:
            key = f"{_shape(c[4])} {c[6]}"
            all_ends[key] += 1
            ends[key] += c[3] in ("end", "line")

    def grade(yes: int, every: int) -> str:
        if not yes:
            return "never" if every >= OFTEN else "rare"
        return "often" if yes >= 0.03 * every else "seldom"

    known = {
        "ends": {k: grade(ends[k], n) for k, n in all_ends.items()},
        "opens": {w: grade(starts[w], starts[w] + inside[w]) for w in set(starts) | {w for w, n in inside.items() if n >= OFTEN}},
    }
    rows, labels = [], []
    for found in every:
        for c in found:
            y = _reliable(c, known)
            if y is not None:
                rows.append(_hashed(_features(c, known)))
                labels.append(y)
    return {"weights": _fit(rows, labels), "known": known}


def _reliable(c: tuple, known: dict) -> int | None:
    """1 or 0 where the surroundings leave no doubt, else None."""
    kind, prev, mark = c[3], c[4], c[6]
    if kind in ("end", "line"):
        return None if kind == "end" else 1
    opening, word, word2 = _first_word(c[7])
    p, w = _shape(prev), _opener(word, word2)
    start = known["opens"].get(w, "rare")
    script = _script(word)
    if c[9] and prev[:1].isdigit():
        return 0  # the number of a heading or list item
    if not opening and (script == "l" and start in ("never", "rare") or script in ",;:)]»”/、，" or word in "[—–"):
        return 0
    if kind == "none" and mark == "." and (script in "0l" or p == "X"):
        return 0
    rate = known["ends"].get(f"{p} {mark}", "rare")
    if rate == "never":
        return 0
    if mark[-1:] not in ".…" and mark in "。！？!?" and (script in ("U", "cj", "0") or opening):
        return 1
    if start == "never" and not opening:
        return 0
    if p == "X" and start in ("rare", "never"):
        return 0
    if start in ("often", "seldom") and rate in ("often", "seldom"):
        return 1
    if script in ("U", "cj") and start in ("often",) and len(prev) >= 4 and prev.islower():
        return 1
    if opening and rate in ("often", "seldom"):
        return 1
    return None


def _fit(rows: list[list[int]], labels: list[int]) -> np.ndarray:
    """Logistic regression by Adagrad over mini-batches; the order of rows is fixed."""
    weights = np.zeros(DIMENSIONS)
    if not rows:
        return weights.astype(np.float32)
    x, y = np.array(rows), np.array(labels, float)
    squares = np.full(DIMENSIONS, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            p = 1 / (1 + np.exp(-np.clip(weights[x[batch]].sum(1), -30, 30)))
            error = np.repeat((p - y[batch])[:, None], x.shape[1], 1).ravel()
            at, where = np.unique(x[batch].ravel(), return_inverse=True)
            g = np.bincount(where, error) + 1e-4 * weights[at]
            squares[at] += g * g
            weights[at] -= 0.3 * g / np.sqrt(squares[at])
    return weights.astype(np.float32)


def boundaries(text: str, model: dict) -> list[int]:
    """The 0-based offsets of the first characters of all sentences."""
    return _starts([text], model)[0]


def _starts(texts: list[str], model: dict) -> list[list[int]]:
    weights, known = model["weights"], model["known"]
    found = [_candidates(t) for t in texts]
    unsure = [(i, c) for i, cs in enumerate(found) for c in cs if c[3] in ("gap", "none")]
    keep: list[set[int]] = [set() for _ in texts]
    if unsure:
        score = weights[np.array([_hashed(_features(c, known)) for _, c in unsure])].sum(1)
        for (i, c), s in zip(unsure, score):
            if s > 0:
                keep[i].add(c[2])
    out = []
    for i, text in enumerate(texts):
        stripped = len(text) - len(text.lstrip())
        if stripped == len(text):
            out.append([])
            continue
        starts = {stripped} | keep[i]
        for m in _BREAK.finditer(text):
            after = m.end()
            if after < len(text) and m.start() > stripped and _breaks(text, m):
                starts.add(after)
        out.append(sorted(starts))
    return out


def _breaks(text: str, m: re.Match) -> bool:
    """Whether a line break ends a sentence: not inside a paragraph that is wrapped in lines."""
    if sum(c in "\n\x85  " for c in m.group()) > 1 or m.group().endswith("  "):
        return True
    line = text[text.rfind("\n", 0, m.start()) + 1:m.start()].rstrip()
    if _ENDED.search(line[-12:]):
        return True
    return len(line) <= 32 and not text[m.end()].islower()


def learn(df: DataFrame, key: str = "id", text: str = "text", rows: int = TRAINING_TEXTS) -> dict:
    """A model fitted on at most ``rows`` texts (one bounded collect)."""
    texts = sampled(df.select(key, F.substring(text, 1, TRAINING_CHARS).alias("text")).where(F.length(F.trim("text")) > 0), key, rows)
    return train([r.text for r in texts.select("text").collect()])


def split(df: DataFrame, key: str = "id", text: str = "text", model: dict | None = None) -> DataFrame:
    """``key, sent_no, sent_start, sent_end``: every sentence of every text, offsets in code points.

    Null, empty and blank texts give no rows; a text without any mark is one sentence. White space
    between sentences belongs to none. Repeated rows are split as often as they stand there. Other
    columns are left out. One pass without a shuffle once the model is fitted.
    """
    fitted = model if model is not None else learn(df, key, text)
    kind = df.schema[key].dataType
    key_type = _arrow_type(kind)
    shipped = df.sparkSession.sparkContext.broadcast(fitted)

    def run(columns: dict) -> pa.RecordBatch:
        texts = [t or "" for t in columns["text"]]
        starts = _starts(texts, shipped.value)
        keys, numbers, begin, end = [], [], [], []
        for k, t, s in zip(columns["key"], texts, starts):
            keys.extend([k] * len(s))
            numbers.extend(range(len(s)))
            begin.extend(s)
            end.extend(a + len(t[a:b].rstrip()) for a, b in zip(s, [*s[1:], len(t)]))
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(numbers, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["key", "sent_no", "sent_start", "sent_end"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(
        map_arrow(run), f"key {kind.simpleString()}, sent_no int, sent_start int, sent_end int").withColumnRenamed("key", key)
