"""Statistics of a document's text, and its lines told apart as prose, list, table and junk (problem 1).

Line statistics come from array operations over whole batches. A hidden Markov
model over them labels each line; label shares by characters describe the
document. Emissions are products of categorical distributions, one per
statistic. They start from lines that plain rules are sure of and are refitted
by a few rounds of expectation maximisation in which those lines keep their
label. What counts as a common word, and the model, come from the whole texts of
all layers: one pass counts words, a second packs each line's statistics into a
number, and the rounds read those numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm import arrays as A
from foliomill.llm.common import stored
from foliomill.llm.tokenize import _arrow_type

#: States of the model; prose and junk come in several sorts that have little in common.
PROSE, LIST, TABLE, SYMBOLS, LETTERS, FRAGMENTS, WIDE_PROSE = range(7)
STATES = 7
KINDS = ["prose", "list", "table", "junk"]
KIND_OF = np.array([0, 1, 2, 3, 3, 3, 0])
ROUNDS = 3
#: A word is common if it stands in this share of the layers that aren't blank (and in three of them at least).
COMMON_SHARE = 0.0025
LEVELS = 7
#: The smoothing of the model holds for so many layers and grows with more, so that what it smooths stays the same share.
USUAL_LAYERS = 3000
#: Words counted in a worker before they are sent on.
CACHE_WORDS = 1_000_000
#: Lines labelled at once.
MOST_LINES = 200_000
#: Parts of a line's weight that the sums of a round are kept in: whole numbers, the same in any order of adding.
FINE = 1 << 20
FEATURES = ["letters", "digits", "symbols", "common", "numeric", "gaps", "opens", "closes", "words", "variety", "leaders", "mixed", "wide"]

_BULLETS = "•‣▪◦·*–—-−○●■"
_ENDS = ".!?…。！？:;»”\"'）)"


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(A.TABLE_SIZE, bool)
    table[[ord(c) for c in chars]] = True
    return table


_IS_BULLET, _IS_END, _IS_NUMBER_MARK = _flags(_BULLETS), _flags(_ENDS), _flags(".,+-±−–%eE")
_ORDINARY = _flags(".,;:!?()'\"-–—“”„«»、。，（）「」’…/%°&[]")
_DASH = _flags("—–=:")


def _levels(share: np.ndarray) -> np.ndarray:
    return np.digitize(share, [0.02, 0.1, 0.25, 0.45, 0.65, 0.85])


def line_statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each line of all texts (see FEATURES; ``levels`` holds them discretised)."""
    batch = A.TextBatch(texts)
    codes, classes = batch.codes, batch.classes
    starts, ends, owner = batch.line_bounds()
    n = len(starts)
    line = np.repeat(np.arange(n), ends - starts + 1)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[mask], minlength=n).astype(float)

    space = classes == A.SPACE
    wide = (classes == A.HAN) | (classes == A.KANA)
    narrow = (classes == A.LATIN) | (classes == A.CYRILLIC) | (classes == A.GREEK) | (classes == A.LETTER) | (classes == A.MARK)
    letter = wide | narrow
    digit = classes == A.DIGIT
    ink = per_line(~space)
    some = np.maximum(ink, 1)
    n_letters, n_digits, n_wide = per_line(letter), per_line(digit), per_line(wide)
    symbols = per_line(~space & ~letter & ~digit & ~_ORDINARY[codes])
    # words and the share of them that are common (pairs of characters in scripts without spaces)
    ws, we = A.runs(narrow)
    word_line = line[ws]
    hashes = A.span_hashes(batch.lower, ws, we)
    known = _isin(hashes, common)
    n_words = np.bincount(word_line, minlength=n).astype(float)
    length = (we - ws).astype(float)
    at = np.flatnonzero(wide)
    pair = at[:-1][np.diff(at) == 1] if len(at) > 1 else at[:0]
    pair_known = _isin(_pair_hash(codes, pair), common)
    known_letters = np.bincount(word_line[known], weights=length[known], minlength=n) + np.bincount(line[pair[pair_known]], minlength=n)
    counted = np.bincount(word_line, weights=length, minlength=n) + np.bincount(line[pair], minlength=n)
    n_common = np.bincount(word_line[known], minlength=n) + np.bincount(line[pair[pair_known]], minlength=n)
    n_units = n_words + np.bincount(line[pair], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, word_line, length)
    # tokens between spaces, numeric ones, and gaps of columns
    ts, te = A.runs(~space & (codes != 59) & (codes != 124))
    tok_line = line[ts] if len(ts) else ts
    cum_num = np.concatenate([[0], np.cumsum(digit | _IS_NUMBER_MARK[codes])])
    cum_digit = np.concatenate([[0], np.cumsum(digit)])
    numeric = (cum_num[te] - cum_num[ts] == te - ts) & (cum_digit[te] - cum_digit[ts] > 0)
    n_tokens = np.bincount(tok_line, minlength=n).astype(float)
    n_numeric = np.bincount(tok_line[numeric], minlength=n).astype(float)
    pipe = (codes == 124) | (codes == 9) | (codes == 59)
    gap_s, gap_e = A.runs(space & (batch.raw != 10))
    gap = gap_e - gap_s >= 2
    inner = gap & (gap_s > starts[line[gap_s]] if len(gap_s) else gap)
    gaps = np.bincount(line[gap_s[inner]], minlength=n) + per_line(pipe)
    # how the line opens and closes
    first = np.full(n, 10, np.int64)
    last = np.full(n, 10, np.int64)
    opens, closes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(ts):
        head = np.flatnonzero(np.concatenate([[True], tok_line[1:] != tok_line[:-1]]))
        tail = np.concatenate([head[1:] - 1, [len(ts) - 1]])
        rows = tok_line[head]
        first[rows] = ts[head]
        last[rows] = te[tail] - 1
        c = codes[ts[head]]
        k2 = classes[np.minimum(ts[head] + 1, len(codes) - 1)]
        end = codes[te[head] - 1]
        size = te[head] - ts[head]
        kind = np.full(len(head), 1)
        kind[digit[ts[head]]] = 2
        kind[digit[ts[head]] & ((end == 46) | (end == 41)) & (size <= 5)] = 3
        kind[(c == 91) & (k2 == A.DIGIT)] = 4
        kind[(c == 40) & (size <= 5) & (end == 41)] = 5
        kind[_IS_BULLET[c] & (size == 1)] = 6
        second = np.minimum(head + 1, len(ts) - 1)
        defines = (tok_line[second] == rows) & (second > head) & (te[second] - ts[second] == 1) & _DASH[codes[ts[second]]] & narrow[ts[head]]
        kind[defines & (size >= 2)] = 7
        comma = narrow[ts[head]] & (end == 44) & (tok_line[second] == rows) & (second > head) & digit[ts[second]]
        kind[comma] = 8
        opens[rows] = kind
        z = codes[te[tail] - 1]
        zk = classes[te[tail] - 1]
        closing = np.where(_IS_END[z], 1, np.where(zk == A.DIGIT, 2, np.where(letter[te[tail] - 1], 3, 4)))
        closes[rows] = closing
    leaders = np.zeros(n)
    ds, de = A.runs((codes == 46) | (codes == 0x2026) | (codes == 0xB7))
    long = de - ds >= 4
    np.add.at(leaders, line[ds[long]], 1)
    # variety: how often a character differs from the one before
    change = np.concatenate([[True], codes[1:] != codes[:-1]]) & ~space
    variety = per_line(change) / some
    cid = np.zeros(n)
    if len(codes) > 5:
        hit = np.flatnonzero((codes[:-4] == 40) & (codes[1:-3] == 99) & (codes[2:-2] == 105) & (codes[3:-1] == 100) & (codes[4:] == 58))
        np.add.at(cid, line[hit], 5)
    symbols = symbols + cid
    # lower-case and upper-case letters and digits mixed inside a token: not a word of any language
    swap = np.concatenate([[False], (narrow[1:] & digit[:-1]) | (digit[1:] & narrow[:-1])])
    mixed = per_line(swap) / some
    common_share = np.where(counted > 0, known_letters / np.maximum(counted, 1), 0.0)
    levels = np.stack([
        _levels(n_letters / some), _levels(n_digits / some), _levels(np.minimum(1, symbols / some)),
        np.where(counted >= 3, 1 + _levels(common_share), 0).clip(0, LEVELS), _levels(n_numeric / np.maximum(n_tokens, 1)),
        np.minimum(gaps, 4).astype(int), opens.clip(0, 8), closes, np.digitize(n_tokens + n_wide / 2, [1, 2, 4, 7, 12, 25]),
        np.digitize(variety, [0.3, 0.6, 0.85, 0.95]), np.minimum(leaders, 2).astype(int), np.digitize(mixed + (longest > 40), [0.03, 0.1, 0.3]), np.digitize(n_wide / some, [0.02, 0.3]),
    ], 1).astype(np.int64)
    return {
        "owner": owner, "chars": (ends - starts).astype(float), "ink": ink, "levels": levels, "letters": n_letters, "symbols": symbols, "digits": n_digits, "words": n_words,
        "word_letters": np.bincount(word_line, weights=length, minlength=n), "units": n_units, "common_units": n_common, "ends_well": closes == 1, "common": common_share,
        "numeric": n_numeric, "tokens": n_tokens, "opens": opens, "gaps": gaps, "leaders": leaders, "variety": variety, "counted": counted, "mixed": mixed, "longest": longest, "wide": n_wide,
    }


def _pair_hash(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint64)
    return A.mix((c[at] << np.uint64(24)) + c[at + 1] + np.uint64(1 << 58)) if len(at) else np.zeros(0, np.uint64)


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def layer_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words (and pairs of characters) of texts, and how many of the texts have each."""
    batch = A.TextBatch(texts)
    classes = batch.classes
    narrow = (classes == A.LATIN) | (classes == A.CYRILLIC) | (classes == A.GREEK) | (classes == A.LETTER) | (classes == A.MARK)
    wide = (classes == A.HAN) | (classes == A.KANA)
    ws, we = A.runs(narrow)
    at = np.flatnonzero(wide)
    pair = at[:-1][np.diff(at) == 1] if len(at) > 1 else at[:0]
    h = np.concatenate([A.span_hashes(batch.lower, ws, we), _pair_hash(batch.codes, pair)])
    doc = np.searchsorted(batch.ends, np.concatenate([ws, pair]))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]
    words = h[new]
    return words, np.bincount((np.cumsum(new) - 1)[once], minlength=len(words))


def _is_common(counts: np.ndarray, texts: int) -> np.ndarray:
    return counts >= max(3, COMMON_SHARE * texts)


def _sure(s: dict[str, np.ndarray]) -> np.ndarray:
    """Label of the lines that leave no doubt, else -1."""
    out = np.full(len(s["ink"]), -1)
    some = np.maximum(s["ink"], 1)
    letters, symbols = s["letters"] / some, s["symbols"] / some
    numeric = s["numeric"] / np.maximum(s["tokens"], 1)
    out[(s["common"] >= 0.55) & (s["tokens"] >= 4) & (letters > 0.6) & (s["opens"] <= 3) & (s["leaders"] == 0)] = PROSE
    wide = s["wide"] / some > 0.3
    out[wide & (s["common"] >= 0.35) & (s["ink"] >= 14) & (letters > 0.5) & (s["opens"] <= 3) & (s["leaders"] == 0)] = WIDE_PROSE
    out[(s["tokens"] >= 3) & (numeric >= 0.6) & (s["opens"] != 8)] = TABLE
    out[np.isin(s["opens"], (4, 5, 6, 7, 8)) & (s["ink"] >= 6) & (letters > 0.2) & (symbols < 0.2)] = LIST
    out[(s["opens"] == 6) & (s["common"] < 0.3) & (symbols > 0.3)] = -1
    out[(s["leaders"] > 0) & (letters > 0.15) & (s["common"] > 0.05)] = LIST
    long = (s["ink"] >= 15) & ~wide
    out[long & (s["mixed"] > 0.2) & (s["common"] < 0.1)] = FRAGMENTS
    out[long & (s["longest"] > 60) & (s["common"] < 0.1)] = FRAGMENTS
    out[long & (s["tokens"] >= 6) & (s["letters"] + s["digits"] < 2.5 * s["tokens"]) & (s["common"] < 0.1) & (numeric < 0.3)] = FRAGMENTS
    out[long & (s["tokens"] >= 3) & (s["common"] < 0.12) & (s["counted"] >= 12) & (letters > 0.6) & (s["opens"] <= 2) & (s["numeric"] < 2) & (s["leaders"] == 0) & (symbols < 0.35)] = LETTERS
    out[long & ((symbols > 0.35) | (s["variety"] < 0.35) & (letters + s["digits"] / some < 0.98))] = SYMBOLS
    return out


def _padded(owner: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts in groups of like numbers of lines: (line numbers, mask), texts x lines."""
    first = np.searchsorted(owner, np.arange(n))
    count = np.searchsorted(owner, np.arange(n), "right") - first
    order = np.argsort(count, kind="stable")
    out, at = [], 0
    while at < n:
        to = int(np.searchsorted(count[order], max(4, count[order[at]] * 1.5), "right"))
        group = order[at:max(to, at + 1)]
        width = int(count[group].max())
        index = first[group][:, None] + np.arange(width)
        mask = np.arange(width) < count[group][:, None]
        out.append((np.where(mask, index, 0), mask))
        at = max(to, at + 1)
    return out


def posteriors(log_emission: np.ndarray, owner: np.ndarray, n: int, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward over all texts: state probabilities of each line, summed transitions and starts."""
    start, move = model["start"], model["move"]
    out = np.zeros((len(log_emission), STATES))
    moves, starts = np.zeros((STATES, STATES)), np.zeros(STATES)
    scaled = np.exp(log_emission - log_emission.max(1, keepdims=True)) if len(log_emission) else log_emission
    for index, mask in _padded(owner, n):
        docs, width = index.shape
        b = scaled[index]
        alpha = np.zeros((docs, width, STATES))
        a = start * b[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, width):
            a = (alpha[:, t - 1] @ move) * b[:, t]
            a = np.where(mask[:, t, None], a, alpha[:, t - 1])
            alpha[:, t] = a / a.sum(1, keepdims=True)
        beta = np.ones((docs, STATES))
        gamma = np.zeros((docs, width, STATES))
        for t in range(width - 1, -1, -1):
            g = alpha[:, t] * beta
            gamma[:, t] = g / g.sum(1, keepdims=True)
            if t:
                nxt = b[:, t] * beta
                if model.get("count"):
                    xi = alpha[:, t - 1, :, None] * move * nxt[:, None, :]
                    xi /= np.maximum(xi.sum((1, 2), keepdims=True), 1e-300)
                    moves += (xi * mask[:, t, None, None]).sum(0)
                nb = nxt @ move.T
                nb /= nb.sum(1, keepdims=True)
                beta = np.where(mask[:, t, None], nb, beta)
        out[index[mask]] = gamma[mask]
        starts += gamma[:, 0].sum(0)
    return out, moves, starts


def _log_emission(levels: np.ndarray, blank: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = np.zeros((len(levels), STATES))
    for f in range(levels.shape[1]):
        out += tables[f][levels[:, f]]
    out[blank] = 0
    return out


def _packed(s: dict[str, np.ndarray]) -> np.ndarray:
    """One number for each line: its levels, the label it is sure of, and whether it is blank."""
    bits = (s["levels"] << (4 * np.arange(len(FEATURES)))).sum(1)
    return bits | (_sure(s) + 1) << (4 * len(FEATURES)) | (s["ink"] == 0).astype(np.int64) << (4 * len(FEATURES) + 3)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, sure labels and blanks of lines."""
    return packed[:, None] >> (4 * np.arange(len(FEATURES))) & 15, (packed >> (4 * len(FEATURES)) & 7) - 1, packed >> (4 * len(FEATURES) + 3) > 0


def _start() -> dict:
    return {"common": np.zeros(0, np.uint64), "start": np.full(STATES, 1 / STATES), "move": np.full((STATES, STATES), 0.02) + (1 - 0.02 * STATES) * np.eye(STATES), "tables": np.zeros((len(FEATURES), 10, STATES))}


def _sums(packed: np.ndarray, owner: np.ndarray, n: int, model: dict | None) -> np.ndarray:
    """What the tables, moves and starts of the next model are made of: summed weights of the states of all lines, by a model
    or, without one, of the sure lines alone."""
    levels, sure, blank = _unpacked(packed)
    weight = np.where(sure[:, None] >= 0, np.eye(STATES)[sure], 0.0)
    moves, starts = np.zeros((STATES, STATES)), np.zeros(STATES)
    if model is not None:
        emission = _log_emission(levels, blank, model["tables"])
        emission[sure >= 0] = np.where(np.eye(STATES)[sure[sure >= 0]] > 0, 0.0, -12.0)
        gamma, moves, starts = posteriors(emission, owner, n, model | {"count": True})
        # lines in doubt count half: they may refine the tables, not take them over
        weight = np.where(sure[:, None] >= 0, weight, 0.5 * gamma)
    weight[blank] = 0
    tables = np.zeros((len(FEATURES), 10, STATES))
    for f in range(len(FEATURES)):
        for k in range(STATES):
            tables[f, :, k] = np.bincount(levels[:, f], weights=weight[:, k], minlength=10)
    return np.concatenate([tables.ravel(), moves.ravel(), starts])


def _next(model: dict, sums: np.ndarray, texts: int, first: bool) -> dict:
    """The model that sums over so many texts give."""
    sums = sums * min(1.0, USUAL_LAYERS / max(1, texts))
    at, to = model["tables"].size, model["tables"].size + STATES * STATES
    tables = sums[:at].reshape(model["tables"].shape) + 0.5
    found = model | {"tables": np.log(tables / tables.sum(1, keepdims=True))}
    if not first:
        moves = sums[at:to].reshape(STATES, STATES) + 3 + 50 * np.eye(STATES)
        found |= {"move": moves / moves.sum(1, keepdims=True), "start": (sums[to:] + 2) / (sums[to:] + 2).sum()}
    return found


def train(texts: list[str]) -> dict:
    """Common words and the model's tables, of texts at hand (see learn)."""
    texts = [p for p in map(A.plain, texts) if p.strip()]
    model = _start()
    if not texts:
        return model
    words, counts = layer_words(texts)
    model["common"] = words[_is_common(counts, len(texts))]
    s = line_statistics(texts, model["common"])
    packed = _packed(s)
    for turn in range(ROUNDS + 1):
        model = _next(model, _sums(packed, s["owner"], len(texts), model if turn else None), len(texts), not turn)
    return model


STATISTICS = T.StructType([
    T.StructField("chars", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("words", T.LongType()), T.StructField("mean_word_length", T.DoubleType()),
    T.StructField("symbol_ratio", T.DoubleType()), T.StructField("lines_ending_in_punctuation", T.DoubleType()), T.StructField("common_words", T.DoubleType()),
    T.StructField("prose", T.DoubleType()), T.StructField("list", T.DoubleType()), T.StructField("table", T.DoubleType()), T.StructField("junk", T.DoubleType()),
])


_SHARES = len(STATISTICS) - len(KINDS)


def _totals(s: dict[str, np.ndarray], texts: list[str]) -> dict[str, np.ndarray]:
    """STATISTICS of texts but for the shares of kinds."""
    n, owner = len(texts), s["owner"]
    blank = s["ink"] == 0

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n)

    ink, lines, words = total(s["ink"]), total(~blank), total(s["words"])
    return {
        "chars": np.array([len(t) for t in texts], np.int64), "lines": lines.astype(np.int64), "words": words.astype(np.int64), "mean_word_length": total(s["word_letters"]) / np.maximum(words, 1),
        "symbol_ratio": total(s["symbols"]) / np.maximum(ink, 1), "lines_ending_in_punctuation": total(s["ends_well"] & ~blank) / np.maximum(lines, 1),
        "common_words": total(s["common_units"]) / np.maximum(total(s["units"]), 1),
    }


def _shares(packed: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int, model: dict) -> dict[str, np.ndarray]:
    """Shares of kinds of texts by the labels of their lines."""
    levels, _, blank = _unpacked(packed)
    label = KIND_OF[posteriors(_log_emission(levels, blank, model["tables"]), owner, n, model)[0].argmax(1)]
    chars = np.bincount(owner, weights=sizes * ~blank, minlength=n)
    return {name: np.bincount(owner, weights=sizes * ((label == k) & ~blank), minlength=n) / np.maximum(chars, 1) for k, name in enumerate(KINDS)}


def describe(texts: list[str], model: dict) -> dict[str, np.ndarray]:
    """STATISTICS of texts as columns."""
    s = line_statistics([A.plain(t) for t in texts], model["common"])
    return _totals(s, texts) | _shares(_packed(s), s["chars"], s["owner"], len(texts), model)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of a partition's texts: hashes of words with the texts that have them; null stands for the texts that aren't blank."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    texts = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, where = np.unique(np.concatenate([w for w, _ in kept]), return_inverse=True)
        return words, np.bincount(where, weights=np.concatenate([n for _, n in kept]), minlength=len(words)).astype(np.int64)

    def sent(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for part in A.parts(batch, 2_000_000):
            plain = [p for t in part.column(0).to_pylist() if t and (p := A.plain(t)).strip()]
            texts += len(plain)
            if plain:
                kept.append(layer_words(plain))
            if sum(len(w) for w, _ in kept) > CACHE_WORDS:
                kept = [merged()]
                if len(kept[0][0]) > CACHE_WORDS // 2:
                    yield sent(*kept.pop())
    if kept:
        yield sent(*merged())
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts], pa.int64())], names=["word", "n"])


def learn_common(df: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the words (and pairs of characters) common in whole texts. Each is in a share of the texts, so they are
    few whatever the corpus holds."""
    every = stored(df.select(text).mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg({"n": "sum"}).toDF("word", "n"))
    texts = every.where("word is null").agg({"n": "sum"}).first()[0] or 0
    common = every.where("word is not null").where(f"n >= {max(3, COMMON_SHARE * texts)!r}").select("word").toArrow()["word"].to_numpy()
    return np.sort(common.astype(np.int64).view(np.uint64))


def _described(df: DataFrame, key: str, text: str, common: np.ndarray) -> DataFrame:
    """``key``, STATISTICS but for the shares of kinds, and the packed numbers and sizes of lines, of every text."""
    kind = df.schema[key].dataType
    key_type = _arrow_type(kind)
    shipped = df.sparkSession.sparkContext.broadcast(common)

    def run(columns: dict) -> pa.RecordBatch:
        texts = [t or "" for t in columns["text"]]
        s = line_statistics([A.plain(t) for t in texts], shipped.value)
        found, packed, sizes = _totals(s, texts), _packed(s), s["chars"].astype(np.int32)
        cut = np.searchsorted(s["owner"], np.arange(len(texts) + 1))
        lines = [pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for v in (packed, sizes)]
        return pa.RecordBatch.from_arrays([pa.array(columns["key"], key_type), *(pa.array(found[f.name], _arrow_type(f.dataType)) for f in STATISTICS[:_SHARES]), *lines], names=["key", *STATISTICS.names[:_SHARES], "packed", "sizes"])

    schema = T.StructType([T.StructField("key", kind), *STATISTICS[:_SHARES], T.StructField("packed", T.BinaryType()), T.StructField("sizes", T.BinaryType())])
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(A.map_arrow(run, 2_000_000), schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of _described in parts of MOST_LINES: the rows, the packed numbers of their lines, and the row of each line."""
    for batch in batches:
        for part in A.cut(batch, pc.binary_length(batch["packed"]).to_numpy(zero_copy_only=False) // 8, MOST_LINES):
            column = part["packed"].to_pylist()
            yield part, np.frombuffer(b"".join(column), np.int64), np.repeat(np.arange(len(column)), [len(b) // 8 for b in column])


def _fitted(lines: DataFrame, common: np.ndarray) -> dict:
    """The model after ROUNDS rounds over all lines; each task sends its sums."""
    spark = lines.sparkSession
    model = _start() | {"common": common}
    some = lines.where("lines > 0").select("packed")
    texts = some.count()
    for turn in range(ROUNDS + 1):
        shipped = spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "common"} if turn else None)

        def added(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for part, packed, owner in _lines(batches):
                total = total + _sums(packed, owner, part.num_rows, shipped.value)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.rint(total * FINE).astype(np.int64))], names=["place", "n"])

        rows = some.mapInArrow(added, "place int, n bigint").groupBy("place").agg({"n": "sum"}).collect()
        sums = np.zeros(model["tables"].size + STATES * STATES + STATES)
        for place, n in rows:
            sums[place] = n / FINE
        model = _next(model, sums, texts, not turn)
    return model


def learn(df: DataFrame, key: str = "id", text: str = "text") -> dict:
    """A model fitted on the whole texts of all rows."""
    common = learn_common(df, text)
    return _fitted(stored(_described(df, key, text, common)), common)


def statistics(df: DataFrame, key: str = "id", text: str = "text", model: dict | None = None) -> DataFrame:
    """``key`` and STATISTICS of every text; a null or blank one has zeros. Shares of prose, list, table and
    junk are by characters of lines with ink and sum to 1 unless blank. Repeated rows are described as
    often as they stand there, other columns left out. Without a model one is fitted on all texts; they are read twice then."""
    common = model["common"] if model is not None else learn_common(df, text)
    lines = _described(df, key, text, common)
    if model is None:
        lines = stored(lines)
        model = _fitted(lines, common)
    shipped = df.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "common"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, packed, owner in _lines(batches):
            found = _shares(packed, np.frombuffer(b"".join(part["sizes"].to_pylist()), np.int32), owner, part.num_rows, shipped.value)
            yield pa.RecordBatch.from_arrays([part[c] for c in ("key", *STATISTICS.names[:_SHARES])] + [pa.array(found[c]) for c in KINDS], names=["key", *STATISTICS.names])

    return lines.mapInArrow(run, T.StructType([T.StructField("key", df.schema[key].dataType), *STATISTICS])).withColumnRenamed("key", key)


def not_prose(df: DataFrame, key: str = "id", text: str = "text", model: dict | None = None) -> DataFrame:
    """``key, kind``: texts of which more than half of the characters are not prose, with what most of those are."""
    s = statistics(df, key, text, model)
    kind = F.when((F.col("junk") >= F.col("list")) & (F.col("junk") >= F.col("table")), "junk").when(F.col("table") >= F.col("list"), "table").otherwise("list")
    return s.where("list + table + junk > 0.5").select(key, kind.alias("kind"))
