"""Texts of one Arrow batch as flat numpy arrays of code points.

Every operator here works on whole batches: the texts of a batch are laid one
after another in one ``uint32`` array, so character classes, words, lines and
their hashes come out of a few array operations instead of a loop per row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points from here on are treated as symbols; scripts in use lie below.
TABLE_SIZE = 0x30000

OTHER, SPACE, LATIN, CYRILLIC, HAN, KANA, LETTER, DIGIT, PUNCT, SYMBOL, CONTROL, GREEK, MARK = range(13)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and their inverses, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                while len(table) < size:
                    table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
            tables.append(table)
        _powers[:] = tables
    return _powers[0], _powers[1]


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point below TABLE_SIZE."""
    table = np.full(TABLE_SIZE, SYMBOL, np.uint8)
    for c in range(0x3400):
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            if c < 0x250 or 0x1E00 <= c < 0x1F00:
                table[c] = LATIN
            elif 0x400 <= c < 0x530:
                table[c] = CYRILLIC
            elif 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
                table[c] = GREEK
            elif 0x3040 <= c < 0x3100:
                table[c] = KANA
            else:
                table[c] = LETTER
        elif category[0] == "M":
            table[c] = MARK
        elif category[0] == "N":
            table[c] = DIGIT
        elif category[0] == "P":
            table[c] = PUNCT
        elif category[0] == "Z" or chr(c).isspace():
            table[c] = SPACE
        elif category[0] == "C":
            table[c] = CONTROL
    table[0x30FC] = KANA  # the long-vowel mark
    table[0x3005] = HAN  # the repetition mark
    table[0x3400:0x4DC0] = HAN
    table[0x4E00:0xA000] = HAN
    table[0xAC00:0xD7A4] = LETTER
    table[0xD800:0xF900] = CONTROL
    table[0xF900:0xFB00] = HAN
    for c in range(0xFB00, 0x10000):
        category = unicodedata.category(chr(c))
        table[c] = {"L": LETTER, "M": MARK, "N": DIGIT, "P": PUNCT, "Z": SPACE, "C": CONTROL}.get(category[0], SYMBOL)
    table[0xFF21:0xFF3B] = LATIN
    table[0xFF41:0xFF5B] = LATIN
    table[0xFF66:0xFFA0] = KANA
    table[0xFB00:0xFB07] = LATIN
    table[0x20000:TABLE_SIZE] = HAN
    for c in range(0x1D400, 0x1D800):
        table[c] = LETTER
    return table


@functools.cache
def lower_table() -> np.ndarray:
    table = np.arange(TABLE_SIZE, dtype=np.uint32)
    for c in range(0x2000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    table[0xFF21:0xFF3B] += 32
    return table


_UNSEEN_CHARS = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_UNSEEN = re.compile(f"[{_UNSEEN_CHARS}]+")


_OTHER_SCRIPT = re.compile("[\u0370-\u04ff]")
_SEAM = re.compile("[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
_MIXED = re.compile("[A-Za-z]*(?:[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z])[A-Za-z\u0370-\u04ff]*")
# Letters of three scripts that look the same.
_LATIN, _CYRILLIC = "aceiopsxyABCEHIKMOPSTX", "асеіорѕхуАВСЕНІКМОРЅТХ"
_TO_LATIN = str.maketrans(_CYRILLIC + "νορΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", _LATIN + "vopABEZHIKMNOPTYX")
_TO_CYRILLIC = str.maketrans(_LATIN, _CYRILLIC)


def _one_script(m: re.Match) -> str:
    """A word with letters of two scripts, in the one that can spell all of it."""
    word = m.group()
    latin = word.translate(_TO_LATIN)
    if latin.isascii():
        return latin
    cyrillic = word.translate(_TO_CYRILLIC)
    return cyrillic if not any("A" <= c <= "z" for c in cyrillic) else word


def plain(text: str) -> str:
    """Without invisible characters, in compatibility form, words in one script: for features only."""
    if text.isascii():
        return text
    # looking for a character is faster than the expression, and most texts have none of these
    for c in _UNSEEN_CHARS:
        if c in text:
            text = _UNSEEN.sub("", text)
            break
    text = unicodedata.normalize("NFKC", text)
    return _MIXED.sub(_one_script, text) if _OTHER_SCRIPT.search(text) and _SEAM.search(text) else text


_ALONE, _WITH_OTHERS, _SCRIPT, _ASCII = 1, 2, 4, 8


@functools.cache
def _plain_table() -> tuple[np.ndarray, dict[str, str]]:
    """What plain does to each code point: _ALONE if it changes it whatever stands around it (to what is in the mapping),
    _WITH_OTHERS if that hangs on its neighbours; _SCRIPT and _ASCII if letters of the other scripts or of ASCII come out, or stand side by
    side once it is gone."""
    table = np.zeros(TABLE_SIZE, np.uint8)
    table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1] = _ASCII
    table[TABLE_SIZE - 1] = _WITH_OTHERS  # stands for all code points behind
    table[0x1161:0x1176] = table[0x11A8:0x11C3] = _WITH_OTHERS
    changed: dict[str, str] = {}
    # ideographs and syllables between these stay as they are
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        char = chr(c)
        if unicodedata.combining(char):
            table[c] |= _WITH_OTHERS
        pair = unicodedata.decomposition(char).split()
        if len(pair) == 2 and pair[0][0] != "<":
            table[int(pair[1], 16)] |= _WITH_OTHERS
        after = "" if char in _UNSEEN_CHARS else unicodedata.normalize("NFKC", char)
        if after != char:
            changed[char] = after
        if _OTHER_SCRIPT.search(char + after):
            table[c] |= _SCRIPT
        if not after or after != char and re.search("[A-Za-z]", after):
            table[c] |= _ASCII
    for char, after in changed.items():
        table[ord(char)] |= _WITH_OTHERS if _SEAM.search(after) or any(x in changed or table[ord(x)] & _WITH_OTHERS for x in after) else _ALONE
    return table, changed


def plain_texts(texts: list[str]) -> list[str]:
    """plain of each text. Most texts have no characters that it changes, or few that change by themselves; these are
    found for all texts at once, and the others go through plain."""
    out = list(texts)
    wide = [i for i, t in enumerate(texts) if not t.isascii()]
    if not wide:
        return out
    table, changed = _plain_table()
    batch = TextBatch([texts[i] for i in wide])
    does = table[batch.codes]
    at = np.flatnonzero(does & np.uint8(_ALONE | _WITH_OTHERS))
    chars, kinds = batch.raw[at].tolist(), does[at].tolist()
    found: dict[int, set[int]] = {}
    for k, c, kind in zip(np.searchsorted(batch.ends, at).tolist(), chars, kinds):
        found.setdefault(k, set()).add(-1 if kind & _WITH_OTHERS else c)
    for k, those in found.items():
        text = batch.texts[k]
        if -1 in those:
            text = plain(text)
        else:
            for c in those:
                text = text.replace(chr(c), changed[chr(c)])
        out[wide[k]] = text
    script, latin = (does & np.uint8(_SCRIPT)) > 0, (does & np.uint8(_ASCII)) > 0
    seams = np.flatnonzero((script[1:] & latin[:-1]) | (latin[1:] & script[:-1]))
    for k in np.unique(np.searchsorted(batch.ends, seams)).tolist():
        text = out[wide[k]]
        if -1 not in found.get(k, ()) and _SEAM.search(text):
            out[wide[k]] = _MIXED.sub(_one_script, text)
    return out


class TextBatch:
    """The texts of a batch, each followed by one LF that isn't part of it."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.minimum(codes, TABLE_SIZE - 1)
        self.raw = codes
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.joined = joined

    @functools.cached_property
    def classes(self) -> np.ndarray:
        return class_table()[self.codes]

    @functools.cached_property
    def lower(self) -> np.ndarray:
        return lower_table()[self.codes]

    def line_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without LF) and text number of each line; a text without LF has one line."""
        ends = np.flatnonzero(self.raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        return starts, ends, np.searchsorted(self.ends, ends)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, from running sums of a polynomial over all of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(codes))
    with np.errstate(over="ignore"):
        terms = codes.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _MULTIPLIER
        terms ^= terms >> np.uint64(29)
        terms *= power[:len(codes)]
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def string_hashes(words: list[str]) -> np.ndarray:
    """span_hashes of strings, for building and asking tables of words."""
    batch = TextBatch(words)
    return span_hashes(batch.codes, batch.starts, batch.ends)


def string_hash(word: str) -> int:
    return int(string_hashes([word])[0])


def sums_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def parts(batch: pa.RecordBatch, most_chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut so that no part holds many more than most_chars characters (a single longer
    text is passed whole)."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += np.nan_to_num(pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return cut(batch, sizes, most_chars)


def cut(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts whose sizes sum to most at most (a single larger row is passed whole)."""
    at, cum = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        base = cum[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cum, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_arrow(fn: Callable[[dict[str, list]], pa.RecordBatch | None], most_chars: int = 4_000_000) -> Callable:
    """A mapInArrow function: fn gets the columns of each part of a batch as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, most_chars):
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                if out is not None and out.num_rows:
                    yield out

    return run
