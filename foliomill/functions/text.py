"""Text functions as column expressions; all of them stay in the JVM.

Character classes are written out so that they mean the same as in the engine's
specification: white space includes U+001C..001F, U+0085 and all separators, a
word character is a letter, a number or "_". Null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"[\n\x{0b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
MIN_PAGE_CHARS = 80
MIN_ALNUM_RATIO = 0.25
# Ligatures and what they are written as; words that are no search terms.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
STOPWORDS = ["and", "in", "or", "the", "using", "vs", "with"]
# Fixed value: what a Cyrillic text decoded with a wrong code page leaves behind, in normalised text.
MOJIBAKE = r"[РС][\x{80}-\x{bf}]|В[^ A-Za-zА-Яа-я]"
# Fixed value: the form of a DOI.
DOI = r"(?iU)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def count_of(c: Column, pattern: str) -> Column:
    """How many characters of a class there are: what is left when all others are dropped."""
    return F.length(F.regexp_replace(c, pattern, ""))


def alnum(c: Column) -> Column:
    return count_of(c, r"[^\p{L}\p{N}]+")


def alpha(c: Column) -> Column:
    return count_of(c, r"[^\p{L}]+")


def printable(c: Column) -> Column:
    return count_of(c, r"[[\p{Z}\p{C}]&&[^ ]]+")


def replacement_marks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))


def mojibake(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MOJIBAKE))


def usable(normalized: Column) -> Column:
    """A page with enough characters, enough of them letters or digits. Takes normalised text."""
    return F.coalesce((F.length(normalized) >= MIN_PAGE_CHARS) & (alnum(normalized) / F.greatest(F.length(normalized), F.lit(1)) >= F.lit(MIN_ALNUM_RATIO)), F.lit(False))


def quality(normalized: Column) -> Column:
    """The score of a text layer between 0 and 1; 0 for a blank one. Takes normalised text."""
    n = F.greatest(F.length(normalized), F.lit(1)).cast("double")

    def share(k: Column) -> Column:
        return k.cast("double") / n

    one = F.lit(1.0)
    score = (
        F.lit(0.35) * F.least(F.length(normalized).cast("double") / F.lit(4.0 * MIN_PAGE_CHARS), one)
        + F.lit(0.30) * F.least(share(alnum(normalized)) / F.lit(0.55), one)
        + F.lit(0.25) * F.least(share(alpha(normalized)) / F.lit(0.45), one)
        + F.lit(0.10) * share(printable(normalized))
        - F.lit(2.0) * share(replacement_marks(normalized))
        - F.lit(4.0) * share(mojibake(normalized))
    )
    return F.when(F.coalesce(F.length(normalized), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(one, score)))


def doi(c: Column) -> Column:
    """The first DOI in a text, lower case, without closing punctuation; null if there is none."""
    found = F.regexp_extract(c, DOI, 0)
    return F.when(found != "", F.lower(F.regexp_replace(found, "[.,;]+$", "")))


def token_count(c: Column) -> Column:
    """Words between white space, at least 1."""
    n = normalize(c)
    return F.greatest(F.lit(1), F.when(n == "", 0).otherwise(F.size(F.split(n, " "))))


def spell_ligatures(c: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        c = F.replace(c, F.lit(ligature), F.lit(letters))
    return c


def truncate(c: Column, limit: int = 500) -> Column:
    """Normalised, cut to a length with "..." behind it if it was longer; null gives an empty text."""
    n = normalize(F.coalesce(c, F.lit("")))
    return F.when(F.length(n) <= limit, n).otherwise(F.concat(F.rtrim(F.substring(n, 1, limit)), F.lit("...")))


def tail(c: Column, n: int = 2000) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.substring(c, -n, n))


def escape_html(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    # The entities.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def stable_name(checksum: Column, path: Column) -> Column:
    """First 16 hex digits, "_", the stem with spaces as "_" (80 characters at most, "document" for none), lower-case suffix."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    suffix = F.regexp_extract(name, r"(?<=[^.])\.[^.]+$", 0)
    stem = F.when(suffix == "", name).otherwise(F.left(name, F.length(name) - F.length(suffix)))
    short = F.left(F.replace(strip(stem), F.lit(" "), F.lit("_")), F.lit(80))
    return F.concat(F.left(checksum, F.lit(16)), F.lit("_"), F.when(short == "", "document").otherwise(short), F.when(suffix == "", ".pdf").otherwise(F.lower(suffix)))


def lines(c: Column) -> Column:
    """The lines of a text, whatever the line break."""
    return F.split(F.regexp_replace(c, "\r\n", "\n"), LINE_BREAK)


def query_terms(c: Column) -> Column:
    """Search terms of a query in order: hyphenated words, two characters or more, no stopwords."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))
    spelled = F.transform(words, lambda w: spell_ligatures(F.regexp_replace(w, "^-+|-+$", "")))
    return F.filter(spelled, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(STOPWORDS))


def score(text: Column, query: Column, terms: Column) -> Column:
    """1000 for the whole phrase, and for each term the characters its occurrences take."""
    low = F.lower(text)

    def taken(term: Column) -> Column:
        return F.length(low) - F.length(F.replace(low, F.lower(term), F.lit("")))

    every = F.when(F.size(terms) > 0, terms).otherwise(F.array(query))
    return F.when(F.contains(low, F.lower(query)), 1000).otherwise(0) + F.aggregate(every, F.lit(0), lambda a, t: a + taken(t))


def matches(text: Column, query: Column, terms: Column) -> Column:
    """The phrase or any of its terms stands in the text, whatever the case."""
    low = F.lower(text)
    return F.contains(low, F.lower(query)) | F.exists(terms, lambda t: F.contains(low, F.lower(t)))


def snippet(text: Column, query: Column, terms: Column, radius: int = 140) -> Column:
    """The surroundings of the phrase, else of the first term that occurs, else the start of the text."""
    n = normalize(spell_ligatures(text))
    low = F.lower(n)
    places = F.filter(
        F.transform(F.concat(F.array(query), terms), lambda t: F.struct(F.position(F.lower(t), low).alias("at"), F.length(t).alias("n"))),
        lambda p: p["at"] > 0)
    hit = F.try_element_at(places, F.lit(1))
    start = F.greatest(F.lit(0), hit["at"] - 1 - radius)
    end = F.least(F.length(n), hit["at"] - 1 + hit["n"] + radius)
    cut = F.concat(
        F.when(start > 0, "...").otherwise(""), strip(F.substring(n, start + 1, end - start)), F.when(end < F.length(n), "...").otherwise(""))
    return F.when(F.length(n) == 0, F.lit("")).when(hit.isNull(), strip(F.substring(n, 1, 2 * radius))).otherwise(cut)
