"""One consistent form for texts that look the same (problem 2).

The mapping is SQL, run by DuckDB on the Arrow batches inside Spark's tasks:
``translate`` brings compatibility forms, spaces and hyphens to one character and
drops what nobody sees, words are brought to the script their unmistakable
letters belong to, and ``nfc_normalize`` composes accents. The tables in the SQL
are made from the Unicode data by rule, but for the look-alike letters of three scripts,
which are listed.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import arrays as A
from foliomill.llm.common import checked_broadcast, stored
from foliomill.llm.tokenize import _arrow_type

#: Letters that look the same, one row each: Latin, Cyrillic, Greek ("-" for none).
LOOK_ALIKE = (
    "aа- cс- eе- iі- jј- oоο pр- sѕ- xх- yу- hһ- dԁ- qԛ- wԝ- v-ν ëё- èѐ- ïї- "
    "AАΑ BВΒ CС- EЕΕ HНΗ IІΙ JЈ- KКΚ MМΜ N-Ν OОΟ PРΡ SЅ- TТΤ XХΧ YҮΥ Z-Ζ ËЁ- ÈЀ-"
).split()
HYPHENS = "‐‑"
#: Characters that DuckDB gets at once.
PART_CHARS = 4_000_000
LINE_BREAKS = {"\r\n": "\n", "\r": "\n", " ": "\n", " ": "\n\n", "\x85": "\n"}


@functools.cache
def folding() -> tuple[str, str, str, dict[str, str]]:
    """Characters to replace, their replacements, characters to drop, and those that become several."""
    one, to, drop, several = [], [], [], {}
    for c in range(0x80, 0x30000):
        char = chr(c)
        category = unicodedata.category(char)
        if category == "Cf" or char in "͏᠎ㅤﾠ" or 0xFE00 <= c <= 0xFE0F:
            if not 0x600 <= c <= 0x6DD and c != 0x70F:
                drop.append(char)
            continue
        if category == "Zs":
            one.append(char)
            to.append(" ")
            continue
        tag, _, rest = unicodedata.decomposition(char).partition(" ")
        if tag in ("<wide>", "<narrow>", "<compat>"):
            plain = unicodedata.normalize("NFKC", char)
            if len(plain) == 1:
                one.append(char)
                to.append(plain)
            elif category == "Ll" and 0xFB00 <= c <= 0xFB06 or char in "ĳĲǆǅǄǉǈǇǌǋǊ":
                several[char] = plain
    for char in HYPHENS:
        one.append(char)
        to.append("-")
    return "".join(one), "".join(to), "".join(drop), several


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.lru_cache(maxsize=256)
def _statement(select: str, used: str) -> str:
    """The query over ``given(key, text)``; ``select`` picks from key, text and clean.

    ``used`` holds the characters of the batch that are not ASCII: the tables are cut to these. ASCII texts
    are passed through, and only texts holding Cyrillic or Greek are taken apart into words, of which
    only those that can change are translated.
    """
    one, to, drop, several = folding()
    pairs = [(a, b) for a, b in zip(one + drop, to.ljust(len(one + drop), "\0")) if a in used]
    pairs.sort(key=lambda p: p[1] == "\0")  # what is dropped stands at the end, without a counterpart
    folded = "text"
    if pairs:
        folded = f"translate(text, {_quoted(''.join(a for a, _ in pairs))}, {_quoted(''.join(b for _, b in pairs if b != chr(0)))})"
    for char, plain in (several | LINE_BREAKS).items():
        if char[0] in used or char[0] == "\r":
            folded = f"replace({folded}, {_quoted(char)}, {_quoted(plain)})"
    to_latin = [(c, row[0]) for row in LOOK_ALIKE for c in row[1:] if c != "-"]
    to_cyrillic = [(c, row[1]) for row in LOOK_ALIKE if row[1] != "-" for c in row if c not in ("-", row[1])]
    unsure = ["".join(row[i] for row in LOOK_ALIKE if row[i] != "-") for i in range(3)]
    sure_latin, sure_cyrillic, sure_greek = (f"[^\\P{{{name}}}{letters}]" for name, letters in zip(("Latin", "Cyrillic", "Greek"), unsure))

    def moved(pairs: list[tuple[str, str]]) -> str:
        return f"translate(w, {_quoted(''.join(a for a, _ in pairs))}, {_quoted(''.join(b for _, b in pairs))})"

    def count(letters: str) -> str:
        return f"length(t) - length(regexp_replace(t, {_quoted(letters)}, '', 'g'))"

    def has(pattern: str) -> str:
        return f"regexp_matches(w, {_quoted(pattern)})"

    ascii = "regexp_full_match(text, '[\\x00-\\x0c\\x0e-\\x7f]*')"
    two_scripts = "regexp_matches(t, '[\\p{Cyrillic}\\p{Greek}]') AND regexp_matches(t, '\\p{Latin}')"
    return f"""
        WITH folded AS MATERIALIZED (SELECT key, text, {folded} AS t FROM given WHERE NOT {ascii}),
        mixed AS (SELECT *, {count(sure_cyrillic)} > {count(sure_latin)} AS mainly_cyrillic FROM folded WHERE {two_scripts}),
        done AS (
            SELECT key, text, text AS clean FROM given WHERE text IS NULL OR {ascii}
            UNION ALL SELECT key, text, nfc_normalize(t) FROM folded WHERE NOT ({two_scripts})
            UNION ALL SELECT key, text, nfc_normalize(array_to_string(list_transform(
                regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: CASE
                    WHEN NOT {has("[\\p{Latin}\\p{Cyrillic}\\p{Greek}]")} THEN w
                    WHEN NOT {has("[\\p{Cyrillic}\\p{Greek}]")} AND (NOT mainly_cyrillic OR {has(sure_latin)}) THEN w
                    WHEN NOT {has("[\\p{Latin}\\p{Greek}]")} AND (mainly_cyrillic OR {has(sure_cyrillic)}) THEN w
                    WHEN {has(sure_cyrillic)} THEN {moved(to_cyrillic)}
                    WHEN {has(sure_greek)} THEN w
                    WHEN {has(sure_latin)} OR NOT mainly_cyrillic THEN {moved(to_latin)}
                    ELSE {moved(to_cyrillic)} END), '')) FROM mixed)
        SELECT {select} FROM done"""


def _in_use(texts: pa.Array) -> str:
    """The characters of an Arrow column that the tables know, sorted."""
    seen = np.zeros(0x110000, bool)
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        joined = "".join(t for t in part.to_pylist() if t)
        seen[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    return "".join(chr(c) for c in np.flatnonzero(seen & _known_characters()))


@functools.cache
def _known_characters() -> np.ndarray:
    one, _, drop, several = folding()
    known = np.zeros(0x110000, bool)
    known[[ord(c[0]) for c in [*one, *drop, *several, *LINE_BREAKS]]] = True
    return known


class Mapper:
    """A DuckDB connection of a worker. It keeps nothing on disk: batches are small, and what doesn't fit fails."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.con.execute("SET preserve_insertion_order = false")

    def select(self, batch: pa.Table, select: str) -> pa.Table:
        """The statement over a table of key and text."""
        self.con.register("given", batch)
        out = self.con.sql(_statement(select, _in_use(batch.column("text")))).to_arrow_table()
        self.con.unregister("given")
        return out

    def texts(self, texts: list[str]) -> list[str]:
        """The consistent forms of texts, in their order."""
        out = list(texts)
        at = [i for i, t in enumerate(texts) if not t.isascii() or "\r" in t]
        if at:
            found = self.select(pa.table({"key": pa.array(at, pa.int64()), "text": pa.array([texts[i] for i in at], pa.string())}), "key, clean")
            for i, clean in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
                out[i] = clean
        return out


def _in_duckdb(select: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper()
        for batch in batches:
            for part in A.parts(batch, PART_CHARS):
                yield from mapper.select(pa.Table.from_batches([part]), select).to_batches()

    return run


def consistent(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, text``: every text in its consistent form.

    Null stays null and empty stays empty; repeated rows and null keys are kept, other columns left
    out. Spaces of any width become one space each, so their number stays; line breaks become LF.
    """
    kind = df.schema[key].dataType
    _arrow_type(kind)
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(_in_duckdb("key, clean AS text"), f"key {kind.simpleString()}, text string").withColumnRenamed("key", key)


def look_alikes(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id_a, id_b``: rows whose texts look the same but differ as strings.

    Null and blank texts never count. Rows with equal strings make no pair with each other. Only the
    digests of both forms are shuffled; groups with a single spelling, however large, are gone before
    the join (a partial aggregate finds them), so the join sees just the groups that make pairs.
    """
    kind = df.schema[key].dataType
    digests = stored(df.select(df[key].alias("key"), df[text].alias("text")).where(F.col("text").isNotNull()).mapInArrow(
        _in_duckdb("key, CASE WHEN regexp_full_match(clean, '[\\s\\p{Z}\\p{C}]*') THEN NULL ELSE md5(clean) END AS form, md5(text) AS spelling"),
        f"key {kind.simpleString()}, form string, spelling string",
    ).where("form is not null").select("key", F.unhex("form").alias("form"), F.unhex("spelling").alias("spelling")))
    several = stored(digests.groupBy("form").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("form"))
    rows = digests.join(checked_broadcast(several), "form", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.expr("a.form = b.form and a.spelling <> b.spelling and a.key < b.key")).select(
        F.col("a.key").alias("id_a"), F.col("b.key").alias("id_b")).distinct()
