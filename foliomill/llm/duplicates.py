"""Groups of near-duplicate records (problem 6).

HyperMinHash: a shingle's hash is split into a bucket and a value, and each bucket
keeps of its least value only the number of leading zeros and a few bits of what
follows, two bytes in all. A sketch has BANDS buckets, and there are ROWS of them
with hashes of their own; the registers of one bucket in all sketches make a band.
Empty buckets of short texts borrow from others for the bands, in an order fixed
for each bucket. Equal bands make the candidate pairs; the Jaccard estimate from
the registers, corrected for collisions of such short ones, throws out most of
them, and the shingle sets of the rest are compared exactly.

Records with the same shingles are one class throughout, so copies, however many,
never meet each other. What makes pairs in buckets of any size, bands as well as
rare words of titles, is in pairs_in_buckets: large buckets are cut into parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm import arrays as A
from foliomill.llm.common import checked_broadcast, stored
from foliomill.llm.visual import Mapper

SHINGLE = 3
THRESHOLD = 0.6
#: The chance that the bands bring a pair together is 0.96 at THRESHOLD, 0.98 at 0.62, 0.99 at 0.65.
BANDS, ROWS = 40, 5
#: Bits kept behind the leading zeros; of the registers that travel with candidates, the last ones alone.
MANTISSA = 8
SHORT_BITS = 4
SHORT_BUCKETS = 128
WORDS = SHORT_BUCKETS * SHORT_BITS // 64
#: Estimates from SHORT_BUCKETS registers spread by less than 0.05; a candidate is compared from this one on.
ESTIMATE = THRESHOLD - 0.2
#: Sets of fewer shingles than this are compared without an estimate.
SMALL_SET = 40
#: Rows of a bucket, or copies of a class, that one task pairs with each other; larger ones are cut into such parts.
PART = 1000
#: Nodes sampled to see which buckets are heavy, and rows of a bucket in the sample that make it so.
SAMPLED_NODES, HEAVY = 20_000, 20

_rng = np.random.default_rng(20240601)
_SALTS = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64)
#: For each bucket, the others in the order in which they are asked when it is empty.
_LENDERS = np.stack([_rng.permutation([k for k in range(BANDS) if k != j]) for j in range(BANDS)])


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: 32-bit hashes and their texts, sorted by text. Words, and in texts mostly
    in scripts without spaces characters, are taken in lower case, without punctuation. Texts come in consistent form."""
    batch = A.TextBatch(texts)
    codes, classes = batch.lower, batch.classes
    wide = (classes == A.HAN) | (classes == A.KANA)
    word = (classes == A.LATIN) | (classes == A.CYRILLIC) | (classes == A.GREEK) | (classes == A.LETTER) | (classes == A.MARK) | (classes == A.DIGIT) | wide
    owner = np.searchsorted(batch.ends, np.arange(len(codes)))
    n = len(texts)
    n_wide = np.bincount(owner, weights=wide, minlength=n)
    by_char = n_wide * 2 > np.bincount(owner, weights=word, minlength=n)
    # units: characters in texts by characters, whole words elsewhere
    starts, ends = A.runs(word & ~by_char[owner])
    single = np.flatnonzero(word & by_char[owner])
    with np.errstate(over="ignore"):
        unit = np.concatenate([A.span_hashes(codes, starts, ends), A.mix(codes[single].astype(np.uint64) + np.uint64(1 << 40))])
        at = np.concatenate([starts, single])
        order = np.argsort(at, kind="stable")
        unit, of = unit[order], owner[at[order]]
        if len(unit) < width:
            gram, of_gram = unit[:0], of[:0]
        else:
            m = len(unit) - width + 1
            gram = np.zeros(m, np.uint64)
            for i in range(width):
                gram = (gram ^ unit[i:i + m]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
            same = of[:m] == of[width - 1:]
            gram, of_gram = A.mix(gram)[same], of[:m][same]
        # a text too short for one shingle is one shingle itself
        have = np.bincount(of_gram, minlength=n)
        short = (have[of] == 0) if len(of) else np.zeros(0, bool)
        if short.any():
            s, o = unit[short], of[short]
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            gram = np.concatenate([gram, A.mix(np.add.reduceat(s * np.uint64(31), first))])
            of_gram = np.concatenate([of_gram, o[first]])
    key = (of_gram.astype(np.uint64) << np.uint64(32)) | (gram >> np.uint64(32))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


def registers(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n x ROWS x BANDS registers: leading zeros of a bucket's least value (and 1) above MANTISSA bits of what
    follows its first one. 0 stands for an empty bucket."""
    out = np.zeros((n, ROWS, BANDS), np.uint16)
    if not len(values):
        return out
    base = of.astype(np.int64) * BANDS
    for r in range(ROWS):
        with np.errstate(over="ignore"):
            h = A.mix(values.astype(np.uint64) + _SALTS[r])
        bucket = ((h >> np.uint64(32)) * np.uint64(BANDS)) >> np.uint64(32)
        least = np.full(n * BANDS, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, base + bucket.astype(np.int64), h.astype(np.uint32))
        fraction, exponent = np.frexp(least + 0.5)  # the exponent gives the zeros, the fraction the bits behind
        kept = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.uint16) & np.uint16((1 << MANTISSA) - 1)
        register = ((33 - np.clip(exponent, 0, 32)).astype(np.uint16) << np.uint16(MANTISSA)) | kept
        out[:, r] = np.where(least == 0xFFFFFFFF, 0, register).reshape(n, BANDS)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """The registers with empty buckets filled from the first of their lenders that isn't empty."""
    flat = regs.reshape(-1, BANDS)
    some = np.flatnonzero((flat == 0).any(axis=1) & (flat != 0).any(axis=1))
    if not len(some):
        return regs
    own = flat[some]
    out = own.copy()
    for turn in range(BANDS - 1):
        empty = out == 0
        if not empty.any():
            break
        out = np.where(empty, own[:, _LENDERS[:, turn]], out)
    flat = flat.copy()
    flat[some] = out
    return flat.reshape(regs.shape)


def compressed(full: np.ndarray) -> np.ndarray:
    """n x WORDS integers of the last SHORT_BITS bits of the first SHORT_BUCKETS registers."""
    short = (full.reshape(len(full), -1)[:, :SHORT_BUCKETS] & ((1 << SHORT_BITS) - 1)).astype(np.uint64)
    out = np.zeros((len(full), WORDS), np.uint64)
    per = 64 // SHORT_BITS
    for i in range(per):
        out |= short[:, i::per] << np.uint64(SHORT_BITS * i)
    return out.view(np.int64)


def band_keys(full: np.ndarray) -> np.ndarray:
    """n x BANDS keys of 40 bits, each of the ROWS registers of a bucket; only keys of the same band are compared."""
    with np.errstate(over="ignore"):
        key = np.zeros((len(full), BANDS), np.uint64)
        for r in range(ROWS):
            key = (key ^ full[:, r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)
        return A.mix(key) >> np.uint64(24)


def estimate(unlike: Column) -> Column:
    """Jaccard from the number of unlike short registers. Unlike minima share the bits kept in one case of 16, which is taken off."""
    collide = 1 / (1 << SHORT_BITS)
    return (1 - unlike / F.lit(float(SHORT_BUCKETS)) - F.lit(collide)) / F.lit(1 - collide)


def unlike_registers(pairs: DataFrame) -> DataFrame:
    """Adds ``unlike``, how many short registers of x_ and y_ columns differ. Step by step, each value once, so that the code stays small."""
    names = [f"__{i}" for i in range(WORDS)]
    out = pairs.select("*", *[F.col(f"x_r{i}").bitwiseXOR(F.col(f"y_r{i}")).alias(n) for i, n in enumerate(names)]).drop(*[f"{side}_r{i}" for side in "xy" for i in range(WORDS)])
    for shift in (1, 2):
        out = out.withColumns({n: F.col(n).bitwiseOR(F.shiftrightunsigned(n, shift)) for n in names})
    low = F.lit(0x1111111111111111)
    return out.withColumn("unlike", reduce(lambda a, b: a + b, [F.bit_count(F.col(n).bitwiseAND(low)) for n in names])).drop(*names)


def _alike(pairs: DataFrame) -> DataFrame:
    """Candidates whose estimate is high enough, and those of small sets, whose registers say little."""
    return unlike_registers(pairs).where((estimate(F.col("unlike")) >= ESTIMATE) | (F.least("x_n", "y_n") < SMALL_SET))


_mapper: list[Mapper] = []


def _consistent(texts: list[str | None]) -> list[str]:
    """The texts in the consistent form of problem 2."""
    if not _mapper:
        _mapper.append(Mapper())
    return _mapper[0].texts([t or "" for t in texts])


def _digests(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n x 2 integers, a digest of 128 bits of each shingle set, and the sizes of the sets."""
    bounds = np.searchsorted(of, np.arange(n + 1))
    counts = np.diff(bounds)
    digest = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        with np.errstate(over="ignore"):
            for i, salt in enumerate((1 << 33, 1 << 34)):
                digest[some, i] = A.mix(np.add.reduceat(A.mix(values.astype(np.uint64) + np.uint64(salt)), bounds[some]) + counts[some].astype(np.uint64))
    return digest.view(np.int64), counts


def _sketch(columns: dict) -> pa.RecordBatch:
    values, of = shingles(_consistent(columns["text"]))
    n = len(columns["text"])
    digest, counts = _digests(values, of, n)
    full = filled(registers(values, of, n))
    keys = band_keys(full)
    at = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
    short = compressed(full)
    return pa.RecordBatch.from_arrays([
        pa.array(columns["key"]), pa.array(columns["carried"], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(counts, pa.int32()),
        *(pa.array(np.ascontiguousarray(short[:, i])) for i in range(WORDS)),
        pa.ListArray.from_arrays(at, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).ravel())),
        pa.ListArray.from_arrays(at, pa.array((keys >> np.uint64(32)).astype(np.uint8).view(np.int8).ravel())),
    ], names=["key", "carried", "d1", "d2", "n", *_REGS, "bands", "more"])


_REGS = [f"r{i}" for i in range(WORDS)]


def _grams(columns: dict) -> pa.RecordBatch:
    values, of = shingles(_consistent(columns["text"]))
    n = len(columns["text"])
    digest, _ = _digests(values, of, n)
    bounds = np.searchsorted(of, np.arange(n + 1))
    # of rows with the same key, the text that the node stands for
    keep = [i for i in range(n) if digest[i, 0] == columns["d1"][i] and digest[i, 1] == columns["d2"][i]]
    return pa.RecordBatch.from_arrays([pa.array([columns["node"][i] for i in keep], pa.int64()), pa.array([values[bounds[i]:bounds[i + 1]].tobytes() for i in keep], pa.binary())], names=["node", "grams"])


def _compared(columns: dict) -> pa.RecordBatch:
    out = []
    for x, y in zip(columns["grams_a"], columns["grams_b"]):
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    keep = [i for i, j in enumerate(out) if j >= THRESHOLD]
    return pa.RecordBatch.from_arrays([pa.array([columns["a"][i] for i in keep], pa.int64()), pa.array([columns["b"][i] for i in keep], pa.int64()), pa.array([out[i] for i in keep], pa.float64())], names=["a", "b", "jaccard"])


def pairs_in_buckets(buckets: DataFrame, about: DataFrame, meeting: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b`` (a < b): distinct pairs of nodes that share a bucket and meet a condition.

    ``buckets`` has ``bucket, node`` (bigints, distinct rows), ``about`` one row a node; ``meeting`` keeps the pairs that meet the
    condition, by the columns of ``about`` with x_ and y_ before their names. Buckets with one node are gone before the join. In buckets up to PART nodes pairs are made first, made
    distinct and then tried, so that what is known of nodes isn't shuffled with the buckets. Larger buckets are cut into parts, each
    tried against each other in a task of its own, and only pairs that meet the condition leave the join. The heaviest
    buckets are known from a sample of nodes (which decides on nothing but the way), so that none is counted in one task.
    """
    columns = [c for c in about.columns if c != "node"]
    x, y = (about.select(F.col("node").alias(n), *[F.col(c).alias(f"{side}_{c}") for c in columns]) for n, side in (("a", "x"), ("b", "y")))
    every = max(1, about.count() // SAMPLED_NODES)
    heavy = F.broadcast(stored(buckets.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).groupBy("bucket").agg(F.count("*").alias("seen")).where(f"seen > {HEAVY} and seen * {every} > {PART}").select("bucket")))
    counted = buckets.join(heavy, "bucket", "left_anti").withColumn("size", F.count("*").over(Window.partitionBy("bucket")))
    shared = stored(counted.where("size > 1"))
    small = shared.where(f"size <= {PART}").select("bucket", "node")
    p, q = small.alias("p"), small.alias("q")
    made = p.join(q, F.expr("p.bucket = q.bucket and p.node < q.node")).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    tried = meeting(made.repartition("a").distinct().join(x, "a").join(y, "b")).select("a", "b")
    large = shared.where(f"size > {PART}").select("bucket", "node")
    beyond = buckets.join(heavy, "bucket", "left_semi")
    large = stored(large.union(beyond))
    if large.isEmpty():
        return tried
    sizes = large.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    given = large.join(checked_broadcast(stored(sizes)), "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = given.withColumnRenamed("node", "a").join(x, "a")
    right = given.withColumnRenamed("node", "b").join(y, "b").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select(F.col("bucket").alias("to"), F.col("part").alias("own"), "other", "b", *[f"y_{c}" for c in columns])
    # the parts of a pair are the key of its task
    left = left.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = left.join(right, F.expr("bucket = to and part = other and against = own and a < b"))
    return tried.union(meeting(met).select("a", "b")).distinct()


def near(df: DataFrame, key: str = "id", text: str = "text", carried: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``key, rep, first, copies`` of every text with words, and ``a, b, jaccard`` of all pairs of
    classes from THRESHOLD on (a < b, both values of rep).

    Records with the same set of shingles (by a digest of 128 bits) are one class: ``rep`` is its number in this run, ``first`` the least
    key in it, ``copies`` its size. Null texts and texts without letters or digits are in neither. Links are never
    capped. A bigint column ``carried`` stays with the members.
    """
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(df[key].alias("key"), df[text].alias("text")).where("text is not null")
    rows = df.select(df[key].alias("key"), (df[carried] if carried else F.lit(None)).cast("bigint").alias("carried"), df[text].alias("text")).where("text is not null")
    sketched = rows.mapInArrow(A.map_arrow(_sketch, 2_000_000), f"key {kind}, carried bigint, d1 bigint, d2 bigint, n int, {', '.join(f'{r} bigint' for r in _REGS)}, bands array<int>, more array<tinyint>").where("n > 0")
    sketched = stored(sketched.withColumn("node", F.monotonically_increasing_id()))
    # classes with copies: first the half digests that come more than once, then whole digests of their rows alone
    twice = stored(sketched.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"))
    copied = stored(sketched.select("d1", "d2", "key", "node").join(checked_broadcast(twice), "d1", "left_semi").groupBy("d1", "d2").agg(
        F.min(F.struct("key", "node")).alias("f"), F.count("*").alias("copies")).where("copies > 1").select("d1", "d2", F.col("f.key").alias("first"), F.col("f.node").alias("rep"), "copies"))
    named = sketched.join(checked_broadcast(copied), ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "node"))
    members = named.select(F.col("key").alias(key), "rep", F.coalesce("first", "key").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"), *([F.col("carried").alias(carried)] if carried else []))
    sets = named.where("rep = node")
    banded = sets.select("node", "more", F.posexplode("bands").alias("no", "low")).select(
        F.expr("shiftleft(cast(no as bigint), 40) | shiftleft(more[no] & 255L, 32) | (low & 4294967295L)").alias("bucket"), "node")
    close = stored(pairs_in_buckets(banded, sets.select("node", "n", *_REGS), _alike))
    # texts are read again, those of close pairs alone, and compared as sets
    needed = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(sketched.select("node", "key", "d1", "d2").join(checked_broadcast(stored(needed)), "node", "left_semi"))
    grams = stored(texts.join(checked_broadcast(wanted), "key").select("node", "d1", "d2", "text").mapInArrow(A.map_arrow(_grams, 2_000_000), "node bigint, grams binary").dropDuplicates(["node"]))
    both = close.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = both.select("a", "b", "grams_a", "grams_b").mapInArrow(A.map_arrow(_compared), "a bigint, b bigint, jaccard double")
    return members, links


def pairs_of(members: DataFrame, links: DataFrame, key: str, same: str | None = None) -> DataFrame:
    """``id_a, id_b`` of all rows in linked or equal classes; rows equal in column ``same`` of members aren't paired.

    Classes with more than PART copies are cut into parts, so that neither a class nor a link is expanded in one task.
    """
    apart = f" and not (x.{same} <=> y.{same})" if same else ""
    parts = F.ceil(F.col("copies") / PART).cast("int")
    given = members.withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).withColumn("parts", parts)
    several = given.where("copies > 1")
    x, y = several.alias("x"), several.withColumn("for", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    equal = x.join(y, F.expr(f"x.rep = y.rep and x.part = y.for and x.`{key}` < y.`{key}`{apart}")).select(F.col(f"x.{key}").alias("id_a"), F.col(f"y.{key}").alias("id_b"))
    large = checked_broadcast(stored(several.where("parts > 1").select("rep", "parts").distinct()))
    asked = links.select("a", "b")
    for side in ("a", "b"):
        asked = asked.join(large.select(F.col("rep").alias(side), F.col("parts").alias(f"parts_{side}")), side, "left")
        asked = asked.withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{side}", F.lit(1)) - 1)))
    x, y = given.alias("x"), given.alias("y")
    linked = asked.join(x, F.expr("a = x.rep and part_a = x.part")).join(y, F.expr("b = y.rep and part_b = y.part")).where("true" + apart).select(
        F.least(f"x.{key}", f"y.{key}").alias("id_a"), F.greatest(f"x.{key}", f"y.{key}").alias("id_b")).where("id_a < id_b")
    return equal.union(linked)


# ---------------------------------------------------------------------------------------------- articles

_DOI = re.compile(r"10\.\d{4,9}/\S+")


def plain_doi(doi: str | None) -> str | None:
    """A DOI however written, in one way: lower case, from "10." on, without closing punctuation."""
    if not doi:
        return None
    m = _DOI.search(A.plain(doi).strip().lower().replace("%2f", "/"))
    return m.group().rstrip(".,;)]\"'") if m else None


def title_words(title: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", A.plain(title or "").lower())


#: Words of either title that may be missing in the other.
MISSING = 2
LEAST_WORDS = 6
#: Of so many words in all, the ones that are more frequent than one of them on average are common; there can't be more.
COMMON_WORDS = 20_000


def _records(columns: dict) -> pa.RecordBatch:
    words = [title_words(t) for t in columns["title"]]
    return pa.RecordBatch.from_arrays([
        pa.array(columns["key"]), pa.array([plain_doi(d) for d in columns["doi"]], pa.string()),
        pa.array([" ".join(sorted(set(w))) if len(w) >= LEAST_WORDS else None for w in words], pa.string()),
    ], names=["key", "doi", "words"])


def _classes(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets) of records by the value of a column: ``key, rep, copies``, and ``node, <by>, copies`` of each value."""
    sets = stored(stored(rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("copies"))).withColumn("node", F.monotonically_increasing_id()))
    members = rows.where(F.col(by).isNotNull()).join(checked_broadcast(sets), by).select("key", F.col("node").alias("rep"), "copies")
    return members, sets


def rare_word_keys(sets: DataFrame) -> DataFrame:
    """``bucket, node`` of sets (``node, words``): two sets of words with at most MISSING words missing on either side share a bucket.

    Words are ranked by rarity over all sets. Such sets share two at least of the MISSING + 2 rarest words of either, so the buckets are
    pairs of these; sets too small for that are met by single words, and the smallest by one bucket of their own. How often a word stands
    is joined by a broadcast for the common ones, of which there are COMMON_WORDS at most, so no common word makes a large group.
    """
    each = sets.select("node", F.explode(F.split("words", " ")).alias("word"))
    rarity = stored(each.groupBy("word").agg(F.count("*").alias("n")))
    total = rarity.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(rarity.where(F.col("n") > max(1, total // COMMON_WORDS)))
    frequent = each.join(common, "word")
    others = each.join(common, "word", "left_anti").join(rarity.where(F.col("n") <= max(1, total // COMMON_WORDS)), "word")
    ranked = frequent.unionByName(others).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).word.alias("w"))
    most = MISSING + 2
    pairs = f"flatten(transform(sequence(0, {most - 2}), i -> transform(sequence(i + 1, {most - 1}), j -> concat(array_min(array(w[i], w[j])), ' ', array_max(array(w[i], w[j]))))))"
    keys = F.expr(f"""concat(CASE WHEN size(w) >= {most} THEN {pairs} ELSE array() END,
        CASE WHEN size(w) <= {2 * MISSING + 1} THEN slice(w, 1, {MISSING + 1}) ELSE array() END, CASE WHEN size(w) <= {2 * MISSING} THEN array('') ELSE array() END)""")
    return ranked.select("node", F.explode(keys).alias("key")).select(F.xxhash64("key").alias("bucket"), "node").distinct()


def near_articles(df: DataFrame, key: str = "id") -> list[tuple[DataFrame, DataFrame]]:
    """Two results like that of near, over records with ``title, doi``: those with the same DOI once written alike (no links), and
    those whose titles have LEAST_WORDS words or more and at most MISSING words of either that aren't in the other, whatever
    case, punctuation and order. Null titles and DOIs match nothing."""
    kind = df.schema[key].dataType.simpleString()
    rows = stored(df.select(df[key].alias("key"), "title", "doi").mapInArrow(A.map_arrow(_records), f"key {kind}, doi string, words string"))
    by_doi, _ = _classes(rows, "doi")
    by_title, sets = _classes(rows, "words")
    few = f"size(array_except(split(x_words, ' '), split(y_words, ' '))) <= {MISSING} and size(array_except(split(y_words, ' '), split(x_words, ' '))) <= {MISSING}"
    links = pairs_in_buckets(rare_word_keys(sets), sets.select("node", "words"), lambda pairs: pairs.where(few))
    none = links.limit(0)
    return [(m.withColumnRenamed("key", key), found) for m, found in ((by_doi, none), (by_title, links))]
