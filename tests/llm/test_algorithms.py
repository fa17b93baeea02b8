"""Tests of near-duplicates, splitting and packing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import common, duplicates, packing, splitting

# ------------------------------------------------------------------------------------------- duplicates


def jaccard(a, b):
    s = [set(zip(x.lower().split(), x.lower().split()[1:], x.lower().split()[2:])) for x in (a, b)]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def corpus(seed=9):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        for k in rng.sample(range(60), rng.choice([1, 2, 4, 9])):
            w[k] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + texts[:3] + [texts[0].upper() + "!"]


def test_pairs_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(f"r{i:03d}", t, "x", "y") for i, t in enumerate(texts)] + [("n1", None, "", ""), ("n2", "", "", ""), ("n3", " ", "", ""), ("n4", "?!", "", "")], "id string, text string, rep string, a string")
    members, links = duplicates.near(df)
    got = {(r.id_a, r.id_b) for r in duplicates.pairs_of(members, links, "id").collect()}
    clean = [t.replace("!", "") for t in texts]
    exact = {(f"r{i:03d}", f"r{j:03d}"): jaccard(clean[i], clean[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    assert all(exact[p] >= 0.6 for p in got)
    want = {p for p, j in exact.items() if j >= 0.62}
    assert len(want & got) >= 0.95 * len(want) and {p for p, j in exact.items() if j > 0.75} <= got
    assert members.count() == len(texts)
    m, l = duplicates.near(df.limit(0))
    assert m.count() == 0 and l.count() == 0


@pytest.mark.parametrize("size, least", [(20, 0.93), (60, 0.95), (300, 0.95)])
def test_bands_bring_pairs_of_low_similarity_together(size, least):
    rng = np.random.default_rng(5)
    n = 3000
    both = int(np.ceil(size * 2 * 0.6 / 1.6))  # of size each: similarity 0.6 or little more
    texts = []
    for _ in range(n):
        pool = rng.choice(1 << 32, 2 * size - both, replace=False).astype(np.uint32)
        texts += [pool[:size], pool[size - both:]]
    regs = duplicates.registers(np.concatenate(texts), np.repeat(np.arange(2 * n), size), 2 * n)
    keys = duplicates.band_keys(duplicates.filled(regs))
    assert keys.max() < 1 << 40
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= least


def test_buckets_of_any_size_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [(i, rng.randrange(4)) for i in range(120)]
    rows = {(rng.randrange(6) if rng.random() < 0.7 else 99, i) for i, _ in nodes for _ in range(3)}
    want = {(a, b) for k, a in rows for j, b in rows if k == j and a < b and dict(nodes)[a] == dict(nodes)[b]}
    buckets, about = spark.createDataFrame(sorted(rows), "bucket long, node long"), spark.createDataFrame(nodes, "node long, kind int")
    for part, heavy in ((1000, 20), (7, 1000), (7, 0)):
        monkeypatch.setattr(duplicates, "PART", part)
        monkeypatch.setattr(duplicates, "HEAVY", heavy)
        got = [(r.a, r.b) for r in duplicates.pairs_in_buckets(buckets, about, lambda p: p.where("x_kind = y_kind")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_copies_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PART", 4)
    texts = ["one two three four five six seven eight nine ten"] * 23 + ["one two three four five six seven eight nine ten eleven"] * 9 + ["something else"]
    df = spark.createDataFrame([(f"r{i:02d}", t) for i, t in enumerate(texts)], "id string, text string")
    members, links = duplicates.near(df)
    got = [(r.id_a, r.id_b) for r in duplicates.pairs_of(members, links, "id").collect()]
    assert len(got) == len(set(got)) == 32 * 31 // 2 and links.count() == 1
    assert {(r["first"], r.copies) for r in members.collect()} == {("r00", 23), ("r23", 9), ("r32", 1)}


def test_tables_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    texts = ["one two three four five six seven eight nine ten"] * 3 + ["one two three four five six seven eight nine ten eleven", "something else", "something else"]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "id string, text string")
    got = []
    for most in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        got.append(sorted((r.id_a, r.id_b) for r in duplicates.pairs_of(*duplicates.near(df), "id").collect()))
    assert got[0] == got[1] and len(got[0]) == 7


def test_form_of_problem_2_is_used(spark):
    texts = ["the house of water stands on the hill", "the \u04bbouse of \u051dater stands on the hill", "the hou\u2061se of water stands on the hill"]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "id string, text string")
    members, _ = duplicates.near(df)
    assert [(r["first"], r.copies) for r in members.collect()] == [("r0", 3)] * 3


def test_short_and_long_and_wide_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([("a", "one"), ("b", "One."), ("c", "two words"), ("d", long), ("e", long + " end"), ("f", "离子交换容量的测量取决于水"), ("g", "离子交换容量的测量取决于水。"), ("h", "完全不同的一段文字在这里")], "id string, text string")
    got = {(r.id_a, r.id_b) for r in duplicates.pairs_of(*duplicates.near(df), "id").collect()}
    assert got == {("a", "b"), ("d", "e"), ("f", "g")}


def test_rows_of_one_place_are_no_pair(spark):
    members = spark.createDataFrame([("a", 1, 3, 7), ("b", 1, 3, 7), ("c", 1, 3, 8)], "id string, rep long, copies long, place long")
    links = spark.createDataFrame([], "a long, b long, jaccard double")
    assert {(r.id_a, r.id_b) for r in duplicates.pairs_of(members, links, "id", "place").collect()} == {("a", "c"), ("b", "c")}


@pytest.mark.parametrize("size", [40, 300])
def test_estimate_is_unbiased(spark, size):
    rng = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.9):
        both, own = int(size * share), int(size * (1 - share) / 2)
        rows = []
        for _ in range(60):
            pool = rng.choice(1 << 32, both + 2 * own, replace=False).astype(np.uint32)
            sets = pool[:both + own], np.concatenate([pool[:both], pool[both + own:]])
            short = duplicates.compressed(duplicates.filled(duplicates.registers(np.concatenate(sets), np.repeat([0, 1], [len(x) for x in sets]), 2)))
            rows.append([int(v) for v in short.ravel()])
        names = [f"{side}_r{i}" for side in "xy" for i in range(duplicates.WORDS)]
        df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
        got = [r[0] for r in duplicates.unlike_registers(df).select(duplicates.estimate(F.col("unlike"))).collect()]
        assert abs(np.mean(got) - both / (both + 2 * own)) < 0.03


@pytest.mark.parametrize("doi, want", [(" 10.1/X", None), ("doi:10.1234/ABC.", "10.1234/abc"), ("https://doi.org/10.1234/abc", "10.1234/abc"), ("DOI 10.1234/a%2Fb", "10.1234/a/b"), ("", None), (None, None), ("１０.1234/abc", "10.1234/abc")])
def test_plain_doi(doi, want):
    assert duplicates.plain_doi(doi) == want


def test_articles(spark):
    rows = [
        ("a", "The second survey of Kalo and Miro films: the cathode slurry", None), ("b", "the cathode slurry: the SECOND survey of Kalo and Miro films", None), ("c", "The second survey of Kalu and Miro film: the cathode slurry", None),
        ("d", "The second survey of Zeno and Bora blends: the cathode slurry", None), ("e", "Short title", "10.1234/x"), ("f", "Short title", "doi:10.1234/X"), ("g", None, None), ("h", None, ""), ("i", "a b c d e f", None), ("j", "a b c d x y", None), ("k", "a b c x y z", None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "id string, title string, doi string, words string")
    got = {(r.id_a, r.id_b) for m, l in duplicates.near_articles(df) for r in duplicates.pairs_of(m, l, "id").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("e", "f"), ("i", "j"), ("j", "k")}
    assert all(duplicates.pairs_of(m, l, "id").count() == 0 for m, l in duplicates.near_articles(df.limit(0)))


def test_articles_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(9)]
    titles = [" ".join(rng.choice(words[:rng.choice([2, 3, 5, 9])]) for _ in range(rng.choice([5, 6, 7, 8]))) for _ in range(90)]
    df = spark.createDataFrame([(f"r{i:02d}", t, None) for i, t in enumerate(titles)], "id string, title string, doi string")
    sets = [set(t.split()) if len(t.split()) >= 6 else None for t in titles]
    want = {(f"r{i:02d}", f"r{j:02d}") for i in range(90) for j in range(i + 1, 90) if sets[i] and sets[j] and len(sets[i] - sets[j]) <= 2 and len(sets[j] - sets[i]) <= 2}
    got = [(r.id_a, r.id_b) for m, l in duplicates.near_articles(df) for r in duplicates.pairs_of(m, l, "id").collect()]
    assert set(got) == want and len(got) == len(want)


# -------------------------------------------------------------------------------------------- splitting

@pytest.mark.parametrize("seed", range(8))
def test_segments_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "another ", "end. ", "。", "\n", "\n\n", "x" * rng.choice([1, 30, 900])]) for _ in range(rng.choice([3, 300, 900])))
    cut = splitting.segments(text, 1000, 150)
    assert "".join(text[s:e] for _, s, e in cut) == text and all(e - low <= 1000 for low, _, e in cut)
    assert all(0 < s - low <= 150 for low, s, _ in cut[1:]) and cut[0][0] == 0
    if len(text) > 1000:
        assert len(cut) > 1


def test_segments_keep_paragraphs():
    paragraphs = ["Sentence one is here. Sentence two is there. " * 8 + "\n\n" for _ in range(12)]
    text = "".join(paragraphs)
    borders = {len("".join(paragraphs[:k])) for k in range(13)}
    cut = splitting.segments(text, 1500, 200)
    assert all(s in borders for _, s, _ in cut) and all(text[low - 1:low].isspace() for low, _, _ in cut[1:])
    assert splitting.segments("x" * 5000, 1000, 100)[1][1] - splitting.segments("x" * 5000, 1000, 100)[1][0] == 100


def test_pieces(spark):
    pages = [f"Page {n} starts. " + f"Words of page {n} go on. " * 60 for n in range(1, 7)]
    text = "\n\n".join(pages)
    chunks = spark.createDataFrame(
        [("a", 0, 1, 6, text, 3), ("a", 1, 7, 7, "short", None), ("b", 0, 1, 2, None, 0), ("b", 1, 3, 3, "", 0), ("c", 0, 4, 9, "z" * 9000, 1), ("d", 0, None, None, "y" * 5000, 1)],
        "article_id string, chunk_index int, page_start int, page_end int, text string, char_count int")
    given = spark.createDataFrame([("a", n, t, "x") for n, t in enumerate(pages, 1)] + [("a", 1, pages[0], "x"), ("a", 7, None, "x")], "article_id string, page_number int, text string, piece string")
    rows = splitting.pieces(chunks, given).orderBy("article_id", "chunk_index", "piece").collect()
    a = [r for r in rows if (r.article_id, r.chunk_index) == ("a", 0)]
    assert "".join(r.text[r.overlap_chars:] for r in a) == text and all(r.char_count == len(r.text) <= 4500 for r in a) and a[0].page_start == 1 and a[-1].page_end == 6
    starts = [text.index(p) for p in pages]
    for r in a:
        assert r.page_start == max([n for n, s in enumerate(starts, 1) if s <= r.char_start]) and r.page_end == max(n for n, s in enumerate(starts, 1) if s < r.char_start + r.char_count)
    assert {(r.article_id, r.chunk_index) for r in rows if r.piece > 0} == {("a", 0), ("c", 0), ("d", 0)}
    assert [(r.text, r.char_count) for r in rows if (r.article_id, r.chunk_index) in (("a", 1), ("b", 1))] == [("short", 5), ("", 0)]
    assert splitting.pieces(chunks.limit(0), given.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------- packing

@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 2048])
    items = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 9)) for _ in range(rng.choice([0, 1, 2000]))]
    histogram = {}
    for n in items:
        histogram[n] = histogram.get(n, 0) + 1
    load, placed = {}, {}
    for length, rank, n, first, each in packing.plan(histogram, capacity):
        assert rank == placed.get(length, 0) + 1
        placed[length] = placed.get(length, 0) + n
        for i in range(n):
            load[first + i // each] = load.get(first + i // each, 0) + length
    assert placed == histogram and all(v <= capacity for v in load.values()) and set(load) == set(range(len(load)))
    # brute force: best fit for single items
    rooms = []
    for n in sorted(items, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    assert len(load) <= len(rooms)


def test_plan_rejects_items_beyond_capacity():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_pack(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "word " * 300, "word " * 300] + ["token " * rng.randint(1, 90) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(7, texts[7], 5)], "doc_id long, text string, length int")
    rows = packing.pack(df, capacity=100).collect()
    load, by_doc = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
    assert max(load.values()) <= 100 and set(load) == set(range(len(load))) and not {0, 1} & set(by_doc) and 2 in by_doc
    assert sorted(by_doc[3])[0] == (0, 0, 100) and sum(n for _, _, n in by_doc[3]) in (300, 301) and len(by_doc[7]) == 2
    assert sum(load.values()) / (100 * len(load)) > 0.95
    assert packing.pack(df.limit(0)).count() == 0 and packing.fill(packing.pack(df.limit(0))).collect()[0].containers == 0
    same = spark.createDataFrame([(i, 40) for i in range(5000)], "doc_id long, n_tokens long")
    placed = packing.place(same, capacity=100).collect()
    assert len(placed) == 5000 and len({r.container for r in placed}) == 2500
