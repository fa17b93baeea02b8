import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliomill.functions import rules
from foliomill.operators import chunking, classify, ingest, keys, layers, reports, search
from foliomill.settings import Settings

PAGES = "article_id string, page_number int, text string"


def fold(paragraphs, target, overlap):
    """Brute force: chunks as ranges of paragraph numbers."""
    sizes, out, first = [len(t) for _, t in paragraphs], [], 0

    def carry(end):
        if not overlap:
            return end
        start = end
        while start > first and sum(sizes[start:end]) < overlap:
            start -= 1
        return start

    for i, n in enumerate(sizes):
        if i > first and sum(sizes[first:i]) + n > target:
            out.append((first, i))
            first = carry(i)
        if n >= target:
            out.append((first, i + 1))
            first = carry(i + 1)
    if first < len(sizes):
        out.append((first, len(sizes)))
    return [(min(p for p, _ in paragraphs[a:b]), max(p for p, _ in paragraphs[a:b]), "\n\n".join(t for _, t in paragraphs[a:b])) for a, b in out]


def chunks_of(spark, rows, target, overlap):
    found = chunking.chunk_pages(spark.createDataFrame(rows, PAGES), target, overlap).collect()
    return {a: [(r.page_start, r.page_end, r.text) for r in sorted((r for r in found if r.article_id == a), key=lambda r: r.chunk_index)] for a in {r.article_id for r in found}}


def test_chunks_golden(spark):
    found = chunking.chunk_pages(spark.createDataFrame([("a", 1, "x" * 31 + "\n\n" + "y" * 17), ("a", 2, "z" * 47)], PAGES), 60, 0).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_start, r.page_end, r.char_count) for r in found] == [(0, 1, 1, 50), (1, 2, 2, 47)]
    big, s, t = "b" * 5000, "s" * 100, "t" * 100
    assert [x[2] for x in chunks_of(spark, [("a", 1, big)], 4500, 600)["a"]] == [big, big]
    assert [x[2] for x in chunks_of(spark, [("a", 1, "\n\n".join((big, s, t)))], 4500, 600)["a"]] == [big, big, f"{big}\n\n{s}", f"{big}\n\n{s}\n\n{t}"]
    assert [x[2] for x in chunks_of(spark, [("a", 1, "\n\n".join((big, s, t)))], 4500, 0)["a"]] == [big, f"{s}\n\n{t}"]


@pytest.mark.parametrize("target, overlap", [(60, 0), (60, 20), (200, 50)])
def test_chunks_against_brute_force(spark, target, overlap):
    rng = random.Random(target + overlap)
    rows, want = [], {}
    for a in range(12):
        paragraphs = [(p, "w" * rng.choice([1, 5, 20, 59, 60, 61, 150])) for p in range(1, rng.randint(1, 9)) for _ in range(rng.randint(0, 4))]
        for page in {p for p, _ in paragraphs}:
            rows.append((f"a{a}", page, "\r\n\r\n".join(t for p, t in paragraphs if p == page)))
        if paragraphs:
            want[f"a{a}"] = fold(paragraphs, target, overlap)
    rows += [("null", 1, None), ("blank", 1, " \n\n ")]
    assert chunks_of(spark, rows, target, overlap) == want


def test_chunk_arguments_and_empty(spark):
    empty = spark.createDataFrame([], PAGES)
    with pytest.raises(ValueError, match="target_chars"):
        chunking.chunk_pages(empty, 0)
    with pytest.raises(ValueError, match="overlap_chars"):
        chunking.chunk_pages(empty, 10, -1)
    assert chunking.chunk_pages(empty).count() == 0


def layer_rows(spark, *rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(str(i), "a", p, k, t, u, s, at + dt.timedelta(hours=i)) for i, (p, k, t, u, s) in enumerate(rows)],
                                 "id string, article_id string, page_number int, layer_type string, text string, has_usable_text boolean, quality_score double, created_at timestamp")


@pytest.mark.parametrize("original, ocr, want", [
    ((True, 0.72), (True, 0.80), "original"), ((True, 0.5), (True, 0.71), "ocr"), ((True, 0.5), (True, 0.70), "original"), ((False, 0.05), (True, 0.70), "ocr"), ((False, 0.1), (False, 0.2), "ocr"),
    ((False, 0.2), (False, 0.2), "original"), ((None, None), None, "original"), (None, (False, None), "ocr"), ((True, 0.1), (False, 0.9), "original")])
def test_layer_choice(spark, original, ocr, want):
    rows = [(1, k, "t", *v) for k, v in (("original", original), ("ocr", ocr)) if v]
    assert [r.selected_text_layer for r in layers.selected_pages(layer_rows(spark, *rows)).collect()] == [want]


def test_layers_redelivered_unknown_and_empty(spark):
    df = layer_rows(spark, (1, "original", "old", True, 0.9), (1, "original", None, False, None), (1, "scan", "x", True, 1.0), (2, "scan", "y", True, 1.0))
    got = layers.selected_pages(df).collect()
    assert [(r.page_number, r.text, r.has_text_layer, r.ocr_used) for r in got] == [(1, None, False, False)]
    assert layers.selected_pages(df.limit(0)).count() == 0 and layers.document_usable(df.limit(0)).count() == 0
    assert [r.selected for r in layers.layer_summary(df).collect()] == [True]


def test_document_usable(spark):
    prose = "The membrane was measured at room temperature in water. " * 3
    df = layer_rows(spark, (1, "original", prose, None, None), (2, "original", "", None, None), (3, "original", None, None, None))
    r = layers.document_usable(df).collect()[0]
    assert (r.pages, r.usable_pages, r.usable, r.ocr_required) == (3, 1, True, False)


def test_tags(spark):
    text = "Lithium form of the membrane was measured in NMP: EIS and ionic conductivity.\nTGA-MS of 5 wt% of water, 5 °C."
    rows = [("a", 0, "The sodium"), ("a", 3, "form and " + text), ("a", 7, None), ("b", 0, "xPC"), ("b", 1, "nothing")]
    got = {(r.article_id, r.tag_type, r.tag_value): r.hits for r in classify.tag_hits(spark.createDataFrame(rows, "article_id string, chunk_index int, text string")).collect()}
    assert {v for _, _, v in got} >= {"Li", "NMP", "conductivity", "EIS", "TGA-MS", "TGA", "membrane", "water", "method_description"}
    assert got["a", "ion_form", "Na"] == 1  # over the border of two chunks
    assert got["a", "method", "conductivity"] == 2 and got["a", "evidence_type", "numerical_table"] == 1
    assert not any(a == "b" for a, _, _ in got)
    confidences = {r.tag_value: r.confidence for r in classify.tags(spark.createDataFrame(rows, "article_id string, chunk_index int, text string")).collect()}
    assert confidences["Na"] == pytest.approx(0.7) and confidences["conductivity"] == pytest.approx(0.85)


def hits_of_whole_texts(rows):
    """Brute force: each article's text put together, and every pattern searched in it."""
    import re

    texts = {}
    for article, index, text in rows:
        texts.setdefault(article, []).append((index, text or ""))
    out = {}
    for article, parts in texts.items():
        text = "\n\n".join(t for _, t in sorted(parts))
        for _, kind, value, pattern in rules.rule_rows():
            if re.search(pattern, text, re.I | re.M):
                out[article, kind, value] = out.get((article, kind, value), 0) + 1
    return out


def test_tags_over_borders_of_chunks(spark):
    rng = random.Random(12)
    words = ["nuclear", "magnetic", "resonance", "thermogravimetric", "mass", "spectrometry", "wt", "%x", "5", "S", "cm", "sodium", "form", "a", "Table", "was", "measured", "ſodium", "K", " ", "\n", "x" * 300, "has", "been", "reported"]
    rows = []
    for article in range(60):
        text = " ".join(rng.choice(words) for _ in range(60))
        at, index = 0, 0
        while at < len(text):
            n = rng.choice([1, 3, 8, 9, 10, 40, 200])
            rows.append((f"a{article:02d}", index, text[at:at + n] if rng.random() < 0.9 else None))
            at += n + 1
            index += rng.choice([1, 1, 3])
    rows += [("m", 0, "nuclear"), ("m", 1, None), ("m", 2, "magnetic"), ("m", 5, " \n"), ("m", 9, "resonance"), ("t", 0, "thermogravimetric " + "y " * 500 + "mass"), ("t", 1, "spectrometry"), ("u", 0, "ſulfolane in N-methyl"), ("u", 1, "-2-pyrrolidone")]
    got = {(r.article_id, r.tag_type, r.tag_value): r.hits for r in classify.tag_hits(spark.createDataFrame(rows, "article_id string, chunk_index int, text string")).collect()}
    assert got == hits_of_whole_texts(rows)
    assert got["m", "method", "NMR"] == 1 and got["t", "method", "TGA-MS"] == 1 and got["u", "solvent", "SL"] == 1


def test_newest_of_rows_equal_in_all(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("k", "1", t, "old"), ("k", "2", t, "new"), (None, "3", None, "null"), (None, "4", t, "later"), ("m", "5", t, "same"), ("m", "5", t, "same"), ("s", "6", None, "one")]
    df = spark.createDataFrame(rows, "k string, id string, created_at timestamp, v string")
    assert sorted(r.v for r in keys.newest(df, ["k"]).collect()) == ["later", "new", "one", "same"]
    assert keys.newest(df.limit(0), ["k"]).columns == df.columns


@pytest.mark.parametrize("text, want", [
    ("see Table 3 for more", "table"), ("a  1  2  3  4\nb  1  2  3  4\nc\t1\t2\t3\t4\nd  5  6  7  8", "table"), ("intro\nFig. 2 shows it", "figure_caption"), ("It was measured twice", "method"), ("Plain words", "main_text"), ("", "main_text")])
def test_source_type(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(classify.source_type(F.col("t")).alias("x")).collect()[0].x == want


def test_sections(spark):
    rows = [("a", 1, "Abstract\nwords\n1. Introduction\nmore"), ("a", 2, "Experimental\n" + "x" * 90), ("a", 4, "Conclusions\nConclusions"), ("b", 4, "5. References"), ("b", 9, None), ("c", 2, "4. Discussion"), ("c", 9, "end")]
    df = spark.createDataFrame(rows, PAGES)
    found = {}
    for r in classify.sections(df).orderBy("article_id", "section_no").collect():
        found.setdefault(r.article_id, []).append((r.normalized_name, r.page_start, r.page_end))
    assert found["a"] == [("abstract", 1, 1), ("introduction", 1, 1), ("experimental", 2, 3), ("conclusions", 4, 4)]
    assert found["b"] == [("full_text", 4, 9)] and found["c"] == [("discussion", 2, 8)]
    assert classify.sections(df.limit(0)).count() == 0
    chunks = spark.createDataFrame([("a", 0, 1, 3), ("a", 1, 9, 9), ("z", 0, 1, 1)], "article_id string, chunk_index int, page_start int, page_end int")
    assert {(r.article_id, r.chunk_index): r.section_no for r in classify.chunk_sections(chunks, classify.sections(df)).collect()} == {("a", 0): 2, ("a", 1): None, ("z", 0): None}


def test_chunk_layers(spark):
    chunks = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 2, 2), ("a", 2, 7, 8), ("a", 3, 5, 4), ("a", 4, None, None)], "article_id string, chunk_index int, page_start int, page_end int")
    pages = spark.createDataFrame([("a", 1, "original"), ("a", 2, "ocr")], "article_id string, page_number int, selected_text_layer string")
    assert {r.chunk_index: r.text_layer for r in chunking.chunk_layers(chunks, pages).collect()} == {0: "mixed", 1: "ocr", 2: "original", 3: "original", 4: "original"}


CHUNKS = "id string, article_id string, chunk_index int, page_start int, page_end int, text string"


def corpus(spark):
    chunks = spark.createDataFrame([("c1", "a", 0, 1, 1, "Film of water"), ("c2", "a", 1, 1, 2, "water film, water film"), ("c3", "b", 0, 1, 1, None), ("c4", "b", 1, 1, 1, "FILM"), ("c5", "lost", 0, 1, 1, "film")], CHUNKS)
    articles = spark.createDataFrame([("a", "One", "10.1/A", "k"), ("b", None, None, "k")], "id string, title string, doi string, collection_id string")
    return chunks, articles


def test_search(spark):
    chunks, articles = corpus(spark)
    got = search.search(chunks, articles, " water film ", 2).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c2", 1018.0), ("c1", 9.0)] and got[0].retrieval_method == "exact_ilike" and got[0].snippet == "water film, water film"
    for bad in ((" ", 1), ("x", 0)):
        with pytest.raises(ValueError):
            search.search(chunks, articles, *bad)
    collections = spark.createDataFrame([("k", "main")], "id string, name string")
    assert search.collection_articles(articles, collections, "main").count() == 2
    with pytest.raises(ValueError, match="Unknown collection: other"):
        search.collection_articles(articles, collections, "other")


def test_batch_search_and_evaluation(spark):
    chunks, articles = corpus(spark)
    asked = [("1", "water film", ["10.1/a"], ["Water"]), ("2", "zzz", [], []), ("3", "film", ["10.2/b"], ["nope", "film"])]
    found = search.batch_search(chunks, articles, [(i, t) for i, t, _, _ in asked], 10)
    single = search.search(chunks, articles, "water film").collect()
    assert [(r.chunk_id, r.score, r.snippet) for r in found.where("qid = '1'").orderBy("rank").collect()] == [(r.chunk_id, r.score, r.snippet) for r in single]
    verdicts = search.evaluate(found, spark.createDataFrame(asked, "qid string, query string, expected_dois array<string>, expected_keywords array<string>"))
    got = {r.qid: (r.passed, r.missing_dois, r.missing_keywords, r.result_count) for r in verdicts.collect()}
    assert got == {"1": (True, [], [], 3), "2": (False, [], [], 0), "3": (False, ["10.2/b"], ["nope"], 3)}
    assert tuple(search.summary(verdicts).collect()[0]) == (3, 1, 2, 1)
    assert tuple(search.summary(verdicts.limit(0)).collect()[0]) == (0, 0, 0, 0)


def test_keys(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("1", "k", t, "a"), ("2", "k", None, "b"), ("3", "k", t, "c"), ("4", None, t, None)], "id string, k string, created_at timestamp, v string")
    assert {(r.k, r.v) for r in keys.newest(df, ["k"]).collect()} == {("k", "c"), (None, None)}
    old = spark.createDataFrame([("k", "x", "manual"), ("k", "y", "rule"), ("l", "z", "rule"), (None, "n", "rule")], "k string, v string, source string")
    new = spark.createDataFrame([("k", "new", "rule"), (None, "m", "rule")], "k string, v string, source string")
    assert {r.v for r in keys.replace_by_key(old, new, ["k"], F.col("source") == "manual").collect()} == {"x", "z", "new", "m"}
    assert keys.replace_by_key(old, new.limit(0), ["k"]).count() == 4
    places = sorted(random.Random(3).sample(range(5000), 60))
    rows = spark.createDataFrame([("g", p, str(p)) for p in places] + [("h", 9, "9")], "g string, p int, v string")
    got = {r.p: r.before for r in keys.previous_value(rows, "g", "p", F.col("v"), "before").where("g = 'g'").collect()}
    assert got == dict(zip(places, [None, *map(str, places[:-1])]))


def test_reports(spark):
    chunks, articles = corpus(spark)
    chunks = chunks.withColumn("source_type", F.lit("main_text")).withColumn("text_layer", F.lit("ocr"))
    pages = spark.createDataFrame([("a", 1, "ocr"), ("a", 2, "original")], "article_id string, page_number int, selected_text_layer string")
    tags = spark.createDataFrame([("a", "solvent", v) for v in ("water", "EC", "EC", "PC")] + [("a", "method", "EIS")], "article_id string, tag_type string, tag_value string")
    got = {r.article_id: r for r in reports.article_list(articles, pages, chunks, tags).collect()}
    assert (got["a"].page_count, got["a"].chunk_count, got["a"].page_layers, got["a"].tags) == (2, 2, "ocr=1, original=1", "method: EIS; solvent: EC, PC, water")
    assert (got["b"].page_count, got["b"].chunk_count, got["b"].page_layers, got["b"].tags) == (0, 2, "", "")
    sections = spark.createDataFrame([("a", 0, "results", "R", 1, 2, "main_text"), ("a", 1, None, "R", 2, 2, "main_text")], "article_id string, section_no int, normalized_name string, name string, page_start int, page_end int, source_type string")
    roll = {(r.metric, r.name): r.n for r in reports.collection_report(articles, chunks, tags, sections).collect()}
    assert roll["articles", "all"] == 2 and roll["tags", "solvent"] == 3 and roll["chunks by source type", "main_text"] == 4 and roll["sections", "unknown"] == 1
    assert reports.article_report(articles, pages, chunks, tags, sections).where("article_id = 'a'").collect()[0].section_count == 2


def test_upsert_jobs_and_first_pages(spark):
    schema = "id string, collection_id string, title string, doi string, pdf_original_path string, pdf_ocr_path string, checksum_sha256 string, status string, indexed_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("1", "c", "T", "", "p", None, "s1", "needs_review", None, None), ("2", "c", "U", "10.1/x", "p", None, "s2", "indexed", None, None)], schema)
    new = spark.createDataFrame([("s1", "d", "10.9/n", "indexed"), ("s2", "d", "10.9/m", "indexed"), ("s3", "d", None, "indexed")], "checksum_sha256 string, collection_id string, doi string, status string")
    got = {r.checksum_sha256: (r.id, r.collection_id, r.title, r.doi, r.status) for r in ingest.upsert_articles(old, new).collect()}
    assert got == {"s1": ("1", "d", "T", "10.9/n", "indexed"), "s2": ("2", "d", "U", "10.1/x", "indexed"), "s3": (None, "d", None, None, "indexed")}
    pages = spark.createDataFrame([("a", n, t) for n, t in ((2, " "), (5, "x"), (6, None), (7, "10.1000/late"))], PAGES)
    assert ingest.first_pages_text(pages).collect()[0].text == " \nx\n"
    assert ingest.first_doi(pages).collect()[0].doi is None
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("1", "p", "failed", t), ("2", "p", "indexed", t), ("3", "q", "processing", None)], "id string, input_path string, status string, created_at timestamp")
    assert {r.input_path: (r.status, r.attempts, r.failures) for r in ingest.latest_jobs(jobs).collect()} == {"p": ("indexed", 2, 1), "q": ("processing", 1, 0)}
    assert tuple(ingest.job_summary(jobs).collect()[0]) == (3, 1, 1, 1, 2)
    with pytest.raises(ValueError):
        Settings(chunk_target_chars=10)
