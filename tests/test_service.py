import hashlib
import json
import stat

import pytest
from pyspark.sql import functions as F

from foliomill import cli, schemas
from foliomill.service import Engine
from foliomill.settings import Settings

PROSE = "The protonated Nafion membrane was measured in water at room temperature. See doi:10.1000/ABC.1, please. " * 2


def fake(content: bytes) -> list[str]:
    text = content.decode()
    if text.startswith("bad"):
        raise ValueError("broken file")
    return text.split("|")


@pytest.fixture
def engine(spark, tmp_path):
    database = f"d{abs(hash(str(tmp_path))) % 10**9}"
    spark.sql(f"CREATE DATABASE {database}")
    schemas.upgrade(spark, database)
    tool = tmp_path / "ocr"
    # what OCR of a file holds is its name with prose, or its error
    tool.write_text(f'#!/bin/sh\ncase "$4" in *unreadable*) echo no page found >&2; exit 2;; *blank*) printf " " > "$5";; *) printf "%s" "OCR of it. {PROSE}" > "$5";; esac\n')
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    yield Engine(spark, Settings(data_root=str(tmp_path / "data"), ocr_command=str(tool)), database, fake)
    spark.sql(f"DROP DATABASE {database} CASCADE")


def folder_of(tmp_path, **names):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for name, text in names.items():
        (folder / f"{name}.pdf").write_text(text)
    return str(folder)


def test_folder_into_tables(engine, tmp_path):
    folder = folder_of(tmp_path, a="Abstract\n\n" + PROSE + "|" + PROSE, b="Abstract\n\n" + PROSE + "|" + PROSE, c="bad", scan=" ", unreadable="\n", blank="  ")
    results, summary = engine.ingest_folder(folder)
    got = {r.path.rsplit("/", 1)[1]: r for r in results.collect()}
    assert summary == {"total": 6, "indexed": 2, "duplicate": 1, "failed": 3}
    assert {k: r.status for k, r in got.items()} == {"a.pdf": "indexed", "b.pdf": "duplicate", "c.pdf": "failed", "scan.pdf": "indexed", "unreadable.pdf": "failed", "blank.pdf": "failed"}
    assert got["b.pdf"].article_id == got["a.pdf"].article_id and (got["a.pdf"].page_count, got["a.pdf"].chunk_count, got["a.pdf"].ocr_required) == (2, 1, False) and got["scan.pdf"].ocr_required
    assert got["c.pdf"].error == "ValueError: broken file" and "no page found" in got["unreadable.pdf"].error and got["blank.pdf"].error.startswith("OCR completed but output still lacks a usable text layer: /")
    articles = {r.title: r for r in engine.read("articles").collect()}
    checksum = hashlib.sha256((tmp_path / "in" / "a.pdf").read_bytes()).hexdigest()
    assert set(articles) == {"a", "scan"} and articles["a"].pdf_original_path == f"{engine.settings.data_root}/pdf/{checksum[:16]}_a.pdf" and articles["a"].pdf_ocr_path is None
    assert articles["a"].doi == "10.1000/abc.1" and articles["a"].indexed_at and articles["a"].created_at and articles["scan"].pdf_ocr_path.endswith("_scan.pdf")
    jobs = engine.read("ingestion_jobs").collect()
    assert len(jobs) == 5 and all(j.started_at and j.finished_at for j in jobs) and {j.status for j in jobs} == {"indexed", "failed"}
    assert engine.read("pages").count() == 3 and {r.selected_text_layer for r in engine.read("pages").collect()} == {"original", "ocr"}
    assert {r.tag_value for r in engine.read("article_tags").collect()} >= {"H", "water", "membrane"} and engine.read("chunks").where("section_id is not null").count() == 2
    # again: all known ones are duplicates, with the counts of their articles
    said = []
    assert cli.run(engine, ["ingest", "folder", folder], said.append) == 1
    *again, last = map(json.loads, said)
    assert last == {"summary": {"total": 6, "indexed": 0, "duplicate": 3, "failed": 3}} and {r["path"].rsplit("/", 1)[1]: r["page_count"] for r in again if r["status"] == "duplicate"} == {"a.pdf": 2, "b.pdf": 2, "scan.pdf": 1}
    assert engine.read("articles").count() == 2 and engine.read("ingestion_jobs").count() == 8
    # OCR that is forced keeps the article
    forced = engine.ingest_file(folder + "/a.pdf", "own_data", force_ocr=True)
    assert (forced["status"], forced["ocr_required"], forced["article_id"]) == ("indexed", True, got["a.pdf"].article_id)
    one = engine.read("articles").where("title = 'a'").collect()
    assert len(one) == 1 and one[0].collection_id == engine.collection_id("own_data") and one[0].pdf_ocr_path and one[0].created_at == articles["a"].created_at
    assert {r.layer_type for r in engine.read("page_text_layers").where(F.col("article_id") == one[0].id).collect()} == {"original", "ocr"} and engine.read("pages").count() == 3


def test_wrong_arguments(engine, tmp_path):
    folder, said = folder_of(tmp_path), []
    with pytest.raises(ValueError, match="Only PDF"):
        engine.ingest_file(folder + "/a.txt")
    with pytest.raises(FileNotFoundError):
        engine.ingest_file(folder + "/none.pdf")
    with pytest.raises(ValueError, match="Unknown collection"):
        engine.ingest(None, "nowhere")
    assert cli.run(engine, ["ingest", "folder", folder], said.append) == 1 and "No PDF files" in said[-1]
    assert cli.run(engine, ["ingest", "reselect-text", "nothing"], said.append) == 1 and "nothing" in said[-1]


def test_reselection_search_and_reports(engine, tmp_path):
    folder = folder_of(tmp_path, b=PROSE, a="Results\n\n" + PROSE)
    engine.ingest_folder(folder)
    path = engine.read("articles").where("title = 'b'").first().pdf_original_path
    open(path, "w").write("New words of a second reading. " + PROSE + "|" + PROSE)
    done = [(r.title, r.status, r.chunk_count) for r in engine.reselect().collect()]
    assert done == [("a", "reselected", 1), ("b", "reselected", 1)]
    found = engine.search("second reading")
    assert found["query"] == "second reading" and list(found["results"][0]) == ["article_id", "chunk_id", "title", "doi", "page_start", "page_end", "snippet", "score", "retrieval_method"] and found["results"][0]["title"] == "b"
    assert [(r.page_number, r.layer_type, r.selected) for r in engine.text_layers(found["results"][0]["article_id"]).collect()] == [(1, "original", True), (2, "original", True)]
    report = engine.report()
    assert report["summary"]["article_count"] == 2 and [a["title"] for a in report["articles"]] == ["a", "b"] and report["articles"][0]["sections"][0]["normalized_name"] == "results"
    assert report["articles"][1]["pages_by_selected_text_layer"] == {"original": 2} and report["summary"]["chunk_counts_by_text_layer"] == {"original": 2} and "H" in report["articles"][0]["tags_by_type"]["ion_form"]
    (tmp_path / "q.yaml").write_text("- {id: q1, query: second reading, expected_article_dois: [10.1000/ABC.1], expected_keywords: [Words]}\n- {id: q2, query: xyzzy, expected_article_dois: [], expected_keywords: []}\n")
    said = []
    assert cli.run(engine, ["evaluate", "retrieval", str(tmp_path / "q.yaml")], said.append) == 0
    told = json.loads(said[0])
    assert told["summary"] == {"total": 2, "passed": 1, "failed": 1, "empty_result_queries": 1} and [q["id"] for q in json.load(open(told["output_path"]))["failures"]] == ["q2"]
    assert cli.run(engine, ["classify", "all"], said.append) == 0 and json.loads(said[-1])["summary"] == {"collection": "literature", "classified": 2}


def test_watched_folder_ends_in_tables(engine, tmp_path):
    folder = folder_of(tmp_path, a=PROSE)
    engine.watch_folder(folder, str(tmp_path / "check")).awaitTermination()
    assert engine.read("articles").count() == engine.read("ingestion_jobs").count() == 1


def test_versions_keep_rows(engine, spark):
    db = engine.database
    schemas.append(spark, db, "pages", spark.createDataFrame([("1", "a", 1, "t", "ocr")], "id string, article_id string, page_number int, text string, selected_text_layer string"))
    schemas.downgrade(spark, db, 1)
    assert "selected_text_layer" not in spark.table(f"{db}.pages").columns and "text_layer" not in spark.table(f"{db}.chunks").columns and engine.read("pages").first().text == "t"
    schemas.upgrade(spark, db)
    assert [(r.text, r.selected_text_layer) for r in engine.read("pages").collect()] == [("t", "original")]
