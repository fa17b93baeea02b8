"""The engine over its own tables: files in, tables, searches and reports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill import schemas
from foliomill.operators import classify, ingest, layers, reports, search
from foliomill.operators.diagnostics import diagnose
from foliomill.settings import Settings
from foliomill.sources import files
from foliomill.sources.staging import stored
from foliomill.streaming.folder import watch

RESULT = ["path", "article_id", "status", "checksum_sha256", "page_count", "chunk_count", "ocr_required", "error"]
#: The columns of a search result that its response shows.
RESPONSE = ["article_id", "chunk_id", "title", "doi", "page_start", "page_end", "snippet", "score", "retrieval_method"]


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    database: str = "default"
    extractor: files.Extractor | None = None

    def read(self, name: str) -> DataFrame:
        return schemas.read(self.spark, self.database, name)

    def _extract(self) -> files.Extractor:
        return self.extractor or files.pdf_extractor()

    def collection_id(self, name: str) -> str:
        found = self.read("collections").where(F.col("name") == name).select("id").limit(1).collect()
        if not found:
            raise ValueError(f"Unknown collection: {name}")
        return found[0].id

    def articles_of(self, target: str) -> DataFrame:
        """Articles by title: all, or the one with an id. ValueError for an id that isn't there."""
        every = self.read("articles")
        if target == "all":
            return every.orderBy(*reports.by_title())
        one = every.where(F.col("id") == target)
        if one.isEmpty():
            raise ValueError(f"target must be 'all' or the id of an article: {target}")
        return one

    # ------------------------------------------------------------------------------------------- ingestion

    def ingest(self, given: DataFrame, collection: str = "literature", force_ocr: bool = False) -> DataFrame:
        """Ingests files (``path, checksum_sha256, content``) into the tables; RESULT of each file, by path. Copies, extraction and OCR run in tasks."""
        collection_id, extract, s = self.collection_id(collection), self._extract(), self.settings
        extracted = stored(files.extract_pages(files.store_copies(given, s.data_root), extract))
        known = stored(self.read("articles").join(extracted.select("checksum_sha256").distinct(), "checksum_sha256", "left_semi"))
        n = lambda name, column: self.read(name).join(known.select(F.col("id").alias("article_id")), "article_id", "left_semi").groupBy("article_id").agg(F.count("*").alias(column))
        counts = n("pages", "page_count").join(n("chunks", "chunk_count"), "article_id", "full")

        def ocr(needed: DataFrame) -> DataFrame:
            done = stored(files.ocr_files(needed, s.data_root, languages=s.ocr_languages, command=s.ocr_command, timeout_seconds=s.ocr_timeout_seconds, force=force_ocr))
            pages = files.read_pages(done.where("ocr_path is not null"), "ocr_path", extract)
            return pages.unionByName(done.where("ocr_path is null").select("path", "checksum_sha256", "ocr_path", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text"), "error"))

        made = ingest.ingest(extracted, known, collection_id, s, ocr, force_ocr, counts)
        articles = stored(ingest.upsert_articles(known, made.articles))
        self._write(articles.where(F.col("id").isNotNull()), made.articles.select("id"), made.page_text_layers, made.content)
        schemas.append(self.spark, self.database, "ingestion_jobs", made.jobs)
        return made.results.select(*RESULT).orderBy("path")

    def _write(self, articles: DataFrame | None, owners: DataFrame, new_layers: DataFrame | None, content: ingest.Content) -> None:
        write = lambda name, rows, **k: schemas.replace(self.spark, self.database, name, rows, owners, **k)
        owners = stored(owners)
        if new_layers is not None:
            kinds = new_layers.select(F.col("article_id").alias("a"), F.col("layer_type").alias("t")).distinct()
            old = self.read("page_text_layers").join(owners.toDF("article_id"), "article_id", "left_semi").join(kinds, F.expr("article_id = a and layer_type = t"), "left_anti")
            write("page_text_layers", schemas.conform(old, "page_text_layers").unionByName(schemas.conform(new_layers, "page_text_layers")))
        now = F.current_timestamp()
        write("pages", content.pages.withColumn("created_at", now))
        write("chunks", content.chunks.withColumn("created_at", now))
        write("sections", content.sections)
        write("article_tags", content.article_tags.withColumn("created_at", now), keep=F.col("source") != schemas.RULE_TAGS)
        if articles is not None:
            write("articles", articles)

    def ingest_folder(self, folder: str, collection: str = "literature", force_ocr: bool = False) -> tuple[DataFrame, dict[str, int]]:
        """RESULT of all PDF files of a folder, and their summary."""
        results = stored(self.ingest(files.scan_folder(self.spark, folder), collection, force_ocr))
        return results.orderBy("path"), ingest.result_summary(results).first().asDict()

    def ingest_file(self, path: str, collection: str = "literature", force_ocr: bool = False) -> dict:
        if not path.lower().endswith(".pdf"):
            raise ValueError(f"Only PDF files are supported: {path}")
        if not files.place(path).exists():
            raise FileNotFoundError(path)
        one = self.spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("checksum_sha256"))
        return self.ingest(one, collection, force_ocr).first().asDict()

    def watch_folder(self, folder: str, checkpoint: str, collection: str = "literature", done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Ingests files as they appear. A batch that is given again after a failure finds its articles known."""
        def handle(batch: DataFrame, number: int) -> None:
            results = self.ingest(batch, collection)
            if done:
                done(results, number)

        return watch(self.spark, folder, checkpoint, handle)

    def reselect(self, target: str = "all") -> DataFrame:
        """Reads the stored PDF and OCR files of articles again, where they are there, and makes pages, chunks, sections and tags of what
        the layers say now. ``article_id, title, status, chunk_count`` by title."""
        articles = stored(self.articles_of(target).select("id", "title", "pdf_original_path", "pdf_ocr_path"))
        owners = articles.select("id")
        fresh = None
        for kind, column in ((layers.ORIGINAL, "pdf_original_path"), (layers.OCR, "pdf_ocr_path")):
            pages = files.read_pages(articles.select(F.col("id").alias("article_id"), column), column, self._extract()).where("page_number is not null")
            rows = pages.select("article_id", "page_number", F.lit(kind).alias("layer_type"), F.coalesce("text", F.lit("")).alias("text"), F.col(column).alias("source_pdf_path"))
            fresh = rows if fresh is None else fresh.unionByName(rows)
        new = stored(layers.scored(fresh).withColumn("id", ingest.deterministic_id(F.col("article_id"), F.col("page_number"), F.col("layer_type"))).withColumn("created_at", F.current_timestamp()))
        kinds = new.select(F.col("article_id").alias("a"), F.col("layer_type").alias("t")).distinct()
        old = self.read("page_text_layers").join(owners.toDF("article_id"), "article_id", "left_semi").join(kinds, F.expr("article_id = a and layer_type = t"), "left_anti")
        every = stored(schemas.conform(old, "page_text_layers").unionByName(schemas.conform(new, "page_text_layers")))
        made = ingest.content(every, self.settings)
        self._write(None, owners, every, made)
        n = self.read("chunks").groupBy("article_id").agg(F.count("*").alias("n"))
        return articles.join(n, F.col("id") == F.col("article_id"), "left").select(
            F.col("id").alias("article_id"), "title", F.lit("reselected").alias("status"), F.coalesce("n", F.lit(0)).alias("chunk_count")).orderBy(F.asc_nulls_last("title"), "article_id")

    # ------------------------------------------------------------------------------------------- questions

    def text_layers(self, article_id: str) -> DataFrame:
        """The layers of an article by page and type, with the one its pages have chosen."""
        self.articles_of(article_id)
        chosen = self.read("pages").where(F.col("article_id") == article_id).select("page_number", "selected_text_layer")
        rows = self.read("page_text_layers").where(F.col("article_id") == article_id).join(chosen, "page_number", "left")
        return rows.select("page_number", "layer_type", "has_usable_text", "quality_score", F.coalesce(F.col("selected_text_layer") == F.col("layer_type"), F.lit(False)).alias("selected"), "source_pdf_path").orderBy("page_number", "layer_type")

    def search(self, query: str, collection: str = "literature", top_k: int | None = None) -> dict:
        """The response of a search: ``query, results``."""
        top_k = self.settings.default_top_k if top_k is None else top_k
        search.checked(query, top_k)
        articles = search.collection_articles(self.read("articles"), self.read("collections"), collection)
        return search.response(query, search.search(self.read("chunks"), articles, query, top_k).select(*RESPONSE))

    def classify(self, collection: str = "literature") -> DataFrame:
        """Tags, sections and kinds of chunks of a collection's articles made again; ``article_id, title, status`` by title."""
        articles = stored(self.read("articles").where(F.col("collection_id") == self.collection_id(collection)).select("id", "title"))
        ids = articles.select(F.col("id").alias("article_id"))
        pages, chunks = (stored(self.read(name).join(ids, "article_id", "left_semi")) for name in ("pages", "chunks"))
        found = stored(classify.sections(pages))
        placed = classify.chunk_sections(chunks, found)
        section = F.when(F.col("section_no").isNotNull(), ingest.deterministic_id(F.col("article_id"), F.lit("section"), F.col("section_no")))
        rows = chunks.join(placed, ["article_id", "chunk_index"], "left").withColumn("section_id", section).withColumn("source_type", classify.source_type(F.col("text")))
        tags = classify.tags(chunks).withColumn("id", ingest.deterministic_id(F.col("article_id"), F.col("tag_type"), F.col("tag_value"), F.col("source"))).withColumn("created_at", F.current_timestamp())
        owners = articles.select("id")
        for name, new, keep in (("chunks", rows, None), ("sections", found.withColumn("id", ingest.deterministic_id(F.col("article_id"), F.lit("section"), F.col("section_no"))), None), ("article_tags", tags, F.col("source") != schemas.RULE_TAGS)):
            schemas.replace(self.spark, self.database, name, stored(new), owners, keep=keep)
        return articles.select(F.col("id").alias("article_id"), "title", F.lit("classified").alias("status")).orderBy(F.asc_nulls_last("title"), "article_id")

    def report(self, collection: str = "literature") -> dict:
        """The classification report of a collection: ``created_at, collection, summary, articles``; nested, with everything by article."""
        articles = self.read("articles").where(F.col("collection_id") == self.collection_id(collection))
        ids = articles.select(F.col("id").alias("article_id"))
        pages, chunks, tags, sections = (self.read(name).join(ids, "article_id", "left_semi") for name in ("pages", "chunks", "article_tags", "sections"))
        rows = reports.nested_articles(articles, pages, chunks, tags, sections).toLocalIterator()
        each = [r.asDict(recursive=True) for r in rows]
        return {"created_at": datetime.now(UTC).isoformat(), "collection": collection, "summary": reports.nested_summary(reports.collection_report(articles, chunks, tags, sections)), "articles": each}

    def evaluate(self, questions_path: str, collection: str = "literature", top_k: int = 10) -> dict:
        """The report of a question file: ``created_at, questions_path, settings, summary, questions, failures``."""
        asked = files.load_questions(self.spark, questions_path)
        articles = search.collection_articles(self.read("articles"), self.read("collections"), collection)
        rows = asked.collect()  # the lines of a file that is read on the driver
        found = stored(search.batch_search(self.read("chunks"), articles, [(r.qid, r.query) for r in rows], top_k))
        verdicts = {r.qid: r for r in search.evaluate(found, asked).collect()}
        results: dict[str, list] = {}
        for r in found.select("qid", "rank", *RESPONSE).orderBy("qid", "rank").collect():
            results.setdefault(r.qid, []).append({c: r[c] for c in RESPONSE})
        questions = [{
            "id": r.qid, "query": r.query, "passed": verdicts[r.qid].passed, "expected_article_dois": r.expected_dois, "expected_keywords": r.expected_keywords, "missing_article_dois": verdicts[r.qid].missing_dois,
            "missing_keywords": verdicts[r.qid].missing_keywords, "result_count": verdicts[r.qid].result_count, "results": results.get(r.qid, [])} for r in rows]
        failures = [q for q in questions if not q["passed"]]
        return {
            "created_at": datetime.now(UTC).isoformat(), "questions_path": questions_path, "settings": {"collection": collection, "top_k": top_k, "retrieval_method": "exact_ilike", "default_top_k": self.settings.default_top_k},
            "summary": {"total": len(questions), "passed": len(questions) - len(failures), "failed": len(failures), "empty_result_queries": sum(q["result_count"] == 0 for q in questions)}, "questions": questions, "failures": failures}

    def doctor(self) -> dict[str, dict[str, object]]:
        return diagnose(self.spark, self.settings, self.database)
