"""Exact ranked search, one query at a time or many in one pass, and its evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as X


def checked(query: str, top_k: int) -> str:
    query = query.strip()
    if not query:
        raise ValueError("query must not be empty")
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    return query


def collection_articles(articles: DataFrame, collections: DataFrame, collection: str) -> DataFrame:
    """The articles of a collection by its name; ValueError for a name that isn't there."""
    known = collections.where(F.col("name") == collection).select("id").limit(1).collect()
    if not known:
        raise ValueError(f"Unknown collection: {collection}")
    return articles.where(F.col("collection_id") == known[0].id)


def _result(query: Column, terms: Column) -> list[Column]:
    return [F.col(c) for c in ("article_id", "chunk_id", "title", "doi", "chunk_index", "page_start", "page_end")] + [
        X.snippet(F.col("text"), query, terms).alias("snippet"), F.col("score").cast("double").alias("score"), F.lit("exact_ilike").alias("retrieval_method")]


def search(chunks: DataFrame, articles: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """The best chunks for a query: phrase or any term as substrings, whatever the case; score, chunk_index, then ids
    order them. Null texts match nothing. Snippets are made of the top_k rows alone."""
    query = checked(query, top_k)
    q = F.lit(query)
    terms = X.query_terms(q)
    hits = chunks.where(X.matches(F.col("text"), q, terms)).withColumn("score", X.score(F.col("text"), q, terms))
    found = hits.select(F.col("id").alias("chunk_id"), "article_id", "chunk_index", "page_start", "page_end", "text", "score").join(
        articles.select(F.col("id").alias("article_id"), "title", "doi"), "article_id")
    return found.orderBy(F.desc("score"), "chunk_index", "article_id", "chunk_id").limit(top_k).select(*_result(q, terms))


def response(query: str, results: DataFrame) -> dict:
    """What a search answers with: the query and its results (top_k rows at most), ready for JSON."""
    return {"query": query.strip(), "results": [r.asDict() for r in results.collect()]}


def batch_search(chunks: DataFrame, articles: DataFrame, questions: list[tuple[str, str]], top_k: int = 10) -> DataFrame:
    """search for many (qid, query) at once: ``qid, query, rank`` and its columns. The questions are a driver-side list, so
    each chunk is read once and tried against all of them; only hits with their scores go on to the ranking."""
    rows = [(qid, checked(query, top_k)) for qid, query in questions]
    spark = chunks.sparkSession
    terms = {r.qid: r.terms for r in spark.createDataFrame(rows, "qid string, query string").select("qid", X.query_terms(F.col("query")).alias("terms")).collect()}
    texts = chunks.select("id", "article_id", "chunk_index", "text").withColumn("low", F.lower("text"))

    def scored(qid: str, query: str) -> Column:
        """qid and score where the chunk is a hit, else null; over the text in lower case."""
        low = F.col("low")
        taken = [F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit(""))) for t in (terms[qid] or [query])]
        phrase = F.contains(low, F.lit(query.lower()))
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms[qid]], phrase)
        return F.when(hit, F.struct(F.lit(qid).alias("qid"), (F.when(phrase, 1000).otherwise(0) + reduce(lambda a, b: a + b, taken)).alias("score")))

    every = F.array(*[scored(qid, query) for qid, query in rows])
    hits = texts.select("id", "article_id", "chunk_index", F.inline(F.filter(every, lambda s: s.isNotNull())))
    hits = hits.join(articles.select(F.col("id").alias("article_id"), "title", "doi"), "article_id")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_index", "article_id", "id")
    asked = spark.createDataFrame([(qid, query, terms[qid]) for qid, query in rows], "qid string, query string, terms array<string>")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).join(F.broadcast(asked), "qid")
    # at most top_k rows a question: small enough to be sent to the texts
    found = chunks.select("id", "page_start", "page_end", "text").join(F.broadcast(top), "id").withColumnRenamed("id", "chunk_id")
    return found.select("qid", "query", "rank", *_result(F.col("query"), F.col("terms")))


def evaluate(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, query, passed, missing_dois, missing_keywords, result_count`` of questions with ``expected_dois`` and ``expected_keywords``:
    passed if there is a result, all DOIs are among the results' and all keywords in their snippets."""
    by_question = results.groupBy("qid").agg(
        F.collect_set(F.when(F.coalesce("doi", F.lit("")) != "", F.lower("doi"))).alias("dois"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda r: r["snippet"]), "\n").alias("text"), F.count("*").alias("n"))
    both = questions.join(by_question, "qid", "left")
    dois, text = F.coalesce("dois", F.array().cast("array<string>")), F.lower(F.coalesce("text", F.lit("")))
    missing_dois = F.filter("expected_dois", lambda d: ~F.array_contains(dois, F.lower(d)))
    missing_keywords = F.filter("expected_keywords", lambda k: ~F.contains(text, F.lower(k)))
    n = F.coalesce("n", F.lit(0))
    return both.select("qid", "query", ((F.size(missing_dois) == 0) & (F.size(missing_keywords) == 0) & (n > 0)).alias("passed"), missing_dois.alias("missing_dois"), missing_keywords.alias("missing_keywords"), n.alias("result_count"))


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"), F.coalesce(F.sum((~F.col("passed")).cast("long")), F.lit(0)).alias("failed"),
        F.coalesce(F.sum((F.col("result_count") == 0).cast("long")), F.lit(0)).alias("empty_result_queries"))
