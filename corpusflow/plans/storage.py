"""Stored collections: upserts, deletes, catalogs and file sinks, through written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import chunking, sparse
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.corpus import windows_sql
from corpusflow.plans.registry import query
from corpusflow.plans.retrieval import containment, corpus, corpus_index
from corpusflow.session import fresh_path, materialize
from corpusflow.sources import collections as store
from corpusflow.sources.files import judged_dataset
from corpusflow.sources.tables import queries_of, spread, table

CHUNKS = f"""ch AS (SELECT md5(doc_id || '_chunk_' || chunk_index) AS id, doc_id, lang AS collection, chunk FROM ({windows_sql(128, 12, 128)}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))"""


def chunk_points(spark, root):
    docs = spread(table(spark, root, "documents").select("doc_id", "text", "lang"))
    parts = chunking.word_windows(docs, 128, 12, min_share=128)
    return parts.select(F.md5(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).alias("id"),
                        "doc_id", F.col("lang").alias("collection"), "chunk")


@query("upserted_chunks", "A9 A17", f"""WITH {CHUNKS} SELECT id, collection, CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 2 ELSE 1 END AS version,
  md5(CASE WHEN quality = 1 THEN 'new ' || chunk ELSE chunk END) AS digest, CASE WHEN quality = 1 THEN 20 ELSE 10 END AS updated_at FROM ch LEFT JOIN labels USING (doc_id)""")
def upserted_chunks(spark, root):
    """Labelled documents ingested again, twice: good ones changed, others unchanged; the last version wins."""
    stored = store.StoredCollections(spark, fresh_path(spark, "collection"))
    stored.create(chunk_points(spark, root).withColumns({"version": F.lit(1), "updated_at": F.lit(10)}))
    marks = table(spark, root, "labels").select("doc_id", "quality")
    again = stored.read().join(marks, "doc_id").select(
        "id", "doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("new "), "chunk")).otherwise(F.col("chunk")).alias("chunk"),
        F.lit(2).alias("version"), F.lit(20).alias("updated_at"), "collection")
    again = materialize(again, "again")
    stored.merge(again, ["id"], "version", "chunk", "updated_at")
    stored.merge(again, ["id"], "version", "chunk", "updated_at")
    return stored.read().select("id", "collection", "version", F.md5("chunk").alias("digest"), "updated_at")


@query("appended_documents", "A10", "SELECT md5(text) AS id, min(doc_id) AS first_doc, count(*) AS copies, lang AS collection FROM documents GROUP BY md5(text), lang")
def appended_documents(spark, root):
    """Documents appended under their content key; copies share one id."""
    return table(spark, root, "documents").groupBy(F.md5("text").alias("id"), F.col("lang").alias("collection")).agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("deleted_documents", "A14", f"WITH {CHUNKS} SELECT collection, count(*) AS points FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def deleted_documents(spark, root):
    """Points left after the chunks of toxic documents are deleted."""
    stored = store.StoredCollections(spark, fresh_path(spark, "collection"))
    stored.create(chunk_points(spark, root))
    stored.remove_documents(table(spark, root, "labels").filter("toxic = 1"))
    return stored.read().groupBy("collection").agg(F.count("*").alias("points"))


@query("dropped_collection", "A15 A18", f"WITH {CHUNKS} SELECT collection, count(*) AS points, count(DISTINCT doc_id) AS documents FROM ch WHERE collection <> 'de' GROUP BY 1")
def dropped_collection(spark, root):
    """A written index listed after one collection is dropped."""
    stored = store.StoredCollections(spark, fresh_path(spark, "collection"))
    stored.create(chunk_points(spark, root))
    stored.drop_collection("de")
    return store.catalog(stored.read()).select("collection", "points", "documents")


@query("cascade_delete", "A16 E17", f"""WITH {sql.bm25()}, r AS ({sql.ranked('scores', 10)}) SELECT query_id, doc_id, rank FROM r WHERE query_id NOT IN (SELECT item_id FROM benchmark WHERE len(text) > 250) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def cascade_delete(spark, root):
    """Result rows left after long queries and poor documents are deleted."""
    run = corpus_index(spark, root).search(queries_of(spark, root), 10)
    queries = queries_of(spark, root).filter(F.length("text") > 250)
    docs = table(spark, root, "labels").filter("quality = 0")
    return store.cascade(run, queries, docs).select("query_id", "doc_id", "rank")


@query("collection_catalog", "A19", f"WITH {CHUNKS} SELECT collection, count(DISTINCT doc_id) AS documents, count(*) AS points, 'Collection ''' || collection || ''' with ' || count(DISTINCT doc_id) || ' documents' AS description FROM ch GROUP BY 1")
def collection_catalog(spark, root):
    """Every collection with its size and description."""
    return store.catalog(chunk_points(spark, root))


@query("judged_dataset_round_trip", "A2", f"WITH {sql.QRELS} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, rel, source AS title, md5(documents.text) AS digest FROM qrels JOIN documents USING (doc_id)")
def judged_dataset_round_trip(spark, root):
    """Corpus, queries and judgments written as a data set folder and loaded back."""
    folder = fresh_path(spark, "dataset")
    docs = table(spark, root, "documents").select("doc_id", F.col("source").alias("title"), "text")
    store.write_judged_dataset(docs, queries_of(spark, root), containment(spark, root), folder)
    loaded, asked, qrels = judged_dataset(spark, folder)
    return qrels.join(asked.select("query_id"), "query_id").join(loaded, "doc_id").select("query_id", "doc_id", "rel", "title", F.md5("text").alias("digest"))


@query("json_article_sink", "A12", "SELECT doc_id, source, md5(text) AS digest FROM documents")
def json_article_sink(spark, root):
    """Articles written as JSON and read back."""
    path = fresh_path(spark, "articles")
    store.write_json(table(spark, root, "documents").select("doc_id", "source", "text"), path)
    return spark.read.schema("doc_id long, source string, text string").json(path).select("doc_id", "source", F.md5("text").alias("digest"))


@query("csv_result_sink", "A13", "SELECT lang, count(*) AS docs, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1")
def csv_result_sink(spark, root):
    """A result table written as CSV with header and read back."""
    path = fresh_path(spark, "results")
    stats = table(spark, root, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    store.write_csv(stats, path)
    return spark.read.schema("lang string, docs long, shortest long, longest long").option("header", True).csv(path)
