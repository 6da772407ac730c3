"""Prompt context and answer rendering. A query has a handful of sources, so they fit one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layout of context documents and of rendered answers.
NO_DOCUMENTS = "No context documents provided."
RULE = "\n" + "-" * 80
MARKDOWN_HEAD = "\n\n---\n**Sources:**\n"
PLAIN_HEAD = "\n\nSources:\n"
UNKNOWN_TITLE, UNKNOWN_SOURCE = "Unknown", "Unknown source"


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("rank", *fields)))


def context_text(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered documents with title, source, score and content."""
    line = lambda name, label: F.when(name.isNotNull() & (name != ""), F.concat(F.lit(label), name, F.lit("\n"))).otherwise("")

    def block(d: Column) -> Column:
        head = F.concat(F.lit("Document "), d["rank"].cast("string"), F.when(d["title"] != "", F.concat(F.lit(": "), d["title"])).otherwise(""), F.lit("\n"))
        score = F.when(d["score"].isNotNull(), F.concat(F.lit("Relevance Score: "), F.format_string("%.3f", d["score"]), F.lit("\n"))).otherwise("")
        return F.concat(head, line(d["source"], "Source: "), score, F.lit("Content:\n"), d["text"], F.lit("\n"))

    made = hits.groupBy("query_id").agg(_ordered("title", "source", "score", "text").alias("_d")).select(
        "query_id", F.concat(F.lit(RULE), F.array_join(F.transform("_d", block), "\n")).alias("context"))
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_DOCUMENTS)).alias("context"))


def rendered(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, markdown, html, plain_text, sources) from answers (query_id, content) and their sources."""
    name = lambda d: F.concat(F.coalesce(d["title"], F.lit(UNKNOWN_TITLE)), F.lit(" - "), F.coalesce(d["source"], F.lit(UNKNOWN_SOURCE)))
    lists = hits.groupBy("query_id").agg(_ordered("title", "source").alias("_d"))
    joined = answers.join(lists, "query_id")
    numbered = F.array_join(F.transform("_d", lambda d: F.concat(d["rank"].cast("string"), F.lit(". "), name(d))), "\n")
    items = F.array_join(F.transform("_d", lambda d: F.concat(F.lit("<li>"), name(d), F.lit("</li>"))), "\n")
    distinct = F.array_sort(F.array_distinct(F.transform("_d", lambda d: F.coalesce(F.nullif(d["source"], F.lit("")), d["title"]))))
    return joined.select(
        "query_id",
        F.concat("content", F.lit(MARKDOWN_HEAD), numbered).alias("markdown"),
        F.concat(F.lit('<div class="response">'), "content", F.lit('</div>\n<hr>\n<div class="sources">\n<strong>Sources:</strong>\n<ol>\n'), items, F.lit("\n</ol>\n</div>")).alias("html"),
        F.concat("content", F.lit(PLAIN_HEAD), numbered).alias("plain_text"),
        F.array_join(distinct, ",").alias("sources"))
