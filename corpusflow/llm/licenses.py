"""License scans with a positional index of rare licence words.

Templates are short licence texts. Every file's words are matched to the template words; the highest-IDF words of a
key phrase (its anchors) propose places, the postings of the phrase's other words are intersected with them by
relative position, and a template counts when all of its mandatory key phrases stand in the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not a digit, a small letter or beyond ASCII parts words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label and the key phrases that must all stand in a file."""

    label: str
    phrases: tuple[str, ...]
    base: bool = False


# Phrases and labels of the scan. The first three are the base set.
TEMPLATES = (
    Template("cc-by", ("cc by",), base=True),
    Template("gpl", ("general public license",), base=True),
    Template("reserved", ("all rights reserved",), base=True),
    Template("agpl", ("gnu affero general public license",)),
    Template("apache-2.0", ("apache license", "version 2 0")),
    Template("bsd", ("redistribution and use in source and binary forms",)),
    Template("bsl-1.0", ("boost software license",)),
    Template("cc-by-nc", ("cc by nc",)),
    Template("cc-by-nd", ("cc by nd",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("cc0", ("cc0 1 0",)),
    Template("creative-commons", ("creative commons attribution",)),
    Template("epl", ("eclipse public license",)),
    Template("gpl-2.0", ("general public license", "version 2")),
    Template("gpl-3.0", ("general public license", "version 3")),
    Template("isc", ("permission to use copy modify and or distribute this software",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("mit", ("mit license",)),
    Template("mit-text", ("permission is hereby granted free of charge", "without restriction")),
    Template("mpl", ("mozilla public license",)),
    Template("public-domain", ("released into the public domain",)),
    Template("unlicense", ("the unlicense",)),
    Template("wtfpl", ("do what the fuck you want to public license",)),
)


def words(text):
    """Words of a text column: A-Z lower-cased, null as no words."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BREAKS), lambda w: w != "")


def _postings(spark, templates) -> DataFrame:
    """(phrase, at, word) of every key phrase: as large as the template texts, whatever the corpus."""
    phrases = sorted({p for t in templates for p in t.phrases})
    rows = [(p, k, w, len(p.split())) for p in phrases for k, w in enumerate(p.split())]
    return spark.createDataFrame(rows, "phrase string, at int, word string, phrase_words int")


def licence_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per file: doc_id, row, n_words, and hits, the (word, pos) of its words that some template uses."""
    vocabulary = sorted({w for t in templates for p in t.phrases for w in p.split()})
    known = F.array(*map(F.lit, vocabulary))
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("words"))
    # the distinct licence words of a file come from one hash lookup a word; most files have a handful
    present = split.select("doc_id", "row", "words", F.array_intersect("words", known).alias("present"))
    places = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("word"), k.alias("pos"))), lambda x: F.array_contains("present", x["word"]))
    return present.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), "present", places.alias("hits"))


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licences of every file.

    Columns: doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and largest start
    of a base phrase, else null), base_labels, labels (distinct, sorted, comma-joined; empty without any), score
    (largest IDF share of a key phrase's words that stand in place, 1 for a whole phrase, 0 without any anchor), and
    places, the number of places of all key phrases. Null and empty texts have no words and no labels. Repeated rows
    and rows with a null doc_id are scanned one by one; an empty table gives an empty result; columns beyond doc_id
    and text are not read.
    """
    spark = docs.sparkSession
    files = materialize(licence_words(docs, templates), "licence_words")  # texts are split into words once
    postings = _postings(spark, templates)
    total = F.broadcast(files.agg(F.count("*").alias("files")))  # one row
    found = files.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # a row for each template word, so these small tables are safe to broadcast
    weighed = (postings.join(F.broadcast(found), "word", "left").crossJoin(total)
               .withColumn("idf", F.log1p(F.col("files") / (F.coalesce("df", F.lit(0)) + F.lit(1)))))
    rarest = Window.partitionBy("phrase").orderBy(F.desc("idf"), "at")
    weighed = (weighed.withColumn("anchor", F.row_number().over(rarest) == 1)
               .withColumn("whole", F.sum("idf").over(Window.partitionBy("phrase")))
               .withColumn("rarest", F.max(F.when(F.col("anchor"), F.col("word"))).over(Window.partitionBy("phrase")))
               .select("phrase", "at", "word", "phrase_words", "idf", "anchor", "whole", "rarest"))
    index = F.broadcast(weighed)
    # only phrases whose rarest word the file has are looked up any further
    hits = files.select("row", "present", F.explode("hits").alias("h")).select("row", "present", F.col("h.word").alias("word"), F.col("h.pos").alias("pos"))
    aligned = (
        hits.join(index, "word").filter(F.array_contains("present", F.col("rarest")))
        .groupBy("row", "phrase", (F.col("pos") - F.col("at")).alias("start"))
        .agg(F.bool_or("anchor").alias("anchored"), F.count("*").alias("in_place"), F.max("phrase_words").alias("phrase_words"),
             F.sum("idf").alias("found"), F.max("whole").alias("whole"))
        .filter("anchored")
        .withColumn("complete", F.col("in_place") == F.col("phrase_words"))
    )
    base_phrases = sorted({p for t in templates if t.base for p in t.phrases})
    is_base = F.col("complete") & F.col("phrase").isin(base_phrases)
    per_file = aligned.groupBy("row").agg(
        F.collect_set(F.when(F.col("complete"), F.col("phrase"))).alias("phrases"),  # at most one for each key phrase
        F.sum(is_base.cast("long")).alias("n_base"),
        F.sum(F.col("complete").cast("long")).alias("places"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.max(F.round(F.when(F.col("complete"), F.lit(1.0)).otherwise(F.col("found") / F.col("whole")), 6)).alias("score"),
    )

    def named(chosen):
        marks = [F.when(_all_in(t.phrases), F.lit(t.label)) for t in chosen]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*marks)))), ",")

    labelled = per_file.withColumn("base_labels", named([t for t in templates if t.base])).withColumn("labels", named(templates))
    out = files.select("doc_id", "row", "n_words").join(labelled, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("places", F.lit(0)).cast("long").alias("places"),
    )


def _all_in(phrases: tuple[str, ...]):
    out = F.array_contains("phrases", phrases[0])
    for phrase in phrases[1:]:
        out = out & F.array_contains("phrases", phrase)
    return out
