"""Splitting documents into units and packing units into overlapping chunks.

Everything happens on the row of one document; nothing is shuffled. Texts are split and joined in the JVM, the
greedy walks over their lengths are linear loops on Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusflow.functions.text import words

# Default chunk size and overlap in estimated tokens, characters per token.
CHUNK_TOKENS = 1024
OVERLAP_TOKENS = 102
CHARS_PER_TOKEN = 4

# Fixed value: abbreviations whose dot does not end a sentence.
ABBREVIATIONS = r"(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g)\.\s"


def _strip(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before whitespace; abbreviations are protected."""
    shielded = F.regexp_replace(text, ABBREVIATIONS, "$1[DOT] ")
    parts = F.split(shielded, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: _strip(F.replace(s, F.lit("[DOT]"), F.lit(".")))), lambda s: s != "")


def plain_sentences(text: Column) -> Column:
    """Sentence split of the article ingest: no abbreviation handling."""
    return F.split(text, r"(?<=[.!?])\s+")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), _strip), lambda p: p != "")


SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("apart", T.BooleanType())]))


def greedy_spans(costs: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """First and one past the last unit of each chunk, in one pass over running sums.

    A chunk is closed when the next unit would overflow it; the next chunk starts
    with the longest run of trailing units whose tokens fit into the overlap.
    """
    spans, before, start, total = [], [0], 0, 0
    for i, cost in enumerate(costs):
        if before[-1] - before[start] + cost > size and i > start:
            spans.append((start, i))
            back = i
            while back > start and before[i] - before[back - 1] <= overlap:
                back -= 1
            start = back
        before.append(before[-1] + cost)
    return spans + ([(start, len(costs))] if len(costs) > start else [])


def _packer(size: int, overlap: int):
    """Column function: spans of the units of every document, given their costs and their runs.

    Only the numbers leave the JVM. Units of one run are packed together; ``apart`` marks runs cut from one unit.
    """

    @F.pandas_udf(SPANS)
    def pack(costs: pd.Series, runs: pd.Series, apart: pd.Series) -> pd.Series:
        out = []
        for cost, run, own in zip(costs, runs, apart):
            spans, first = [], 0
            cost, run = ([] if x is None else list(x) for x in (cost, run))
            while first < len(cost):
                last = first
                while last < len(cost) and run[last] == run[first]:
                    last += 1
                spans += [{"s": first + s, "e": first + e, "apart": bool(own[first])} for s, e in greedy_spans(cost[first:last], size, overlap)]
                first = last
            out.append(spans)
        return pd.Series(out)

    return pack


def _packed(cut: DataFrame, doc: str, rest: list[str], size: int, overlap: int, separator: str) -> DataFrame:
    """(doc, ..., chunk_index, chunk) from ``_units``, an array of (text, run, apart)."""
    costs = F.transform("_units", lambda u: F.floor(F.length(u["text"]) / CHARS_PER_TOKEN).cast("int"))
    spans = cut.withColumn("_spans", _packer(size, overlap)(costs, F.col("_units.run"), F.col("_units.apart")))
    # Chunk texts are built on the document's row before it is exploded.
    chunks = F.transform("_spans", lambda p: F.when(p["apart"], _text(p, " ")).otherwise(_text(p, separator)))
    return spans.select(doc, *rest, F.posexplode(chunks).alias("chunk_index", "chunk"))


def _text(span: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.slice("_units", span["s"] + 1, span["e"] - span["s"]), lambda u: u["text"]), separator)


def _short(text: str, size: int) -> Column:
    return F.length(text) / CHARS_PER_TOKEN < size + 1


def _units(parts: Column, run: Column, apart: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(p.alias("text"), run.cast("int").alias("run"), apart.alias("apart")))


def sentence_chunks(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS,
                    doc: str = "doc_id", text: str = "text", split=sentences,
                    separator: str = " ") -> DataFrame:
    """(doc_id, ..., chunk_index, chunk): sentences packed greedily.

    A text no longer than ``size`` tokens is one chunk.
    """
    rest = [c for c in docs.columns if c not in (doc, text)]
    parts = F.when(_short(text, size), F.array(text)).otherwise(split(F.col(text)))
    cut = docs.select(doc, *rest, _units(parts, F.lit(0), F.lit(False)).alias("_units"))
    return _packed(cut, doc, rest, size, overlap, separator)


def document_chunks(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS,
                    doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ..., chunk_index, chunk): paragraphs packed greedily, long paragraphs by sentence.

    Paragraphs between two over-long ones form a run that is packed on its own; so does every over-long one.
    """
    rest = [c for c in docs.columns if c not in (doc, text)]
    paras = docs.select(doc, *rest, F.when(_short(text, size), F.array(text)).otherwise(paragraphs(F.col(text))).alias("_paras"))
    long = lambda p: F.floor(F.length(p) / CHARS_PER_TOKEN) > size
    # a long paragraph is run 2 * its number + 1, others are 2 * the number of the last long one before them
    places = F.filter(F.transform("_paras", lambda p, i: F.when(long(p), i)), lambda i: i.isNotNull())
    placed = paras.withColumn("_long", places)
    own = lambda p, i: F.when(long(p), _units(sentences(p), 2 * i + 1, F.lit(True))).otherwise(
        _units(F.array(p), F.coalesce(2 * F.try_element_at(F.filter("_long", lambda k: k < i), F.lit(-1)) + 2, F.lit(0)), F.lit(False)))
    cut = placed.select(doc, *rest, F.flatten(F.transform("_paras", own)).alias("_units"))
    return _packed(cut, doc, rest, size, overlap, "\n\n")


def char_chunks(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS,
                doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Character windows of 4*size that back off to the last blank, overlapping by 4*overlap.

    The walk ends with the window that reaches the end of the text. A window is cut
    at its full width only if backing off would not move the walk forward.
    """
    width, back = size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN

    @F.arrow_udf("array<int>")
    def ends(texts: pa.Array) -> pa.Array:
        """Where the windows end; one text at a time is a Python object, and no piece of it goes back."""
        out, offsets = [], [0]
        for row in texts:
            t, start = row.as_py(), 0
            while t:
                end = len(t)
                if start + width < len(t):
                    blank = t.rfind(" ", start, start + width)
                    end = blank if blank - back > start else start + width
                out.append(end)
                if end >= len(t):
                    break
                start = end - back
            offsets.append(len(out))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()))

    rest = [c for c in docs.columns if c not in (doc, text)]
    start = lambda i: F.when(i > 0, F.get("_ends", i - 1) - back).otherwise(0)
    span = lambda e, i: F.struct(start(i).alias("s"), e.alias("e"), F.substring(F.col(text), start(i) + 1, e - start(i)).alias("t"))
    # windows are cut on the document's row; exploding first would copy the text to each
    spans = docs.select(doc, *rest, text, ends(text).alias("_ends")).select(doc, *rest, F.transform("_ends", span).alias("_spans"))
    cut = spans.select(doc, *rest, F.posexplode("_spans").alias("chunk_index", "_p"))
    return cut.select(doc, *rest, "chunk_index", F.col("_p.s").alias("start_char"), F.col("_p.e").alias("end_char"), _strip(F.col("_p.t")).alias("chunk"))


def word_windows(docs: DataFrame, size: int, overlap: int, min_share: int = 2, doc: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Windows of ``size`` words, step size-overlap; windows under size/min_share words are dropped."""
    rest = [c for c in docs.columns if c not in (doc, text)]
    # No filter on empty texts here: it would be pushed down and split every text twice.
    bag = docs.select(doc, *rest, words(text).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(size - overlap))
    # Windows are built on the document's row; exploding first would copy all words to each window.
    pieces = F.filter(F.transform(starts, lambda i: F.slice("_w", i + 1, F.lit(size))), lambda p: F.size(p) >= max(size // min_share, 1))
    held = bag.select(doc, *rest, pieces.alias("_pieces")).select(doc, *rest, F.size("_pieces").alias("total_chunks"), "_pieces")
    cut = held.select(doc, *rest, "total_chunks", F.posexplode_outer("_pieces").alias("chunk_index", "_piece")).filter(F.col("_piece").isNotNull())
    return cut.select(doc, *rest, "chunk_index", "total_chunks", F.size("_piece").alias("n_words"), F.array_join("_piece", " ").alias("chunk"))


class ChunkFunction:
    """Table function chunk(text, size, overlap): the windows of ``word_windows``, row by row. A null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        for given in (size, overlap):
            if given.isConstantExpression and given.value is None:
                raise ValueError("size and overlap must be numbers")
        if size.isConstantExpression and overlap.isConstantExpression and not 0 <= overlap.value < size.value:
            raise ValueError("overlap must be at least 0 and less than size")
        return AnalyzeResult(T.StructType().add("chunk_index", T.IntegerType()).add("n_words", T.IntegerType()).add("chunk", T.StringType()))

    def eval(self, text, size, overlap):
        # the blanks of Java's space class
        bag = [] if text is None else [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        index = 0
        for start in range(0, len(bag), size - overlap):
            piece = bag[start: start + size]
            if len(piece) >= max(size // 2, 1):
                yield index, len(piece), " ".join(piece)
                index += 1


def register_chunk(spark, name: str = "chunk") -> None:
    """Make ``chunk(text, size, overlap)`` a table function of the session's SQL, for use under LATERAL."""
    spark.udtf.register(name, F.udtf(ChunkFunction))
