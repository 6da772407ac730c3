"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window of a few words that compresses better with the toxic dictionary than with the ordinary one looks toxic.
Both dictionaries share the same common ordinary words, so that ordinary parts of a window cost the same with
either. The toxic one adds the words that mark toxic documents; the ordinary one adds, in their place, the ordinary
words that look most like them. How many windows of a document pass which length difference is turned into a
probability by a logistic calibration on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.logistic import fitted, probability
from corpusflow.llm.names import unused
from corpusflow.session import materialize

WINDOW_WORDS = 6
LEVEL = 9
DIFFERENCES = (2, 3, 4, 5, 6, 7, 8)
COMMON_BYTES = 8_000
MARK_BYTES = 4_000
MARK_ODDS = 30.0
GRAM = 5
#: The only samples: labelled rows that the dictionaries (per label) and the calibration are fitted on.
TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS = 8_000, 24_000, 16_000
THRESHOLD = 0.3
AT_ONCE = 256  # rows of an Arrow batch that are Python objects at one time
HELD_OUT, DICTIONARY_PARTS = 2, (0, 1)


def parts(ids) -> list[int]:
    """crc32 of the decimal id modulo 4; null ids count as the text 'null'."""
    return [zlib.crc32(b"null" if i is None else b"%d" % i) % 4 for i in ids]


def part_of(ids: str) -> Column:
    """``parts`` as a column expression, so that no task needs a Python worker for it."""
    text = F.coalesce(F.col(ids).cast("long").cast("string"), F.lit("null"))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)).cast("int")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def windows_of(words: list[bytes]) -> list[bytes]:
    """Windows of six words that cover every word of the text."""
    return [b" " + b" ".join(words[i: i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(low, AT_ONCE)


def _grams(word: bytes) -> set[bytes]:
    whole = b" " + word + b" "
    return {whole[i: i + GRAM] for i in range(len(whole) - GRAM + 1)}


def _word_table(docs: DataFrame) -> DataFrame:
    """Documents of either label with each word, and its count in ordinary ones; combined within tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, ordinary, total = Counter(), Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                (toxic if label else ordinary).update(set(words))
                if not label:
                    total.update(words)
            names = list(toxic.keys() | ordinary.keys())
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.binary()), pa.array([toxic[w] for w in names], pa.int64()),
                pa.array([ordinary[w] for w in names], pa.int64()), pa.array([total[w] for w in names], pa.int64())],
                ["word", "toxic", "ordinary", "uses"])

    return (docs.select("text", "toxic").mapInArrow(count, "word binary, toxic long, ordinary long, uses long")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.sum("uses").alias("uses")))


def _cut(words: list[bytes], size: int) -> list[bytes]:
    """The first words that fit into ``size`` bytes."""
    out, held = [], 0
    for word in words:
        held += len(word) + 1
        if held > size:
            break
        out.append(word)
    return out


def _joined(words: list[bytes]) -> bytes:
    return b"".join(b" " + w for w in reversed(words))  # the best words last, where offsets are short


def trained_dictionaries(docs: DataFrame) -> tuple[bytes, bytes] | None:
    """(toxic, ordinary) dictionary contents from labelled documents (text, toxic), or None without both labels."""
    sizes = {bool(r.toxic): r.n for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    table = materialize(_word_table(docs), "words")
    rate_t = (F.col("toxic") + 0.1) / (sizes[True] + 1)
    rate_o = (F.col("ordinary") + 0.1 * sizes[False] / sizes[True]) / (sizes[False] + 1)
    known = table.filter(F.col("toxic") >= max(4, sizes[True] // 500)).filter(rate_t / rate_o > MARK_ODDS)
    # no more rows than the dictionaries can hold come to the driver
    marks = _cut([bytes(r.word) for r in known.orderBy(F.desc("toxic"), "word").limit(MARK_BYTES // 2).collect()], MARK_BYTES)
    marked = set(marks)
    uses = table.orderBy(F.desc("uses"), "word").limit(COMMON_BYTES // 2 + len(marks)).collect()
    common = _cut([w for w in (bytes(r.word) for r in uses) if w not in marked], COMMON_BYTES)
    grams = set().union(*map(_grams, marks)) if marks else set()

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shared = [0 if bytes(w) in marked else GRAM * len(_grams(bytes(w)) & grams) for w in frame["word"]]
            frame["alike"] = np.array(shared, dtype=np.int64) * frame["uses"]
            yield frame.loc[frame["alike"] > 0, ["word", "alike"]]

    close = table.select("word", "uses").mapInPandas(alike, "word binary, alike long")
    near = _cut([bytes(r.word) for r in close.orderBy(F.desc("alike"), "word").limit(MARK_BYTES // 2).collect()], len(_joined(marks)) + 1)
    return _joined(marks) + _joined(common), _joined(near) + _joined(common)


class Distance:
    """Compresses windows with both dictionaries."""

    def __init__(self, contents: tuple[bytes, bytes]):
        self.sides = []
        for content in contents:
            data = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                                       write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> np.ndarray:
        """How many and what share of the windows pass each difference, the largest difference, and the length."""
        windows = windows_of(words_of(text))
        out = np.zeros(2 * len(DIFFERENCES) + 2)
        if windows:
            toxic, ordinary = self.sides[0].compress, self.sides[1].compress
            gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows])
            passed = np.array([(gain >= d).sum() for d in DIFFERENCES])
            out[: len(DIFFERENCES)] = np.log1p(passed)
            out[len(DIFFERENCES): -2] = passed / len(windows)
            out[-2:] = max(0, gain.max()), np.log1p(len(windows))
        return out


def _judged(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``docs`` with one more column, ``name``, for the score; see ``toxicity``."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("part", part_of("doc_id"))
             .withColumn("place", F.xxhash64(F.lit(8), "doc_id")).filter(F.col("part") != HELD_OUT))
    first = known.filter(F.col("part").isin(*DICTIONARY_PARTS))
    rows = first.filter("toxic = 1").orderBy("place").limit(TOXIC_ROWS).unionByName(first.filter("toxic = 0").orderBy("place").limit(ORDINARY_ROWS))
    rest = known.filter(~F.col("part").isin(*DICTIONARY_PARTS)).orderBy("place").limit(CALIBRATION_ROWS)
    # both samples are bounded by the constants above, so their ids may be broadcast
    contents = trained_dictionaries(plain.join(F.broadcast(rows.select("doc_id", "toxic")), "doc_id").select("text", "toxic"))
    model, sides = None, None
    if contents is not None:
        sides = spark.sparkContext.broadcast(contents)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            distance = Distance(sides.value)
            for batch in sliced(batches):
                found = [distance.features(t).tolist() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

        seen = plain.join(F.broadcast(rest.select("doc_id", "toxic")), "doc_id").select("toxic", "text").mapInArrow(
            measured, "toxic int, features array<double>").collect()
        y = np.array([r.toxic for r in seen], dtype=float)
        if 0 < y.sum() < len(y):
            model = fitted(np.array([r.features for r in seen]), y)
    share = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("s")).first().s if model is None else 0.0
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(sides.value) if model is not None else None
        for batch in sliced(batches):
            if distance is None or not batch.num_rows:
                score = np.full(batch.num_rows, share)
            else:
                score = probability(model, np.array([distance.features(t) for t in batch.column(at).cast(pa.string()).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.3).

    Labels come from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 4 is not 2; parts 0 and 1 train the
    dictionaries, part 3 the calibration, each on a bounded sample drawn by a seeded hash of the id. Text alone
    enters a score. Null and empty texts have no windows and get the calibrated score of a text without any. Labels
    that are null are left out, the largest of repeated ones counts. Without both labels the score is the share of
    toxic labels (0 without any). An empty table gives an empty result; other columns are not read.
    """
    judged = _judged(docs.select("doc_id", "text"), labels, "toxic_score")
    score = F.col("toxic_score")
    return judged.select("doc_id", (part_of("doc_id") == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own score stays below the threshold, with all their columns; see ``toxicity``.

    Each row is judged by itself, so repeated rows share their fate. Columns may have any names.
    """
    name = unused(docs, "toxic_score")
    return _judged(docs, labels, name).filter(F.col(name) < THRESHOLD).select(*docs.columns)
