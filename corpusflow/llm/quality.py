"""Quality classification by co-training a text view and a metadata view.

The text view sees what a text looks like, the metadata view only source, language and length. Both learn from
labelled documents, then label unlabelled ones for each other over a few rounds: each view hands the documents that it
is surest of to the other one's training set. Both views are calibrated on labelled documents that neither has
trained on, and a calibrated combination scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.logistic import fitted, probability
from corpusflow.llm.toxicity import part_of, parts
from corpusflow.llm.words import text_buffers, word_runs
from corpusflow.session import materialize

#: The only samples: labelled rows for training and calibration. They also bound the pseudo-labels of a round.
TRAIN_ROWS, CALIBRATION_ROWS = 20_000, 10_000
ROUNDS = 4
SURE = 0.98
HANDED_SHARE = 0.1
THRESHOLD = 0.5
HELD_OUT, CALIBRATION_PART = 2, 3
SOURCE_SLOTS, LANG_SLOTS = 32, 16

#: Byte classes of the text view: capitals, digits, sentence marks, other marks, line feeds, beyond ASCII.
CLASSES = np.full(256, 6)
CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 0, 1, 5
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 2
CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 3
CLASSES[10] = 4


def text_features(texts: pa.Array) -> np.ndarray:
    """Shape of every text: shares of byte classes, word lengths, repetition and length."""
    offsets, data = text_buffers(texts)
    size = np.diff(offsets)
    blocks = []
    for words in word_runs(texts):
        rows = words.count
        own = size[words.first: words.first + rows]
        doc = np.repeat(np.arange(rows), own)
        shares = np.bincount(doc * 7 + CLASSES[words.data], minlength=rows * 7).reshape(rows, 7)[:, :6] / np.maximum(own, 1)[:, None]
        h = words.hashes()
        n = np.bincount(words.doc, minlength=rows)
        order = np.lexsort((h, words.doc))
        d, hs = words.doc[order], h[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (hs[1:] != hs[:-1])
        first = np.flatnonzero(new)
        uses = np.diff(np.append(first, len(d)))
        top = np.zeros(rows)
        np.maximum.at(top, d[first], uses)
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
        length = words.ends - words.starts
        last = CLASSES[words.data[words.ends - 1]] if len(h) else np.zeros(0)
        per_word = [np.bincount(words.doc, weights=w, minlength=rows) / np.maximum(n, 1) for w in (length, length > 12, last == 2, last == 3, twice)]
        blocks.append(np.c_[shares, np.stack(per_word, 1), np.bincount(d[first], minlength=rows) / np.maximum(n, 1) ** 0.8,
                            top / np.maximum(n, 1), np.log1p(n), np.log1p(n) ** 2, n == 0])
    if not blocks:
        return np.zeros((0, 16))
    out = np.concatenate(blocks)
    return np.c_[out, np.sqrt(out[:, :6])]


def metadata_features(source: list, lang: list, length: list) -> np.ndarray:
    """Source and language in hashed slots, and the recorded length; nulls have slots of their own."""

    def slot(value, slots):
        return 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (slots - 1)

    out = np.zeros((len(source), SOURCE_SLOTS + LANG_SLOTS + 4))
    for i, (s, g, n) in enumerate(zip(source, lang, length)):
        out[i, slot(s, SOURCE_SLOTS)] = 1
        out[i, SOURCE_SLOTS + slot(g, LANG_SLOTS)] = 1
        size = np.log1p(max(0, n or 0))
        out[i, -4:] = size, size ** 2, size ** 3, n is None
    return out


def _views(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrices of text, source, lang, n_chars in columns from ``at``."""
    return text_features(batch.column(at)), metadata_features(*(batch.column(at + k).to_pylist() for k in (1, 2, 3)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _pool(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every unlabelled row outside the held-out part: row, place (order among equals) and features, written once."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array(list(text_features(batch.column(2))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, *batch.columns[3:]], ["doc_id", "place", "text", "source", "lang", "n_chars"])

    place = F.xxhash64(F.lit(6), "doc_id", "text").alias("place")
    shapes = docs.filter(part_of("doc_id") != HELD_OUT).select("doc_id", place, "text", "source", "lang", "n_chars").mapInArrow(
        measured, "doc_id long, place long, text array<double>, source string, lang string, n_chars long")
    # features are joined, not texts
    free = shapes.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti")
    return materialize(free.select(F.monotonically_increasing_id().alias("row"), "place", "text", "source", "lang", "n_chars"), "pool")


def surest(pool: DataFrame, models: list[np.ndarray], taken: np.ndarray, room: int) -> pa.Table:
    """Of all rows but the taken ones, the ``room`` that each view is surest of for either label.

    Columns side (2 * view + label), row, text, meta. Every row is scored; a task keeps ``room`` rows for each side.
    """

    def best(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((table["row"], table["place"], -table["sure"]))[:room]
        return {name: column[order] for name, column in table.items()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[str, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            row, place = (batch.column(k).to_numpy() for k in (0, 1))
            views = [batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), metadata_features(*(batch.column(k).to_pylist() for k in (3, 4, 5)))]
            free = ~np.isin(row, taken)
            for v in (0, 1):
                p = probability(models[v], views[v])
                for label, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(free & (sure >= SURE))
                    found = best({"sure": sure[at], "place": place[at], "row": row[at], "text": views[0][at], "meta": views[1][at]})
                    side = 2 * v + label
                    kept[side] = best({n: np.concatenate([kept[side][n], c]) for n, c in found.items()}) if side in kept else found
        for side, found in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found["row"]), side, np.int32)), *(pa.array(found[n]) for n in ("sure", "place", "row")),
                 *(pa.array(list(found[n]), pa.list_(pa.float64())) for n in ("text", "meta"))], ["side", "sure", "place", "row", "text", "meta"])

    found = pool.mapInArrow(scored, "side int, sure double, place long, row long, text array<double>, meta array<double>")
    order = Window.partitionBy("side").orderBy(F.desc("sure"), "place", "row")
    # 4 * room rows come to the driver
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= room)
            .orderBy("side", "rank").select("side", "row", "text", "meta").toArrow())


def co_trained(views: list[np.ndarray], labels: np.ndarray, pool: DataFrame) -> list[np.ndarray]:
    """A model for each view after the rounds of exchanged pseudo-labels, drawn from all rows of the pool."""
    given = [[views[v]] for v in (0, 1)]
    answers = [[labels] for _ in (0, 1)]
    taken = np.zeros(0, np.int64)
    room = max(1, int(HANDED_SHARE * len(labels) / 2))
    models = []
    for turn in range(ROUNDS + 1):
        models = [fitted(np.concatenate(given[v]), np.concatenate(answers[v])) for v in (0, 1)]
        if turn == ROUNDS:
            break
        found = surest(pool, models, taken, room)
        if not found.num_rows:
            break
        side = found.column("side").to_numpy()
        shapes = [np.array(found.column(c).to_pylist(), dtype=float) for c in ("text", "meta")]
        for v in (0, 1):
            for label in (1, 0):
                own = side == 2 * v + label
                given[1 - v].append(shapes[1 - v][own])
                answers[1 - v].append(np.full(own.sum(), float(label)))
        taken = np.union1d(taken, found.column("row").to_numpy())
    return models


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with doc_id, held_out, text_score, metadata_score, score (0 to 1), predicted and keep.

    Labels come from rows of ``labels`` (doc_id, quality) whose crc32(doc_id) mod 4 is not 2: part 3 calibrates, the
    rest trains, each on a bounded sample drawn by a seeded hash of the id. All unlabelled rows outside part 2 may get
    pseudo-labels. keep is score >= 0.5. Null and empty texts, and null metadata, have feature values of their own and get a score. Null
    labels are left out, the smallest of repeated ones counts. With labels of one kind only, or none, every score is
    their mean (1 without any). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.min("quality") > 0).cast("int").alias("label")).withColumn("part", part_of("doc_id"))
             .withColumn("place", F.xxhash64(F.lit(6), "doc_id")).filter(F.col("part") != HELD_OUT))
    train = known.filter(F.col("part") != CALIBRATION_PART).orderBy("place").limit(TRAIN_ROWS).withColumn("use", F.lit("train"))
    calibrate = known.filter(F.col("part") == CALIBRATION_PART).orderBy("place").limit(CALIBRATION_ROWS).withColumn("use", F.lit("calibrate"))
    rows = train.select("doc_id", "label", "use").unionByName(calibrate.select("doc_id", "label", "use"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = (pa.array(list(v), pa.list_(pa.float64())) for v in _views(batch, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, meta], ["label", "use", "text", "meta"])

    # the sampled ids are bounded by the constants above, and so is what comes to the driver
    sample = docs.join(F.broadcast(rows), "doc_id").select("label", "use", "text", "source", "lang", "n_chars").mapInArrow(
        measured, "label int, use string, text array<double>, meta array<double>").toArrow()
    use = np.array(sample.column("use").to_pylist(), dtype=object)
    label = np.array(sample.column("label").to_pylist(), dtype=float)
    views = [np.array(sample.column(c).to_pylist(), dtype=float) for c in ("text", "meta")]
    learn, check = (use == name for name in ("train", "calibrate"))
    models = mixer = single = None
    if len(set(label[learn])) == 2 and len(set(label[check])) == 2:
        models = co_trained([v[learn] for v in views], label[learn], _pool(docs, labels))
        sides = np.stack([_logit(probability(m, v[check])) for m, v in zip(models, views)], 1)
        single = [fitted(sides[:, [k]], label[check]) for k in (0, 1)]
        mixer = fitted(sides, label[check])
    mean = float(label.mean()) if len(label) else 1.0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = meta = both = np.full(n, mean)
            if models is not None:
                sides = np.stack([_logit(probability(m, v)) for m, v in zip(models, _views(batch, 1))], 1)
                text, meta = (probability(single[k], sides[:, [k]]) for k in (0, 1))
                both = probability(mixer, sides)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([p == HELD_OUT for p in parts(batch.column(0).to_pylist())]), pa.array(text), pa.array(meta), pa.array(both),
                pa.array((both >= THRESHOLD).astype(np.int32)), pa.array(both >= THRESHOLD)],
                ["doc_id", "held_out", "text_score", "metadata_score", "score", "predicted", "keep"])

    return docs.mapInArrow(scored, "doc_id long, held_out boolean, text_score double, metadata_score double, score double, predicted int, keep boolean")
