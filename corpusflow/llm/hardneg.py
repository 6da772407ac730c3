"""Hard negatives by threshold joins in the manner of L2AP.

Rows are dealt to shards; anchors go to every shard. A shard's inverted index leaves out the dimensions of a row whose
suffix norm cannot reach the lowest threshold of the anchors that ask. Partial scores are summed over the indexed
dimensions, strip by strip, and pairs whose partial score and remaining norms stay below the anchor's threshold are
dropped; what is left is completed exactly. Thresholds start high and are lowered until the anchor's windows are full
or their floor is reached. Each anchor fills its windows in its own shard first; the worst score kept there is where
the thresholds of all other shards end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialize

ANCHOR_STEP, RELABEL_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES, SCALE = 5, 3, 256
LOWEST, HIGHEST = (50, 100), (95, 100)  # of the positive's score
LEAST_ROWS, MOST_ROWS = 4096, 65536  # of a shard
STRIP, ANCHOR_TILE, ROW_TILE = 8, 64, 8192
STEPS = (0.95, 0.8, 0.6, 0.3)
FLOOR, CEILING = -(1 << 62), 1 << 62


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q): valid rows with components floor(256 x) and the label changed where vec_id is divisible by 7.

    Of rows that share a vec_id the one with the smallest label and vector stays.
    """
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    valid = raw.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(fine)
    once = valid.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    return once.select("vec_id", F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
                       F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))).alias("q"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers, shorter ones filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _suffix_norms(matrix: np.ndarray) -> np.ndarray:
    """Norms of components d.., for d = 0..width."""
    out = np.zeros((len(matrix), matrix.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((matrix.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1])
    return out


class Shard:
    """Rows of a shard in a dimension order of falling energy, with the norms of all suffixes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.order = np.argsort(-(matrix.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        # sums of products stay exact in float64 below 2**53; larger numbers are multiplied as integers
        self.ids, self.labels, self.matrix = ids, labels, matrix[:, self.order]
        self.suffix = _suffix_norms(self.matrix)
        self.largest = float(self.suffix[:, 0].max(initial=0.0))

    def index(self, reach: float) -> tuple:
        """Rows that can reach ``reach`` per unit of the anchor, most indexed dimensions first, split into indexed and left out."""
        width = self.matrix.shape[1]
        kept = (self.suffix[:, :width] >= reach).sum(axis=1) if reach > 0 else np.full(len(self.ids), width)
        rows = np.argsort(-kept, kind="stable")
        rows = rows[: int((kept > 0).sum())]
        kept = kept[rows]
        inside = np.arange(width)[None, :] < kept[:, None]
        part = self.matrix[rows]
        return rows, kept, np.where(inside, part, 0), np.where(inside, 0, part)

    def above(self, anchors: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of all pairs whose score reaches the anchor's threshold."""
        anchors = anchors[:, self.order]
        norms = _suffix_norms(anchors)
        reach = float((thresholds / np.maximum(norms[:, 0], 1e-9)).min()) if len(anchors) else 0.0
        rows, kept, indexed, left_out = self.index(reach * (1 - 1e-12))
        exact = float if norms[:, 0].max(initial=0.0) * self.largest < 2 ** 53 else np.int64
        for low in range(0, len(rows), ROW_TILE):
            yield from self._tile(anchors.astype(exact), norms, thresholds, rows[low: low + ROW_TILE], kept[low: low + ROW_TILE],
                                  indexed[low: low + ROW_TILE].astype(exact), left_out[low: low + ROW_TILE].astype(exact))

    def _tile(self, anchors, norms, thresholds, rows, kept, indexed, left_out):
        partial = np.zeros((len(anchors), len(rows)), anchors.dtype)
        width = anchors.shape[1]
        here = np.arange(len(rows))
        for start in range(0, width, STRIP):
            stop = min(start + STRIP, width)
            long = int(np.searchsorted(-kept[here], -start))  # postings of these dimensions: rows with more than ``start``
            partial[:, :long] += anchors[:, start:stop] @ indexed[here[:long], start:stop].T
            rest = np.minimum(kept[here], stop)
            most = partial + norms[:, rest] * self.suffix[rows[here], rest][None, :] * (1 + 1e-9) + 1e-6
            alive = most >= thresholds[:, None]
            some = alive.any(axis=0)
            if not some.all():
                here, partial, alive = here[some], partial[:, some], alive[:, some]
            if not len(here):
                return
        a, r = np.nonzero(alive)
        for low in range(0, len(a), 1 << 18):
            x, y = a[low: low + (1 << 18)], r[low: low + (1 << 18)]
            score = partial[x, y] + (anchors[x] * left_out[here[y]]).sum(axis=1)
            good = score >= thresholds[x]
            yield x[good], rows[here[y[good]]], score[good].astype(np.int64)


def _best(found: list[tuple], windows: tuple[np.ndarray, np.ndarray], k: int, ids: np.ndarray):
    """(window, row, score): every window's k best of the pairs (anchor, row, score), by score and then smaller id.

    Windows are (anchors x slots) lowest and highest scores; window w of anchor a has number a * slots + w.
    """
    lowest, highest = windows
    slots = lowest.shape[1]
    a, row, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    out = []
    for w in range(slots):
        good = (score >= lowest[a, w]) & (score <= highest[a, w])
        x, y, s = a[good], row[good], score[good]
        order = np.lexsort((ids[y], -s, x))
        x, y, s = x[order], y[order], s[order]
        first = np.searchsorted(x, x)
        near = np.arange(len(x)) - first < k
        out.append((x[near] * slots + w, y[near], s[near]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def searched(shard: Shard, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, windows, k: int, same: bool):
    """(window, row, score) of the shard's k best rows of every window of the anchors, by falling thresholds.

    Rows have the anchor's label (``same``) or another one; the anchor itself takes no part.
    """
    lowest, highest = windows
    slots = lowest.shape[1]
    floors = lowest.min(axis=1)
    tops = np.minimum(highest.max(axis=1), np.ceil(_suffix_norms(anchors)[:, 0] * shard.largest).astype(np.int64) + 1)
    open_, done = np.arange(len(ids)), []
    for share in (*STEPS, None):
        at_floor = np.full(len(open_), share is None)
        thresholds = floors[open_].copy()
        if share is not None:
            higher = (tops[open_] * share).astype(np.int64)
            at_floor = higher <= thresholds
            thresholds = np.maximum(thresholds, higher)
        found = []
        for x, row, score in shard.above(anchors[open_], thresholds):
            ours = ((shard.labels[row] == labels[open_[x]]) == same) & (shard.ids[row] != ids[open_[x]])
            found.append((open_[x[ours]], row[ours], score[ours]))
        best = _best(found, windows, k, shard.ids)
        # a window is settled when it is full above the threshold, or the threshold is at its floor
        full = (np.bincount(best[0], minlength=len(ids) * slots).reshape(-1, slots)[open_] >= k) | (lowest[open_] > highest[open_]) | at_floor[:, None]
        settled = np.zeros(len(ids), bool)
        settled[open_[full.all(axis=1)]] = True
        keep = settled[best[0] // slots]
        done.append(tuple(b[keep] for b in best))
        open_ = open_[~full.all(axis=1)]
        if not len(open_):
            break
    return tuple(np.concatenate([d[i] for d in done]) for i in range(3))


def _search(asked: DataFrame, rows: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, doc_id, score): the best rows of the asked shards for every window.

    ``asked`` (shard, vec_id, label, q, lows, highs) names the shard, ``rows`` (shard, vec_id, label, q) has its rows.
    """
    schema = "anchor_id long, slot long, doc_id long, score long"

    def run(rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        rows_, asked_ = rows_.combine_chunks(), asked_.combine_chunks()
        column = lambda t, c: t.column(c).combine_chunks()
        out = [[], [], [], []]
        if rows_.num_rows and asked_.num_rows:
            shard = Shard(column(rows_, "vec_id").to_numpy(), column(rows_, "label").to_numpy(), _matrix(column(rows_, "q"), width))
            for low in range(0, asked_.num_rows, ANCHOR_TILE):
                part = asked_.slice(low, ANCHOR_TILE).combine_chunks()
                ids, labels = column(part, "vec_id").to_numpy(), column(part, "label").to_numpy()
                slots = max(1, int(np.diff(column(part, "lows").offsets.to_numpy()).max(initial=1)))
                windows = []
                for name, missing in (("lows", CEILING), ("highs", FLOOR)):  # anchors with fewer windows get empty ones
                    lists = column(part, name)
                    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                    table = np.full((len(ids), slots), missing, np.int64)
                    table[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                    windows.append(table)
                window, row, score = searched(shard, ids, labels, _matrix(column(part, "q"), width), tuple(windows), k, same)
                for o, x in zip(out, (ids[window // slots], window % slots, shard.ids[row], score)):
                    o.append(x)
        empty = np.zeros(0, np.int64)
        return pa.table({n: pa.array(np.concatenate(o) if o else empty, pa.int64()) for n, o in zip(("anchor_id", "slot", "doc_id", "score"), out)})

    return rows.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, schema)


def _everywhere(own: DataFrame, rows: DataFrame, shards: int, width: int, k: int, same: bool) -> DataFrame:
    """The k best rows of every window over all shards: (anchor_id, slot, doc_id, score, rank).

    ``own`` are the anchors' windows in their own shard. What is found there raises the lower ends for the others.
    """
    own = materialize(own, "asked")
    seed = materialize(_search(own, rows, width, k, same), "seed")
    kth = seed.groupBy("anchor_id", "slot").agg(F.min("score").alias("worst"), F.count("*").alias("hits")).filter(F.col("hits") >= k)
    raised = kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("raised"))
    wide = own.withColumnRenamed("vec_id", "anchor_id").join(raised, "anchor_id", "left").withColumnRenamed("anchor_id", "vec_id")
    lows = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("raised", i.cast("long")), low)))
    others = (wide.withColumn("lows", lows).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("other <> shard")
              .select(F.col("other").cast("long").alias("shard"), "vec_id", "label", "q", "lows", "highs"))
    hits = seed.unionByName(_search(others, rows, width, k, same)) if shards > 1 else seed
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by 50; positives their 5 best other rows of the same label; negatives
    of a positive the 3 best rows of other labels whose score is between 50 and 95 hundredths of the positive's. Scores
    are inner products of floor(256 x), ties go to the smaller vec_id. Rows with a null id, label, vector or component, or
    a component that is not finite, take no part; of rows that share a vec_id one stays; vectors of different lengths are
    compared as if filled with zeros. Other columns are not read; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    clean = materialize(whole_vectors(embeddings), "vectors")
    size = clean.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    width = max(1, size.width or 1)
    per = min(MOST_ROWS, max(LEAST_ROWS, size.n // (4 * spark.sparkContext.defaultParallelism)))
    shards = max(1, -(-size.n // per))
    rows = clean.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    anchors = rows.filter(F.col("vec_id") % ANCHOR_STEP == 0)
    ask = anchors.withColumn("lows", F.array(F.lit(FLOOR))).withColumn("highs", F.array(F.lit(CEILING)))
    positives = materialize(_everywhere(ask, rows, shards, width, POSITIVES, True), "positives")
    low = F.expr(f"cast(ceil(score * {LOWEST[0]}BD / {LOWEST[1]}) AS long)")
    high = F.expr(f"cast(floor(score * {HIGHEST[0]}BD / {HIGHEST[1]}) AS long)")
    wanted = positives.select("anchor_id", F.struct("rank", low.alias("low"), high.alias("high")).alias("w")).groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    ask = anchors.join(wanted.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("lows", F.col("w.low")).withColumn("highs", F.col("w.high")).drop("w")
    negatives = _everywhere(ask, rows, shards, width, NEGATIVES, False)
    pairs = positives.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("doc_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (negatives.join(pairs, ["anchor_id", "slot"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
