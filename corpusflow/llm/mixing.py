"""Mixing sources to target weights by fitting each source's word budget as a subset sum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.names import row_hash, unused
from corpusflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
SEED = 17
HASH_BINS = 4096
KNAPSACK_WORDS = 1 << 22


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place): words of each text, and the seeded place in the drawing order."""
    place = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), place.alias("place"), F.xxhash64("text").alias("tie"))


def water_filled(sizes: dict[str, int], weights: dict[str, float], total: float, most: float) -> dict[str, float]:
    """Shares of ``total`` by weight; a target stops at ``most`` x its size and its excess goes to the others by weight."""
    targets: dict[str, float] = {}
    open_, left = set(sizes), float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not full:
            targets.update({s: left * weights[s] / weight for s in open_})
            break
        for s in full:
            targets[s] = float(most * sizes[s])
        left -= sum(targets[s] for s in full)
        open_ -= full
    return targets


def fitted_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to the budget or as near below as possible.

    A proportional share of every length comes first; the small rest is a bounded knapsack over the leftover counts,
    solved exactly by dynamic programming over sums (a bit set per item, items doubled up to the leftover count).
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    rest = int(budget - (lengths * take).sum())
    # sums are searched up to twice the longest document, but never beyond 2 * KNAPSACK_WORDS: still longer ones are only
    # taken whole, largest first
    longest = int(lengths[lengths <= KNAPSACK_WORDS].max(initial=0))
    # largest lengths first until the rest is about one longest document
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= 2 * longest:
            break
        if lengths[i] > 0:
            more = max(0, int(min(counts[i] - take[i], (rest - longest) // lengths[i])))
            take[i] += more
            rest -= more * int(lengths[i])
    items = []
    rest = min(rest, 2 * KNAPSACK_WORDS)
    for i in np.argsort(-lengths, kind="stable"):
        left, size = min(int(counts[i] - take[i]), rest // max(1, int(lengths[i]))), 1
        while lengths[i] > 0 and left > 0:
            step = min(size, left)
            items.append((int(i), step))
            left -= step
            size *= 2
    reached = np.zeros(rest + 1, dtype=bool)
    reached[0] = True
    by = np.full(rest + 1, -1, dtype=np.int32)
    for k, (i, step) in enumerate(items):
        weight = int(lengths[i]) * step
        if reached[rest] or weight > rest:
            continue
        new = np.zeros_like(reached)
        new[weight:] = reached[: rest + 1 - weight]
        new &= ~reached
        by[new] = k
        reached |= new
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, step = items[by[at]]
        take[i] += step
        at -= int(lengths[i]) * step
    return take


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE,
          most_repeats: int = MOST_REPEATS) -> DataFrame:
    """How many words the mix takes of every document.

    Columns: doc_id, source, size, source_size, target, repeats, taken, tie (a hash of the text). Sources are weighed by ``weights`` in turn, in
    code-point order, null last; together they get ``total_share`` of all words, none over ``most_repeats`` times its
    own. A target of w wholes and a part takes every document w times and then fits the part to a subset: documents
    are counted by length, a knapsack fits the lengths, and each length's documents are drawn in seeded order. Null
    texts have size 0 and take 0 words; rows repeated in full are drawn separately; an empty table gives an empty
    result. Reruns draw the same documents.
    """
    spark = docs.sparkSession
    sized = materialize(document_sizes(docs), "sizes")  # the texts are read once
    by_length = sized.groupBy("source", "size").agg(F.count("*").alias("docs"))
    # one row for each source comes to the driver, never the lengths or the documents
    totals = {r.source: int(r.words) for r in by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words")).collect()}
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in totals if s is None]
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    targets = water_filled(totals, weight, total_share * sum(totals.values()), most_repeats) if order else {}
    plan = spark.createDataFrame(
        [(s, totals[s], targets[s], int(targets[s] // totals[s]) if totals[s] else 0) for s in order],
        "source string, source_size long, target double, wholes long",
    )

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        lengths, counts = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64)
        part = int(round(group["target"].iloc[0])) - int(group["wholes"].iloc[0] * group["source_size"].iloc[0])
        group["extra"] = fitted_counts(lengths, counts, max(0, part))
        return group[["source", "size", "docs", "source_size", "target", "wholes", "extra"]]

    # a group holds one row for each length of a source, so it is bounded by the longest document
    fits = (
        by_length.join(F.broadcast(plan), by_length["source"].eqNullSafe(plan["source"])).select(by_length["*"], "source_size", "target", "wholes")
        .groupBy("source").applyInPandas(fit, "source string, size long, docs long, source_size long, target double, wholes long, extra long")
    )
    # the first `extra` documents of each (source, length) in seeded order: whole hash bins by counting, one bin by rank
    binned = sized.withColumn("bin", F.pmod("place", F.lit(HASH_BINS)))
    counted = binned.groupBy("source", "size", "bin").agg(F.count("*").alias("in_bin"))
    before = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.withColumn("ahead", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    cuts = (
        bins.alias("b").join(fits.alias("f"), F.col("b.source").eqNullSafe(F.col("f.source")) & (F.col("b.size") == F.col("f.size")))
        .select("b.source", "b.size", "b.bin", "source_size", "target", "wholes", (F.col("extra") - F.col("ahead")).alias("room"), "in_bin")
    )
    joined = binned.alias("d").join(
        cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.bin") == F.col("c.bin"))
    ).select("d.*", "source_size", "target", "wholes", "room", "in_bin")
    whole = (F.col("room") <= 0) | (F.col("room") >= F.col("in_bin"))
    sure = joined.filter(whole).withColumn("drawn", (F.col("room") > 0).cast("long"))
    rank = Window.partitionBy("source", "size", "bin").orderBy("place", "doc_id", "tie")
    edge = joined.filter(~whole).withColumn("drawn", (F.row_number().over(rank) <= F.col("room")).cast("long"))
    repeats = F.col("wholes") + F.col("drawn")
    return sure.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"),
                                         (F.col("size") * repeats).alias("taken"), "tie")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with all its columns.

    Rows that repeat doc_id, source and text are one document, taken as often as all of them together; of such rows the
    one with the smallest hash of its columns is taken. Columns may have any names: helper names are made so that
    ``docs`` does not use them. Null texts and texts without words are not taken. An empty table stays empty.
    """
    key, times, text, copy, place = (unused(docs, n) for n in ("key", "times", "text_hash", "copy", "place"))
    # rows are dealt once by this key, which is never null (null fields are left out of it): the window and the join both find them there
    named = lambda doc_id, source, tie: F.to_json(F.struct(F.col(doc_id).alias("d"), F.col(source).alias("s"), F.col(tie).alias("t")))
    plan = (mixed(docs, **how).select(named("doc_id", "source", "tie").alias(key), F.col("repeats").alias(times))
            .groupBy(key).agg(F.sum(times).alias(times)).filter(F.col(times) > 0))
    once = docs.withColumn(text, F.xxhash64("text")).withColumn(key, named("doc_id", "source", text))
    once = once.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(row_hash(docs)))).filter(F.col(place) == 1)
    copies = once.join(plan, key).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return copies.select(*docs.columns)
