"""Links inside buckets: from documents that share a bucket to connected components, without expanding a bucket.

Candidate generation deals documents to buckets (tokens of a prefix, bands of a sketch). Here the members of a bucket are
first compared with one centre, and those of large buckets that still hold several components with a few more.
Members of the buckets that are left meet in tiles: packs of about ``TILE`` members, compared as matrices inside a
task, which hands over only each member's likeliest partners in other components. The number handed over grows from
round to round until no member has more, so every possible link between components is confirmed on the full sets,
each pair once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.graph import components
from corpusflow.llm.words import distinct_per_document, mix, shingle_hashes, word_runs
from corpusflow.session import materialize

TILE = 256
HOME_TILE = 48
CENTRES = 4
FIRST_PARTNERS, MORE = 2, 128


def sets_of(batches, size: int):
    """(ids, shingle hashes, owners, number of documents): distinct shingles of runs of (id, text) rows."""
    for batch in batches:
        ids = batch.column(0)
        for words in word_runs(batch.column(1), lower=True):
            h, d = distinct_per_document(*shingle_hashes(words, words.hashes(), size))
            yield ids.slice(words.first, words.count), h, d, words.count


def set_digests(h: np.ndarray, d: np.ndarray, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Size and a 128-bit digest (two sums of mixed hashes) of every document's set."""
    bounds = np.searchsorted(d, np.arange(count + 1))
    sums = []
    for salt in (0, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return np.diff(bounds), sums


@dataclass(frozen=True)
class Likeness:
    """How two members of a bucket are judged before their texts are read.

    ``possible`` is a column condition on the sizes and places of both; ``score`` takes numpy arrays that broadcast
    (sizes, places and features of both sides) and gives a likeness, below zero where a link is ruled out.
    """

    possible: Callable[[Column, Column, Column, Column], Column]
    score: Callable[..., np.ndarray]


@dataclass(frozen=True)
class Threshold:
    """Sets link when den * |A and B| >= num * |A or B| over shingles of ``size`` words."""

    size: int
    num: int
    den: int


def _rows_of(column: pa.Array) -> np.ndarray:
    """Features (binary values of one length) as a matrix of bytes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _sets(texts: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    out: list[np.ndarray] = []
    for chunk in texts.chunks:
        for words in word_runs(chunk, lower=True):
            h, d = distinct_per_document(*shingle_hashes(words, words.hashes(), size))
            out += np.split(h, np.searchsorted(d, np.arange(1, words.count)))
    return out


def _linking(rule: Threshold):
    """For a home (documents and pairs of them): the pairs whose full sets link. Each document's set is built once."""

    def check(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        sets = _sets(docs.column("text"), rule.size) if docs.num_rows else []
        rows: dict[int, list[int]] = {}
        for i, doc in enumerate(docs.column("id").to_pylist()):
            rows.setdefault(doc, []).append(i)
        good = np.zeros(pairs.num_rows, bool)
        for k, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
            for x in (sets[i] for i in rows.get(a, ())):
                for y in (sets[i] for i in rows.get(b, ())):
                    low, high = (x, y) if len(x) <= len(y) else (y, x)
                    if len(low):
                        common = int((high[np.minimum(np.searchsorted(high, low), len(high) - 1)] == low).sum())
                        good[k] |= common * rule.den >= (len(x) + len(y) - common) * rule.num
        return pairs.select(["a", "b"]).filter(pa.array(good))

    return check


def confirmed(pairs: DataFrame, texts: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) whose full sets link. ``texts`` (id, text) is bucketed by id, so it is joined where it lies.

    A pair's home is the smallest neighbour of its documents, so that pairs of one family meet; a home's documents are
    dealt to tiles, and a text moves once for each pair of tiles that needs it, not once for each pair.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("low"))
    homed = pairs.join(low, "a").join(low.select(F.col("a").alias("b"), F.col("low").alias("low_b")), "b").select("a", "b", F.least("low", "low_b").alias("home"))
    homed = materialize(homed, "homes")
    size = homed.select("home", F.col("a").alias("id")).unionByName(homed.select("home", F.col("b").alias("id"))).groupBy("home").agg(F.approx_count_distinct("id").alias("docs"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("docs") / HOME_TILE))
    at = ["home", "left", "right"]
    placed = homed.join(size, "home").withColumn("x", tile("a")).withColumn("y", tile("b")).select(
        "home", F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "a", "b")
    placed = materialize(placed, "homes")
    needed = placed.select(*at, F.col("a").alias("id")).unionByName(placed.select(*at, F.col("b").alias("id"))).distinct().join(texts, "id").select(
        *[F.col(c).alias(f"{c}_of") for c in at], "id", "text")
    found = needed.groupBy(*[f"{c}_of" for c in at]).cogroup(placed.groupBy(*at)).applyInArrow(_linking(rule), "a long, b long")
    return found.distinct()


def _judged_pairs(pairs: DataFrame, features: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that the features (id, n, feat) do not rule out: the likeliest a of each b.

    One link to a component joins a document as well as many do; the pairs left out stay open for the tiles.
    """
    sides = pairs
    for x in "ab":
        sides = sides.join(features.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("feat").alias(f"f{x}")), x)
    score = like.score

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            likely = score(na, None, _rows_of(batch.column("fa")), nb, None, _rows_of(batch.column("fb")))
            keep = pa.array(likely >= 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in "ab"), pa.array(likely).filter(keep)], ["a", "b", "likely"])

    judged = sides.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(judge, "a long, b long, likely double")
    return judged.groupBy("b").agg(F.max_by("a", F.struct("likely", "a")).alias("a")).select("a", "b")


def _partners(like: Likeness, most: int):
    """Every left member's ``most`` likeliest right members of other components; ``more`` marks members with further ones."""
    score = like.score

    def side(column, i):
        members = column[i].values
        number = [members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "pos", "comp")]
        return number, _rows_of(members.field("feat"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ia, na, pa_, ca), fa = side(batch.column(0), i)
                (ib, nb, pb, cb), fb = side(batch.column(1), i)
                likely = score(na[:, None], pa_[:, None], fa[:, None, :], nb[None, :], pb[None, :], fb[None, :, :])
                likely = np.where(ca[:, None] != cb[None, :], likely, -1.0)
                if (likely < 0).all():
                    continue
                found = (likely >= 0).sum(axis=1)
                if len(ib) > most:
                    cut = np.partition(likely, len(ib) - most, axis=1)[:, len(ib) - most]
                    take = (likely >= 0) & (likely >= cut[:, None])
                else:
                    take = likely >= 0
                x, y = np.nonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(ia[x], ib[y])), pa.array(np.maximum(ia[x], ib[y])), pa.array((found > take.sum(axis=1))[x])], ["a", "b", "more"])

    return compare


def _centre_pairs(members: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): members of each bucket with its seeded centres, where components differ and a link is possible."""
    centre = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("place"), "id", "n", "pos", "comp")) for k in range(CENTRES)]
    centres = members.groupBy("token").agg(F.array_distinct(F.array(*[F.struct(c["id"].alias("id"), c["n"].alias("n"), c["pos"].alias("pos"), c["comp"].alias("comp")) for c in centre])).alias("c"))
    met = members.join(centres.select("token", F.explode("c").alias("c")), "token").filter("comp <> c.comp")
    met = met.filter(like.possible(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
    return met.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


def linked(entries: DataFrame, features: DataFrame, docs: DataFrame, like: Likeness, rule: Threshold) -> DataFrame:
    """(id, component) of the documents that link with another one.

    ``entries`` (token, id, n, pos) are the members of the buckets, ``features`` (id, n, feat) what a pair is judged
    by, ``docs`` (id, text) the texts. Only texts whose document shares a bucket are moved, once, into a table
    bucketed by id.
    """
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition("token")  # dealt once, for the centres and for the join with them
    first = entries.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("c"), F.max("id").alias("last")).filter("last > c.id")
    buckets = materialize(entries.join(first.select("token", "c"), "token"), "buckets")
    name = f"texts_{uuid.uuid4().hex}"
    # dealt by id at any size, as the bucketed table needs it
    moved = docs.join(buckets.select("id").distinct().hint("merge"), "id").select("id", "text")
    moved.write.bucketBy(shuffles, "id").sortBy("id").format("parquet").saveAsTable(name)
    try:
        texts = spark.table(name)
        star = (buckets.filter("id <> c.id").filter(like.possible(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
                .select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct())
        checked = materialize(_judged_pairs(star, features, like), "pairs")
        links = materialize(confirmed(checked, texts, rule), "links")
        members, most, many = buckets.select("token", "id", "n", "pos"), FIRST_PARTNERS, True
        while True:
            found = materialize(components(links), "components")
            # buckets of one component stay so; rounds read only the others
            placed = members.select("token", "id", "n", "pos").join(found, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
            per = placed.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(
                F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("comps")).filter("comps > 1")
            members = materialize(placed.join(per.select("token", "m", F.col("top.comp").alias("top")), "token"), "open")
            if members.isEmpty():
                return found
            if many:  # large buckets once more with a few centres, before any matrix; judged pairs name a centre first
                many, large = False, members.filter(F.col("m") > TILE)
                if not large.isEmpty():
                    pairs = _judged_pairs(_centre_pairs(large, like), features, like).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    fresh = materialize(pairs.distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
                    links = materialize(links.unionByName(confirmed(fresh, texts, rule)), "links")
                    checked = materialize(checked.unionByName(fresh), "pairs")
                    continue
            tiled = (members.join(features.select("id", "feat").distinct(), "id").withColumn("tiles", F.ceil(F.col("m") / TILE))
                     .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))))
            packs = F.collect_list(F.struct("id", "n", "pos", "comp", "feat"))
            left = (tiled.filter("comp <> top").groupBy("token", "tile", "tiles").agg(packs.alias("x"))
                    .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("token", F.col("other").alias("tile"), "x"))
            right = tiled.groupBy("token", "tile").agg(packs.alias("y"))
            # matrices cost much more than their bytes suggest, so they are dealt over all tasks
            met = left.join(right, ["token", "tile"]).select("x", "y").repartition(shuffles).mapInArrow(_partners(like, most), "a long, b long, more boolean")
            pairs = materialize(met.groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
            fresh = materialize(pairs.select("a", "b").join(checked, ["a", "b"], "left_anti"), "pairs")
            done = pairs.filter("more").isEmpty()
            links = materialize(links.unionByName(confirmed(fresh, texts, rule)), "links")
            if done:
                return materialize(components(links), "components")
            checked, most = materialize(checked.unionByName(fresh), "pairs"), most * MORE
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def classes_named(digests: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``digests`` (id, n, d1, d2); equal sets are one class.

    ``link`` gets the classes' representatives (rep) and gives (id, component) of those that link with others.
    A document whose rows are in several classes joins them.
    """
    classes = digests.filter("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    found = link(classes.select("rep").distinct())
    named = digests.join(classes, ["n", "d1", "d2"], "left")
    several = named.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    bridges = materialize(named.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")), "links")
    if not bridges.isEmpty():
        found = components(bridges.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    named = named.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.coalesce("component", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))).alias("component_id"))
