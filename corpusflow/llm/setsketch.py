"""Near-dedup by SetSketch registers: banded, judged by joint likelihood, confirmed on the full sets.

Every shingle sends a Poisson stream of arrivals to the registers, so a register's first arrival over a set is an
exponential minimum. Registers keep its exponent to base b, truncated to 0..Q+1; the registers of a union are the
element-wise maxima. The probabilities that one of two registers is larger depend only on the sizes of both sets and
on their similarity, which is estimated from all registers at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.buckets import Likeness, Threshold, classes_named, linked, set_digests, sets_of
from corpusflow.llm.words import mix
from corpusflow.session import materialize

SHINGLE, NUMERATOR, DENOMINATOR = 5, 85, 100
BANDS, ROWS = 24, 6
REGISTERS = 256  # the first BANDS * ROWS are banded, all of them are judged
B, RATE, Q = 1.02, 20.0, 2046
#: A pair is ruled out when similarities from the threshold on are e^-9 times as likely as the likeliest one (over 4 sigma).
LOG_ODDS = 9.0
GRID = 32


def registers(h: np.ndarray, d: np.ndarray, count: int) -> np.ndarray:
    """Registers (count x REGISTERS) of the sets with element hashes ``h`` and owners ``d``."""
    first = np.full((count, REGISTERS), np.inf)
    flat, cap = first.reshape(-1), np.ones(count)
    state, owner, time, step = h, d, np.zeros(len(h)), 0
    while len(state):
        step += 1
        draw = mix(state + np.uint64((step * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52) / (REGISTERS * RATE)
        place = (mix(draw) >> np.uint64(33)).astype(np.int64) % REGISTERS
        np.minimum.at(flat, owner * REGISTERS + place, time)
        # arrivals beyond every register's first one, or beyond time 1 (register 0), change nothing
        alive = time < np.minimum(first.max(axis=1), cap)[owner]
        state, owner, time = state[alive], owner[alive], time[alive]
    return np.clip(np.floor(1.0 - np.log(first) / np.log(B)), 0, Q + 1).astype(np.int16)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, n, d1, d2, regs): set size, digest and registers of every row of ``docs`` (doc_id, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, d, count in sets_of(batches, shingle):
            n, sums = set_digests(h, d, count)
            regs = registers(h, d, count)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), *map(pa.array, sums), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["id", "n", "d1", "d2", "regs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch, "id long, n long, d1 long, d2 long, regs binary")


def merged(sketched: DataFrame, *by: str) -> DataFrame:
    """Registers and estimated number of distinct shingles of each group's union: the largest register of each place.

    Groups of any size: registers are combined inside the scan's own tasks, then once for each group's partial maxima.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.int16).reshape(batch.num_rows, REGISTERS)
            for key, own in zip(zip(*(batch.column(c).to_pylist() for c in by)), regs):
                best[key] = np.maximum(best[key], own) if key in best else own
        if best:
            keys = list(zip(*best))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array([r.tobytes() for r in best.values()], pa.binary()),
                 pa.array([cardinality(r) for r in best.values()], pa.float64())], [*by, "regs", "estimate"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(sketched.schema[c].dataType) for c in by]
    schema = ", ".join(f"{c} {sketched.schema[c].dataType.simpleString()}" for c in by) + ", regs binary, estimate double"
    partial = sketched.select(*by, "regs").mapInArrow(fold, schema)
    return partial.drop("estimate").repartition(*by).mapInArrow(fold, schema)


def cardinality(regs: np.ndarray) -> float:
    """Number of distinct elements that a sketch has seen."""
    if not regs.any():
        return 0.0
    return float(len(regs) * (1 - 1 / B) / (RATE * np.log(B) * np.sum(np.power(B, -regs.astype(np.float64)))))


def _larger(x):
    """Probability that one register exceeds the other, where x is the share of the union that only the first set has."""
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (B - 1) / B) / np.log(B)


def estimate(na, nb, above, below, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, log odds against similarities from ``floor`` on).

    ``above`` and ``below`` count registers in which the first or the second set is larger; sizes are known exactly.
    """
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    best, at, allowed = np.full(u.shape, -np.inf), np.zeros(u.shape), np.full(u.shape, -np.inf)
    level = REGISTERS - above - below
    for k in range(GRID + 1):
        # half of the grid lies from the floor on, where the sizes allow it
        low = np.minimum(floor, most)
        j = low * (2 * k / GRID) if k <= GRID // 2 else low + (most - low) * (2 * k / GRID - 1)
        p, q = _larger(u - v * j), _larger(v - u * j)
        value = above * np.log(p + 1e-9) + below * np.log(q + 1e-9) + level * np.log(np.maximum(1 - p - q, 1e-12))
        better = value > best
        best, at = np.where(better, value, best), np.where(better, j, at)
        allowed = np.where((j >= floor - 1e-12) & (value > allowed), value, allowed)
    return at, best - allowed


def likeness(num: int, den: int) -> Likeness:
    """Sizes must allow a link, and the registers must not speak against one."""
    floor = num / den
    # with fewer equal registers than this no test below would pass; a cheap first sieve
    least = REGISTERS * floor - 7 * np.sqrt(REGISTERS * floor * (1 - floor))

    def possible(na, pos_a, nb, pos_b):
        return F.least(na, nb) * den >= F.greatest(na, nb) * num

    def first_shared(a, b):
        """The first band in which each pair of registers agrees; BANDS where none does."""
        same = (a[:, : BANDS * ROWS] == b[:, : BANDS * ROWS]).reshape(len(a), BANDS, ROWS).all(axis=-1)
        return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)

    def score(na, pos_a, fa, nb, pos_b, fb):
        a, b = fa.view(np.int16), fb.view(np.int16)
        equal = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int16)
        for k in range(REGISTERS):  # register by register: no array of all pairs and registers at once
            equal += a[..., k] == b[..., k]
        na, nb, equal = np.broadcast_arrays(na, nb, equal)
        out = np.full(equal.shape, -1.0)
        maybe = np.nonzero((np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (equal >= least))
        if len(maybe[0]):
            wide = (*equal.shape, REGISTERS)
            a, b = np.broadcast_to(a, wide), np.broadcast_to(b, wide)
            # several bands hold the same pair; it is judged in the first of them
            here = None if pos_a is None else np.broadcast_to(pos_a, equal.shape)
            for low in range(0, len(maybe[0]), 8192):
                part = tuple(x[low: low + 8192] for x in maybe)
                left, right = a[part], b[part]
                above = (left > right).sum(axis=-1)
                at, odds = estimate(na[part].astype(float), nb[part].astype(float), above, REGISTERS - equal[part] - above, floor)
                good = odds <= LOG_ODDS
                if here is not None:
                    good &= first_shared(left, right) == here[part]
                out[part] = np.where(good, at, -1.0)
        return out

    return Likeness(possible, score)


def _bands(sketched: DataFrame) -> DataFrame:
    """(token, id, n, pos): one bucket for each band of ROWS registers; the place is the band."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.int16).reshape(batch.num_rows, REGISTERS)
            regs = regs[:, : BANDS * ROWS].reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            token = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], (batch.num_rows, BANDS)).copy()
            for k in range(ROWS):
                token = mix(token * np.uint64(4099) + regs[:, :, k])
            index = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(token.reshape(-1).view(np.int64)), batch.column("id").take(index), batch.column("n").take(index),
                                              pa.array(np.tile(np.arange(BANDS), batch.num_rows))], ["token", "id", "n", "pos"])

    return sketched.select("id", "n", "regs").mapInArrow(band, "token long, id long, n long, pos long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Two documents link when denominator * |A and B| >= numerator * |A or B| over their distinct word shingles; texts
    with fewer words than a shingle have their whole word sequence as one, texts without words (null, empty) have an
    empty set and link with nothing. Equal sets are one class from the start. Sets too small to differ by less than the
    threshold allows meet nobody else. Links are confirmed on the full sets; a pair at the threshold itself is
    missed with a probability of about 3e-5 (no band in common, or registers that speak against it). Rows that share a doc_id are one document for linking; rows with a null
    doc_id link with nothing, have a null component and are kept. ``kept`` marks rows whose doc_id is their component.
    Other columns are not read. An empty table gives an empty result.
    """
    rule = Threshold(shingle, numerator, denominator)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialize(sketches(docs, shingle), "sketches")  # the texts are read once for this and once to confirm

    def link(reps: DataFrame) -> DataFrame:
        # n / (n + 1) is the largest similarity of two sets of which one has n elements and that differ
        able = sketched.filter(F.col("n") * denominator >= (F.col("n") + 1) * numerator).join(reps.withColumnRenamed("rep", "id"), "id", "left_semi")
        able = materialize(able.select("id", "n", F.col("regs").alias("feat")).distinct(), "features")
        return linked(_bands(able.withColumnRenamed("feat", "regs")), able, docs.withColumnRenamed("doc_id", "id"), likeness(numerator, denominator), rule)

    return classes_named(sketched, link).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
