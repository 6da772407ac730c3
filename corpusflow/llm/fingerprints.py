"""Document fingerprints from prefix polynomial hashes.

Prefix sums of a polynomial over the code points, modulo a prime, give the hash of any span with one subtraction, so
spans of two texts compare in constant time and their longest common extension is found by binary search. The
fingerprint of a text is its whole-span hash and the smallest hashes among all its fixed-length spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = (1 << 31) - 1
BASES = (1_000_003, 92_821)
SPAN = 16
KEPT = 48
RUN_CHARS = 1 << 18

_tables: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < size:
        out = np.ones(1 << max(10, int(size - 1).bit_length()), dtype=np.uint64)
        out[1] = base
        done = 2
        while done < len(out):  # base**(i + done) = base**i * base**done
            out[done: 2 * done] = out[:done] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done *= 2
        have = _tables[base] = out
    return have[:size]


class PrefixHashes:
    """Modular prefix arrays of one sequence of code points, one for each base."""

    def __init__(self, codes: np.ndarray, bases: tuple[int, ...] = BASES):
        self.bases, self.size = bases, len(codes)
        self.prefix = []
        for base in bases:
            terms = (codes.astype(np.uint64) + np.uint64(1)) * _powers(base, len(codes)) % np.uint64(PRIME)
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.prefix.append(sums % np.uint64(PRIME))

    def spans(self, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
        """Hashes of spans; equal spans have equal hashes wherever they stand."""
        sums = self.prefix[base]
        gap = sums[ends] + np.uint64(PRIME) - sums[starts]
        return gap % np.uint64(PRIME) * _powers(pow(self.bases[base], -1, PRIME), self.size + 1)[starts] % np.uint64(PRIME)

    def key(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of one span over all bases, and its length."""
        out = [end - start]
        for k, base in enumerate(self.bases):
            gap = int(self.prefix[k][end]) - int(self.prefix[k][start])
            out.append(gap * pow(base, -start, PRIME) % PRIME)
        return tuple(out)


def equal_spans(a: PrefixHashes, a_span: tuple[int, int], b: PrefixHashes, b_span: tuple[int, int]) -> bool:
    """Whether two spans are equal, in constant time."""
    return a.key(*a_span) == b.key(*b_span)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension to the right of position i in one text and j in another."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, (i, i + middle), b, (j, j + middle)):
            low = middle
        else:
            high = middle - 1
    return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _smallest(values: np.ndarray, kept: int) -> np.ndarray:
    """The ``kept`` smallest distinct values."""
    take = 4 * kept
    while take < len(values):
        found = np.unique(np.partition(values, take)[:take])
        if len(found) > kept:  # the largest may be cut off from equal values, smaller ones are complete
            return found[:kept]
        take *= 4
    return np.unique(values)[:kept]


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def sketches(texts: list[str]) -> list[tuple[str, np.ndarray]]:
    """(whole-text hash, smallest span hashes) of every text; texts are hashed in runs of bounded length."""
    out: list[tuple[str, np.ndarray]] = []
    lengths = [len(t) for t in texts]
    first = 0
    while first < len(texts):
        last, held = first + 1, lengths[first]
        while last < len(texts) and held + lengths[last] <= RUN_CHARS:
            held += lengths[last]
            last += 1
        run = PrefixHashes(code_points("".join(texts[first:last])))
        ends = np.cumsum(lengths[first:last])
        starts = ends - np.array(lengths[first:last], dtype=np.int64)
        wholes = [run.spans(starts, ends, k) for k in range(len(BASES))]
        at = np.arange(max(0, held - SPAN + 1))
        spans = _scrambled(run.spans(at, at + SPAN)) if len(at) else np.zeros(0, np.uint64)
        for k in range(last - first):
            size = lengths[first + k]
            whole = f"{size:08x}{int(wholes[0][k]):08x}{int(wholes[1][k]):08x}"
            if size >= SPAN:
                kept = _smallest(spans[starts[k]: ends[k] - SPAN + 1], KEPT)
            else:  # too short for a span: the whole text is its only one
                kept = _scrambled(wholes[0][k: k + 1] + np.uint64(size + 1) * np.uint64(PRIME))
            out.append((whole, kept))
        first = last
    return out


def as_text(sketch: tuple[str, np.ndarray]) -> str:
    return sketch[0] + "".join(f"{v:08x}" for v in sketch[1].tolist())


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """Estimated share of spans in common (Dice coefficient), 1.0 for equal texts."""
    if a[0] == b[0]:
        return 1.0
    kept = min(KEPT, len(np.union1d(a[1], b[1])))
    smallest = np.union1d(a[1], b[1])[:kept]
    both = np.intersect1d(a[1], b[1], assume_unique=True)
    jaccard = float(np.isin(smallest, both).sum()) / kept
    return min(2 * jaccard / (1 + jaccard), 0.999999)


def edited_text(text: str, following: str) -> str:
    """The last third of a text replaced by the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within a range, each with the row that follows it; marked rows only follow."""
    held = None  # last row of the batch before: (range, doc_id, text, sketch, mark)
    for batch in batches:
        parts, marks, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        texts = [t or "" for t in batch.column(3).to_pylist()]
        sketch = sketches(texts)
        rows = list(zip(parts, ids, texts, sketch, marks))
        if held is not None:
            rows.insert(0, held)
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[4]]
        if pairs:
            yield _finished(pairs)


def _finished(pairs: list[tuple]) -> pa.RecordBatch:
    edited = [edited_text(a[2], b[2]) for a, b in pairs]
    out = []
    for (a, b), text, sketch in zip(pairs, edited, sketches(edited)):
        same = common_extension(PrefixHashes(code_points(a[2])), 0, PrefixHashes(code_points(text)), 0) if a[2] != text else len(text)
        out.append((a[1], len(a[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), as_text(a[3]), as_text(sketch),
                    likeness(a[3], sketch), likeness(a[3], b[3]), same))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), RESULT)], schema=RESULT)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_start", pa.int64())])


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_start
    (code points that the text and its edit share at their start). The edit takes the start of the next document by
    descending doc_id; the last document takes the first one's. Documents are dealt to ranges of doc_id, and the
    first document of each range is also sent to the range before, so no ordering of all rows in one task is needed.
    Null and very short texts count as texts (null is empty; empty texts are equal to each other). Rows with one
    doc_id follow each other by text hash; null ids come last. An empty table gives an empty result. A document that
    is alone is its own next one. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(100 * ranges)).alias("cuts")
                     if shares else F.array().cast("array<long>").alias("cuts")).first()
    heads = np.array(sorted({c for c in found.cuts or [] if c < found.top}), dtype=np.int64)  # ascending
    last = len(heads)

    @F.pandas_udf(T.LongType())
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy()
        return pd.Series(last - np.searchsorted(heads, known, side="left"), dtype="int64")

    part = F.least(range_of("doc_id"), F.lit(last))
    own = docs.withColumn("part", part)
    is_head = F.col("doc_id").isin([int(h) for h in heads]) if last else F.lit(False)
    before = F.when(F.col("doc_id").eqNullSafe(F.lit(found.top)), F.lit(last)).when(is_head, F.col("part") - 1)
    places = F.when(before.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("mark")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("mark")), F.struct(before.cast("long").alias("part"), F.lit(1).alias("mark"))))
    dealt = own.select("doc_id", "text", F.explode(places).alias("p")).select("p.part", "p.mark", "doc_id", "text")
    ordered = dealt.repartition(max(1, last + 1), "part").sortWithinPartitions("part", "mark", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    spark_schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double, common_start long")
    return ordered.select("part", "mark", "doc_id", "text").mapInArrow(_compared, spark_schema)
