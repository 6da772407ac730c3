"""Similarity join on word n-grams: prefixes of hashed parts, with length and suffix filters.

Every document becomes a set of shingle hashes. The hash space is cut into parts, somewhat more than two linking sets
can differ in shingles, so linking sets agree in some whole parts: the shingles of a part together are one token, which
only near copies share, however common its single shingles are. Parts in one global order, large ones first, allow a
prefix filter: linking sets share a token within their prefixes. Documents meet in the buckets of these tokens
(``buckets.linked``): with one centre first, then in tiles with members of other components. Only pairs within one
component are left out, so no link between components is lost, and each pair is confirmed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.buckets import Likeness, Threshold, classes_named, linked, set_digests, sets_of
from corpusflow.llm.names import unused
from corpusflow.llm.words import mix
from corpusflow.session import materialize

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
PARTS = 128  # of the suffix filter
AT_ONCE = 2048  # pairs whose parts are subtracted in one go
SMALLEST = 4  # sizes up to this are one class; each further class reaches twice as far
SPARE = 5  # a class has a part more for each SPARE parts of the longest prefix, so that prefixes leave out the smallest parts


def _size_classes(num: int, den: int) -> np.ndarray:
    """Upper ends of the size classes. Linking sets are in one class or in adjacent ones."""
    ends = [SMALLEST]
    while ends[-1] < 1 << 40:
        ends.append(max(2 * ends[-1], -(-ends[-1] * den // num)))
    return np.array(ends, np.int64)


def _tokens(h: np.ndarray, d: np.ndarray, n: np.ndarray, level: np.ndarray, ends: np.ndarray, differ: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, document) of the prefixes of documents cut into the parts of class ``level``; ``h`` is sorted by document.

    A document and a partner differ in at most ``differ`` shingles, hence in as many parts of the K that the class has:
    they have K - differ parts in common, of which the first is among the first differ + 1 of either. A part's place in
    the order follows from its contents: large parts, then small ones, then empty ones. Without ``differ`` no
    other set can link.
    """
    able = differ > 0
    longest = 2 * ends[level] * (den - num) // (den + num) + 1
    parts = longest + -(-longest // SPARE)
    use = able[d]
    h, d = h[use], d[use]
    part = ((h >> np.uint64(32)) * parts[d].astype(np.uint64)) >> np.uint64(32)  # rises with the hash
    new = np.ones(len(h), bool)
    new[1:] = (part[1:] != part[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    size, part, doc = np.diff(first, append=len(h)), part[first], d[first]
    token = np.add.reduceat(mix(h ^ np.uint64(0xD1B54A32D192ED03)), first) if len(first) else h
    named = lambda part, doc: mix((level[doc].astype(np.uint64) << np.uint64(48)) + part + np.uint64(1))
    token = mix(token ^ named(part, doc))
    order = np.lexsort((token, -size, doc))
    token, doc = token[order], doc[order]
    held = np.bincount(doc, minlength=len(n))
    place = np.arange(len(doc)) - (np.cumsum(held) - held)[doc]
    keep = place <= differ[doc]
    tokens, owners = [token[keep]], [doc[keep]]
    for k in np.flatnonzero(able & (held <= differ)):  # too few parts with contents: empty ones, by number
        empty = np.setdiff1d(np.arange(parts[k], dtype=np.uint64), part[np.searchsorted(d[first], k): np.searchsorted(d[first], k, "right")])
        empty = empty[: differ[k] + 1 - held[k]]
        owners.append(np.full(len(empty), k))
        tokens.append(named(empty, owners[-1]))
    return np.concatenate(tokens), np.concatenate(owners)


def _prefixes(h: np.ndarray, d: np.ndarray, n: np.ndarray, ends: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, document), by document: a document's prefix in its own size class, and in the next one where partners can be in it."""
    level, most = np.searchsorted(ends, n), n * den // num
    differ = (n + np.minimum(most, ends[level])) * (den - num) // (den + num)
    beyond = np.where(most > ends[level], (n + most) * (den - num) // (den + num), 0)
    found = [_tokens(h, d, n, level, ends, differ, num, den), _tokens(h, d, n, level + 1, ends, beyond, num, den)]
    token, doc = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(doc, kind="stable")
    return token[order].view(np.int64), doc[order]


def _profiles(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(id, n, d1, d2, feat, prefix): set size, digest, part sizes and prefix tokens of every document."""
    ends = _size_classes(num, den)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, d, count in sets_of(batches, size):
            n, sums = set_digests(h, d, count)
            parts = np.bincount(d * PARTS + (mix(h ^ np.uint64(0x94D049BB133111EB)) % np.uint64(PARTS)).astype(np.int64), minlength=count * PARTS)
            parts = parts.astype(np.uint8).reshape(count, PARTS)  # modulo 256; see likeness
            prefix, owner = _prefixes(h, d, n, ends, num, den)
            offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.cast(pa.int64()), pa.array(n, pa.int64()), *map(pa.array, sums), pa.array([p.tobytes() for p in parts], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix))], ["id", "n", "d1", "d2", "feat", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(profile, "id long, n long, d1 long, d2 long, feat binary, prefix array<long>")


def likeness(num: int, den: int) -> Likeness:
    """Length filter for two members of a bucket, and the suffix filter.

    The suffix filter splits the token space into ``PARTS`` parts: the two sets differ in at least as many tokens as their
    parts differ in size, which bounds their similarity from above. Sizes are known modulo 256, so a part's difference is
    taken the shorter way round, which is never more than it is.
    """
    def possible(na, pos_a, nb, pos_b):
        return F.least(na, nb) * den >= F.greatest(na, nb) * num

    def score(na, pos_a, fa, nb, pos_b, fb):
        total = na + nb
        good = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
        apart = np.zeros(good.shape, np.uint16)
        if good.size <= AT_ONCE:  # most tiles hold a few members
            gap = fa - fb
            apart = np.minimum(gap, -gap).sum(axis=-1, dtype=np.uint16)
        elif good.any():
            for a, b in zip(*(np.ascontiguousarray(np.moveaxis(f, -1, 0)) for f in (fa, fb))):  # part by part, a byte a pair
                gap = a - b
                apart += np.minimum(gap, -gap)
        apart = apart.astype(np.int64)
        good = good & (apart * (num + den) <= total * (den - num))
        return np.where(good, (total - apart) / np.maximum(total + apart, 1), -1.0)

    return Likeness(possible, score)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when denominator * |A and B| >= numerator * |A or B| over their distinct word shingles.
    Texts with fewer words than a shingle have their whole word sequence as one; texts without words (null, empty)
    have an empty set and link with nothing. Equal sets are one class from the start. Rows that share a doc_id are
    one document for linking; rows with a null doc_id link with nothing and have a null component. Columns beyond
    doc_id and text are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialize(_profiles(docs, shingle, numerator, denominator), "profiles")

    def link(reps: DataFrame) -> DataFrame:
        own = profiles.filter("n > 0").join(reps.withColumnRenamed("rep", "id"), "id", "left_semi")
        features = materialize(own.select("id", "n", "feat").distinct(), "features")
        entries = own.select(F.explode("prefix").alias("token"), "id", "n", F.lit(0).cast("long").alias("pos"))
        return linked(entries, features, docs.withColumnRenamed("doc_id", "id"), likeness(numerator, denominator), Threshold(shingle, numerator, denominator))

    return classes_named(profiles, link)


def one_per_component(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component stays: the smallest doc_id.

    Rows with a null doc_id are in no component and stay. Of rows that share the staying doc_id all stay. Columns may
    have any names: rows are compared by doc_id under a name that ``docs`` does not use. An empty table stays empty.
    """
    dropped = unused(docs, "dropped")
    found = jaccard_components(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(found, docs["doc_id"] == found[dropped], "left_anti")
