"""Phrase collocations by Rabin-Karp fingerprints.

Texts are packed per language into chunks of about two megabytes, written once in a table bucketed by chunk. Prefix
polynomials over word hashes give the fingerprint of every n-gram of a chunk with one subtraction. Fingerprints are
counted per chunk, shuffled with the chunk as occurrence pointer, and summed; a part hands back to every chunk the
frequent fingerprints that occur in it, never to the driver or to all tasks. Words and pairs come first; longer
n-grams are fingerprinted where all of their pairs are frequent. Only frequent phrases become text: every chunk
compares the occurrences of a fingerprint word by word, and the exact counts of the texts decide.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.words import BASE, INVERSE, Words, _power_table, mix
from corpusflow.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
CHUNK_BYTES = 2 << 20
HELD_BYTES = 16 << 20
PART_BYTES = 8 << 20
BITS = 48
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True


def _cut(body: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK_BYTES, cut behind separators only; a piece without separators stays whole."""
    start = 0
    if len(body) > CHUNK_BYTES:
        ends = np.flatnonzero(_SEPARATES[np.frombuffer(body, np.uint8)]) + 1
        while len(body) - start > CHUNK_BYTES:
            at = int(np.searchsorted(ends, start + CHUNK_BYTES, side="right")) - 1
            at += at < 0 or ends[at] <= start  # no separator within a chunk: the next one behind it
            if at >= len(ends):
                break
            yield body[start: ends[at]]
            start = int(ends[at])
    yield body[start:]


def _chunks(docs: DataFrame) -> DataFrame:
    """(lang, body): lower-cased texts of one language, a separator between any two."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def out(lang):
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([b"\n".join(held.pop(lang))], pa.binary())], ["lang", "body"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                for part in _cut(text.as_buffer().to_pybytes().lower()):  # bytes.lower() changes A-Z alone
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= CHUNK_BYTES:
                        yield out(lang)
            while sum(sizes.values()) > HELD_BYTES:
                yield out(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield out(lang)

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string"))
    return plain.mapInArrow(pack, "lang string, body binary")


class Chunk:
    """Words of a chunk, the piece each is in, and prefix polynomials over their hashes."""

    def __init__(self, lang: str, body: bytes):
        self.body, self.data = body, np.frombuffer(body, dtype=np.uint8)
        separates = _SEPARATES[self.data]
        solid = ~(separates | _BLANK[self.data])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.cumsum(separates, dtype=np.int32)[self.starts]
        words = Words(self.data, self.starts, self.ends, self.piece, 0, 0)
        self.words = words.hashes() if len(self.starts) else np.zeros(0, np.uint64)
        size = len(self.words)
        self.prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(self.words * _power_table("base", BASE, size), out=self.prefix[1:])
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8"), digest_size=8).digest(), "little"))

    def grams(self, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, 64-bit fingerprint) of the runs of ``n`` words that stay within a piece, ``at`` all or given words."""
        last = len(self.words) - n + 1
        at = np.arange(max(0, last)) if at is None else at[at < last]
        at = at[self.piece[at] == self.piece[at + n - 1]] if len(at) else at
        span = (self.prefix[at + n] - self.prefix[at]) * _power_table("inverse", INVERSE, len(self.words) + 1)[at]
        return at, mix(span + np.uint64(n) ^ self.seed)

    def exact_words(self) -> np.ndarray:
        """A number for each word such that equal numbers mean equal bytes."""
        _, first, number = np.unique(self.words, return_index=True, return_inverse=True)
        model, sizes = first[number], self.ends - self.starts
        same = sizes == sizes[model]
        if same.all():
            shift = np.repeat(self.starts - (np.cumsum(sizes) - sizes), sizes)
            place = np.arange(len(shift)) + shift
            other = place + np.repeat(self.starts[model] - self.starts, sizes)
            if (self.data[place] == self.data[other]).all():
                return number
        seen: dict[bytes, int] = {}  # two words with one hash
        return np.array([seen.setdefault(self.data[s:e].tobytes(), len(seen)) for s, e in zip(self.starts, self.ends)])

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.body[s:e] for s, e in zip(self.starts[at: at + n].tolist(), self.ends[at: at + n].tolist()))


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def _packed(prints: list[np.ndarray], chunk: int, parts: int) -> pa.RecordBatch:
    """(part, chunk, prints, counts): distinct fingerprints of a chunk and their counts, cut by ranges of values.

    Both are stored as byte planes: sorted values have long runs in their high bytes, which shuffle files compress.
    """
    value, count = np.unique(np.concatenate(prints), return_counts=True)
    part = ((value >> np.uint64(16)) * np.uint64(parts) >> np.uint64(BITS - 16)).astype(np.int64)
    edges = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    planes = lambda x, width: [_planes(x[a:b], width) for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[edges[:-1]]), pa.array(np.full(len(edges) - 1, chunk, np.int64)), pa.array(planes(value, BITS // 8), pa.binary()),
         pa.array(planes(count.astype(np.uint32), 4), pa.binary())], ["part", "chunk", "prints", "counts"])


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize)[:, :width].T).tobytes()


def _unplaned(planes: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64)[:, 0]


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    """(chunk, prints): for every chunk those of its fingerprints whose counts over all chunks reach ``least``, as byte planes."""

    def total(table: pa.Table) -> pa.Table:
        prints = [_unplaned(p, BITS // 8) for p in table.column("prints").to_pylist()]
        counts = np.concatenate([_unplaned(c, 4) for c in table.column("counts").to_pylist()])
        owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        value, number = np.unique(np.concatenate(prints), return_inverse=True)
        often = np.bincount(number, weights=counts) >= least
        take = often[number]
        number, owner = number[take], owner[take]
        edges = np.searchsorted(owner, np.arange(len(prints) + 1))
        found = [_planes(value[number[a:b]], BITS // 8) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"chunk": table.column("chunk"), "prints": pa.array(found, pa.binary())}).filter(pa.array(np.diff(edges) > 0))

    return counted.groupBy("part").applyInArrow(total, "chunk long, prints binary")


def _known(flags: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unplaned(p, BITS // 8) for p in flags.column("prints").to_pylist())]))


def _among(prints: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(prints), bool)
    return known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of up to ``longest`` words with f >= least, (lang, n) of all words).

    Counting is exact whatever fingerprints collide. A phrase that stands in every chunk is one fingerprint a chunk,
    so no phrase, language or group of copies makes a large group.
    """
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    packed = _chunks(docs).withColumn("chunk", F.monotonically_increasing_id())
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # the bucketed table is the only copy of the texts, and what fixes the numbers of the chunks
    packed.repartition(parts, "chunk").write.bucketBy(parts, "chunk").sortBy("chunk").format("parquet").saveAsTable(name)
    try:
        chunks = spark.table(name)

        def short_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, body, chunk in zip(batch.column("lang").to_pylist(), batch.column("body"), batch.column("chunk").to_pylist()):
                    own = Chunk(lang, body.as_buffer().to_pybytes())
                    if len(own.words):
                        yield _packed([_short(own.grams(n)[1]) for n in (1, 2)], chunk, parts)

        def long_grams(own: pa.Table, flags: pa.Table) -> pa.Table:
            out = []
            for lang, body, chunk in zip(own.column("lang").to_pylist(), own.column("body"), own.column("chunk").to_pylist()):
                mine, known = Chunk(lang, body.as_buffer().to_pybytes()), _known(flags)
                at, h = mine.grams(2)
                pair = np.zeros(len(mine.words) + longest, bool)
                pair[at[_among(_short(h), known)]] = True
                run, prints = pair.copy(), []
                for n in range(3, longest + 1):
                    run[: len(mine.words)] &= pair[n - 2: n - 2 + len(mine.words)]
                    prints.append(_short(mine.grams(n, np.flatnonzero(run[: len(mine.words)]))[1]))
                if sum(map(len, prints)):
                    out.append(_packed(prints, chunk, parts))
            return pa.Table.from_batches(out, _PACKED)

        def texts(own: pa.Table, flags: pa.Table) -> pa.Table:
            out = []
            for lang, body, chunk in zip(own.column("lang").to_pylist(), own.column("body"), own.column("chunk").to_pylist()):
                mine, known = Chunk(lang, body.as_buffer().to_pybytes()), _known(flags)
                found: dict[int, list[tuple]] = {chunk % parts: [(0, None, len(mine.words))]}
                exact = mine.exact_words() if len(known) else None
                for n in range(1, longest + 1) if len(known) else ():
                    at, h = mine.grams(n)
                    take = _among(_short(h), known)
                    at, h = at[take], h[take]
                    if not len(at):
                        continue
                    _, first, number, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    model = at[first][number]
                    if not all((exact[at + k] == exact[model + k]).all() for k in range(n)):  # two phrases with one fingerprint
                        _, first, count = np.unique(np.stack([exact[at + k] for k in range(n)], axis=1), axis=0, return_index=True, return_counts=True)
                    for m, c in zip(at[first].tolist(), count.tolist()):
                        text = mine.text(m, n)
                        found.setdefault(zlib.crc32(text) % parts, []).append((n, text, c))
                for part, rows in found.items():
                    out.append((lang, part, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
            return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(_TEXTS.types)], schema=_TEXTS)

        def exact_counts(table: pa.Table) -> pa.Table:
            own = pa.table({c: table.column(c).combine_chunks().flatten() for c in ("words", "phrase", "f")})
            own = own.group_by(["words", "phrase"]).aggregate([("f", "sum")])
            own = own.filter(pc.or_(pc.equal(own.column("words"), 0), pc.greater_equal(own.column("f_sum"), least)))
            lang = pa.array(table.column("lang").slice(0, 1).to_pylist() * own.num_rows, pa.string())
            return pa.table([lang, own.column("words"), own.column("phrase").cast(pa.string()), own.column("f_sum")], ["lang", "words", "phrase", "f"])

        pairs = materialize(_frequent(chunks.mapInArrow(short_grams, "part long, chunk long, prints binary, counts binary"), least), "prints")
        longer = chunks.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(long_grams, "part long, chunk long, prints binary, counts binary")
        longer = materialize(_frequent(longer, least), "prints")
        # the phrases of a chunk and part travel as one row
        found = chunks.groupBy("chunk").cogroup(pairs.unionByName(longer).groupBy("chunk")).applyInArrow(
            texts, "lang string, part long, words array<long>, phrase array<binary>, f array<long>")
        counts = materialize(found.groupBy("lang", "part").applyInArrow(exact_counts, "lang string, words long, phrase string, f long"), "phrases")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return counts.filter("words > 0"), counts.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))


_PACKED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])
_TEXTS = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("words", pa.list_(pa.int64())), ("phrase", pa.list_(pa.binary())), ("f", pa.list_(pa.int64()))])


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Pieces end at ``.,;:!?`` and line ends, words at blanks; only A-Z are lower-cased. Candidates are phrases of 2 to
    ``longest`` words with a >= least occurrences. Of the cuts of a candidate the lowest floor(1000 a n / (l r)) counts
    (of equal ones the first); candidates that occur no more often than a longer candidate around them go. Null texts
    are empty, a null language is ``und``; an empty table gives an empty result; repeated rows count each time; other
    columns are not read.
    """
    counts, totals = phrase_counts(docs, longest, least)
    wide = "decimal(38,0)"
    candidates = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    # a longer candidate that occurs as often implies one with one word more that does
    longer = counts.filter("words > 2").select("lang", "f", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cast(k AS int))")).withColumn("rest", F.expr("substring_index(phrase, ' ', cast(k - words AS int))"))
    for part, column in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(column)), ["lang", part])
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(f"cast(cast(1000 AS {wide}) * a * n AS {wide}) div cast(cast(l AS {wide}) * r AS {wide})"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    kept = scored.join(covered, ["lang", "phrase"], "left").filter("most IS NULL OR most < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.select("lang", "phrase", "a", "low.l", "low.r", "n", F.col("low.score").cast("long").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))
