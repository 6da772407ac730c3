"""Substring dedup: word windows that an earlier document holds are found with FM-indexes and removed.

Every window of 13 words has one minimizer, the word triple in it with the smallest hash, so equal windows meet under
equal minimizers. Minimizers that stand in one document only are dropped. The places of the others, with the windows
that belong to them, are dealt to shards; each shard builds a compressed FM-index over its pieces of text and streams
the pieces through it by backward search. Intervals of matching statistics that reach the window length give the
smallest document that holds a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.fmindex import FMIndex
from corpusflow.llm.words import Words, mix, word_runs
from corpusflow.session import materialize

WINDOW = 13
GRAM = 3
FLUSH_KEYS = 1 << 20
FLUSH_PIECES = 1 << 17
SHARD_PIECES = 50_000
HOT_KEYS = 10_000


@F.pandas_udf(T.BinaryType())
def _squeezed(texts: pd.Series) -> pd.Series:
    """Texts as they travel to their minimizers and intervals: a third less than the shuffle's own compression."""
    press = zstandard.ZstdCompressor(level=3)
    return pd.Series([press.compress((t or "").encode("utf-8")) for t in texts], dtype="object")


def _unpacked(packed: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(p) for p in packed.to_pylist()]


def _grams(h: np.ndarray) -> np.ndarray:
    out = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k: len(h) - GRAM + 1 + k]
    return mix(out)


def _places(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of every run of windows that share one minimizer place."""
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return none.astype(np.uint64), none, none
    grams = _grams(h)
    at = np.arange(len(h) - window + 1)
    place = at + sliding_window_view(grams, window - GRAM + 1).argmin(axis=1)
    whole = words.doc[at] == words.doc[at + window - 1]
    at, place = at[whole], place[whole]
    if not len(at):
        return none.astype(np.uint64), none, none
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return grams[place[first]], at[first], np.diff(np.append(first, len(at)))


def _shared_keys(docs: DataFrame, window: int) -> DataFrame:
    """(key, docs) rows of the minimizers that stand in two documents or more.

    A task settles the keys that it meets in several documents by itself and sends one document on for each, so a
    minimizer that stands in a third of all documents reaches its partition as one row per flush.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held, flush = [], [], 0, 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for words in word_runs(batch.column(1)):
                key, first, _ = _places(words, words.hashes(), window)
                keys.append(key)
                ids.append(doc[words.first + words.doc[first]])
                held += len(key)
                if held >= FLUSH_KEYS:
                    flush += 1
                    yield from grouped(np.concatenate(keys), np.concatenate(ids), flush)
                    keys, ids, held = [], [], 0
        if held:
            yield from grouped(np.concatenate(keys), np.concatenate(ids), flush + 1)

    def grouped(key: np.ndarray, doc: np.ndarray, flush: int) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bounds = np.append(first, len(key))
        size = np.diff(bounds)
        several = np.flatnonzero(size > 1)
        # one document for each key, dealt by key; `sure` if the flush holds another
        yield _rows(key[first].view(np.int64), key[first], doc[first], np.arange(len(first) + 1), size > 1)
        if len(several):
            lists = np.repeat(bounds[several] - np.concatenate([[0], np.cumsum(size[several])[:-1]]), size[several]) + np.arange(size[several].sum())
            dealt = mix(key[first[several]] + np.uint64(flush) + doc[first[several]].astype(np.uint64))
            yield _rows(dealt.view(np.int64), key[first[several]], doc[lists], np.concatenate([[0], np.cumsum(size[several])]), np.ones(len(several), bool), True)

    def _rows(deal, key, values, offsets, sure, settled=False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(deal), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
            pa.array(sure), pa.array(np.full(len(key), settled))], ["deal", "key", "docs", "sure", "settled"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key; a key's lone first row waits until another document or a sure row comes."""
        waiting: tuple[int, int] | None = None  # (key, document) not yet known to be shared
        open_key = None
        for batch in batches:
            key, sure, settled = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
            docs_, bounds = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            if settled.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[settled]), batch.column(2).filter(pa.array(settled))], ["key", "docs"])
            alone = ~settled
            k, d, s = key[alone], docs_[bounds[:-1][alone]], sure[alone]
            if waiting is not None:
                k, d, s = np.append([waiting[0]], k), np.append([waiting[1]], d), np.append([False], s)
            elif open_key is not None:
                s = s | (k == open_key)
            if not len(k):
                continue
            new = np.concatenate([[True], k[1:] != k[:-1]])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            known = np.logical_or.reduceat(s, first) | (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))
            keep = known[group]
            waiting, open_key = (None, k[-1]) if known[-1] else ((k[-1], d[-1]), None)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.ListArray.from_arrays(
                    pa.array(np.arange(int(keep.sum()) + 1, dtype=np.int32)), pa.array(d[keep]))], ["key", "docs"])

    rows = docs.select("doc_id", "text").mapInArrow(collect, "deal long, key long, docs array<long>, sure boolean, settled boolean")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "deal").sortWithinPartitions("key").mapInArrow(shared, "key long, docs array<long>")


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated byte spans and their offsets."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _pieces(candidates: DataFrame, window: int, hot: np.ndarray, shards: int) -> DataFrame:
    """(shard, piece, doc_id, place, windows) of the shared minimizers of every document.

    place holds the text's tag and the first word. Equal pieces within a flush are settled there: all but those of
    the smallest document go on without text, as windows that a smaller document holds. Windows of hot minimizers
    are dealt one by one, by their own hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tag = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(3)
            wanted, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for words in word_runs(pa.array(_unpacked(batch.column(1)), pa.large_binary()).view(pa.large_string())):
                h = words.hashes()
                key, first, count = _places(words, h, window)
                owner = words.first + words.doc[first]
                # keys of the document that are shared, by one sorted lookup of (document, key)
                low, high = cuts[words.first], cuts[words.first + words.count]
                mine = np.repeat(np.arange(words.first, words.first + words.count), np.diff(cuts[words.first: words.first + words.count + 1]))
                pair = mix(wanted[low:high].view(np.uint64) ^ mix(mine.astype(np.uint64)))
                keep = np.isin(mix(key ^ mix(owner.astype(np.uint64))), pair)
                key, first, count, owner = key[keep], first[keep], count[keep], owner[keep]
                route = mix(key)
                if len(hot):
                    burning = np.isin(key.view(np.int64), hot)
                    if burning.any():
                        single = np.repeat(first[burning] - np.concatenate([[0], np.cumsum(count[burning])[:-1]]), count[burning]) + np.arange(count[burning].sum())
                        first = np.concatenate([first[~burning], single])
                        owner = words.first + words.doc[first]
                        count = np.concatenate([count[~burning], np.ones(len(single), dtype=count.dtype)])
                        route = np.concatenate([route[~burning], np.zeros(len(single), np.uint64)])
                ends = first + count + window - 2
                # a hash of the piece's words: prefix sums of a polynomial over word hashes
                same = _sequence_hash(h, first, ends)
                route = np.where(route == 0, same, route)
                text, offsets = _gathered(words.data, words.starts[first], words.ends[ends]) if len(first) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
                start = first - words.bounds()[words.doc[first]] if len(first) else first
                parts.append((route, same, doc[owner], (tag[owner] << 32) | start, count, text, np.diff(offsets)))
                held += len(first)
                if held >= FLUSH_PIECES:
                    yield settled(parts)
                    parts, held = [], 0
        if held:
            yield settled(parts)

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        route, same, doc, place, count, text, size = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, same))
        lead = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        least = doc[order][np.flatnonzero(lead)][np.cumsum(lead) - 1]
        mine = np.empty(len(doc), dtype=bool)
        mine[order] = doc[order] == least
        shard = np.where(mine, route % np.uint64(shards), mix(doc.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        kept_text, kept_offsets = _gathered(text, offsets[:-1][mine], offsets[1:][mine])
        lengths = np.zeros(len(doc), dtype=np.int64)
        lengths[mine] = np.diff(kept_offsets)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(kept_text)])
        return pa.RecordBatch.from_arrays([pa.array(shard), pieces.cast(pa.binary()), pa.array(doc), pa.array(place), pa.array(count.astype(np.int64))],
                                          ["shard", "piece", "doc_id", "place", "windows"])

    return candidates.select("doc_id", "text", "tag", "keys").mapInArrow(cut, "shard long, piece binary, doc_id long, place long, windows long")


def _sequence_hash(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words first..last (inclusive) of each span, wherever it stands."""
    from corpusflow.llm.words import BASE, INVERSE, _power_table

    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _power_table("base", BASE, len(h)), out=sums[1:])
    span = (sums[last + 1] - sums[first]) * _power_table("inverse", INVERSE, len(h) + 1)[first]
    return mix(span + (last - first).astype(np.uint64))


def _searched(window: int):
    """Task of one shard: index the pieces, stream them through the index, report covered words."""

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, place, count = (table.column(k).to_numpy() for k in ("doc_id", "place", "windows"))
        piece = table.column("piece").combine_chunks().cast(pa.large_binary())
        with_text = np.diff(np.frombuffer(piece.buffers()[1], dtype=np.int64)[piece.offset: piece.offset + len(piece) + 1]) > 0
        covered = [(doc[~with_text], place[~with_text], np.zeros(int((~with_text).sum()), np.int64), count[~with_text])]
        chosen = np.flatnonzero(with_text)
        if len(chosen):
            texts = pa.Array.from_buffers(pa.large_string(), len(piece), piece.buffers(), offset=piece.offset).take(pa.array(chosen))
            symbols, owner = [], []
            for words in word_runs(texts):
                symbols.append(words.hashes())
                owner.append(words.first + words.doc)
            h, owner = np.concatenate(symbols), np.concatenate(owner)
            names, ids = np.unique(h, return_inverse=True)
            # one separator before each piece
            at = np.arange(len(h)) + owner + 1
            text = np.zeros(len(h) + len(chosen) + 1, dtype=np.int64)
            text[at] = ids + 1
            index = FMIndex(text, len(names) + 1, window + 3)
            holder = np.full(len(text), np.iinfo(np.int64).max)
            holder[at] = doc[chosen][owner]
            head = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
            wins = count[chosen]
            nth = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
            starts = np.repeat(head, wins) + nth
            matched, low, high = index.matching_statistics(text, starts, window)
            whole = matched == window
            edges, inverse = np.unique(low[whole], return_inverse=True)
            tops = np.zeros(len(edges), dtype=np.int64)
            tops[inverse] = high[whole]
            in_order = np.append(holder[index.order], np.iinfo(np.int64).max)
            least = np.minimum.reduceat(in_order, np.stack([edges, tops], 1).ravel())[::2][inverse]
            row = np.repeat(chosen, wins)[whole]
            gone = least < doc[row]
            row, nth = row[gone], nth[whole][gone]
            covered.append((doc[row], place[row], nth, np.ones(len(row), np.int64)))
        d, p, n, c = (np.concatenate(x) for x in zip(*covered))
        begin = (p & 0xFFFFFFFF) + n
        tag = (p >> 32).astype(np.int64)
        # neighbouring windows become one interval
        order = np.lexsort((begin, tag, d))
        d, tag, begin, end = d[order], tag[order], begin[order], (begin + c + window - 1)[order]
        if len(d):
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (begin[1:] > end[:-1])])
            first = np.flatnonzero(new)
            d, tag, begin, end = d[first], tag[first], begin[first], np.maximum.reduceat(end, first)
        return pa.table({"doc_id": pa.array(d, pa.int64()), "tag": pa.array(tag, pa.int64()), "begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64())})

    return search


def covered_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, begin, end): word intervals covered by windows that a smaller doc_id holds; tag is the text's hash."""
    spark = docs.sparkSession
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = materialize(_shared_keys(known, window), "shared_minimizers")
    total = shared.agg(F.sum(F.size("docs"))).first()[0] or 0
    # at most HOT_KEYS keys can pass the limit; lists of one are left out of the count, a hot key has few of them
    limit = max(1_000, total // HOT_KEYS)
    counts = shared.filter(F.size("docs") > 1).groupBy("key").agg(F.sum(F.size("docs")).alias("n")).filter(F.col("n") > limit)
    hot = np.array([r.key for r in counts.select("key").collect()], dtype=np.int64)
    shards = max(1, -(-total // SHARD_PIECES))
    per_doc = shared.select("key", F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # one text's minimizers
    candidates = known.select("doc_id", "tag", _squeezed("text").alias("text")).join(per_doc, "doc_id")
    pieces = _pieces(candidates, window, hot, shards)
    # a shard has about SHARD_PIECES pieces, whatever the input
    return pieces.groupBy("shard").applyInArrow(_searched(window), "doc_id long, tag long, begin long, end long")


def deduplicated_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` without the words that a smaller doc_id's windows cover.

    Columns: doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space). A window of
    ``window`` words is removed where the same words also start somewhere in a document with a smaller doc_id; all
    windows are judged on the input. Null and empty texts have no words. Rows with one doc_id do not remove each
    other's words; rows with a null doc_id remove and lose nothing. An empty table gives an empty result; other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.hash("text").cast("long").alias("tag"))
    spans = covered_intervals(docs, window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # within one text
    joined = docs.select("doc_id", "tag", _squeezed("text").alias("text")).join(spans, ["doc_id", "tag"], "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans_ in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                total = len(words)
                if spans_:
                    gone = np.zeros(total, dtype=bool)
                    for span in spans_:
                        gone[span["begin"]: span["end"]] = True
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
            if out:
                n, removed, digest, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(
        rest, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
