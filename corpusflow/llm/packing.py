"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
CAPACITIES = (512, 1024, 2048, 4096)
BIN_OVERHEAD = 16
SHARD_PIECES = 65_536


def bin_cost(capacity: int) -> float:
    """Cost of one sequence: its positions and a fixed overhead, plus attention that grows with its square."""
    return capacity + BIN_OVERHEAD + capacity * capacity / 16_384


def smallest(capacities: tuple[int, ...], need: int) -> int:
    return next(c for c in capacities if c >= need)


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every piece and final capacity of every bin, for pieces sorted by descending length.

    A piece goes to the open bin whose free room is smallest and still enough. Where none has room, a bin opens. The
    size it opens with is a policy: always the cost per position that is least, or one fixed permitted length. All
    policies are tried, every bin is downsized to the shortest permitted length that holds its contents, and the
    policy of least total cost wins.
    """
    capacities = tuple(sorted(capacities))
    best = None
    for size in capacities:
        bins, fill = _packed(lengths, capacities, size)
        final = np.array([smallest(capacities, int(f)) for f in fill], dtype=np.int64)
        cost = sum(bin_cost(int(c)) for c in final)
        if best is None or cost < best[0]:
            best = (cost, bins, final)
    return best[1], best[2]


def _packed(lengths: np.ndarray, capacities: tuple[int, ...], preferred: int) -> tuple[np.ndarray, list[int]]:
    waiting: dict[int, list[int]] = {}  # open bins by free room
    mask = 0  # one bit for each room in use
    bins = np.empty(len(lengths), dtype=np.int64)
    fill: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        above = mask >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            stack = waiting[room]
            at = heapq.heappop(stack)  # the oldest of equal rooms
            if not stack:
                mask &= ~(1 << room)
        else:
            # least-cost size that holds the piece, never below the policy's length
            options = [c for c in capacities if c >= max(length, preferred)] or [capacities[-1]]
            room = min(options, key=lambda c: bin_cost(c) / c)
            at = len(fill)
            fill.append(0)
        bins[i] = at
        fill[at] += length
        room -= length
        if room:
            heapq.heappush(waiting.setdefault(room, []), at)
            mask |= 1 << room
    return bins, fill


def pieces(docs: DataFrame, longest: int, tokens: str | None = None) -> DataFrame:
    """Documents cut to pieces of at most ``longest`` tokens: doc_id, row, piece, start, length.

    ``tokens`` names a column of token counts; without it the words of ``text`` count. Null texts have no tokens.
    """
    count = F.col(tokens).cast("long") if tokens else F.regexp_count(F.col("text"), F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", F.coalesce(count, F.lit(0)).cast("long").alias("n"),
                        F.xxhash64("doc_id", *(["text"] if "text" in docs.columns else [])).alias("row"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(longest).cast("long"))
    return (sized.filter("n > 0").select("doc_id", "row", "n", F.posexplode(starts).alias("piece", "start"))
            .select("doc_id", "row", F.col("piece").cast("long"), "start", F.least(F.lit(longest), F.col("n") - F.col("start")).alias("length")))


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, tokens: str | None = None,
           shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece of every document with the sequence it goes to.

    Columns: doc_id, piece, start, length, shard, bin_id, bin_offset, bin_capacity, bin_fill. Pieces are dealt to
    shards by hash, each about ``shard_pieces`` large at any input size; shards are packed independently. Documents
    longer than the longest capacity are cut, nothing is truncated. Empty and null texts have no piece. Rows that
    repeat are packed separately. An empty table gives an empty result. Reruns give the same bins.
    """
    cut = materialize(pieces(docs, max(capacities), tokens), "pieces")  # the texts are read once
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece", "start"), F.lit(shards)))

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, final = best_fit(group["length"].to_numpy(np.int64), capacities)
        group["bin_id"] = bins
        group["bin_capacity"] = final[bins]
        group["bin_offset"] = group.groupby("bin_id")["length"].cumsum() - group["length"]
        group["bin_fill"] = group.groupby("bin_id")["length"].transform("sum")
        return group[["doc_id", "piece", "start", "length", "shard", "bin_id", "bin_offset", "bin_capacity", "bin_fill"]]

    schema = "doc_id long, piece long, start long, length long, shard long, bin_id long, bin_offset long, bin_capacity long, bin_fill long"
    return dealt.groupBy("shard").applyInPandas(pack, schema)
