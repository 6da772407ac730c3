"""BM25 search of very many queries in one cell: queries are held as numbers, ranges of documents stream past them.

Scores of a block of queries and a range are estimated in single precision, as a matrix product for the words that many
documents have and pair by pair for the others. Only documents that can reach a query's k-th score so far, given the largest
error that the estimate may have, are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusflow.operators.ranking import DIGITS

K1, B = 1.5, 0.75
#: Queries that are multiplied at once; the share of a range's documents from which a word is a row of the matrix; words looked up at once.
QUERIES_AT_ONCE, COMMON, WORDS_AT_ONCE = 1024, 16, 1_500_000
#: Bytes of postings that are packed together.
LOAD_BYTES = 48 << 20
#: New hits that wait before they are sorted into the lists, at least.
WAITING = 200_000
#: Relative error of a sum in single precision, for each of its numbers (with room to spare).
ERROR = 2.0 ** -22


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), first[1], ..."""
    return np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)


def _slices(sizes: np.ndarray, most: int):
    """(low, high) of neighbours whose sizes add up to at most ``most``, or of one."""
    if not len(sizes):
        return
    part, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(part, (part[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


class Lists:
    """The k best documents of every query so far. Ids that are whole numbers break ties; of others all ties are kept."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor, self.full = k, np.zeros(n_queries), np.zeros(n_queries, bool)
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.waiting: list[tuple] = []
        self.ids: list[pa.Array] = []
        self.base = 0

    def more(self, ids: pa.Array) -> int:
        """Take in the ids of a range; the place of its first document."""
        self.ids.append(ids)
        self.base += len(ids)
        return self.base - len(ids)

    def add(self, query, score, place) -> None:
        self.waiting.append((query, score, place))
        if sum(len(x[0]) for x in self.waiting) > max(WAITING, len(self.held[0]) // 4):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        query, score, place = (np.concatenate([x[i] for x in (self.held, *self.waiting)]) for i in range(3))
        self.waiting = []
        ids = pa.chunked_array(self.ids).combine_chunks()
        whole = pa.types.is_integer(ids.type)
        own = pc.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[place] if whole else place
        order = np.lexsort((own, -score, query))
        query, score, place = query[order], score[order], place[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        size = np.diff(first, append=len(query))
        last = first[size >= self.k] + self.k - 1
        self.floor[query[last]], self.full[query[last]] = score[last], True
        rank = np.arange(len(query)) - np.repeat(first, size)
        keep = (rank < self.k) | (False if whole else score >= self.floor[query])
        self.held = (query[keep], score[keep], place[keep])

    def batches(self, query_ids: pa.Array):
        self.settle()
        query, score, place = self.held
        if not len(query):
            return
        ids = pa.chunked_array(self.ids).combine_chunks()
        for low in range(0, len(query), 100_000):
            some = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query[some])), ids.take(pa.array(place[some])), pa.array(score[some])], ["query_id", "doc_id", "score"])


class Cell:
    """Queries (blocks of ids and their words), then ranges one after the other, then the hits."""

    def __init__(self, k: int, average: float):
        self.k, self.average, self.ready = k, average, False
        self.numbers: dict[str, int] = {}
        self.blocks: list[tuple] = []

    def queries(self, asked: pa.Array) -> None:
        """A block of structs (query_id, words: list of (term, weight))."""
        lists = asked.field("words")
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = flat.field("term").dictionary_encode()
        number = np.array([self.numbers.setdefault(t, len(self.numbers)) for t in coded.dictionary.to_pylist()], np.int32)
        self.blocks.append((pa.concat_arrays([asked.field("query_id")]), sizes, number[coded.indices.to_numpy()], flat.field("weight").to_numpy().copy()))

    def _start(self) -> None:
        self.ids = pa.concat_arrays([b[0] for b in self.blocks])
        self.sizes, code, weight = (np.concatenate([b[i] for b in self.blocks]) for i in (1, 2, 3))
        self.code, self.weight, self.edges = code, weight, np.r_[0, np.cumsum(self.sizes)]
        self.words, self.blocks = pa.array(list(self.numbers), pa.string()), []
        self.numbers, self.lists, self.ready = {}, Lists(len(self.sizes), self.k), True

    def range(self, ids: pa.Array, lens: np.ndarray, barred, allowed, terms: pa.Array, docs: pa.Array, tfs: pa.Array) -> None:
        """Documents of a range and the postings of its words, documents ascending."""
        if not self.ready:
            self._start()
        number = pc.index_in(terms, value_set=self.words)
        known = pc.is_valid(number)
        number, docs, tfs = number.filter(known).to_numpy(), docs.filter(known), tfs.filter(known)
        many = pc.list_value_length(docs).to_numpy(zero_copy_only=False)
        doc, tf = docs.flatten().to_numpy(), tfs.flatten().to_numpy()
        for marked, wanted in ((barred, False), (allowed, True)):
            if marked is not None:
                listed = np.zeros(len(ids), bool)
                listed[marked] = True
                take = listed[doc] == wanted
                many = np.bincount(np.repeat(np.arange(len(many)), many)[take], minlength=len(many))
                doc, tf = doc[take], tf[take]
        some = many > 0
        number, many = number[some], many[some]
        if not len(number):
            return
        base, n = self.lists.more(ids), len(ids)
        gain = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * (lens[doc] / self.average)))
        first = np.cumsum(many) - many
        own = np.repeat(np.arange(len(many)), many)
        row_of = np.full(len(self.words), -1, np.int32)
        row_of[number] = np.arange(len(number))
        # a row of the matrix for every common word
        common = np.flatnonzero(many > n // COMMON)
        line = np.full(len(many), -1)
        line[common] = np.arange(len(common))
        inside = line[own] >= 0
        matrix = np.zeros((len(common), n), np.float32)
        matrix[line[own[inside]], doc[inside]] = gain[inside]
        for low in range(0, len(self.sizes), QUERIES_AT_ONCE):
            self._some(low, min(low + QUERIES_AT_ONCE, len(self.sizes)), row_of, line, matrix, many, first, doc, gain, own * n + doc, base, n)

    def _some(self, low: int, high: int, row_of, line, matrix, many, first, doc, gain, post, base: int, n: int) -> None:
        a, b = self.edges[low], self.edges[high]
        row = row_of[self.code[a:b]]
        at = np.flatnonzero(row >= 0)
        if not len(at):
            return
        row, weight, query = row[at], self.weight[a:b][at], np.repeat(np.arange(high - low), self.sizes[low:high])[at]
        count = np.bincount(query, minlength=high - low)
        edges = np.r_[0, np.cumsum(count)]
        error = (count + 4) * ERROR * (K1 + 1.0) * np.bincount(query, weight, minlength=high - low) + 10.0 ** -DIGITS
        dense = line[row] >= 0
        asked = np.zeros((high - low, len(matrix)), np.float32)
        asked[query[dense], line[row[dense]]] = weight[dense]  # a word is once in a query
        scores = asked @ matrix
        rare = np.flatnonzero(~dense)
        size = many[row[rare]]
        places = _runs(first[row[rare]], size)
        np.add(scores, np.bincount(np.repeat(query[rare] * n, size) + doc[places], np.repeat(weight[rare], size) * gain[places], scores.size).reshape(scores.shape), out=scores, casting="unsafe")
        floor, k = self.lists.floor[low:high].copy(), self.k
        new = np.flatnonzero(~self.lists.full[low:high])
        if len(new) and n > k:
            floor[new] = np.maximum(floor[new], np.partition(scores[new], n - k, axis=1)[:, n - k] - error[new])
        of, at = np.nonzero((scores >= (floor - error)[:, None]) & (scores > 0))
        score = np.empty(len(of))
        for u, v in _slices(count[of], WORDS_AT_ONCE):
            number = count[of[u:v]]
            word = _runs(edges[of[u:v]], number)
            sought = row[word].astype(np.int64) * n + np.repeat(at[u:v], number)
            place = np.minimum(np.searchsorted(post, sought), len(post) - 1)
            score[u:v] = np.bincount(np.repeat(np.arange(v - u), number), np.where(post[place] == sought, weight[word] * gain[place], 0.0), minlength=v - u)
        score = np.round(score, DIGITS)
        keep = (score > 0) & (score >= self.lists.floor[low:high][of])
        of, at, score = of[keep], at[keep], score[keep]
        if len(of) > k:  # a range hands over a query's k best and their ties
            order = np.lexsort((-score, of))
            of, at, score = of[order], at[order], score[order]
            start = np.flatnonzero(np.diff(of, prepend=-1))
            long = np.diff(start, append=len(of))
            keep = score >= np.repeat(score[start + np.minimum(k, long) - 1], long)
            of, at, score = of[keep], at[keep], score[keep]
        self.lists.add(of + low, score, base + at)

    def hits(self):
        if not self.ready:
            return
        yield from self.lists.batches(self.ids)


def packed(batches):
    """Postings (range, term, docs, tfs) as one row (range, load) for all words of a range that a task has at hand: numbers as small
    as they can be, compressed. They are dealt to cells that way."""
    def flush(held):
        table = pa.Table.from_batches(held).combine_chunks()
        ranges = table.column("range").to_numpy()
        order = np.argsort(ranges, kind="stable")
        edges = np.r_[np.flatnonzero(np.diff(ranges[order], prepend=-1)), len(order)]
        for low, high in zip(edges[:-1], edges[1:]):
            own = table.select(["term", "docs", "tfs"]).take(pa.array(order[low:high])).combine_chunks()
            small = []
            for name in ("docs", "tfs"):
                lists = own.column(name).combine_chunks()
                most = pc.max(lists.flatten()).as_py() or 0
                small.append(lists.cast(pa.list_(pa.uint8() if most < 1 << 8 else pa.uint16() if most < 1 << 16 else pa.int32())))
            batch = pa.RecordBatch.from_arrays([own.column("term").combine_chunks(), *small], ["term", "docs", "tfs"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([ranges[order[low]]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["range", "load"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > LOAD_BYTES:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def searcher(k: int, average: float):
    """Batches sorted by cell, range (none: queries) and load (none: the documents of the range) to batches of hits."""

    def groups(batches):
        held, last = [], None
        for batch in batches:
            cell = batch.column("_cell").to_numpy()
            ranges = pc.fill_null(batch.column("range"), -1).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(np.diff(cell) | np.diff(ranges)) + 1, batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                key = (int(cell[low]), batch.column("range")[int(low)].as_py())
                if held and key != last:
                    yield last, held
                    held = []
                held, last = [*held, batch.slice(low, high - low)], key
        if held:
            yield last, held

    def search(batches):
        now, cell = None, None
        for (number, ordinal), parts in groups(b for b in batches if b.num_rows):
            if number != now:
                if cell is not None:
                    yield from cell.hits()
                now, cell = number, Cell(k, average)
            if ordinal is None:
                for part in parts:
                    for i in range(part.num_rows):
                        cell.queries(part.column("asked")[i].values)
                continue
            head, loads = parts[0].slice(0, 1), [x for part in parts for x in part.column("load").to_pylist() if x is not None]
            if not head.column("ids")[0].is_valid or not loads or not (cell.blocks or cell.ready):
                continue
            posts = [pa.ipc.open_stream(x).read_all().combine_chunks() for x in loads]
            column = lambda name, kind: pa.concat_arrays([x.column(name).combine_chunks().cast(kind) for x in posts])
            ids, lens, barred, allowed = (head.column(c)[0].values for c in ("ids", "lens", "barred", "allowed"))
            listed = [None if x is None else x.to_numpy() for x in (barred, allowed)]
            ints = pa.list_(pa.int32())
            cell.range(pa.concat_arrays([ids]), lens.to_numpy(), *listed, column("term", pa.string()), column("docs", ints), column("tfs", ints))
        if cell is not None:
            yield from cell.hits()

    return search
