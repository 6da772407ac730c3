"""Chunk packing against plain Python loops, and invariants on real texts."""

import re

import pytest

from corpusflow.operators import chunking
from corpusflow.sources.tables import table


def greedy(units, size, overlap):
    """Spans of a straightforward greedy packer."""
    spans, start, total = [], 0, 0
    for i, unit in enumerate(units):
        cost = len(unit) // 4
        if total + cost > size and i > start:
            spans.append((start, i))
            kept, back = 0, i
            while back > start and kept + len(units[back - 1]) // 4 <= overlap:
                back -= 1
                kept += len(units[back]) // 4
            start, total = back, kept
        total += cost
    return spans + ([(start, len(units))] if len(units) > start else [])


def sentences(text):
    parts = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", re.sub(chunking.ABBREVIATIONS, r"\1[DOT] ", text))
    return [s for s in (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", p.replace("[DOT]", ".")) for p in parts) if s]


@pytest.mark.parametrize("size,overlap", [(64, 6), (128, 0), (40, 30)])
def test_sentence_packing_equals_loop(spark, root, size, overlap):
    docs = table(spark, root, "documents").select("doc_id", "text")
    got = {}
    for row in chunking.sentence_chunks(docs, size, overlap).collect():
        got.setdefault(row.doc_id, {})[row.chunk_index] = row.chunk
    for doc_id, text in docs.collect():
        units = [text] if len(text) // 4 <= size else sentences(text)
        want = [" ".join(units[s:e]) for s, e in greedy(units, size, overlap)]
        assert [got[doc_id][i] for i in range(len(got[doc_id]))] == want


def test_paragraph_packing_splits_long_paragraphs(spark):
    short, long = "a" * 100, "One two three. " * 40
    text = "\n\n".join([short, short, long.strip(), short])
    rows = chunking.document_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 60, 10).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].chunk == short + "\n\n" + short and rows[-1].chunk == short
    assert all("\n\n" not in r.chunk for r in rows[1:-1])


@pytest.mark.parametrize("size,overlap", [(32, 4), (100, 0), (20, 19)])
def test_char_windows_cover_the_text(spark, root, size, overlap):
    docs = table(spark, root, "documents").select("doc_id", "text")
    spans = {}
    for r in chunking.char_chunks(docs, size, overlap).collect():
        spans.setdefault(r.doc_id, []).append((r.chunk_index, r.start_char, r.end_char))
    for doc_id, text in docs.collect():
        parts = sorted(spans[doc_id])
        assert parts[0][1] == 0 and parts[-1][2] == len(text)
        for (_, s, e), (_, s2, e2) in zip(parts, parts[1:]):
            assert s2 == e - overlap * 4 and s2 > s and e2 > s2
        assert all(e - s <= size * 4 for _, s, e in parts)


def test_char_windows_back_off_to_blank(spark):
    text = "x" * 30 + " " + "y" * 30
    rows = chunking.char_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10, 0).collect()
    assert [(r.start_char, r.end_char) for r in rows] == [(0, 30), (30, 61)]


def test_word_windows_keep_every_word_with_full_minimum(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    n = {r.doc_id: r.n for r in chunking.word_windows(docs, 50, 0, min_share=50).groupBy("doc_id").agg({"n_words": "sum"}).withColumnRenamed("sum(n_words)", "n").collect()}
    for doc_id, text in docs.collect():
        assert n.get(doc_id, 0) == len([w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w])


def test_char_chunks_cut_code_points_and_send_only_numbers_back(spark):
    text = "𝔘né words ß " * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    out = chunking.char_chunks(docs, 8, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython [ends(text" in plan and "Python [walk" not in plan
    rows = sorted(out.select("doc_id", "chunk_index", "start_char", "end_char", "chunk").collect())
    assert {r.doc_id for r in rows} == {1, 4}
    assert all(r.chunk == (text if r.doc_id == 1 else "short")[r.start_char: r.end_char].strip() for r in rows)
    own = [r for r in rows if r.doc_id == 1]
    assert own[0].start_char == 0 and own[-1].end_char == len(text) and all(b.start_char == a.end_char - 8 for a, b in zip(own, own[1:]))
