"""Hard negatives, collocations and banded near-dedup against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest
from corpusflow.llm import buckets, exact, hardneg, jaccard, mixing, phrases, setsketch
from test_llm_bruteforce import brute_components, key

VECTORS = "vec_id long, embedding array<float>, label int, score double, shard string, q int, rank int"


def brute_negatives(rows):
    clean = {}
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own = (label, [float(np.float32(x)) for x in vec])
        clean[vec_id] = min(clean.get(vec_id, own), own)
    data = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in clean.items()}
    out = []
    for a, (la, va) in data.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in data.items() if i != a)
        for p, pid in [(-s, i) for s, i, label in scored if label == la][:5]:
            fit = [(i, -s) for s, i, label in scored if label != la and 50 * p <= 100 * -s <= 95 * p][:3]
            out += [(a, pid, rank, i, p, s) for rank, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=260, width=6, scale=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, width))
    out = []
    for i in range(n):
        v = base[i % 8] + rng.normal(size=width) * (0 if i % 5 == 0 else 0.4)  # every fifth repeats, so scores tie
        out.append((int(i), [float(np.float32(x * scale)) for x in v], int(rng.integers(0, 10)), None, None, None, None))
    return out


AWKWARD = [(None, [1.0] * 6, 1), (50, None, 1), (100, [1.0] * 6, None), (150, [float("nan")] * 6, 1), (200, [float("inf")] + [0.0] * 5, 1), (1, [None] * 6, 1),
           (400, [], 3), (450, [1.0, 2.0], 3), (7, [0.5] * 6, 9), (7, [0.5] * 6, 9), (350, [0.0] * 6, 2)]


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 0.05), (3, 1e6)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, seed, scale):
    for name, value in (("LEAST_ROWS", 40), ("MOST_ROWS", 40), ("ROW_TILE", 16), ("ANCHOR_TILE", 3), ("STRIP", 2)):
        monkeypatch.setattr(hardneg, name, value)
    rows = [r for r in vectors(seed, scale=scale) if r[0] not in (50, 100, 150, 200)] + [(*r, 0.5, "x", 1, 2) for r in AWKWARD]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert hardneg.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_index_leaves_dimensions_out_and_loses_nothing():
    rng = np.random.default_rng(4)
    matrix = np.floor(rng.normal(size=(300, 12)) * np.linspace(200, 5, 12)).astype(np.int64)
    shard = hardneg.Shard(np.arange(300), np.zeros(300, int), matrix)
    anchors = matrix[:20]
    scores = anchors @ matrix.T
    for share in (0.9, 0.5, 0.1):
        limits = (scores.max(axis=1) * share).astype(np.int64)
        found = {(a, r, s) for part in shard.above(anchors, limits) for a, r, s in zip(*(x.tolist() for x in part))}
        want = {(a, r, int(scores[a, r])) for a, r in zip(*np.nonzero(scores >= limits[:, None]))}
        assert found == want
    rows, kept, indexed, left_out = shard.index(float(np.median(shard.suffix[:, 6])))
    assert (kept < 12).any() and (indexed + left_out == shard.matrix[rows]).all() and (np.linalg.norm(left_out, axis=1) < np.median(shard.suffix[:, 6])).all()


def brute_collocations(rows, least, top, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and f_ * 100 >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f_ in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def spoken():
    rng = random.Random(9)
    words = ["ab", "Ab", "c", "déf", "g h", "日本", "k.", "l,", "m\n", "n\t", "o  ", "p!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["one two three four five six"] * 9 + ["one  two\tthree"] * 4 + [None, "", " . , ", "x" * 3000, "a\x00b a\x00b a\x00b"]
    return [(t, [None, "und", "en", "a language with a long name"][i % 4]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [40, 700, 1 << 21])
@pytest.mark.parametrize("bits", [48, 5])
def test_collocations_equal_plain_counts(spark, monkeypatch, chunk, bits):
    """Small chunks spread phrases over many of them; few bits make nearly all fingerprints collide."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk)
    if bits < 48:
        if chunk != 700:
            return
        monkeypatch.setattr(phrases, "_short", lambda h: (h >> np.uint64(64 - bits)) << np.uint64(48 - bits))
    rows = spoken()
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "x", 3) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, f long, n long, phrase string, k long").repartition(4)
    got = phrases.collocations(docs, least=6, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 6, 25)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(cases.empty(spark)).collect() == []
    assert phrases.collocations(cases.documents(spark, [None, "", " "])).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([("en", 1, "a", 5 * 10 ** 12), ("en", 1, "b", 4 * 10 ** 12), ("en", 2, "a b", 3 * 10 ** 12)], "lang string, words long, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10 ** 17)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, longest, least: (counts, totals))
    row = phrases.collocations(counts).collect()[0]
    assert row.score == 1000 * 3 * 10 ** 12 * 9 * 10 ** 17 // (5 * 10 ** 12 * 4 * 10 ** 12)


def test_words_with_one_hash_are_told_apart():
    chunk = phrases.Chunk("en", b"ab cd ab ef cd")
    chunk.words = np.zeros(5, np.uint64)
    assert [list(chunk.exact_words()).index(x) for x in chunk.exact_words()] == [0, 1, 0, 3, 1]


def groups_texts():
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    chain, texts = list(base), []
    for step in range(30):
        chain[rng.randrange(200)] = f"s{step}"
        texts.append(" ".join(chain))
    group = [f"g{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(80):
        copy = list(group)
        for _ in range(k % 4):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("tile", [256, 7])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, tile):
    """Awkward documents, chains and a large group of near copies; small tiles and few partners make many rounds."""
    monkeypatch.setattr(buckets, "TILE", tile)
    if tile < 256:
        monkeypatch.setattr(buckets, "FIRST_PARTNERS", 1)
        monkeypatch.setattr(buckets, "MORE", 2)
    rows = cases.rows() + [(1000 + i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(groups_texts())]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(5)
    got = setsketch.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert sorted((tuple(r)[:3] for r in found), key=key) == brute_components(rows, 5, 85, 100)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)
    assert setsketch.near_duplicates(cases.empty(spark)).collect() == []


def test_a_document_of_two_classes_joins_them(spark):
    texts = [(2, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (9, "h i j k l m n")]
    got = setsketch.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {2}


def test_every_possible_pair_of_a_bucket_is_confirmed(spark):
    """One bucket holds many documents of which few link: tiles find all links, and no pair is confirmed twice."""
    texts = groups_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    features = spark.createDataFrame([(i, 1, b"x") for i in range(len(texts))], "id long, n long, feat binary")
    entries = spark.range(len(texts)).selectExpr("1L AS token", "id", "1L AS n", "0L AS pos")
    seen = []
    plain = buckets.confirmed

    def counted(pairs, *rest):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return plain(pairs, *rest)

    buckets.confirmed, old = counted, buckets.TILE
    buckets.TILE = 16
    try:
        from pyspark.sql import functions as F

        open_to_all = buckets.Likeness(lambda *_: F.lit(True), lambda na, pa_, fa, nb, pb, fb: np.ones(np.broadcast_shapes(np.shape(na), np.shape(nb))))
        found = buckets.linked(entries, features, docs, open_to_all, buckets.Threshold(5, 85, 100)).collect()
    finally:
        buckets.confirmed, buckets.TILE = plain, old
    assert len(seen) == len(set(seen))
    want = {r[0]: r[2] for r in brute_components(list(enumerate(texts)), 5, 85, 100)}
    got = {r.id: r.component for r in found}
    assert all(got.get(i, i) == c for i, c in want.items())


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    a, b = x[:3000], x[500:]
    sketch = lambda h: setsketch.registers(h, np.zeros(len(h), np.int64), 1)[0]
    assert (np.maximum(sketch(a), sketch(b)) == sketch(x)).all()
    assert abs(setsketch.cardinality(sketch(x)) / 4000 - 1) < 0.3
    above, below = (sketch(a) > sketch(b)).sum(), (sketch(a) < sketch(b)).sum()
    at, odds = setsketch.estimate(np.array([3000.0]), np.array([3500.0]), np.array([above]), np.array([below]), 0.85)
    assert abs(at[0] - 2500 / 4000) < 0.15 and odds[0] > setsketch.LOG_ODDS / 2


def test_merged_sketches_of_groups(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 10, i * 10 + 200)), "a" if i % 2 else "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = setsketch.merged(setsketch.sketches(docs).join(docs.selectExpr("doc_id AS id", "source"), "id"), "source").collect()
    for r in found:
        union = {tuple(t.split()[i:i + 5]) for _, t, s in rows if s == r.source for i in range(196)}
        assert abs(r.estimate / len(union) - 1) < 0.35
    assert len(found) == 2


def test_collocations_write_their_texts_once(spark, monkeypatch):
    """The bucketed table holds the texts; besides it only fingerprints and phrases are written."""
    written, plain = [], phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda frame, name: (written.append(frame.columns), plain(frame, name))[1])
    docs = spark.createDataFrame([(i, "en", "one two three") for i in range(5)], "doc_id long, lang string, text string")
    counts, totals = phrases.phrase_counts(docs, least=5)
    assert {(r.phrase, r.f) for r in counts.collect()} >= {("one", 5), ("one two three", 5)} and totals.first().n == 15
    assert written and not any("body" in columns for columns in written)


def feature(members):
    parts = np.bincount(np.asarray(members) % jaccard.PARTS, minlength=jaccard.PARTS)
    return np.frombuffer(parts.astype(np.uint8 if jaccard.PARTS == 128 else np.uint16).tobytes(), np.uint8)[None, :]


def test_the_suffix_filter_rules_out_pairs_below_the_threshold_and_no_link():
    """Most sets of 800 with a likeness of 0.8 went on to their full texts at a threshold of 0.9; sizes of parts beyond 255 rule out no link."""
    rng, score = np.random.default_rng(4), jaccard.likeness(90, 100).score
    judged = lambda x, y: score(np.array([len(x)]), None, feature(x), np.array([len(y)]), None, feature(y))[0]
    out = 0
    for _ in range(100):
        drawn = rng.choice(1 << 40, 1000, replace=False)
        out += judged(drawn[:800], drawn[89:889]) < 0
        assert judged(drawn[:800], drawn[42:842]) >= 0.9
    assert out > 70
    huge = rng.choice(1 << 40, 60_000, replace=False)
    assert judged(huge[:57_000], huge[:54_000]) >= 0.9


def test_whole_rows_are_dealt_once(spark):
    """Exact dedup and the mix dealt the texts to find copies and dealt them again for the join."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "web", 6) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for stage in (exact.kept_documents, mixing.mixed_documents):
        for k, v in wanted.items():
            spark.conf.set(k, v)
        try:
            plan = spark._jvm.PythonSQLUtils.explainString(stage(docs)._jdf.queryExecution(), "formatted")
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert sum(bool(re.search(r"\btext#", columns)) for columns in dealt) == 1


def test_null_keys_and_repeated_rows_keep_their_place(spark):
    rows = [(1, "A b", "en", None, 3), (1, "a B", "de", None, 3), (None, "c", "en", "", 1), (None, "c", "en", None, 1), (2, "c d", "en", "", 3), (2, "c d", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text.lower()) for r in exact.kept_documents(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b"), (None, "c"), (2, "c d")], key=str)
    drawn = Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).select("doc_id", "source").collect())
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken[(r.doc_id, r.source)] += r.repeats
    assert drawn == +taken


def prefixes_of(sets, num, den):
    """One set of tokens for each set of shingle hashes."""
    n = np.array([len(s) for s in sets])
    token, doc = jaccard._prefixes(np.concatenate([np.sort(s) for s in sets]), np.repeat(np.arange(len(sets)), n), n, jaccard._size_classes(num, den), num, den)
    return [set(token[doc == k].tolist()) for k in range(len(sets))]


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2)])
def test_linking_sets_share_a_token_of_their_prefixes(num, den):
    """At the threshold itself, from one class of sizes to the next, and where sets hardly fill their parts."""
    rng = np.random.default_rng(7)
    for size in [*range(1, 70), 128, 129, 500]:
        for smaller in range(-(-size * num // den), size + 1):
            pool = rng.integers(1, 1 << 63, 3 * size, dtype=np.uint64) << np.uint64(1)
            common = -(-num * (size + smaller) // (num + den))
            if common <= smaller:
                a, b = prefixes_of([pool[:size], np.r_[pool[:common], pool[2 * size: 2 * size + smaller - common]]], num, den)
                assert a & b or size == smaller == common


def test_sets_that_share_a_common_passage_meet_in_few_buckets():
    """Documents met wherever one frequent shingle was in both prefixes, so pairs grew with the square of the corpus."""
    rng = np.random.default_rng(8)
    passage = rng.integers(1, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    found = prefixes_of([np.r_[passage, rng.integers(1, 1 << 63, 240, dtype=np.uint64) << np.uint64(1)] for _ in range(200)], 90, 100)
    assert sum(bool(a & b) for k, a in enumerate(found) for b in found[:k]) < 20  # of 19 900 pairs
    assert all(len(f) <= 300 * 0.3 for f in found)


def test_small_and_large_tiles_are_judged_alike(monkeypatch):
    """A tile of a few members took a hundred steps over single numbers."""
    rng, score = np.random.default_rng(9), jaccard.likeness(90, 100).score
    base = rng.integers(0, 256, jaccard.PARTS).astype(np.uint8)
    feats = [base + rng.integers(0, 2, (k, jaccard.PARTS)).astype(np.uint8) for k in (30, 40)]
    sizes = [rng.integers(500, 700, k) for k in (30, 40)]
    judged = lambda: score(sizes[0][:, None], None, feats[0][:, None, :], sizes[1][None, :], None, feats[1][None, :, :])
    fast = judged()
    monkeypatch.setattr(jaccard, "AT_ONCE", 0)
    assert (fast == judged()).all() and 0 < (fast >= 0).mean() < 1


def test_frequent_fingerprints_travel_in_six_bytes(spark):
    """A chunk's frequent fingerprints came back in eight bytes each, which hardly compress."""
    value = np.unique(np.random.default_rng(5).integers(0, 1 << phrases.BITS, 500, dtype=np.uint64))
    rows = [r for chunk in (0, 1) for r in phrases._packed([value], chunk, 3).to_pylist()]
    back = phrases._frequent(spark.createDataFrame([(r["part"], r["chunk"], r["prints"], r["counts"]) for r in rows], "part long, chunk long, prints binary, counts binary"), 2).collect()
    assert sum(len(r.prints) for r in back) == 2 * 6 * len(value)
    assert (phrases._known(pa.table({"prints": pa.array([bytes(r.prints) for r in back if r.chunk == 1], pa.binary())})) == value).all()
