"""Operators against plain Python on awkward documents."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import cases
import pytest
from corpusflow.llm import exact, fingerprints, fmindex, graph, jaccard, licenses, mixing, packing, substrings
from corpusflow.llm.words import word_runs


def by_row(frame):
    return sorted(tuple(r) for r in frame.collect())


def key(row):
    return tuple((v is None, v) for v in row)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_words_are_runs_between_ascii_white_space():
    import pyarrow as pa

    texts = cases.texts()
    for lower in (False, True):
        got = []
        for run in word_runs(pa.array(texts), lower):
            own = [[] for _ in range(run.count)]
            for d, s, e in zip(run.doc, run.starts, run.ends):
                own[d].append(run.data[s:e].tobytes())
            got += own
        assert got == [cases.words(t, lower) for t in texts]


def test_equal_words_have_equal_hashes_anywhere():
    import pyarrow as pa

    seen = defaultdict(set)
    for run in word_runs(pa.array(cases.texts())):
        for h, s, e in zip(run.hashes().tolist(), run.starts, run.ends):
            seen[run.data[s:e].tobytes()].add(h)
    assert all(len(h) == 1 for h in seen.values())
    assert len({next(iter(h)) for h in seen.values()}) == len(seen)


def test_exact_dedup_equals_grouping(spark):
    data = cases.rows()
    groups = defaultdict(list)
    for r in data:
        groups[(r[1] or "").encode().lower()].append(r[0])
    got = exact.deduplicated(cases.documents(spark)).collect()
    assert len(got) == len(data)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        mine = [r for r in got if r.text_sha256 == sha(text)]
        assert sorted((r.doc_id for r in mine), key=str) == sorted(ids, key=str)
        assert {(r.keep_id, r.group_size) for r in mine} == {(keep, len(ids))}
        assert sum(r.kept for r in mine) == 1
    kept = exact.kept_documents(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    assert Counter((t.text or "").encode().lower() for t in kept.collect()) == Counter(list(groups))


def test_index_keeps_what_an_earlier_call_added(spark):
    index = exact.DigestIndex(spark, buckets=4)
    schema = "doc_id long, text string"
    index.ingest(exact.digests(spark.createDataFrame([(1, "A b"), (2, "c")], schema)))
    index.ingest(exact.digests(spark.createDataFrame([(9, "a B"), (3, "d"), (4, "d")], schema)))
    assert sorted(r.keep_id for r in index.read().collect()) == [1, 2, 4]
    plan = index.read()._jdf.queryExecution().toString()
    assert "digest" in plan


def brute_components(data, size, num, den):
    sets = []
    for r in data:
        w = cases.words(r[1], True)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {r[0]: r[0] for r in data if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(r[0], s) for r, s in zip(data, sets)], 2):
        if x and y and a is not None and b is not None and den * len(x & y) >= num * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted([(r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(data, sets)], key=key)


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_jaccard_components_equal_all_pairs(spark, size, num, den):
    got = sorted((tuple(r) for r in jaccard.jaccard_components(cases.documents(spark), size, num, den).collect()), key=key)
    assert got == brute_components(cases.rows(), size, num, den)


def test_jaccard_chains_and_large_groups(spark):
    """Copies that drift word by word link in a chain; a large group of near copies shares its rare words."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    chain, texts = list(base), []
    for step in range(30):
        chain[rng.randrange(100)] = f"s{step}"
        texts.append(" ".join(chain))
    group = [f"g{rng.randrange(10**6)}" for _ in range(60)]
    for k in range(80):
        copy = list(group)
        for _ in range(k % 4):
            copy[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    data = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    for size, num, den in ((3, 90, 100), (5, 80, 100), (2, 70, 100)):
        got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, size, num, den).collect())
        assert got == brute_components(data, size, num, den)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {5} and 7 not in got


def brute_substrings(data, window):
    texts = [(r[0], cases.words(r[1])) for r in data]
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            if i is not None:
                s = tuple(w[k:k + window])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=key)


def test_substring_dedup_equals_window_lookup(spark):
    got = substrings.deduplicated_substrings(cases.documents(spark)).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=key) == brute_substrings(cases.rows(), 13)


def test_substring_dedup_with_hot_minimizers_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_PIECES", 50)
    monkeypatch.setattr(substrings, "FLUSH_KEYS", 40)
    monkeypatch.setattr(substrings, "FLUSH_PIECES", 30)
    monkeypatch.setattr(substrings, "HOT_KEYS", 10**9)
    real = max
    monkeypatch.setattr(substrings, "max", lambda *a: 2 if a[0] == 1_000 else real(*a), raising=False)  # every minimizer in 3 documents is hot
    data = cases.rows()
    got = substrings.deduplicated_substrings(cases.documents(spark)).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=key) == brute_substrings(data, 13)


def test_fm_index_counts_patterns():
    import numpy as np

    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), [0]])
    index = fmindex.FMIndex(text, 5, 9)
    whole = "".join(map(str, text))
    starts = np.arange(1, 290)
    matched, low, high = index.matching_statistics(text, starts, 6)
    for s, m, a, b in zip(starts, matched, low, high):
        assert m == 6 and b - a == len(re.findall(f"(?={whole[s:s + 6]})", whole))
    other = np.concatenate([rng.integers(1, 5, 50), np.zeros(6, int)])
    matched, _, _ = index.matching_statistics(other, np.arange(44), 6)
    for s, m in enumerate(matched):
        found = [k for k in range(7) if "".join(map(str, other[s + 6 - k:s + 6])) in whole]
        assert m == max(found)


def test_fingerprints_follow_the_descending_order(spark):
    data = [(i, t) for i, t in enumerate(cases.texts())]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    for ranges in (1, 3, 200):
        got = {r.doc_id: r for r in fingerprints.fingerprints(docs, ranges).collect()}
        assert len(got) == len(data)
        for i, t in data:
            t, following = t or "", data[i - 1][1] or ""
            third = len(t) // 3
            edited = t[: len(t) - third] + following[:third]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited.encode()))
            start = next((k for k, (x, y) in enumerate(zip(t, edited)) if x != y), min(len(t), len(edited)))
            assert r.common_start == start
            assert 0 <= r.near_edited <= 1 and (r.near_edited == 1) == (t == edited) and (r.near_next == 1) == (t == following)
            if third and len(t) > 300 and len(set(t)) > 5 and t != following:
                assert r.near_edited > r.near_next
        for a, b in itertools.combinations(data, 2):
            assert (got[a[0]].fingerprint == got[b[0]].fingerprint) == ((a[1] or "") == (b[1] or ""))


def test_longest_common_extension():
    a, b = (fingerprints.PrefixHashes(fingerprints.code_points(t)) for t in ("xxhello world!", "say hello world?"))
    assert fingerprints.common_extension(a, 2, b, 4) == len("hello world")
    assert fingerprints.equal_spans(a, (2, 7), b, (4, 9)) and not fingerprints.equal_spans(a, (2, 7), b, (5, 10))


def brute_licences(text):
    lowered = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def places(phrase):
        p = phrase.split()
        return [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]

    base = [k for t in licenses.TEMPLATES if t.base for p in t.phrases for k in places(p)]
    names = [[t.label for t in licenses.TEMPLATES if all(places(p) for p in t.phrases) and (t.base or not only)] for only in (True, False)]
    return (len(w), len(base), min(base, default=None), max(base, default=None), *(",".join(sorted(set(n))) for n in names))


def test_licences_equal_phrase_search(spark):
    extra = [" and ".join(p) for t in licenses.TEMPLATES for p in (t.phrases,)] + ["CC-BY cc by CC_BY, cc by by", "general public\nlicense " * 3, "public license general"]
    texts = cases.texts() + extra
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_licences(t)
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.labels)


def test_licences_stay_native(spark):
    plan = licenses.scanned(cases.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_reaches_targets(spark):
    texts = [("w " * (1 + i % 37)).strip() for i in range(900)]
    sources = ["big"] * 500 + ["mid"] * 300 + [None] * 80 + ["é"] * 20
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string").repartition(6)
    got = mixing.mixed(docs).collect()
    assert len(got) == 900
    total = sum(r.size for r in got)
    per = defaultdict(lambda: [0, 0, None])
    for r in got:
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert abs(sum(v[2] for v in per.values()) - 1.5 * total) < 1e-6 * total
    for size, taken, target in per.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 1
    again = mixing.mixed(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_fitted_counts_find_exact_sums():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 9)))
        counts = rng.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        took = mixing.fitted_counts(lengths, counts, budget)
        assert (took >= 0).all() and (took <= counts).all() and (lengths * took).sum() <= budget
        if total < 400:
            sums = {0}
            for n, c in zip(lengths.tolist(), counts.tolist()):
                sums = {s + n * k for s in sums for k in range(c + 1)}
            best = max(s for s in sums if s <= budget)
            assert budget - (lengths * took).sum() <= max(budget - best, lengths.max())


def check_bins(rows, data, capacities):
    bins = defaultdict(list)
    for r in rows:
        bins[(r.shard, r.bin_id)].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at and r.length > 0
            at += r.length
        assert {r.bin_fill for r in own} == {at}
        assert {r.bin_capacity for r in own} == {min(c for c in capacities if c >= at)}
    want = Counter()
    for i, t in data:
        n = len(cases.words(t))
        for k in range(-(-n // max(capacities))):
            want[(i, k, k * max(capacities), min(max(capacities), n - k * max(capacities)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == want


def test_packing_places_every_piece_once(spark):
    data = [(r[0], r[1]) for r in cases.rows()]
    for capacities, shard in (((16, 64, 256), 10**6), ((512, 1024, 2048, 4096), 7), ((1,), 100)):
        if capacities == (1,):
            data = data[:12]
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        rows = packing.packed(docs, capacities, shard_pieces=shard).collect()
        check_bins(rows, data, capacities)
        assert sorted(map(str, rows)) == sorted(map(str, packing.packed(docs.repartition(2), capacities, shard_pieces=shard).collect()))


def test_best_fit_uses_less_than_one_bin_a_piece():
    import numpy as np

    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 400, 2000))[::-1]
    bins, final = packing.best_fit(lengths, (128, 512, 1024))
    assert lengths.sum() / final.sum() > 0.97
