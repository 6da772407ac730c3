"""Vector search against brute force, also with many copies and several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import dense
from corpusflow.operators import multivector as mv
from corpusflow.operators.tokenindex import TokenIndexes
from corpusflow.plans.registry import load_all


def brute(queries, vectors, k, exclude_self):
    out = {}
    for qid, q in queries:
        scored = []
        for vid, v in vectors:
            if exclude_self and vid == qid:
                continue
            q64, v64 = np.array(q, dtype=np.float64), np.array(v, dtype=np.float64)
            scored.append((-round(float(q64 @ v64 / np.linalg.norm(q64) / np.linalg.norm(v64)), 9), vid))
        out[qid] = [vid for _, vid in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    # A third of the table is one vector.
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, vec array<float>").repartition(3)


@pytest.mark.parametrize("block,limit", [(2048, 1 << 25), (25, 1 << 25), (2048, 0), (25, 0)])
def test_topk_is_exact(data, monkeypatch, block, limit):
    """Broadcast and salted joins, one and several query blocks."""
    rows, frame = data
    monkeypatch.setattr(dense, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(dense, "QUERY_BLOCK", block)
    got = {}
    for r in dense.cosine_topk(frame.withColumnRenamed("doc_id", "query_id"), frame, 7, exclude_self=True).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    as32 = [(i, np.array(v, dtype=np.float32)) for i, v in rows]
    assert {q: [d[i] for i in sorted(d)] for q, d in got.items()} == brute(as32, as32, 7, True)


def test_zero_vectors_have_no_neighbours(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "doc_id long, vec array<float>")
    hits = dense.cosine_topk(frame.withColumnRenamed("doc_id", "query_id"), frame, 5).collect()
    assert {r.query_id for r in hits} == {2, 3} and 1 not in {r.doc_id for r in hits}


def _recall(exact, approx):
    pairs = {(r.query_id, r.doc_id) for r in exact}
    return len(pairs & {(r.query_id, r.doc_id) for r in approx}) / len(pairs)


def test_clustered_search_recall(spark, root):
    base = spark.read.parquet(f"{root}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    queries = base.withColumnRenamed("doc_id", "query_id")
    exact = dense.cosine_topk(queries, base, 10, exclude_self=True).collect()
    centroids = dense.train_centroids(base, 8)
    assert _recall(exact, dense.ivf_topk(queries, base, centroids, 10, n_probe=8, exclude_self=True).collect()) == 1.0
    assert _recall(exact, dense.ivf_topk(queries, base, centroids, 10, n_probe=4, exclude_self=True).collect()) > 0.6


def test_clustered_search_scores_are_true_scores(spark, data):
    rows, frame = data
    queries = frame.withColumnRenamed("doc_id", "query_id")
    hits = dense.ivf_topk(queries, frame, dense.train_centroids(frame, 6), 5, n_probe=2)
    vecs = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
    for r in hits.collect():
        a, b = vecs[r.query_id], vecs[r.doc_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-8


def test_quantized_forms_stay_close(spark, root):
    base = spark.read.parquet(f"{root}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    queries = base.withColumnRenamed("doc_id", "query_id")
    exact = dense.cosine_topk(queries, base, 10, exclude_self=True).collect()
    half = mv.half_precision(base)
    assert _recall(exact, dense.cosine_topk(queries, half, 10, exclude_self=True).collect()) > 0.97


REGISTERED = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["ivf_search", "product_quantization"])
def test_registered_settings_reach_nine_tenths(spark, name):
    """Recall@10 of the queries as registered, against the exact search; their scores are true cosines."""
    catalog = load_all()
    exact, found = catalog["dense_topk"].job(spark, REGISTERED).collect(), catalog[name].job(spark, REGISTERED).collect()
    assert _recall(exact, found) >= 0.9
    true = {(r.query_id, r.doc_id): r.score for r in exact}
    assert all(abs(true[r.query_id, r.doc_id] - r.score) < 1e-8 for r in found if (r.query_id, r.doc_id) in true)


def test_token_index_lives_by_its_manifest(spark):
    rng = np.random.default_rng(11)
    rows = [(d, p, [float(x) for x in rng.normal(size=6)]) for d in range(40) for p in range(1 + d % 4)]
    frame = spark.createDataFrame(rows, "doc_id long, pos long, vec array<double>")
    indexes = TokenIndexes(spark)
    assert indexes.catalog().collect() == [] and not indexes.exists("a")
    indexes.save("a", frame.filter("doc_id < 10"), cells=4)
    indexes.save("a", frame, cells=4)  # replaces
    indexes.save("b", frame, cells=4)
    indexes.delete("b")
    indexes.delete("none")
    assert [(r.name, r.documents, r.tokens, r.dim) for r in indexes.catalog().collect()] == [("a", 40, len(rows), 6)]
    with pytest.raises(KeyError):
        TokenIndexes(spark, indexes.folder).load("b")
    # another session of the same folder finds it; with all cells and all documents the search is exact
    index = TokenIndexes(spark, indexes.folder).load("a")
    hits = index.search(frame.withColumnRenamed("doc_id", "query_id"), 5, depth=40, n_probe=4).collect()
    packed = mv.packed_documents(frame)
    exact = mv.maxsim_topk(packed.withColumnRenamed("doc_id", "query_id"), packed, 5).collect()
    rows_of = lambda found: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found)
    assert rows_of(hits) == rows_of(exact)


def test_token_index_recall_as_registered(spark):
    catalog = load_all()
    exact, found = catalog["maxsim_topk"].job(spark, REGISTERED).collect(), catalog["token_index_search"].job(spark, REGISTERED).collect()
    assert _recall(exact, found) >= 0.9


def test_a_search_reads_the_probed_cells_only(spark, root):
    base = spark.read.parquet(f"{root}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    lists = dense.InvertedLists.build(base, dense.train_centroids(base, 8), copies=2)
    files = lambda frame: {r[0] for r in frame.select("_metadata.file_path").distinct().collect()}
    every, some = files(lists.read()), files(lists.read([2, 5]))
    assert some == {f for f in every if "cell=2/" in f or "cell=5/" in f} and len(some) < len(every) / 2
    plan = lists.read([2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and lists.read().count() == 2 * base.count()
    one = base.filter("doc_id = 3").withColumnRenamed("doc_id", "query_id")
    hits = lists.search(one, 5, n_probe=1).collect()
    assert hits[0].doc_id == 3 and len({r.doc_id for r in hits}) == 5


def test_codes_are_eight_bytes_and_scores_come_from_vectors(spark, root):
    base = spark.read.parquet(f"{root}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    books = mv.train_codebooks(base, 8, 32, max_iter=2)
    codes = mv.product_codes(base, books)
    assert {r[0] for r in codes.select(F.length("code")).distinct().collect()} == {8} and codes.count() == base.count()
    odd = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0]), (3, None), (4, [1.0, 2.0, 3.0])], "doc_id long, vec array<float>")
    assert mv.product_codes(odd, mv.train_codebooks(odd, 2, 4)).count() == 3
    queries = base.withColumnRenamed("doc_id", "query_id")
    # with every vector re-scored the search is exact
    deep = mv.product_topk(queries, base, codes, books, 10, 10 ** 6, exclude_self=True).collect()
    assert _recall(dense.cosine_topk(queries, base, 10, exclude_self=True).collect(), deep) == 1.0


def test_maxsim_with_uneven_documents(spark, monkeypatch):
    monkeypatch.setattr(mv, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    docs = {d: [[float(x) for x in rng.normal(size=4)] for _ in range(1 + d % 5)] for d in range(12)}
    rows = [(d, p, v) for d, vs in docs.items() for p, v in enumerate(vs)]
    packed = mv.packed_documents(spark.createDataFrame(rows, "doc_id long, pos long, vec array<double>"))
    got = {(r.query_id, r.doc_id): r.score for r in mv.maxsim_topk(packed.withColumnRenamed("doc_id", "query_id"), packed, 12).collect()}
    for q, qv in docs.items():
        for d, dv in docs.items():
            want = np.mean((np.array(qv) @ np.array(dv).T).max(axis=1))
            assert abs(got[(q, d)] - want) < 1e-8


def test_grid_copies_do_not_follow_the_number_of_blocks(data, monkeypatch):
    """What is dealt to the cells: every vector block once a row, every query block once a column, however many blocks."""
    _, frame = data
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dense, "CELLS_A_CORE", 1)
    cores = frame.sparkSession.sparkContext.defaultParallelism
    blocks = frame.sparkSession.range(100).select(F.col("id").alias("block"), F.array("id").alias("qids"))
    vectors = frame.sparkSession.range(40).select(F.lit(0).cast("long").alias("block"), F.array("id").alias("vids"))
    met = dense.join_blocks(blocks, vectors, 100, 1, "vids", lambda: 2 * dense.CELL_BYTES)
    got = [(r.qids[0], r.vids[0]) for r in met.collect()]
    assert len(got) == len(set(got)) == 4000
    assert met.select("_column").distinct().count() == 2 and met.select("_row").distinct().count() == -(-cores // 2)


def test_best_of_tiles_equals_sorting_all(monkeypatch):
    """Ties go to smaller ids, whatever the order and the cut of the tiles; a query is left out of its own list."""
    rng = np.random.default_rng(3)
    sims, ids, qids = rng.integers(0, 6, (9, 200)) / 3, rng.permutation(200), np.arange(9)
    best = dense.Best(qids, 7, threshold=0.4, exclude_self=True)
    for low in range(0, 200, 5):
        best.add(sims[:, low: low + 5], ids[low: low + 5])
    got = {}
    for q, d, s in zip(*(c.to_pylist() for c in best.batch().columns)):
        got.setdefault(q, []).append((-s, d))
    assert got == {q: sorted((-round(s, 9), d) for s, d in zip(sims[q].tolist(), ids.tolist()) if d != q and s >= 0.4)[:7] for q in range(9)}


def test_maxsim_holds_few_products_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    q, d, ql, dl = rng.normal(size=(6, 4)), rng.normal(size=(30, 4)), np.array([1, 2, 3]), np.array([3, 1, 4, 1, 5, 9, 2, 5])
    whole = mv.maxsim(q.ravel(), ql, d.ravel(), dl)
    monkeypatch.setattr(mv, "TILE_CELLS", 40)
    assert np.allclose(mv.maxsim(q.ravel(), ql, d.ravel(), dl), whole, atol=1e-12)
    one = (q[3:] @ d[3:4].T).mean()
    assert abs(whole[2, 1] - one) < 1e-12


def test_listed_copies_are_dropped_where_hits_are_ranked(data):
    """All cells probed: the exact result, and no hit is shuffled by its document."""
    rows, frame = data
    queries = frame.withColumnRenamed("doc_id", "query_id")
    lists = dense.InvertedLists.build(frame, dense.train_centroids(frame, 4), copies=3)
    found = lists.search(queries, 7, n_probe=4, exclude_self=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not any("hashpartitioning(query_id" in x and "doc_id" in x for x in plan.splitlines())
    key = lambda hits: sorted((r.query_id, r["rank"], r.doc_id) for r in hits.collect())
    assert key(found) == key(dense.cosine_topk(queries, frame, 7, exclude_self=True))


def test_the_grid_is_square_and_vectors_stay_four_bytes_wide(data, monkeypatch):
    """Small tables too: about as many columns as rows, so neither side is copied to every cell; floats are not widened before the shuffle."""
    _, frame = data
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dense, "CELLS_A_CORE", 4)
    blocks = frame.sparkSession.range(100).select(F.col("id").alias("block"), F.array("id").alias("qids"))
    vectors = frame.sparkSession.range(400).select(F.lit(0).cast("long").alias("block"), F.array("id").alias("vids"))
    met = dense.join_blocks(blocks, vectors, 100, 1, "vids", lambda: 1)
    side = int(np.ceil(np.sqrt(4 * frame.sparkSession.sparkContext.defaultParallelism)))
    assert met.select("_column").distinct().count() == side and met.select("_row").distinct().count() <= side
    assert dense.pack(frame.select(F.lit(0).cast("long").alias("block"), "doc_id", "vec"), "v", True, True).schema["vvecs"].dataType.simpleString() == "array<float>"


def test_decoded_codes_have_the_products_of_the_tables():
    rng = np.random.default_rng(2)
    books, codes, q = rng.normal(size=(4, 16, 3)), rng.integers(0, 16, (50, 4)).astype(np.uint8), rng.normal(size=(5, 12))
    tables = np.einsum("qsw,scw->qsc", q.reshape(5, 4, 3), books)
    assert np.allclose(q @ mv._decoded(codes, books).T, sum(tables[:, s, :][:, codes[:, s]] for s in range(4)))


def test_listed_pairs_meet_without_copies_of_vectors(spark, monkeypatch):
    """Each vector is dealt once a row or column of the grid, not once a pair; pairs of unknown ids and zero vectors have no score."""
    monkeypatch.setattr(dense, "CELLS_A_CORE", 1)
    monkeypatch.setattr(dense, "PAIRS_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    vecs = {i: [float(x) for x in rng.normal(size=4)] for i in range(40)} | {40: [0.0] * 4}
    frame = spark.createDataFrame(list(vecs.items()), "doc_id long, flat array<double>")
    pairs = [(q, d) for q in range(41) for d in range(0, 41, 3)] + [(5, 999), (999, 5)]
    found = dense.score_pairs(spark.createDataFrame(pairs, "query_id long, doc_id long"), frame.withColumnRenamed("doc_id", "query_id"), frame, 328, mv._cosines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    want = {(q, d): round(float(np.dot(vecs[q], vecs[d]) / np.linalg.norm(vecs[q]) / np.linalg.norm(vecs[d])), 9) for q, d in pairs if q < 40 and d < 40}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)


def test_finds_of_a_token_are_dealt_by_query_once(spark):
    """Neither sums nor ranks move the finds a second time, and no join by token brings the query back."""
    rng = np.random.default_rng(12)
    frame = spark.createDataFrame([(d, p, [float(x) for x in rng.normal(size=6)]) for d in range(20) for p in range(3)], "doc_id long, pos long, vec array<double>")
    indexes = TokenIndexes(spark)
    indexes.save("a", frame, cells=4)
    found = indexes.load("a").candidates(frame.withColumnRenamed("doc_id", "query_id"), 20, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert any("hashpartitioning(query_id" in x for x in dealt) and not any("token" in x.split("hashpartitioning(")[1].split(")")[0] or "doc_id" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt)
    assert found.count() == 400


def test_hits_of_many_queries_do_not_grow_with_the_partitions(spark, monkeypatch):
    """Broadcast queries had k hits from every partition of vectors, however many there were."""
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    seen, plain = [], dense.best_hits
    monkeypatch.setattr(dense, "best_hits", lambda hits, k: (seen.append(hits.count()), plain(hits, k))[1])
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(200, 4))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "doc_id long, vec array<double>").repartition(50)
    found = dense.cosine_topk(rows.withColumnRenamed("doc_id", "query_id"), rows, 2).collect()
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    order = np.argsort(-(unit @ unit.T), axis=1)[:, :2]
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == [(q, n + 1, int(order[q, n])) for q in range(200) for n in range(2)]
    columns = np.ceil(np.sqrt(dense.CELLS_A_CORE * spark.sparkContext.defaultParallelism))
    assert seen[0] <= 200 * 2 * columns
