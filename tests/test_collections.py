"""Stored collections: merges, removals and drops rewrite only the cuts they touch, and versions appear at once."""

import pytest
from pyspark.sql import functions as F

from corpusflow.session import fresh_path
from corpusflow.sources import collections as store


@pytest.fixture
def stored(spark):
    rows = [(f"{d}-{c}", d, [None, "de", "en/x=1"][d % 3], f"chunk {c} of {d}", 1, 10) for d in range(300) for c in range(3)]
    frame = spark.createDataFrame(rows, "id string, doc_id long, collection string, chunk string, version int, updated_at int")
    out = store.StoredCollections(spark, fresh_path(spark, "collection"), buckets=16)
    out.create(frame)
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("id", "doc_id", "collection", "chunk", "version", "updated_at").collect()), key=str)


def test_a_merge_of_few_keys_rewrites_few_cuts(spark, stored):
    first, whole = stored.cuts(), rows_of(stored.read())
    assert len(first) == 48 and len(whole) == 900
    again = spark.createDataFrame([("7-0", 7, "de", "changed", 2, 20), ("7-1", 7, "de", "chunk 1 of 7", 2, 20), ("999-0", 999, None, "new", 2, 20)],
                                  "id string, doc_id long, collection string, chunk string, version int, updated_at int")
    stored.merge(again, ["id"], "version", "chunk", "updated_at")
    second = stored.cuts()
    assert sum(first[c] != second[c] for c in first) == 2  # of 48; the other cuts keep their files
    want = [r for r in whole if r[0] not in ("7-0", "7-1")] + [("7-0", 7, "de", "changed", 2, 20), ("7-1", 7, "de", "chunk 1 of 7", 2, 10), ("999-0", 999, None, "new", 2, 20)]
    assert rows_of(stored.read()) == sorted(want, key=str)
    stored.merge(again, ["id"], "version", "chunk", "updated_at")
    assert rows_of(stored.read()) == sorted(want, key=str)
    assert rows_of(stored.read(version=1)) == whole  # earlier versions can still be read
    plan = stored.read([("de", 3)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan


def test_readers_never_see_half_a_version(spark, stored, monkeypatch):
    whole, again = rows_of(stored.read()), stored.read().limit(5).withColumn("version", F.lit(9))

    def lost(self, cuts, schema):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.StoredCollections, "_commit", lost)
    with pytest.raises(RuntimeError):
        stored.merge(again, ["id"], "version")
    assert stored.versions() == [1] and rows_of(stored.read()) == whole


def test_documents_and_collections_are_removed(spark, stored):
    first, whole = stored.cuts(), rows_of(stored.read())
    stored.remove_documents(spark.createDataFrame([(4,), (5,), (12345,), (None,)], "doc_id long"))
    second = stored.cuts()
    assert sum(first[c] != second.get(c) for c in first) == 2
    left = [r for r in whole if r[1] not in (4, 5)]
    assert rows_of(stored.read()) == left
    stored.drop_collection("de")
    assert {c for c, f in stored.cuts().items()} == {c for c in second if c[0] != "de"} and all(stored.cuts()[c] == second[c] for c in stored.cuts())
    assert rows_of(stored.read()) == [r for r in left if r[2] != "de"]
    stored.drop_collection("en/x=1")
    stored.remove_documents(stored.read().select("doc_id"))
    assert stored.read().columns == ["id", "doc_id", "collection", "chunk", "version", "updated_at"] and stored.read().collect() == []


def test_a_repeated_merge_rewrites_no_cut(spark, stored):
    """Contents, null contents and touch columns as they are: only the manifest is new. One changed row rewrites its cut alone."""
    kind = "id string, doc_id long, collection string, chunk string, version int, updated_at int"
    again = stored.read().withColumns({"version": F.lit(2), "updated_at": F.lit(20), "chunk": F.when(F.col("doc_id") % 5 > 0, F.col("chunk"))})
    for _ in range(2):
        before, rows = stored.cuts(), rows_of(stored.read())
        stored.merge(again, ["id"], "version", "chunk", "updated_at")
    assert stored.cuts() == before and rows_of(stored.read()) == rows and stored.versions() == [1, 2, 3]
    one = spark.createDataFrame([("8-1", 8, "en/x=1", "other", 3, 30)], kind)
    stored.merge(again.unionByName(one), ["id"], "version", "chunk", "updated_at")
    after = stored.cuts()
    assert sum(before[c] != after[c] for c in before) == 1 and ("8-1", 8, "en/x=1", "other", 3, 30) in rows_of(stored.read()) and len(rows_of(stored.read())) == 900


def test_keys_in_two_cuts_are_merged_together(spark, stored):
    """An older row of a key in another cut does not bring the key back there."""
    kind = "id string, doc_id long, collection string, chunk string, version int, updated_at int"
    late = spark.createDataFrame([("7-0", 9, None, "moved", 0, 5), ("9-0", 9, None, "changed", 2, 20), ("7-1", 7, "de", "chunk 1 of 7", 1, 10)], kind)
    stored.merge(late, ["id"], "version", "chunk", "updated_at")
    got = {r[0]: r[1:] for r in rows_of(stored.read())}
    assert stored.read().count() == len(got) == 900 and got["7-0"][0] == 7 and got["9-0"] == (9, None, "changed", 2, 20)
