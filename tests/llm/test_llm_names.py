"""Stage functions keep columns whose names are those of their own helpers, and choose among tied rows by rule."""

import cases
import pytest
from corpusflow.llm import exact, jaccard, mixing, toxicity

HELPERS = ["keep_id", "keep_sha", "SHA", "place", "key", "of_source", "tie", "times", "text_hash", "copy", "toxic_score", "dropped",
           "__keep_id", "__sha", "__copy", "__repeats", "_dropped", "component_id", "id", "n", "rep", "digest", "bin", "sha_"]
STAGES = {"toxicity": lambda d, l: toxicity.without_toxic(d, l), "exact": lambda d, l: exact.kept_documents(d),
          "jaccard": lambda d, l: jaccard.one_per_component(d), "mixing": lambda d, l: mixing.mixed_documents(d)}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_helper_names_come_through(spark, name):
    data = [(i, t, "en", "s", 1, *[f"{h}{i}" for h in HELPERS]) for i, t in enumerate(["alpha beta gamma"] * 3 + [f"word{i} other{i}" for i in range(6)])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{h}` string" for h in HELPERS)
    docs = spark.createDataFrame(data, schema).repartition(3)
    labels = cases.labels(spark).selectExpr("doc_id", "quality", "0 AS toxic")
    got = STAGES[name](docs, labels)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert rows and set(rows) <= set(data)
    again = STAGES[name](spark.createDataFrame(data[::-1], schema).repartition(2), labels).collect()
    assert sorted(map(tuple, again)) == sorted(rows)
    assert STAGES[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["exact", "mixing"])
def test_rows_that_agree_in_id_and_text_are_chosen_by_rule(spark, name):
    rows = [(1, "one two", "en", "s", n) for n in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    picked = {tuple(r) for order in (rows, rows[::-1]) for parts in (1, 5) for r in STAGES[name](spark.createDataFrame(order, schema).repartition(parts), None).collect()}
    assert len(picked) == 1
