"""The approximate index: what it shuffles, and that pieces and products of few rows lose nothing."""

import random
import time

import pytest

from weftline.operators import cells, similarity


def rows_of(df):
    return sorted((r["source_id"], r["target_id"], r["similarity"]) for r in df.collect())


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    time.sleep(1)  # figures of tasks come with a delay
    context = spark.sparkContext
    none, list_ = context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList
    stages = context._jsc.sc().statusStore().stageList(list_(), False, False, none, list_())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def items_of(spark, n, dim):
    rnd = random.Random(5)
    return spark.createDataFrame([(i, f"https://a.example/{i}", [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)], "id long, url string, embedding array<double>")


def test_shuffle_does_not_grow_with_cells(spark):
    items, before = items_of(spark, 1500, 64), shuffled(spark)
    got = rows_of(cells.link_suggestions_indexed(items, 3, 0.1, cells=60, probes=60))
    assert shuffled(spark) - before < 60_000  # a row for each cell that is asked would be 1500 * 60
    assert got == rows_of(similarity.link_suggestions(items, 3, 0.1))


@pytest.mark.parametrize("bounds", [{"FOUND": 40, "ASKING": 30, "PRODUCT": 3}, {"FOUND": 9, "ASKING": 500, "PRODUCT": 50}, {"LEAST": 1, "MEETINGS": 30}])
def test_regions_and_pieces_lose_nothing(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(cells, name, value)
    items = items_of(spark, 150, 4)
    items = items.union(items.limit(20).selectExpr("id + 1000", "concat(url, '/copy')", "embedding"))
    assert rows_of(cells.link_suggestions_indexed(items, 3, 0.1, cells=12, probes=12)) == rows_of(similarity.link_suggestions(items, 3, 0.1))


def test_no_targets(spark):
    items = items_of(spark, 5, 3).selectExpr("id", "'https://a.example/' AS url", "embedding")
    assert rows_of(cells.link_suggestions_indexed(items)) == []
