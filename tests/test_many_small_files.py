"""Readers of packages and orders of slides hand on many small groups at once, and packages are made by more than one task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from folioquarry.operators import decks
from folioquarry.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def mapped(spark, monkeypatch, name):
    """What a query hands to Python last: the rows, and the function that maps their batches."""
    seen, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema, *a: seen.append((self, run)) or real(self, run, schema, *a))
    QUERIES[name](spark, SF)
    return seen[-1]


READERS = {"cartridge_outlines": 3, "collection_outlines": 3, "epub_metadata": 2, "epub_outlines": 2, "word_tables": 2, "deck_shapes": 3, "epub_items": 3}


@pytest.mark.parametrize("name", READERS)
def test_many_files_make_one_batch(spark, monkeypatch, name):
    rows, run = mapped(spark, monkeypatch, name)
    assert rows.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    got = list(run(iter(rows.toArrow().to_batches())))
    assert len(got) == 1 and got[0].num_rows == READERS[name] * rows.count()


def test_slides_that_batches_cut(spark, monkeypatch):
    boxes = [("d", s, 10 * s + i, i, 3 * i % 7, 5 * i % 11, 4, 4, i == 3) for s in range(40) for i in range(1 + s % 5)]
    shapes = spark.createDataFrame(boxes, "deck string, slide int, shape_id int, seq int, x int, y int, w int, h int, is_title boolean")
    seen = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: seen.append((self, run)) or self)
    decks.drafted_order(shapes)
    rows, run = seen[-1]
    held = rows.coalesce(1).sortWithinPartitions("deck", "slide", "seq").toArrow()
    whole = list(run(iter(held.to_batches())))
    cut = list(run(iter(held.to_batches(max_chunksize=3))))
    assert len(whole) <= 2  # all slides but the last, then the last
    assert pa.Table.from_batches(cut).to_pylist() == pa.Table.from_batches(whole).to_pylist()
    assert len(boxes) == sum(b.num_rows for b in whole)


def test_overlapping_shapes_stay_as_drawn(spark):
    # The second shape lies on the first and is further up; the third lies apart at the top, the fourth is the title.
    shapes = spark.createDataFrame([("d", 1, 1, 1, 0, 10, 9, 9, False), ("d", 1, 2, 2, 0, 5, 9, 9, False), ("d", 1, 3, 3, 50, 0, 3, 3, None), ("d", 1, 4, 4, 50, 50, 3, 3, True), (None, 1, 5, 1, 0, 0, 1, 1, False)], "deck string, slide int, shape_id int, seq int, x int, y int, w int, h int, is_title boolean")
    assert {r.shape_id: r["rank"] for r in decks.drafted_order(shapes).collect()} == {4: 1, 3: 2, 1: 3, 2: 4, 5: 1}
