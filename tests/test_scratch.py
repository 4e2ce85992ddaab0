import os

import pytest

from weaveline import scratch


def test_work_tables_are_removed(spark):
    with scratch.work_tables(spark):
        df = scratch.materialize(spark.range(5), "five")
        folder = scratch.shared_dir(spark).removeprefix("file://")
        assert df.count() == 5 and any(p.startswith("five-") for p in os.listdir(folder))
    assert not any(p.startswith("five-") for p in os.listdir(folder))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)


def test_salted_join_equals_a_plain_one(spark):
    many = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) AS g")
    few = spark.range(60).selectExpr("id AS g", "id * 10 AS x")
    got = sorted(map(tuple, scratch.salted_join(many, few, ["g"], "id").select("id", "g", "x").collect()))
    assert got == sorted(map(tuple, many.join(few, "g").select("id", "g", "x").collect()))
    left = scratch.salted_join(many, few.filter("g < 5"), ["g"], "id", "left")
    assert left.count() == 3000 and left.filter("x is null").count() == many.filter("g >= 5").count()
