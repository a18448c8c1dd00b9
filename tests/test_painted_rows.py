"""Painting of many pictures: spread over tasks, each picture judged in one pass."""

import time

import __spark_entry__ as entry


def test_pictures_of_one_file_are_painted_in_many_tasks(spark, tmp_path):
    spark.range(40_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    df = entry.queries()["painted_boxes"](spark, str(tmp_path))
    df.limit(1).collect()  # Python workers have started
    began = time.perf_counter()
    got = {r.c_custkey: r.black for r in df.collect()}
    assert time.perf_counter() - began < 30
    assert len(got) == 40_000 and got[0] == 4 and got[41] == (1 + 41 % 9 + 2) * (41 % 15 + 41 % 6 + 2 - (41 % 15 - 2))
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
