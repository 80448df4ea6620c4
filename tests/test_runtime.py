import pytest
from pyspark.sql import functions as F

from maskmill import runtime


@pytest.mark.parametrize(("most", "hot"), [(-1, 10), (1000, 10), (5, 100), (5, 10**6)])
def test_lookup_by_every_way(spark, monkeypatch, most, hot):
    """A hot key, keys without a partner and null keys give the same rows under salts, by
    broadcast, with the hot key broadcast alone, and by a plain join."""
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", most)
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    big = spark.range(900).select("id", F.when(F.col("id") < 300, 7).when(F.col("id") < 310, None).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("sk"), (F.col("id") * 10).alias("v"))
    left = runtime.lookup(big, small, "k", "sk").collect()
    assert len(left) == 900 and set(left[0].asDict()) == {"id", "k", "sk", "v"}
    assert all(r.v == (r.k * 10 if r.k is not None and r.k < 40 else None) for r in left)
    inner = runtime.lookup(big, small, "k", "sk", "inner").collect()
    assert sorted(r.id for r in inner) == sorted(r.id for r in left if r.v is not None)
    assert runtime.lookup(big, small.limit(0), "k", "sk").count() == 900


def test_checkpoint_folder_is_that_of_the_session(spark):
    folder = runtime.ensure_checkpoint_dir(spark)
    assert runtime.ensure_checkpoint_dir(spark) == folder
    assert runtime.cut(spark.range(5)).count() == 5


def test_estimates_do_not_grow_and_files_go(spark):
    """Sixty rounds of joins, each cut: the planner's estimate stays that of the files."""
    import os

    current = runtime.cut(spark.range(40).select("id", (F.col("id") % 7).alias("v")))
    for _ in range(60):
        small = current.groupBy("id").agg(F.max("v").alias("w")).withColumnRenamed("id", "k")
        before = current
        current = runtime.cut(before.join(small, F.col("id") == F.col("k")).select("id", (F.col("v") + F.col("w") - F.col("w")).alias("v")))
        path = before.cut_path.removeprefix("file:")
        assert os.path.isdir(path)
        runtime.release(before)
        assert not os.path.exists(path)
    size = int(str(current._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()
    assert size < 64 and current.count() == 40


def test_broadcasts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    few = spark.range(3).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(1)).alias("a"), F.struct("id").alias("s"))
    assert runtime.fits_broadcast(few) and runtime.fits_broadcast(few.limit(0))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 3000)
    assert not runtime.fits_broadcast(few)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 1 << 30)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 2)
    assert not runtime.fits_broadcast(few)


def test_ranks_do_not_depend_on_the_number_of_ranges(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    one = {r.id: r.rank for r in runtime.ranked(df, ["g"], ["id"]).collect()}
    many = {r.id: r.rank for r in runtime.ranked(df.repartition(5), ["g"], ["id"], rank_rows=100).collect()}
    assert one == many
    assert sorted(v for k, v in one.items() if k % 3 == 0) == list(range(1, 1001))
