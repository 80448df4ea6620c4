"""Session helpers: reading tables, sizing work, and cutting lineage safely."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; one that does not is refused. Only on
    a single machine, as in tests, a temporary folder of our own is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"maskmill-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, where tasks shall not be put together by their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_FOLDERS: dict[str, str] = {}
_NUMBERS = itertools.count()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended already
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path[5:], ignore_errors=True)


def _folder(spark: SparkSession) -> str:
    """A folder for the tables of this application, deleted when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_delete_at_exit, spark, _FOLDERS[app])
    return _FOLDERS[app]


def cut(df: DataFrame, **metrics: Column) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and continue from the files.

    The files outlive any executor, so a lost executor never forces a rerun of an
    iterative plan. What is read back is a plain scan: the planner's size estimate is that
    of the files, not a product of the estimates of all rounds before, as it stays with
    ``DataFrame.checkpoint``. ``release`` deletes the files of a round that is over.

    Rows, bytes (of flat tables) and the aggregates in ``metrics`` are observed as the rows
    are written and kept for ``rows_of``, ``fits_broadcast`` and ``seen``.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{next(_NUMBERS)}"
    flat = not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema.fields)
    metrics = {"rows": F.count(F.lit(1)), **({"bytes": F.sum(_width(df))} if flat else {}), **metrics}
    watch = Observation()
    df.observe(watch, *[m.alias(n) for n, m in metrics.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["cut_path"] = path
    out.__dict__["cut_seen"] = watch.get
    return out


def seen(df: DataFrame, metric: str):
    """A metric of a frame from ``cut``."""
    return df.__dict__["cut_seen"][metric]


def rows_of(df: DataFrame) -> int:
    """The number of rows, without a job if ``df`` comes from ``cut``."""
    known = df.__dict__.get("cut_seen")
    return known["rows"] if known else df.count()


def release(*frames: DataFrame) -> None:
    """Delete the files of frames from ``cut`` that no frame still in use reads."""
    for df in frames:
        path = df.__dict__.pop("cut_path", None)
        if path:
            _delete(df.sparkSession, path)


#: A table is broadcast only if it was measured and has at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 16


def _bytes_of(field: T.StructField):
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2 + 32
    return F.lit(16)


def _width(df: DataFrame) -> Column:
    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        out = out + _bytes_of(f)
    return out


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a table is within both bounds of a broadcast; it is counted unless it comes
    from ``cut``."""
    known = small.__dict__.get("cut_seen", {})
    if "bytes" in known:
        n, size = known["rows"], known["bytes"]
    elif known.get("rows", 0) > BROADCAST_ROWS:
        return False
    else:
        n, size = small.agg(F.count("*"), F.sum(_width(small))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


#: A key that so many rows share is hot: its rows are not sent to one task.
HOT_ROWS = 100_000


def lookup(big: DataFrame, small: DataFrame, key: str, small_key: str, how: str = "left", fits: bool | None = None, skewed: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Join each row of ``big`` with its one row of ``small``, whatever the skew of ``key``.

    ``small`` is unique in ``small_key`` and shares no other column name with ``big``.
    It is broadcast only if it was measured (``fits``, or here). Beyond the bound the keys
    of ``big`` are counted: the rows of ``small`` for hot keys, which are few, are measured
    and broadcast, and only the others are joined by a shuffle, in which hot rows are
    spread. Should even the hot keys be too many, ``small`` is repeated under ``SALTS``
    salts. Where no key can be hot (``skewed=False``) it is a plain join. ``counts`` may
    give a cheaper table with the keys of ``big``, to count them there.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), F.col(key) == F.col(small_key), how)
    if not skewed:
        return big.join(small, F.col(key) == F.col(small_key), how)
    keys = (big if counts is None else counts).groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT_ROWS).select("__hot")
    hot = cut(small.join(keys, F.col(small_key) == F.col("__hot"), "left_semi"))
    if rows_of(hot) == 0:
        return big.join(small, F.col(key) == F.col(small_key), how)
    mix = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    if not fits_broadcast(hot):
        salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        mixed = big.withColumn("__mix", F.pmod(mix, F.lit(SALTS)).cast("int"))
        return mixed.join(salted, (F.col(key) == F.col(small_key)) & (F.col("__mix") == F.col("__salt")), how).drop("__salt", "__mix")
    known = big.join(F.broadcast(hot.toDF(*[f"__hot_{c}" for c in small.columns])), F.col(key) == F.col(f"__hot_{small_key}"), "left")
    known = known.withColumn("__mix", F.when(F.col(f"__hot_{small_key}").isNotNull(), 1 + F.pmod(mix, F.lit(10_000))).otherwise(0).cast("int"))
    cold = small.withColumn("__cold", F.pmod(F.xxhash64(small_key), F.lit(1)).cast("int"))  # zero, but no constant to the planner
    joined = known.join(cold, (F.col(key) == F.col(small_key)) & (F.col("__mix") == F.col("__cold")), "left")
    out = joined.select(*[F.col(f"`{c}`") for c in big.columns], *[F.coalesce(F.col(f"__hot_{c}"), F.col(f"`{c}`")).alias(c) for c in small.columns])
    return out if how == "left" else out.filter(F.col(small_key).isNotNull())


#: Rows that one task ranks at once.
RANK_ROWS = 100_000


def ranked(df: DataFrame, groups: list[str], identity: list[str], name: str = "rank", seed: int = 17, rows: int | None = None, rank_rows: int | None = None, hashed: Column | None = None) -> DataFrame:
    """Exact row number within each group in the order of the hash of ``identity`` (then of
    ``identity`` itself), without one task per group. ``hashed`` may give another hash,
    spread over all of ``bigint``.

    Rows are spread over ranges of the hash, so the order is the same whatever the number
    of ranges and the size of the table. The ranges' sizes, summed up within a group, give
    each its offset: a group that holds a third of all rows is ranked by as many tasks as
    its size asks for.
    """
    rows = rows_of(df) if rows is None else rows
    bits = max(0, (max(1, -(-rows // (rank_rows or RANK_ROWS))) - 1).bit_length())
    hashed = df.withColumn("__ranked_h", F.xxhash64(F.lit(seed), *identity) if hashed is None else hashed)
    order = ["__ranked_h", *identity]
    if bits == 0:
        return hashed.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).drop("__ranked_h")
    placed = hashed.withColumn("__ranked_bucket", F.shiftright("__ranked_h", 64 - bits))
    sizes = placed.groupBy(*groups, "__ranked_bucket").agg(F.count("*").alias("__ranked_n"))
    before = Window.partitionBy(*groups).orderBy("__ranked_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__ranked_offset", F.coalesce(F.sum("__ranked_n").over(before), F.lit(0))).drop("__ranked_n")
    inside = placed.withColumn("__ranked_r", F.row_number().over(Window.partitionBy(*groups, "__ranked_bucket").orderBy(*order)))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*groups, "__ranked_bucket"]]
    joined = inside.alias("a").join(offsets.alias("b"), on)
    return joined.select("a.*", (F.col("b.__ranked_offset") + F.col("a.__ranked_r")).alias(name)).drop("__ranked_bucket", "__ranked_r", "__ranked_h")
