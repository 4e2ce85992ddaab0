"""Work tables in the shared folder, partition spreading and bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that `bounded_broadcast` sends to every executor.
BROADCAST_ROWS = 200_000

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one on a local master and an error on a cluster, whose executors would not share it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="weaveline-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs only its running tasks; an empty frame keeps its schema.  `clear`
    removes the tables once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that `materialize` wrote within the block: write or collect results inside it."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        clear(spark, before)


def clear(spark: SparkSession, before: int = 0) -> int:
    """Remove the tables `materialize` wrote in this driver, from the `before`th on; returns how many.  Results that are still to be read must not depend on them."""
    paths, _WRITTEN[before:] = _WRITTEN[before:], []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by `keys` where costly Python work would meet too few partitions.

    A table stored as one small file would feed one Python worker, and so would
    a shuffle whose few bytes adaptive execution puts together.  Inputs with
    enough splits pass through without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    shuffled = "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString()
    if not shuffled and df.rdd.getNumPartitions() >= cores:
        return df
    n = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))) if shuffled else cores
    return df.repartition(n, *[F.col(k) for k in keys])


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, text: str | None = None, chars: int = 32_000_000) -> tuple[DataFrame, bool]:
    """(`df` with a broadcast hint, True) if it is counted to have at most `rows` rows and `chars` characters in column `text`, else (`df`, False)."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)) if text else F.lit(0), F.lit(0))).first()
    small = n <= rows and size <= chars
    return (F.broadcast(df), True) if small else (df, False)


def hot_keys(df: DataFrame, keys: list[str], share: int = 256) -> DataFrame:
    """Keys with more than 1/share of all rows: (keys, salts), to be broadcast: their shares add up to 1, so there are under `share`.

    `salts` is the number of parts into which a key's rows have to be cut so
    that each has at most about 1/share of all rows.
    """
    total = df.agg(F.count("*").alias("total"))
    return F.broadcast(
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(total))  # one row
        .filter(F.col("n") * share > F.col("total"))
        .select(*keys, F.ceil(F.col("n") * share / F.col("total")).cast("int").alias("salts"))
    )


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join on `keys` where one key may hold a large share of `many`'s rows and `few` has few rows a key.

    Rows of hot keys are spread over salts by a hash of column `by`, and `few`'s
    rows of these keys repeated, so no task gets more than about 1/256 of `many`.
    """
    hot = hot_keys(many, keys)
    left = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for models that are costly to load."""
    name = "_weaveline_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
