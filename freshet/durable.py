"""Cutting lineage and looking values up at any key skew."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension of at most this many rows and (estimated) bytes may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# A key holding more than 1/HOT_SHARE of the rows is spread over SALTS join keys.
# By construction there are fewer than HOT_SHARE such keys.
HOT_SHARE = 200
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors must share.

    The session's `spark.checkpoint.dir` decides; only a local session without
    one gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and continue from the written table.

    A lost executor then costs a re-read and not a recomputation, which could
    come out with other range borders. Later steps read only the columns they use.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """`df`, kept by the executors (on their disks where memory is short) while many passes read it.

    Vectors are read from files row by row, which costs more than what most passes do with them.
    A lost part is computed anew, so `df` should be cheap to make from a written table.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def lookup(
    facts: DataFrame,
    stats: DataFrame,
    keys: list[str],
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_share: int = HOT_SHARE,
    salts: int = SALTS,
    size: int | None = None,
) -> DataFrame:
    """Left join of `facts` to `stats`, which holds one row per key.

    `stats` must be materialized. It is broadcast when its counted rows (or the
    `size` counted by the caller) and its estimated bytes allow. Beyond that, keys
    that hold more than the `hot_share` of the fact rows are salted, whether `stats`
    knows them or not, so that a key with a third of all rows is spread, and so are
    rows without a key. `weight`, a count in `stats` by the caller, is dropped.
    """
    plain = stats.drop(weight) if weight else stats
    rows, width = _extent(plain)
    if (rows if size is None else size) <= broadcast_rows and rows * width <= BROADCAST_BYTES:
        return facts.join(F.broadcast(plain), keys, "left")
    counted = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = _hot_keys(counted, hot_share).select(*keys, F.lit(True).alias("_hot"))
    # Rows without a key match nothing, but would all meet in one task: spread them too.
    unknown = F.lit(False)
    for name in keys:
        unknown = unknown | F.col(name).isNull()
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | unknown, spread(facts, salts)).otherwise(F.lit(0))
    )
    copies = plain.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))),
    )
    return salted.drop("_hot").join(
        copies.drop("_hot"), [*keys, "_salt"], "left"
    ).drop("_salt")


def _extent(df: DataFrame) -> tuple[int, float]:
    """Rows of a table and their mean width in bytes: 8 per number, the length of each text."""
    texts = [F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in df.dtypes if kind in ("string", "binary")]
    wide = [F.length(F.to_json(F.struct(n))) for n, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    each = F.lit(8.0 * len(df.columns))
    for width in [*texts, *wide]:
        each = each + width
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.avg(each).alias("width")).first()
    return row["rows"], row["width"] or 0.0


def _hot_keys(counted: DataFrame, hot_share: int) -> DataFrame:
    """Keys with more than 1/hot_share of all rows; fewer than hot_share by construction."""
    counted = materialize(counted)
    total = counted.agg(F.sum("_rows")).first()[0] or 0
    return counted.where(F.col("_rows") * hot_share > F.lit(total))


def spread(df: DataFrame, salts: int) -> Column:
    """A salt in [0, salts) that depends on the row's content only."""
    plain = [name for name, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
