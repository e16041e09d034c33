"""Session helpers shared by all operators: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was measured and found to have at most so many rows, and bytes as JSON text.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_folders: set[str] = set()
_written: list[str] = []


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without zone is taken as UTC whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """This process's folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where none is set a temporary one is made, but only if the master is local: executors elsewhere could not share it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftspan-"))
    base = f"{sc._jsc.sc().getCheckpointDir().get()}/weftspan"
    if base not in _folders:
        _folders.add(base)
        atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already
        pass


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table to the shared folder, in folders ``by`` a column if wanted, and go on from there.

    It cuts the lineage, survives the loss of executors, and takes less room than checkpointed rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd", partitionBy=by)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that :func:`cut` wrote within, once the results that read them have been written or counted."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _remove(spark, path)
        del _written[before:]


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, salt: int = 16) -> DataFrame:
    """Join ``big`` with a table expected to be small.

    The small side is measured first. Up to ``max_rows`` rows that take at most ``max_bytes`` as JSON text it is
    broadcast; beyond, the join is :func:`join_spread`. ``how`` is inner, left or left_semi.
    """
    some = small.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return join_spread(big, small, on, how, salt)


def join_spread(big: DataFrame, other: DataFrame, on: list[str], how: str = "left", salt: int = 16) -> DataFrame:
    """Join by shuffling both sides on ``on`` and a salt, so that one hot key of ``big`` is spread; ``other`` is repeated ``salt`` times.

    The salt is a hash of the row, so that a task run again puts each row where it was.
    """
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    hashed = [c for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(salt)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")
