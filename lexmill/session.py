"""What a Spark session needs to run this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 1 << 22
#: What Spark gives for its own bound.
SPARKS_BATCH_BYTES = "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches that go to Python have BATCH_BYTES (or one row), unless the session sets a bound of its own.

    Spark's bounds are 10 000 rows and 64 MB; a batch is held by the executor's JVM outside its heap, by the Python worker as it comes,
    and again there as strings.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, SPARKS_BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Let Spark's file server hand this package to every executor, once for each application; bound what goes to Python at once."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_lexmill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "lexmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(str(archive))
    context._lexmill_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, run after ship()."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Only a local session without spark.checkpoint.dir (a test on one machine) gets a folder of its own; on a cluster, where other machines
    couldn't read it, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Run `df` once and cut its lineage, in the folder that all machines share."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Run `df` once and read it back from a table in the folder that all machines share.

    For loops whose rounds join a table with itself: a checkpoint keeps the size that Spark estimates for its plan, which such a join
    squares, so that after a dozen rounds the estimate is a number of millions of digits and planning doesn't end. A written table has
    the size of its files.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
