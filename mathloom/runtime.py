"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a session that names none, as in
    tests on one machine, gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mathloom-"))
        _ends_with_us(spark, sc._jsc.sc().getCheckpointDir().get())
    return sc._jsc.sc().getCheckpointDir().get()


def _ends_with_us(spark: SparkSession, folder: str) -> None:
    """Have a folder removed when this application ends."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(own)  # what isn't there can't be registered
    system.deleteOnExit(own)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, for as long as this application runs."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _ends_with_us(spark, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    The files outlive the executors that wrote them, so later reads survive their loss.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once; they may run elsewhere.

    The driver serves the file itself; executors fetch it from there and need no common folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="mathloom-")) / "mathloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def _shuffles(plan) -> bool:
    """Whether a physical plan of the JVM has an exchange, by the classes of its nodes."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffles(plan.initialPlan())
    children = plan.children()
    return kind.endswith("ExchangeExec") or any(_shuffles(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than there are cores.

    Row groups can't be split, so costly Python over a small file would run in one task.  A scan
    with enough splits, a plan that already shuffles and a stream stay as they are.
    """
    if df.isStreaming or _shuffles(df._jdf.queryExecution().executedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def memoised(function: Callable, most: int = 20_000) -> Callable:
    """``function`` with a bounded memory of its results.

    Frequent values are computed once a task instead of once a row, without the shuffle and the
    join that computing over distinct values would take.
    """
    return lru_cache(maxsize=most)(function)
