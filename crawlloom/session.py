"""Session construction and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A folder of this machine is used only if the setting is absent and the master is local.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="crawlloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_staged: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but the files are columnar and compressed, so
    later reads prune columns; they outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, placed: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder in buckets by hash of ``key``, as many as there are
    shuffle partitions, and read it back: joins and aggregations on the key then need no
    exchange. ``placed``: its rows already lie so (it comes from such a join)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    (df if placed else df.repartition(n, key)).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved; the files outlive the name
    spark.sql(f"DROP TABLE {table}")
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that ``drop_stages`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def drop_stages() -> None:
    """Delete what ``stage`` wrote and ``scratch`` named; called at exit, or when results have been consumed."""
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(drop_stages)


def parallelism(spark: SparkSession) -> int:
    """Tasks worth making: the shuffle setting, and at least the cores there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Make the package importable by Python workers wherever they run; once a session."""
    context = spark.sparkContext
    if getattr(context, "_crawlloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="crawlloom-code-")) / "crawlloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._crawlloom_shipped = True
