"""Session helpers: reading the project tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a lookup side is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 200_000
#: Bytes above which it is, whatever its number of rows.
BROADCAST_BYTES = 64 << 20


def get_spark(app: str = "loomgraph", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loomgraph-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._loomgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data; the path may be a file or a directory of part files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where all tasks run on this machine a folder of our own takes its place; elsewhere an unset folder is an error,
    as executors would write to disks that others cannot read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if not getattr(sc, "_loomgraph_scratch", None):
        sc._loomgraph_scratch = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, sc._loomgraph_scratch, ignore_errors=True)
    return sc._loomgraph_scratch


class Scratch:
    """Tables written to the shared folder in order to cut lineage.

    A table survives the loss of any executor. `keep` writes a frame and reads it back, so its size is known to the
    planner and nothing upstream runs again; `drop` deletes what a later step has superseded.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows and, written as text, `size` bytes; else `df`: the planner then joins by shuffle."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got["n"] <= rows and got["bytes"] <= size else df
