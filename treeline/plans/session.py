"""Session helpers: shared scratch folder, materialised intermediate tables, spreading of CPU-heavy scans."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_KNOWN: set[str] = set()


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("treeline")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that queries run from any working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_treeline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="treeline-")) / "treeline_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    atexit.register(shutil.rmtree, to.parent, True)
    sc._treeline_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir``. Only a session on one machine (tests) may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "treeline-scratch")
    return f"{base.rstrip('/')}/treeline/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once into the scratch folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    base = scratch_dir(spark)
    if base not in _KNOWN:
        _KNOWN.add(base)
        atexit.register(_remove, spark, base)
    path = f"{base}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeline_path = path
    return out


def exists(df: DataFrame) -> bool:
    """Whether a materialised table is still there."""
    spark = df.sparkSession
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(df._treeline_path + "/_SUCCESS")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    except Exception:  # its session has ended
        return False


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: nothing can be deleted any more
        pass


def release(*frames: DataFrame | None) -> None:
    """Delete superseded intermediate tables; frames that were not materialised are ignored."""
    for df in frames:
        path = getattr(df, "_treeline_path", None)
        if path is None:
            continue
        _remove(df.sparkSession, path)


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Give a CPU-heavy stage enough tasks: hash-repartition by ``keys`` only where the scan has too few splits."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys])


def settled(df: DataFrame, *keys: str) -> DataFrame:
    """``spread`` for a table that is read several times: where it has to be moved, it is moved once and written."""
    wide = spread(df, *keys, per_core=1)
    return df if wide is df else materialize(wide, "settled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
