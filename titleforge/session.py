"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "titleforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, ANSI, AQE.

    On a cluster pass no master; the launcher's settings then hold."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_titleforge", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp())  # on the driver, which serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._titleforge = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only where the setting is missing (local tests) a temporary folder is used."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = Path(tempfile.gettempdir()) / f"titleforge-{os.getuid()}"
    own.mkdir(exist_ok=True)
    return own.as_uri()


def tasks_for(df: DataFrame, rows_per_task: int = 50_000) -> int:
    """How many tasks work that takes long per row should have: at least one per core.

    Shuffles are sized by bytes, which says nothing of the work that follows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, so that a lost executor
    costs no recomputation and each reader sees the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
