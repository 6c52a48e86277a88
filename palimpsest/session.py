"""Session settings and the inputs every query shares."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Keys are at most 1,024 bytes, so a path has at most 512 segments; recursion needs a little more than that.
RECURSION_LIMIT = 600


def session(app: str = "palimpsest", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries expect; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.cteRecursionLevelLimit", str(RECURSION_LIMIT)).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    send_package(spark)
    return spark


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application, so that their Python workers find them.

    A package that is itself read from an archive was sent by whoever started the application.
    """
    context, folder = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SENT or not folder.is_dir():
        return
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="palimpsest-"))) / "palimpsest.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(folder.rglob("*.py")):
            out.write(file, file.relative_to(folder.parent))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where the session names none and runs on one machine, a local folder is set; on a cluster that is an error, as what
    one machine writes there the others can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if named is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named or os.path.dirname(context.getCheckpointDir())


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of one data directory."""
    send_package(spark)
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
