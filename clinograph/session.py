"""Local Spark sessions for tests, benchmarks and trials."""
from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session in one JVM.  On a cluster, use the session that it gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("clinograph")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the session's spark.checkpoint.dir, which executors share.

    Only a local session without that setting gets a folder of its own under /tmp.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = "/tmp/clinograph-shared"
        context.setCheckpointDir(path)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Gives the package to the session's Python workers, once, unless PYTHONPATH does so already."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "clinograph_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="clinograph-")
    target = os.path.join(folder, "clinograph.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.glob("clinograph/**/*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(target)
    context.clinograph_shipped = True
