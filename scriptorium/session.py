"""Sessions: defaults for a local one, and shipping the package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine with adaptive execution, UTC and quiet output."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shipped(spark: SparkSession) -> SparkSession:
    """spark, with this package on its Python workers: sent once, unless they run on this machine and have it on their path."""
    sc = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(":") if sc.master.startswith("local") else []
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        paths.append(os.getcwd())
    if ROOT not in {Path(p).resolve() for p in paths if p} and not getattr(sc, "_scriptorium", False):
        file = Path(tempfile.mkdtemp()) / "scriptorium.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted((ROOT / "scriptorium").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(str(file))
        sc._scriptorium = True
    return spark
