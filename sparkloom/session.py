"""Session set-up: defaults for local work, and workers that find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster, submit it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def local(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC, adaptive execution, and few shuffle partitions."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("sparkloom")
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return importable(b.getOrCreate())
