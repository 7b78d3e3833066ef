"""Session helpers: package shipping and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ensure_shipped(spark: SparkSession) -> None:
    """Send this package to the executors once, unless their PYTHONPATH has it."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_stimfuse_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="stimfuse-")) / "stimfuse_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((ROOT / "stimfuse").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    sc.addPyFile(str(at))
    sc._stimfuse_shipped = True


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Python workers get Arrow batches of at most this size, so their memory doesn't follow the number of rows a batch may have.

    The setting is read when a plan runs, which may be long after this call: it stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which every machine of the cluster sees. Where that is unset, it lies in the
    warehouse, which they see as well; only a session of one machine uses its temporary folder. The folders stay until the cluster clears it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = os.path.join(tempfile.gettempdir(), "stimfuse-checkpoints")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stimfuse-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path is left to Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
