"""What every job asks of its session: tables, a shared folder and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_ROOT = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset.

    Only a local session (tests) may leave the setting unset.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and go on from the written rows (lineage ends here)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which ``sized`` has a table broadcast.
MOST_BROADCAST = 100_000


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, settled, with a broadcast hint if it has at most ``most`` rows (narrow ones: some MB); larger ones are joined by shuffles."""
    out = settle(df)
    return F.broadcast(out) if out.count() <= most else out


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    sc._tessera_shipped = True
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "tessera_pkg.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, Path("tessera") / p.relative_to(_ROOT))
    sc.addPyFile(str(path))
