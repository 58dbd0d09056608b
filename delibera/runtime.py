"""Session services every operator shares: cutting lineage, spreading work, size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders of this process's cut tables, by the session that wrote them; removed by ``sweep`` or at the end.
_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named in ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; on a cluster that is an
    error, as no executor could read what another wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="delibera-")
    return _own[app]


def cut(df: DataFrame, label: str = "cut", onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor loses nothing.

    With ``onto``, a frame that was cut before, its rows are read too, in one scan of both.
    """
    return _cut(df, label, onto)


def cut_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and how many rows meet each condition, taken while they are written."""
    seen = Observation()
    kept = _cut(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]), label)
    return kept, seen.get


def _cut(df: DataFrame, label: str, onto: DataFrame | None = None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    paths = [*(onto._cut_paths if onto is not None else []), path]
    out = spark.read.schema(df.schema).parquet(*paths)
    out._cut_paths = paths
    return out


def sweep(spark: SparkSession) -> None:
    """Delete the cut tables of this session. Frames that were built on them can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    for s, path in [w for w in _written if w[0].sparkContext.applicationId == spark.sparkContext.applicationId]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _written.remove((s, path))


@atexit.register
def _sweep_at_end() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            if spark.sparkContext._jsc is not None:
                sweep(spark)
        except Exception:  # the session is gone, and with it the way to its file system  # noqa: BLE001
            pass
    import shutil

    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def slots(spark: SparkSession) -> int:
    """Tasks to cut Python-heavy work into: a few for each core, so that none is long."""
    return max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Hash-spread rows before costly per-row Python: files are often too few for the cores.

    Keys are hashed with the row's own key, so the placement is the same when a lost task runs again.
    """
    return df.repartition(tasks or slots(df.sparkSession), *[F.col(k) for k in keys])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
