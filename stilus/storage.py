"""Where data between steps is kept, and how small tables are dealt out."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir`` (or was given by
    ``setCheckpointDir``). Only where neither is set and all of Spark is this
    one process, as in local tests, a temporary folder is made the session's
    checkpoint folder; on a cluster a folder of one machine would be wrong.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="stilus-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _removed(sc, path: str) -> None:
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def _remove_all(sc) -> None:
    for path in _made:
        with contextlib.suppress(Exception):  # a session that has ended cannot remove
            _removed(sc, path)


def new_dir(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is there is removed when the driver exits."""
    if not _made:
        atexit.register(_remove_all, spark.sparkContext)
    path = f"{shared_dir(spark)}/stilus-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage so that a lost executor costs a re-read, and lets
    several consumers share one computation. ``discard`` removes it.
    """
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame | str) -> None:
    """Remove tables of ``stage``, and folders of ``new_dir``, that nothing reads any more."""
    for x in staged:
        path = x if isinstance(x, str) else x.__dict__.get("_staged_at")
        if path in _made:
            _made.remove(path)
            _removed(SparkSession.active().sparkContext if isinstance(x, str) else x.sparkSession.sparkContext, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. One of fewer splits than cores is dealt out evenly; larger ones are read as they lie."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df
