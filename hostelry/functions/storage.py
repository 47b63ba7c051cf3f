"""Cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder that all executors share: the one that ``spark.checkpoint.dir`` names.

    Only a local session without that setting (tests) gets a folder of its own; a
    cluster without it is refused, as its executors could not read each other's files.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: Folders of tables that ``cut`` has written and nobody has dropped, with their sessions.
_written: dict[str, SparkSession] = {}


def _delete(session: SparkSession, folder: str) -> None:
    path = session._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def clear() -> None:
    """Delete all tables that ``cut`` has written; called when the driver ends with its session open."""
    while _written:
        folder, session = _written.popitem()
        try:
            if session.sparkContext._jsc is not None:
                _delete(session, folder)
        except (Py4JError, OSError):  # the session has ended before
            pass


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and continue from there.

    A written table, unlike a checkpoint, is planned by its real size: a checkpoint
    keeps the estimate of the plan before it, which joins square, so that after a few
    rounds planning takes longer than the work.
    """
    session = df.sparkSession
    path = f"{shared_folder(session)}/cut-{uuid.uuid4().hex}"
    _written[path] = session
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        folders = {file.rpartition("/")[0] for file in df.inputFiles()} if df is not None else ()
        for folder in folders:
            if "/cut-" in folder:
                _delete(df.sparkSession, folder)
                name = folder.rpartition("/")[2]
                for path in [p for p in _written if p.endswith(name)]:
                    del _written[path]


def table(session: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return session.read.parquet(f"{sf_dir}/{name}.parquet")
