"""The shared folder, and tables that are computed once and kept in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir;
    where it is unset, that of the context, or, if the master is local (tests), a temporary one
    that is made and set. A cluster without such a folder is refused: executors couldn't see
    each other's files."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir().get()


#: Files of a table by compact(), for each core of the cluster.
FILES = 4


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame) -> DataFrame:
    """settled(), in at most FILES files for each core. A small table otherwise has as many as the
    shuffle before it has partitions, and in a local folder Hadoop starts a process or two to
    set each file's mode. For tables of a row a key: the parts of a split partition would be
    joined again."""
    return settled(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism))
