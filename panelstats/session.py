"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "panelstats", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # no stack walk per column expression while a plan is built
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged data: ``spark.checkpoint.dir``, or a local one where that is unset."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"panelstats-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


#: Owners of staged files, the innermost last.
_OWNERS: list[list[str]] = []


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Own what is staged inside: tables and checkpoints are deleted at the end, also after an error.

    Results that read them must be written or collected before. Inside another owner, the inner one deletes its own.
    Without an owner staged files stay until someone clears the folder (checkpoints: or until Spark's cleaner does,
    with ``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    owned: list[str] = []
    _OWNERS.append(owned)
    try:
        yield
    finally:
        _OWNERS[:] = [o for o in _OWNERS if o is not owned]
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
        for path in owned:
            folder = hadoop.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def _own(path: str) -> None:
    if _OWNERS:
        _OWNERS[-1].append(path)


def stage_table(df: DataFrame) -> DataFrame:
    """Write a row-level intermediate as a Parquet table of the shared folder and read it back.

    Several analyses then read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    _own(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame) -> DataFrame:
    """Write an aggregated intermediate once and continue from the written copy.

    Iterative fits and operators that read one aggregate several times start from here,
    so the raw scan runs once. The copy is a checkpoint in the folder that the cluster
    names in ``spark.checkpoint.dir``: it outlives lost executors.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _OWNERS:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _own(file.get())
    return out


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per session, as one of its Python files.

    Functions that run inside tasks are pickled by name, so workers must be able to import them
    wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_panelstats_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="panelstats-"), "panelstats.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._panelstats_shipped = True
