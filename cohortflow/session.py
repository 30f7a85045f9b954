"""Session helpers: the shared work folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_LOCAL: dict[str, str] = {}  # of local sessions without a setting, by application
_SHARED: set[str] = set()  # folders that were tried, by application
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, which must be shared by all executors.

    A path without a scheme is read by the session's default file system. On a cluster whose default is the local disk such
    a path may be a mount that all machines share, or each machine's own: it is tried once (:func:`shared`), and refused
    if executors write their own. Only a local session may leave the setting unset and then gets a temporary folder for
    its lifetime.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.split("[")[0] == "local"
    if folder:
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        tried = f"{spark.sparkContext.applicationId}:{folder}"
        if not local and "://" not in folder and not folder.startswith("file:") and default.startswith("file:") and tried not in _SHARED:
            if not shared(spark, folder):
                raise ValueError(f"spark.checkpoint.dir is {folder}, which executors do not share: name a shared store, as in hdfs://... or file:///mount")
            _SHARED.add(tried)
        return folder.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="cohortflow-")
    return _LOCAL[app]


def shared(spark: SparkSession, folder: str) -> bool:
    """Whether what tasks write to this folder is there for the driver and for other tasks: a few rows, written and counted."""
    n, path = 2 * spark.sparkContext.defaultParallelism, f"{folder.rstrip('/')}/cohortflow/tried-{uuid.uuid4().hex}"
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == n
    finally:
        _drop(spark, path)


_SCOPE: ContextVar[str] = ContextVar("scope", default="tables")  # folder for tables written now, of this thread or task


class Scope:
    """Tables written inside ``with Scope(spark) as scope`` go to a folder of their own, which is removed at the end.

    What is computed from them must be stored before: in a folder of the caller's, or by :meth:`keep`. Scopes nest, and
    every thread has its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"scope-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scope":
        self.outer = _SCOPE.get()
        self.token = _SCOPE.set(self.name)
        return self

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """:func:`written` to the folder outside, so it outlives this scope."""
        token = _SCOPE.set(self.outer)
        try:
            return written(df, name)
        finally:
            _SCOPE.reset(token)

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self.token)
        _drop(self.spark, f"{work_folder(self.spark)}/cohortflow/{self.spark.sparkContext.applicationId}/{self.name}")


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this scope in the shared folder that nothing has used."""
    return f"{work_folder(spark)}/cohortflow/{spark.sparkContext.applicationId}/{_SCOPE.get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Used between rounds of iterative jobs: the plan stays short, a lost executor re-reads files instead
    of recomputing every earlier round, and the next plan knows the real table size. Shuffle files of the write are removed
    as soon as it ends, so a job of many rounds holds those of one round.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before) if before is not None else spark.conf.unset(RELEASE)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """:func:`written`, plus aggregates observed while writing, so no second job is needed to count."""
    watch = Observation()
    table = written(df.observe(watch, *[c.alias(k) for k, c in counts.items()]), name)
    return table, watch.get


def drop_table(table: DataFrame) -> None:
    """Remove one table that :func:`written` returned, before its scope ends."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _drop(table.sparkSession, folder)


def drop_written(spark: SparkSession) -> None:
    """Remove all tables this application wrote through :func:`written`; results must be stored before."""
    _drop(spark, f"{work_folder(spark)}/cohortflow/{spark.sparkContext.applicationId}")
