"""Helpers about how a table lies, not what it holds; and tables that are written so that no later branch computes them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of fewer bytes for each core are spread where their files are few.
SMALL = 64 << 20
#: Rows that a task of a large table sorts or groups at once, about.
ROWS_A_TASK = 500_000


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than the cluster has cores, dealt over these; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """A large table dealt by these keys over as many tasks as its rows ask for, so that what one task sorts or groups does not grow with it; a small one as it is.

    Spark merges the partitions of a join up to a size in packed bytes, and rows of few distinct values unpack
    to many times that. The rows are counted, so the table should lie in files; rows: those of the
    table that it is to be dealt like, which it meets in a join.
    """
    spark, rows = df.sparkSession, df.count() if rows is None else rows
    if rows <= ROWS_A_TASK * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one in local mode if none is named, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sluiceway-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Files:
    """What a job does to whole files and folders, by Hadoop's file system, so that any store works."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def names(self, path: str) -> list[str]:
        """The names in a folder; none if it is not there."""
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def usage(self, path: str) -> tuple[int, int]:
        """How many files lie below a folder, and their bytes."""
        fs, at = self._at(path)
        found = fs.getContentSummary(at)
        return int(found.getFileCount()), int(found.getLength())

    def put_once(self, path: str, text: str) -> bool:
        """Writes a small file under another name and moves it to its own; False if that is taken."""
        fs, at = self._at(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(at) and fs.rename(draft, at):
            return True
        fs.delete(draft, False)
        return False


class StageStore:
    """The tables of one run, each under the number and name of its stage; a stage that is there with its marker is not run again.

    The marker is the _SUCCESS that Spark's committer writes last. `resumed` names the stages that were there.
    """

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.files = spark, Files(spark)
        self.root = f"{shared_folder(spark)}/sluiceway-stages/{key}"
        self.stages: list[str] = []
        self.resumed: list[str] = []

    def keep(self, df: DataFrame, name: str, hashed: bool = False) -> DataFrame:
        stage = f"{len(self.stages):03}-{name}"
        self.stages.append(stage)
        path = f"{self.root}/{stage}"
        if self.files.exists(f"{path}/_SUCCESS"):
            self.resumed.append(name)
        else:
            df.write.mode("overwrite").options(**_HASHED if hashed else {}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        self.files.delete(self.root)


_STORE: ContextVar[StageStore | None] = ContextVar("stage_store", default=None)


@contextmanager
def stages(spark: SparkSession, key: str | None = None) -> Iterator[StageStore]:
    """Inside, kept() writes to the store of this key, which is deleted at the end; what is read from it must be used up inside.

    With a key, a run that fails leaves its store, and the next run with the key goes on from the stages that
    ended. The key must say all that the tables depend on (see plans.runs.run_key). Without one, a failed
    run's store is deleted too.
    """
    store = StageStore(spark, key or uuid.uuid4().hex)
    token = _STORE.set(store)
    try:
        yield store
    except BaseException:
        if key is None:
            store.free()
        raise
    else:
        store.free()
    finally:
        _STORE.reset(token)


#: Columns of hashes hold hardly a value twice, which a dictionary would look for.
_HASHED = {"parquet.enable.dictionary": "false"}


def kept(df: DataFrame, name: str, hashed: bool = False) -> DataFrame:
    """The table written to the shared folder and read from there, so that no later branch computes it again (see stages); hashed: most of it are hashes."""
    store = _STORE.get()
    if store is not None:
        return store.keep(df, name, hashed)
    path = f"{shared_folder(df.sparkSession)}/sluiceway-run-{uuid.uuid4().hex}/{name}"
    df.write.options(**_HASHED if hashed else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
