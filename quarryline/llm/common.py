"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, for Java and Python patterns alike, and as characters for translate().
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which driver and executors share."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = root or "file:///tmp/checkpoints"  # one machine, as in tests
        _roots[app] = f"{root.rstrip('/')}/quarryline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by now; the folder then stays
        pass


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """For tasks that read or write files of the shared folder themselves."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that have, but for case, the names of results to come."""
    lower = {n.lower() for n in names}
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in lower])


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores as needed to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
    """The rows from a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


_last = None


class Held:
    """A bounded value for all tasks, broadcast. A worker process serves many stages: it keeps the value that its last
    task used, and none of earlier stages beside it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.shared = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        global _last
        if _last is not None and _last is not self.shared:
            _last.__dict__.pop("_value", None)  # the broadcast's copy in this process; its file stays
            tidy()
        _last = self.shared
        return self.shared.value


def tidy() -> None:
    """Gives free memory of this worker process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def training_row(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id as text, mod 4, is not 2 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2
