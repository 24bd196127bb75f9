"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import posixpath
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are Python objects at a time.
ROWS = 2048
#: The tables that materialize has written and nothing has deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir; only where that is unset and all runs in one process (as in tests), a temporary folder."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='textquarry-')}")
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return posixpath.join(shared_dir(spark), "textquarry", spark.sparkContext.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    return posixpath.join(_own_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets the cleaner delete the shuffle files that led here
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote; nothing may read them, or what was derived from them and isn't written, after that."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)
        _made.remove(df.stored_at)


def written(work, name: str) -> DataFrame:
    """materialize(work()), after which all tables that were written on the way are deleted."""
    before = len(_made)
    out = materialize(work(), name)
    for path in _made[before:-1]:
        _delete(out.sparkSession, path)
    del _made[before:-1]
    return out


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables and files of this application, whose results must have been written or read by then."""
    _delete(spark, _own_dir(spark))
    _made.clear()


def map_lists(df: DataFrame, work, kinds: str) -> DataFrame:
    """df.mapInPandas for work that goes row by row: it is given a dict of lists, ROWS rows at a time, and yields pandas frames.

    So a null makes no floating-point numbers of a batch's whole numbers, and texts are Python objects a few at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def column(x: pa.Array) -> list:
        return x.to_numpy().tolist() if not x.null_count and pa.types.is_integer(x.type) else x.to_pylist()

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                yield {name: column(some.column(k)) for k, name in enumerate(some.schema.names)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(lists(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return df.mapInArrow(run, kinds)


def file_system(uri: str):
    """pyarrow's file system for uri, and the path there. Works on executors too."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_new(uri: str):
    """A stream that writes the file at uri; its folder is made where the store has folders."""
    store, path = file_system(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def open_old(uri: str):
    store, path = file_system(uri)
    return store.open_input_file(path)


def valid(text: Column | str) -> Column:
    """The text as well-formed UTF-8, each ill-formed part as U+FFFD: Python stages can't be given other bytes."""
    return F.make_valid_utf8((F.col(text) if isinstance(text, str) else text).cast("string"))


def content_of(text: Column | str) -> Column:
    """A hash that tells texts of one key apart; null counts as empty."""
    return F.xxhash64(F.coalesce(valid(text), F.lit("")))


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def null_safe(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[name])
    return out
