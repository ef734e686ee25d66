"""What the training-data operators share: reading, cutting lineage, word pattern, fold of a document."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A word: a run of bytes other than ASCII white space. bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-kvloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Spark's own setting: shuffle files go when the write that needed them is done, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. Survives lost executors; the write's shuffle files are deleted with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kvloom-{name}-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kvloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing will read again."""
    path = getattr(df, "_kvloom_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as 0 (held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0).cast("long"))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


#: A table of keys is broadcast only if it is counted to have at most so many rows.
BROADCAST_ROWS = 500_000


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for the smaller side of a join: broadcast if its rows are few by count, else joined by shuffling."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}{k}" for k in itertools.count()) if n not in taken)


SLICE = 250

_ARROW = {"long": "int64", "int": "int32", "double": "float64", "string": "string", "binary": "binary", "boolean": "bool_"}


def map_columns(df: DataFrame, keep: list[str], use: list[str], start: Callable[[], Callable], fields: dict[str, str]) -> DataFrame:
    """Arrow batches through Python: the keep columns pass untouched, fields are made anew.

    start() runs once a task and gives make(*lists of the use columns) -> one list
    for each field, in order. Batches are cut to SLICE rows, so that few texts
    are Python objects at one time.
    """
    kinds = [pa.list_(pa.int64()) if k == "array<long>" else getattr(pa, _ARROW[k])() for k in fields.values()]
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                made = make(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in use])
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(c)) for c in keep] + [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(made, kinds)], names=[*keep, *fields]
                )

    return df.select(*dict.fromkeys([*keep, *use])).mapInArrow(run, schema)
