"""Shared pieces: scratch tables in the cluster's shared folder and Arrow mapping."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows in one Arrow batch sent to Python; keeps a batch of long texts within a worker's memory.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or f"file://{tempfile.gettempdir()}/logfold-{os.getuid()}").rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, so later jobs start from the files. Where
    discard() doesn't delete it before, it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver collects
    its garbage, which by itself may be long after a large step."""
    gc.collect()
    spark._jvm.System.gc()


def packed_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its text compressed, to be shuffled; unpacked() gives a text back. Null stays null."""
    at = docs.columns.index(text_col)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            new = [None if x is None else press.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    prepare(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema)


def unpacked(packed: bytes | None) -> str | None:
    import zstandard

    return None if packed is None else zstandard.decompress(packed).decode("utf-8", "surrogatepass")


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """Maps Arrow batches one by one; f returns columns by name, or None for no rows."""
    prepare(df.sparkSession)
    target = empty_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def empty_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators read, under fixed names whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
