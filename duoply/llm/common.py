"""What the operators share: tables in the shared folder, and texts as Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoply.operators.order import fresh

#: Bytes of a batch that a worker turns into Python objects at a time.
STRIDE = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset; it gets a temporary folder."""
    if not (folder := spark.sparkContext.getCheckpointDir()):
        if not (chosen := spark.conf.get("spark.checkpoint.dir", None)):
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            chosen = tempfile.mkdtemp(prefix="duoply-")
        spark.sparkContext.setCheckpointDir(chosen)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    """Fold of a document: true where crc32 of its id as text leaves 2 when divided by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def strides(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes, or of one larger row; nothing is copied."""
    size = np.full(batch.num_rows, 16, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            size += column.nbytes // max(1, batch.num_rows)
    begins = np.flatnonzero(np.diff((np.cumsum(size) - size) // (most or STRIDE), prepend=-1))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType) -> DataFrame:
    """df through fn(batch) -> columns by name, a few megabytes of rows at a time; None drops the rows. Columns that fn returns as they came are not copied."""
    to = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in strides(whole):
                if (out := fn(batch)) is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return df.mapInArrow(run, to)


def sampled(df: DataFrame, label: str, most: int, labels: int = 256) -> DataFrame:
    """About `most` rows of each of the `labels` most frequent labels (all, if there are fewer): the bound of what is learned from. Rows are chosen by a hash of all their columns and their place in the input, so null or repeated ids, and equal rows, are chosen apart from each other; the same files give the same rows."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(labels).collect()}
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1 << 20, int(most / n * (1 << 20))))).otherwise(share)
    if not counts:
        return df.limit(0)
    draw, limit = fresh(df.columns, 2)
    drawn = df.withColumns({draw: F.pmod(F.xxhash64(F.monotonically_increasing_id(), *df.columns), F.lit(1 << 20)), limit: share})
    return drawn.where(F.col(draw) < F.col(limit)).drop(draw, limit)
