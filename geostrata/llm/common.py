"""What the text operators share: reading, batched Arrow maps, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and bytes of their texts, handed to a Python function at once; a row of more bytes goes alone.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20

#: The contract's words: runs of anything but ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def doc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text modulo divisor; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where none is named and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="geostrata-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Paths of the tables that written_and_reread has made and that still stand, oldest first.
WRITTEN: list[str] = []


def written_and_reread(df: DataFrame) -> DataFrame:
    """df by way of Parquet files in the shared folder; they stand until drop_written."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.parquet(path)


def drop_written(spark: SparkSession, after: int = 0, keep: int = 0) -> None:
    """Delete the tables of WRITTEN from place ``after`` on, but for the ``keep`` latest; what reads them must be done."""
    jvm = spark.sparkContext._jvm
    for path in WRITTEN[after : len(WRITTEN) - keep]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        WRITTEN.remove(path)


def hash_share(share: Column | float, *by: Column) -> Column:
    """True for about ``share`` of the values of ``by``; the same ones however the rows are partitioned, and equal values alike."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share


def unused(name: str, columns: Sequence[str]) -> str:
    """name, or with underscores added until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema, *StructType.fromDDL(ddl)])


def heavy_join(left: DataFrame, sized: DataFrame, keys: str | list[str], n: str, parts: int = 1000) -> DataFrame:
    """left joined with sized (keys, n, others) on the keys, where n counts left's rows of the keys.

    Keys with more than a ``parts``-th of all rows counted are fewer than ``parts``: those rows of sized
    are broadcast, and a hot key's rows stay where they are. The rest are joined by a shuffle. left is
    read twice.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    most = (sized.agg(F.sum(n)).first()[0] or 0) / parts
    hot = sized.where(F.col(n) > most).withColumn("is_hot", F.lit(True))
    marked = left.join(F.broadcast(hot), keys, "left")
    met = [*left.columns, *[c for c in sized.columns if c not in keys]]
    return marked.where("is_hot").select(met).unionByName(marked.where("is_hot IS NULL").select(left.columns).join(sized.where(F.col(n) <= most), keys).select(met))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of SLICE_ROWS rows and SLICE_BYTES bytes of text at most, one row at least."""
    if batch.num_rows <= SLICE_ROWS and batch.nbytes <= SLICE_BYTES:
        yield batch
        return
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right"))
        to = min(max(to, at + 1), at + SLICE_ROWS)
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, schema: StructType | str, make: Callable, *args) -> DataFrame:
    """Rows of df's columns through ``make(*args)``, made once a task.

    The function gets one list a column, of the rows of a slice, and returns one list (or Arrow
    array) for each field of schema; it may return more or fewer rows than it got.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    fields = to_arrow_schema(schema)

    def run(batches):
        apply = make(*args)
        for batch in batches:
            for piece in slices(batch):
                columns = apply(*(c.to_pylist() for c in piece.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: Sequence[str], make: Callable, *args) -> DataFrame:
    """df's rows, all columns untouched, for which ``make(*args)`` says True; it gets lists as in map_slices."""
    order = [df.columns.index(c) for c in columns]

    def run(batches):
        apply = make(*args)
        for batch in batches:
            for piece in slices(batch):
                yield piece.filter(pa.array(apply(*(piece.column(k).to_pylist() for k in order)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
