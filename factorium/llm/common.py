"""What the training-data operators share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter of keys: 8 MB, however many keys. Beyond some 10^8 of them it lets ever more others through.
MARKS = 1 << 26
#: A missing id counts as one id larger than every other.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir. Only where it is unset (tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="factorium-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and a lost executor costs only reading."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def crc32_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8"))


def mark(*columns: str) -> Column:
    """The bit that stands for the columns' values in a filter of keys."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(MARKS - 1))


def marks(df: DataFrame, *columns: str) -> np.ndarray:
    """A filter of keys: its bits are set for all values that df has, and for few others. It saves moving rows that match none; an exact join must follow."""
    at = df.select(mark(*columns).alias("at")).select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bit"))
    found = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def marked(b: pa.RecordBatch, column: str, bits: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch whose bit, in the column, is set."""
    at = b.column(column).to_numpy(zero_copy_only=False)
    return b.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((n, columns[n]) for n in schema.names)], schema=schema)


def texts_in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each (one row at least), so that what is made of a slice stays small."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = _lengths(b.column(column))
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        yield b.slice(at)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
