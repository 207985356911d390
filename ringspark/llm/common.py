"""What several operators share: the shared folder, saved tables, small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.operators.tables import save, shared_dir

__all__ = ["WORD", "fresh", "held_out", "save", "shared_dir", "small_batches", "table", "uniform"]

#: Bytes of the ASCII white space that separates words, as in [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Keeps Arrow batches of whole texts small: rows can be megabytes long, and a batch is in memory at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def uniform(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("uniform"), *cols), 11) / F.lit(float(1 << 53))
