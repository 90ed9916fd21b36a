"""What the corpus operators share: tables, shared storage and small column helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans.storage import materialize, shared_dir  # noqa: F401

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers that share this file system find the package, wherever the driver was started
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else kept."""
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod `of`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)).cast("int")


def key_columns(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Join a document to facts found about it: rows equal in id and text share both numbers."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def wrapped(docs: DataFrame) -> DataFrame:
    """`doc` (all columns, whatever their names), _i and _h: what can be joined without a clash."""
    i, h = key_columns()
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), i.alias("_i"), h.alias("_h"))


#: Measured size up to which a table of decisions is sent to every executor instead of moving the texts.
BROADCAST_BYTES = 16 << 20


def bounded(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """`df`, written, to be joined to texts: by broadcast if its measured size allows, else by shuffle."""
    kept = materialize(df)
    size = kept.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).head()[0] or 0
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose document is not in `gone` (_i, _h), columns kept."""
    return wrapped(docs).join(bounded(gone.select("_i", "_h").distinct()), ["_i", "_h"], "left_anti").select("doc.*")


#: Rows that a Python worker holds at a time: texts are long, and two workers share an executor's memory.
BATCH_ROWS = 1000


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas over batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInPandas(function, schema)
