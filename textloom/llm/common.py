"""Shared plumbing: table loading, tables in the shared folder, and what may be sent to all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.tables import drop_path, new_path, shared_dir, written

__all__ = ["SLICE_BYTES", "drop_path", "free", "new_path", "sent", "shared_dir", "table", "written"]

#: Bytes of text that a vectorised step holds at once; its temporaries are a small multiple of this.
SLICE_BYTES = 2 << 20
#: Bytes of a table, as rows in memory, that may be sent to all executors.
SEND_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table marked for broadcast, if its rows at so many bytes each stay within SEND_BYTES; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= SEND_BYTES else df


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever extra columns it carries."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
