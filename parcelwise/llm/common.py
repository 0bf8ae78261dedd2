"""Small helpers of the operators: held-out folds, bounded labelled samples, free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.session import register_scratch, remove_scratch, shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal digits modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit hash of a document's id and text; with the id itself it names the row."""
    return F.xxhash64(F.col(text), F.length(text), F.col(doc_id))


def keep(df: DataFrame) -> tuple[DataFrame, str]:
    """(the written table, its path): ``df`` once in the shared folder, packed tighter than by default."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    register_scratch(path)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(df: DataFrame, path: str) -> None:
    """Remove a kept table that nothing will read again; ``df`` is any frame of the session."""
    remove_scratch(df.sparkSession, path)


def labelled_sample(labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` labelled ids of either class, in hash order.

    ``learn`` selects the rows that may be learned from. Rows without an id or a 0/1 label are left
    out and an id labelled twice counts once (its smaller label). The bound makes the sample small
    enough to broadcast.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    parts = [rows.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1])
