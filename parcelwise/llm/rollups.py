"""Token counts kept as delta-maintained rollups by source, language and tokenizer version.

A batch of changes (inserted, deleted and revised counts) becomes signed amounts, summed by group before they are
stored; the totals are the sum over all committed batches, so no batch reads the documents of another one.

A batch is written under a fresh name and then committed by renaming one small marker to the batch's
name, which succeeds once: a batch delivered again, or retried after a failure, changes nothing. Readers
follow committed markers only. ``compact`` folds committed batches into one base the same way.
One process at a time commits to a rollup; tasks and executors may fail at any time.

Defined results: null source or language is a group by itself; a null count is 0; a group whose documents
have all been deleted is not listed; an empty batch commits and changes nothing; repeated rows in a batch count
each; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.common import WORD

GROUP = ("source", "lang", "tokenizer")
PIECE = r"\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]"
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
_NONE = "-"


def count_by_pattern(text: Column, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def count_by_vocabulary(docs: DataFrame, path: str, name: str = "tokens") -> DataFrame:
    """``docs`` with the number of tokens of the tokenizer file at ``path`` (a JSON file every executor can
    open, or one that the session ships); the text is taken as ordinary text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            counts = []
            for lo in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(at).slice(lo, 256).to_pylist()]
                counts += [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` long")


def inserted(counts: DataFrame) -> DataFrame:
    """Changes for new documents; ``counts`` has source, lang, tokenizer and tokens."""
    return counts.select(*GROUP, F.lit(1).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).alias("docs"), (-F.coalesce("tokens", F.lit(0))).alias("tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes for documents whose count went from ``old_tokens`` to ``tokens``."""
    more = F.coalesce("tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return counts.select(*GROUP, F.lit(0).alias("docs"), more.alias("tokens"))


class Rollup:
    """Totals in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("batches", "bases", "data"):
            self._files.mkdirs(self._path(f"{self.path}/{part}"))

    def _markers(self, part: str) -> dict[str, list[str]]:
        """Names of committed markers and their lines."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{part}"))]
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.path}/{part}/{n}" for n in names], wholetext=True).select(
            F.col("_metadata.file_name").alias("name"), "value"
        )
        return {r["name"]: r["value"].split("\n") for r in rows.collect()}

    def _commit(self, part: str, name: str, lines: list[str]) -> bool:
        wait = self._path(f"{self.path}/data/marker-{uuid.uuid4().hex}")
        out = self._files.create(wait, False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        goal = self._path(f"{self.path}/{part}/{name}")
        if self._files.exists(goal) or not self._files.rename(wait, goal):
            self._files.delete(wait, False)
            return False
        return True

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        sums.where("docs <> 0 OR tokens <> 0").write.parquet(f"{self.path}/data/{name}")
        return name

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit one batch of changes; False if a batch of that name is there already."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch name has letters, digits, - and _ only")
        if self._files.exists(self._path(f"{self.path}/batches/{batch}")):
            return False
        return self._commit("batches", batch, [self._write(changes)])

    def _sources(self) -> tuple[list[str], list[str]]:
        """(data to be summed, batches in it): the latest base and the batches that it does not cover."""
        bases, batches = self._markers("bases"), self._markers("batches")
        base = bases[max(bases)] if bases else [_NONE]
        covered = set(base[1:])
        data = [lines[0] for name, lines in batches.items() if name not in covered]
        return data + [base[0]] * (base[0] != _NONE), sorted(batches)

    def _sum(self, data: list[str]) -> DataFrame:
        if not data:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/data/{d}" for d in data])
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) after all committed batches."""
        return self._sum(self._sources()[0]).where(F.col("docs") != 0)

    def compact(self) -> None:
        """Fold all committed batches into a new base."""
        data, names = self._sources()
        if data:
            number = f"{len(self._markers('bases')):012d}"
            self._commit("bases", number, [self._write(self._sum(data)), *names])
