"""Run metrics: counters observed while a job runs, appended to a table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

RUN_SCHEMA = (
    "source_slug string, stage string, started_at timestamp, finished_at timestamp, "
    "status string, stats map<string,bigint>, error string"
)


class Run:
    """Counts rows of a DataFrame as a side product of the action that consumes it.

    >>> run = Run("portal", "parse")
    >>> parsed = run.watch(parsed, {"ok": F.count_if(...)})
    >>> parsed.write...            # the one and only pass
    >>> run.finish(spark, path)
    """

    def __init__(self, source_slug: str, stage: str) -> None:
        self.source_slug, self.stage = source_slug, stage
        self.started_at = dt.datetime.now(dt.UTC)
        self._observed: list[Observation] = []

    def watch(self, df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
        obs = Observation()
        self._observed.append(obs)
        return df.observe(obs, *[c.alias(n) for n, c in counters.items()])

    def row(self, error: str | None = None) -> tuple:
        stats: dict[str, int] = {}
        if error is None:
            for obs in self._observed:
                stats.update({k: int(v or 0) for k, v in obs.get.items()})
        return (
            self.source_slug, self.stage, self.started_at, dt.datetime.now(dt.UTC),
            "failed" if error else "ok", stats, error[:1000] if error else None,
        )

    def finish(self, spark: SparkSession, path: str, error: str | None = None) -> None:
        spark.createDataFrame([self.row(error)], RUN_SCHEMA).write.mode("append").parquet(path)
