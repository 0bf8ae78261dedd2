"""The registered queries: one Spark callable and, where SQL can say it, one oracle each."""

from workloads.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    from workloads import (  # noqa: F401
        analytics,
        geo_links,
        ingest,
        market,
        scalars,
        scores,
        search,
        streams,
        tables,
    )
