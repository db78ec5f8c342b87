"""Links to candidate files from paged services, behind a data source with a pluggable fetcher.

The box has no network: a fetcher is a picklable function ``(service, query, cursor) ->
(urls, next cursor or None)``. Its pages are read in the executors, one partition a
query, with retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Fetch = Callable[[str, str, str | None], tuple[list[str | None], str | None]]
# Page sizes and the most results of each service.
SERVICES = {"crs": (None, None), "world_bank": (50, 10_000), "open_alex": (100, None), "eric": (200, 10_000)}
TRIES = 3


class Refused(Exception):
    """A client error other than too many requests: another try is no use."""


def with_retries(call: Callable[[], object], tries: int = TRIES, first_delay: float = 1.0, sleep=time.sleep):
    """``call()``, tried again after 1, 2, 4 ... times ``first_delay`` seconds; the last error is raised."""
    for attempt in range(tries):
        try:
            return call()
        except Refused:
            raise
        except Exception:
            if attempt + 1 == tries:
                raise
            sleep(first_delay * 2**attempt)


def pages_of(fetch: Fetch, service: str, query: str, sleep=time.sleep) -> Iterator[str]:
    """The links of a query, page by page, null and empty ones left out, up to the service's most."""
    size, most = SERVICES.get(service, (None, None))
    cursor, seen = None, 0
    while True:
        urls, cursor = with_retries(lambda at=cursor: fetch(service, query, at), sleep=sleep)
        yield from (u for u in urls if u)
        seen += size or len(urls)
        if cursor is None or not urls or (most and seen >= most):
            return


def candidate_links(queries: DataFrame, fetch: Fetch) -> DataFrame:
    """``source_no, position, url`` of ``queries`` (``source_no, service, query``); a source that fails ends there."""

    def run(batches):
        for batch in batches:
            for number, service, query in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[str] = []
                try:
                    for url in pages_of(fetch, service, query):
                        rows.append(url)
                except Exception:
                    pass
                yield pa.RecordBatch.from_pydict({"source_no": pa.array([number] * len(rows), pa.int32()), "position": pa.array(range(len(rows)), pa.int64()), "url": pa.array(rows, pa.string())})

    return queries.select("source_no", "service", "query").mapInArrow(run, "source_no int, position long, url string")
