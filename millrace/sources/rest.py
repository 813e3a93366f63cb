"""Pages of a web API as a frame.

Calling an API is driver work: pages come one after another.  Rows are written to a
folder in batches as they come, so what the driver holds is bounded by a batch.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .sinks import Files

Fetch = Callable[[str, dict[str, Any], dict[str, str]], Any]


def fetch_json(url: str, params: dict[str, Any], headers: dict[str, str]) -> Any:
    query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
    with urllib.request.urlopen(urllib.request.Request(f"{url}?{query}" if query else url, headers=headers), timeout=60) as r:  # noqa: S310
        return json.load(r)


@dataclass
class RestSource:
    url: str
    #: none, page, offset or cursor
    pagination: str = "none"
    data_path: str = ""
    page_param: str = "page"
    size_param: str = "limit"
    page_size: int = 100
    first_page: int = 1
    cursor_param: str = "cursor"
    cursor_path: str = "next"
    params: dict[str, Any] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    retries: int = 3
    wait_s: float = 1.0
    #: calls a second, at most
    rate: float | None = None


def _at(doc: Any, path: str) -> Any:
    for part in filter(None, path.split(".")):
        doc = doc.get(part) if isinstance(doc, dict) else None
    return doc


def pages(source: RestSource, fetch: Fetch = fetch_json) -> Iterator[list[dict[str, Any]]]:
    """Rows of each page until one is empty, short or names no next one."""
    at, cursor, last = source.first_page if source.pagination == "page" else 0, None, 0.0
    while True:
        params = dict(source.params)
        if source.pagination in ("page", "offset"):
            params |= {source.page_param if source.pagination == "page" else "offset": at, source.size_param: source.page_size}
        elif source.pagination == "cursor" and cursor is not None:
            params[source.cursor_param] = cursor
        if source.rate:
            time.sleep(max(0.0, last + 1 / source.rate - time.time()))
        last = time.time()
        for attempt in range(source.retries + 1):
            try:
                doc = fetch(source.url, params, source.headers)
                break
            except OSError:
                if attempt == source.retries:
                    raise
                time.sleep(source.wait_s * 2**attempt)
        rows = _at(doc, source.data_path) if source.data_path else doc
        rows = [rows] if isinstance(rows, dict) else rows or []
        if rows:
            yield rows
        if source.pagination == "none" or not rows:
            return
        if source.pagination == "cursor":
            cursor = _at(doc, source.cursor_path)
            if cursor is None:
                return
        elif len(rows) < source.page_size:
            return
        at += 1 if source.pagination == "page" else len(rows)


def read_rest(spark: SparkSession, source: RestSource, folder: str, schema: str, fetch: Fetch = fetch_json, batch: int = 10_000) -> DataFrame:
    """All rows, by way of JSON lines in ``folder``."""
    files, held, n = Files(spark), [], 0
    if files.exists(folder):
        files.delete(folder)
    for rows in pages(source, fetch):
        held += rows
        if len(held) >= batch:
            files.create(f"{folder}/part-{n:05d}.json", "\n".join(map(json.dumps, held)))
            held, n = [], n + 1
    if held or not n:
        files.create(f"{folder}/part-{n:05d}.json", "\n".join(map(json.dumps, held)))
    return spark.read.schema(schema).json(folder)
