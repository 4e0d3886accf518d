"""A polite JSON source: one partition per host, retries with growing delays, a transport that can be replaced in tests."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Statuses worth another try.
RETRIED = {429, 500, 502, 503, 504}

Transport = Callable[[str], tuple[int, dict[str, str], str]]


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds to wait by a Retry-After header: a number or a date, never below 0; None where it says neither."""
    if value is None:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def fetch(url: str, transport: Transport, retries: int = 2, factor: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The JSON text at ``url``; statuses of RETRIED and transport errors are tried ``retries`` times more."""
    for attempt in range(retries + 1):
        wait = factor * 2**attempt
        try:
            status, headers, body = transport(url)
        except OSError:
            if attempt == retries:
                raise
            sleep(wait)
            continue
        if status in RETRIED and attempt < retries:
            said = retry_after(headers.get("Retry-After"), time.time()) if status == 429 else None
            sleep(wait if said is None else said)
            continue
        if status != 200:
            raise OSError(f"status {status} for {url}")
        kind = headers.get("Content-Type")
        if kind and "json" not in kind.lower():
            raise ValueError(f"no JSON at {url}")
        return body
    raise OSError(f"no answer from {url}")


def _urllib(url: str) -> tuple[int, dict[str, str], str]:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=15) as got:  # noqa: S310
            return got.status, dict(got.headers), got.read().decode()
    except HTTPError as error:
        return error.code, dict(error.headers), ""


class JsonSource(DataSource):
    """``spark.read.format("polite_json").option("urls", "a b c")``: (url, payload). One task per host fetches its addresses one after
    another, with a random pause of ``delay`` to ``most_delay`` seconds (1 to 2.5) between two of them."""

    transport: Transport = staticmethod(_urllib)

    @classmethod
    def name(cls) -> str:
        return "polite_json"

    def schema(self) -> str:
        return "url string, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, type(self).transport)


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options, transport):
        self.urls = options["urls"].split()
        self.delay = float(options.get("delay", "1.0"))
        self.most_delay = max(self.delay, float(options.get("most_delay", options.get("delay", "2.5"))))
        self.transport = transport

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(urlsplit(url).netloc.lower(), []).append(url)
        return [_Host(urls) for urls in hosts.values()]

    def read(self, partition):
        for k, url in enumerate(partition.urls):
            if k:
                time.sleep(random.uniform(self.delay, self.most_delay))
            yield url, fetch(url, self.transport)
