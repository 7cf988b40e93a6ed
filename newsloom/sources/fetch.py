"""Scans over HTTP with an injected transport: robots, pace, conditional headers, then the request.

A transport is a picklable callable (url, headers) -> (status, headers, body). One host is one group, so its pace is
kept by one task; the hosts spread over the cluster. No failure stops a scan: it is a row with a status or an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, dict], tuple[int, dict, str | None]]
AGENT, DELAY_S, RULES_S = "newsloom", 1.0, 3600.0
_ANSWER = "url string, status int, etag string, last_modified string, body string, error string"


class Robots:
    """Rules by host, kept RULES_S seconds. 401 and 403 deny all, other 4xx allow all; 5xx and no answer deny."""

    def __init__(self, transport: Transport, clock: Callable[[], float] = time.monotonic):
        self.transport, self.clock = transport, clock
        self.known: dict[str, tuple[float, object]] = {}

    def allows(self, base: str, url: str) -> bool:
        at, rules = self.known.get(base, (0.0, None))
        if rules is None or self.clock() - at > RULES_S:
            rules = self._read(base)
            self.known[base] = self.clock(), rules
        return rules if isinstance(rules, bool) else rules.can_fetch(AGENT, url)

    def _read(self, base: str):
        try:
            status, _, body = self.transport(f"{base}/robots.txt", {})
        except Exception:  # noqa: BLE001
            return False
        if status in (401, 403) or status >= 500:
            return False
        if status >= 400:
            return True
        parser = RobotFileParser()
        parser.parse((body or "").splitlines())
        return parser


def scan(requests: DataFrame, transport: Transport, delay_s: float = DELAY_S, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, etag, last_modified, body, error) of every request (url, etag, last_modified).

    error: `robots` where the host's rules forbid, `empty` for a 200 without a body, else the transport's failure. A 304
    keeps the headers it was asked with."""
    base = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    rows = requests.where("trim(url) <> ''").select(base.alias("base"), "url", "etag", "last_modified")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robots, last = Robots(transport), {}
        for batch in batches:
            out = []
            for base, url, etag, modified in zip(batch["base"], batch["url"], batch["etag"], batch["last_modified"]):
                if not robots.allows(base, url):
                    out.append((url, None, etag, modified, None, "robots"))
                    continue
                wait = last.get(base, -delay_s) + delay_s - time.monotonic() if base in last else 0.0
                if wait > 0:
                    sleep(wait)
                last[base] = time.monotonic()
                asked = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if isinstance(v, str)}
                try:
                    status, got, body = transport(url, asked)
                except Exception as e:  # noqa: BLE001
                    out.append((url, None, etag, modified, None, type(e).__name__))
                    continue
                if status == 200:
                    out.append((url, status, got.get("ETag"), got.get("Last-Modified"), body, None if body else "empty"))
                else:
                    out.append((url, status, etag, modified, None, None if status == 304 else f"http {status}"))
            answer = pd.DataFrame(out, columns=["url", "status", "etag", "last_modified", "body", "error"])
            yield answer.astype({"status": "Int32"})

    return rows.repartition("base").sortWithinPartitions("base", "url").mapInPandas(run, _ANSWER)
