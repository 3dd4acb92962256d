"""A FHIR server as a Spark data source: many partitions a resource type, and a stream of what is new.

The planner asks each type's total and halves the time of last update until a part has at most `part_rows` resources, so a type of a billion is read by as many tasks as one wants. The first part has no lower end and the
last no upper one. A server that counts no ranges, or counts them otherwise than its total, is read in one part a type. Within a part pages follow their next links.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.error import HTTPError
from urllib.parse import urlencode, urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import IngestError

_FORM = "%Y-%m-%dT%H:%M:%S.%f"


def _instant(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)


def _text(t: datetime) -> str:
    return t.strftime(_FORM)[:-3] + "Z"


def _origin(url: str) -> tuple:
    u = urlsplit(url)
    return u.scheme, u.hostname, u.port or {"http": 80, "https": 443}.get(u.scheme)


class _Redirects(HTTPRedirectHandler):
    """The token stays with the host that it is for."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and _origin(newurl) != _origin(req.full_url):
            new.remove_header("Authorization")
        return new


@dataclass(frozen=True)
class Range(InputPartition):
    """Resources of a type with from <= last update < upto; empty ends are open. number: its place among the type's parts."""

    kind: str
    start: str = ""
    upto: str = ""
    number: int = 0


class Client:
    """options: url, token, timeout, retries (of answers 429 and 5xx, and of broken connections) and wait (seconds before the first, doubled each time unless the server says how long)."""

    def __init__(self, options: dict) -> None:
        self.base, self.token = options["url"].rstrip("/"), options.get("token", "")
        self.timeout, self.retries, self.wait, self.count = float(options.get("timeout", 30)), int(options.get("retries", 4)), float(options.get("wait", 0.5)), int(options.get("count", 100))
        self.opener = build_opener(_Redirects)

    def get(self, url: str) -> dict:
        head = {"Accept": "application/fhir+json"}
        if self.token and _origin(url) == _origin(self.base):
            head["Authorization"] = f"Bearer {self.token}"
        for turn in range(self.retries + 1):
            pause = self.wait * 2**turn
            try:
                with self.opener.open(Request(url, headers=head), timeout=self.timeout) as r:  # noqa: S310
                    return json.load(r)
            except HTTPError as e:
                if turn == self.retries or e.code != 429 and e.code < 500:
                    raise IngestError(f"request for {url} failed: {e}") from e
                after = e.headers.get("Retry-After", "")
                pause = float(after) if after.isdigit() else pause
            except ValueError as e:
                raise IngestError(f"request for {url} failed: {e}") from e
            except OSError as e:
                if turn == self.retries:
                    raise IngestError(f"request for {url} failed: {e}") from e
            time.sleep(pause)
        raise AssertionError

    def url(self, part: Range, **more: str) -> str:
        ends = [("_lastUpdated", f"ge{part.start}")] * bool(part.start) + [("_lastUpdated", f"lt{part.upto}")] * bool(part.upto)
        return f"{self.base}/{part.kind}?{urlencode([*ends, *more.items()], safe=':')}"

    def total(self, part: Range) -> int | None:
        n = self.get(self.url(part, _summary="count")).get("total")
        return n if isinstance(n, int) else None

    def edge(self, part: Range, last: bool) -> datetime | None:
        """The first or last time of update."""
        page = self.get(self.url(part, _sort="-_lastUpdated" if last else "_lastUpdated", _count="1"))
        times = [e.get("resource", {}).get("meta", {}).get("lastUpdated") for e in page.get("entry") or []]
        return _instant(times[0]) if times and times[0] else None

    def pages(self, part: Range) -> Iterator[dict]:
        url = self.url(part, _count=str(self.count))
        while url:
            page = self.get(url)
            for entry in page.get("entry") or []:
                yield entry.get("resource", entry)
            following = next((x.get("url") for x in page.get("link") or [] if x.get("relation") == "next"), None)
            url = following and urljoin(f"{self.base}/", following)


def _halved(client: Client, part: Range, n: int, low: datetime, high: datetime, most: int) -> list[tuple[Range, int]]:
    """Parts of at most `most` resources (or of a single millisecond) with their counts; [] if the server's counts don't add up. low and high are inside the part."""
    if n <= most or high - low < timedelta(milliseconds=1):
        return [(part, n)]
    middle = low + (high - low) / 2
    middle = max(middle.replace(microsecond=middle.microsecond // 1000 * 1000), low.replace(microsecond=low.microsecond // 1000 * 1000) + timedelta(milliseconds=1))
    halves = [Range(part.kind, part.start, _text(middle)), Range(part.kind, _text(middle), part.upto)]
    counts = [client.total(h) for h in halves]
    if None in counts or sum(counts) < n:
        return []
    out = []
    for half, c, a, b in zip(halves, counts, (low, middle), (middle - timedelta(milliseconds=1), high), strict=True):
        if c:
            found = _halved(client, half, c, a, b, most)
            if not found:
                return []
            out += found
    return out


def plan(client: Client, kinds: list[str], start: str = "", upto: str = "", part_rows: int = 10_000, most_parts: int = 1000) -> list[Range]:
    """Parts of all types. At most 2 * most_parts + 1 parts a type: beyond that they hold more rows."""
    out = []
    for kind in kinds:
        whole = Range(kind, start, upto)
        n = client.total(whole)
        if n == 0:
            continue
        found = []
        most = max(part_rows, -(-(n or 0) // most_parts))
        if n is not None and n > most and (low := client.edge(whole, False)) and (high := client.edge(whole, True)):
            joined: list[tuple[Range, int]] = []  # of two neighbours one has over half of what a part may have
            for r, c in _halved(client, whole, n, low, high, most):
                if joined and joined[-1][1] + c <= most:
                    joined[-1] = (joined[-1][0], joined[-1][1] + c)
                else:
                    joined.append((r, c))
            found = [r for r, _ in joined]
            # What comes between the ends while we read belongs to one of the parts, so they must leave no gap.
            found = [Range(kind, a.start if k else start, b.start if b else upto, k) for k, (a, b) in enumerate(zip(found, [*found[1:], None][: len(found)], strict=True))]
        out += found or [whole]
    return out


class FHIRServer(DataSource):
    """Options: url, types (comma-separated), count, token, timeout, retries, wait, part_rows, most_parts; since and upto (instants) for a part of the time; lag (seconds, for streams)."""

    @classmethod
    def name(cls) -> str:
        return "fhir_server"

    def schema(self) -> str:
        return "resource_type string, data_json string, uri string, n string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


def _planned(options: dict, start: str, upto: str) -> list[Range]:
    return plan(Client(options), options["types"].split(","), start, upto, int(options.get("part_rows", 10_000)), int(options.get("most_parts", 1000)))


def _rows(options: dict, part: Range) -> Iterator[tuple]:
    """n is the resource's own id, so that ids of records don't depend on the plan; without one, its place in the part."""
    client = Client(options)
    for k, resource in enumerate(client.pages(part)):
        own = resource.get("id")
        yield resource.get("resourceType"), json.dumps(resource, ensure_ascii=False), client.base, f"{part.kind}/{own}" if own else f"{part.kind}#{part.number}#{k}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _planned(self.options, self.options.get("since", ""), self.options.get("upto", "")) or [Range("")]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.options, partition) if partition.kind else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are instants of last update, [start, end). The last `lag` seconds are left to the next batch, so that what is stamped while a batch is planned is not lost."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto": self.options.get("since", "")}

    def latestOffset(self) -> dict:  # noqa: N802
        client = Client(self.options)
        newest = [t for kind in self.options["types"].split(",") if (t := client.edge(Range(kind, self.options.get("since", "")), True))]
        if not newest:
            return self.initialOffset()
        end = min(max(newest) + timedelta(milliseconds=1), datetime.now(UTC) - timedelta(seconds=float(self.options.get("lag", 2))))
        end = _text(end)
        return {"upto": max(end, self.options.get("since", ""))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _planned(self.options, start["upto"], end["upto"]) if start["upto"] < end["upto"] else []

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.options, partition)
