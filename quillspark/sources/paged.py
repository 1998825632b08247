"""A Python Data Source over paged or monthly HTTP APIs.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", ...).option("kind", "offset").load()

kind `offset`: one request per page, enumerated from the item count of the first page; where that cannot be had, the scan
fails. kind `month`: one request per calendar month of [start, stop). kind `grid`: one request per entity and metric, whose
names (options `entities` and `metrics`, split at commas) take the places {entity} and {metric} of the URL; with start and
stop, one per month of each. kind `single`: one URL, a list or {"items": []}.

Rows are (part, ord, value, error): the JSON text of each item. A page that fails after its retries, or whose body is no
list, does not end the run: it is one row with its error and no value. 401 and 403 are final, after one 403 the token goes
into the query. Requests are `spacing` seconds apart over the whole scan: one task reads all pages, or `tasks` of them
wait `tasks` times as long.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPACING = 0.7


def fetch(url: str, token: str = "", tries: int = 3, wait: float = 2.0, timeout: float = 60.0, final: tuple[int, ...] = (401, 404), open_: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes | None:
    """Body of a 200 answer, else None: other answers and errors are retried after wait, 2 * wait, .. seconds."""
    in_query = False
    for n in range(tries):
        to = url
        head = {"Authorization": f"Bearer {token}"} if token and not in_query else {}
        if token and in_query:
            to += ("&" if "?" in to else "?") + urllib.parse.urlencode({"apiToken": token})
        try:
            with open_(urllib.request.Request(to, headers=head), timeout=timeout) as r:
                if r.status == 200:
                    return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 403 and token and not in_query:
                in_query = True
                continue
            if e.code in final or e.code == 403:
                return None
        except OSError:
            pass
        if n + 1 < tries:
            sleep(wait * (n + 1))
    return None


def months(start: str, stop: str) -> list[tuple[str, str]]:
    """[first day, first day of the next month) of each month from that of start to that of stop."""
    a, b, out = date.fromisoformat(start).replace(day=1), date.fromisoformat(stop), []
    while a <= b:
        nxt = date(a.year + a.month // 12, a.month % 12 + 1, 1)
        out.append((a.isoformat(), nxt.isoformat()))
        a = nxt
    return out


def listed(body: bytes | None) -> list:
    """Items of a list or of an object with `items`; nothing for what is neither."""
    return _items(body) or []


def _items(body: bytes | None) -> list | None:
    try:
        value = json.loads(body or b"")
    except ValueError:
        return None
    value = value.get("items", []) if isinstance(value, dict) else value
    return value if isinstance(value, list) else None


class Part(InputPartition):
    """(name, url) of the pages that one task reads, one after another."""

    def __init__(self, pages: list[tuple[str, str]]):
        self.pages = pages


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = dict(options)
        self.tasks = int(self.o.get("tasks", "1"))

    def _with(self, url: str, **query) -> str:
        return url + ("&" if "?" in url else "?") + urllib.parse.urlencode(query)

    def pages(self) -> list[tuple[str, str]]:
        kind, size, url = self.o.get("kind", "single"), int(self.o.get("count", "100")), self.o["url"]
        ranges = months(self.o["start"], self.o["stop"]) if "start" in self.o else []
        if kind == "month":
            return [(a[:7], self._with(url, start=a, end=b)) for a, b in ranges]
        if kind == "grid":
            names = lambda option: [x.strip() for x in self.o.get(option, "").split(",") if x.strip()]
            grid = [(f"{e}|{m}", url.replace("{entity}", urllib.parse.quote(e, "")).replace("{metric}", urllib.parse.quote(m, ""))) for e in names("entities") for m in names("metrics")]
            return [(f"{name}|{a[:7]}", self._with(to, start=a, end=b)) for name, to in grid for a, b in ranges] if ranges else grid
        if kind == "offset":
            body = fetch(self._with(url, count=size, offset=0), self.o.get("token", ""))
            try:
                most = int(json.loads(body or b"")["itemsMax"])
            except (ValueError, KeyError, TypeError) as e:
                raise OSError(f"no item count from the first page of {url}") from e
            return [(str(i), self._with(url, count=size, offset=i)) for i in range(0, max(most, 1), size)]
        return [("0", url)]

    def partitions(self) -> list[Part]:
        pages = self.pages()
        return [Part(pages[i :: self.tasks]) for i in range(min(self.tasks, len(pages)))] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for k, (name, url) in enumerate(partition.pages):
            if k:
                time.sleep(float(self.o.get("spacing", SPACING)) * self.tasks)
            items = _items(fetch(url, self.o.get("token", "")))
            if items is None:
                yield name, 0, None, f"no list from {url}"
                continue
            for i, item in enumerate(items):
                yield name, i, json.dumps(item, sort_keys=True, ensure_ascii=False), None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "part string, ord int, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
