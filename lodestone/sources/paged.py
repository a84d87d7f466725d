"""Paged services as Spark sources: pages that name the next one by a token, read in batches or as a stream that goes on where it stopped.

What talks to the service is a function that the caller injects, fetch(request, token) -> page, with request a dict of text (what to ask for; `from` is the
cursor of a stream), token None for the first page, and page a dict:

    records   list of dicts with id, deleted (bool), stamp (ISO text) and payload (text)
    token     of the next page, or None
    total     records of the whole answer, where the service says it
    error     code of an error that is an answer (noRecordsMatch: nothing to give), or None

`oai_page` and `works_page` make pages from the answers of two common protocols. A page that fails is asked for TRIES times.

Batch: each request is a partition and follows its own tokens, so requests (years, categories, queries) run side by side and a lost one is asked for anew.
Stream: the offset holds the token, so after a restart the next page is asked for, not the first one; a batch is at most `pages` pages. When the tokens end
the cursor moves to the latest stamp seen, and the next round asks `from` there; records of that very stamp come again only if there are more of them than
before, so sinks should upsert by id.
"""

from __future__ import annotations

import json
import time
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

TRIES, PAUSE_SECONDS = 4, 1.0
SCHEMA = "request string, page int, id string, deleted boolean, stamp string, payload string, total long"


class Request(InputPartition):
    def __init__(self, request: dict):
        self.request = request


def _asked(fetch: Callable, request: dict, token: str | None, pause: float) -> dict:
    """A page, asked for again after failures with growing pauses."""
    for k in range(TRIES):
        try:
            page = fetch(request, token)
        except (OSError, TimeoutError):
            if k == TRIES - 1:
                raise
            time.sleep(pause * 2**k)
            continue
        if page.get("error") in (None, "noRecordsMatch"):
            return page
        raise ValueError(f"{page['error']}: {request}, token {token}")
    raise AssertionError


def _rows(name: str, number: int, page: dict) -> Iterator[tuple]:
    for r in page.get("records") or []:
        yield name, number, r["id"], bool(r.get("deleted")), r.get("stamp"), r.get("payload"), page.get("total")


class _Batch(DataSourceReader):
    def __init__(self, fetch: Callable, options: dict):
        self.fetch, self.requests, self.pause = fetch, json.loads(options["requests"]), float(options.get("pause", PAUSE_SECONDS))

    def partitions(self) -> list[Request]:
        return [Request(r) for r in self.requests]

    def read(self, partition: Request) -> Iterator[tuple]:
        name, token, number = json.dumps(partition.request, sort_keys=True), None, 0
        while True:
            page = _asked(self.fetch, partition.request, token, self.pause)
            # a page without records has a row too, so that a request that gives nothing is known to have been asked
            yield from _rows(name, number, page) if page.get("records") else [(name, number, None, None, None, None, page.get("total"))]
            token, number = page.get("token"), number + 1
            if not token:
                return


class _Stream(SimpleDataSourceStreamReader):
    """Offsets: from (cursor), token and page of the next page, seen (latest stamp), edge (records of that stamp), last (edge of the round before)."""

    def __init__(self, fetch: Callable, options: dict):
        self.fetch, self.request = fetch, json.loads(options.get("request", "{}"))
        self.start, self.pages, self.pause = options.get("from", ""), int(options.get("pages", 10)), float(options.get("pause", PAUSE_SECONDS))

    def initialOffset(self) -> dict:
        return {"from": self.start, "token": None, "page": 0, "seen": "", "edge": 0, "last": -1, "round": 0}

    def _page(self, at: dict) -> tuple[list[tuple], dict]:
        request = self.request | {"from": at["from"]}
        page = _asked(self.fetch, request, at["token"], self.pause)
        rows = list(_rows(json.dumps(self.request, sort_keys=True), at["page"], page))
        stamps = [r[4] or "" for r in rows]
        seen = max([at["seen"], *stamps])
        edge = (at["edge"] if seen == at["seen"] else 0) + stamps.count(seen)
        after = at | {"token": page.get("token"), "page": at["page"] + 1, "seen": seen, "edge": edge}
        if not after["token"]:
            if at["round"] and at["page"] == 0 and seen == at["from"] and edge == at["last"]:
                return [], at  # just what the last round ended with
            if seen:
                after |= {"from": seen, "last": edge, "round": at["round"] + 1}
            after |= {"page": 0, "seen": "", "edge": 0}
        return rows, after

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for _ in range(self.pages):
            more, after = self._page(at)
            rows += more
            if after == at or (not more and not after["token"]):
                at = at if after == at or not rows else after
                break
            at = after
            if at["page"] == 0:
                break  # a round has ended
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same pages again: what a batch had that failed before its commit."""
        at = start
        while at != end:
            rows, after = self._page(at)
            yield from rows
            if after == at or (after["round"] > end["round"]):
                return
            at = after


def paged_source(name: str, fetch: Callable[[dict, str | None], dict]) -> type[DataSource]:
    """A data source for spark.dataSource.register. Batch: option requests (a JSON list). Stream: options request (JSON), from, pages. Both: pause."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(fetch, self.options)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Stream(fetch, self.options)

    return Paged


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def oai_page(answer: str) -> dict:
    """A page from a ListRecords answer; payload is the record's metadata as XML."""
    root = ElementTree.fromstring(answer)
    found = {"records": [], "token": None, "total": None, "error": None}
    for x in root.iter():
        kind = _local(x.tag)
        if kind == "error":
            found["error"] = x.get("code")
        elif kind == "resumptionToken":
            size = x.get("completeListSize")
            found |= {"token": (x.text or "").strip() or None, "total": int(size) if size else None}
        elif kind == "record":
            part = {_local(y.tag): y for y in x}
            head = {_local(y.tag): (y.text or "").strip() for y in part["header"]}
            inside = list(part.get("metadata", []))
            found["records"].append({
                "id": head.get("identifier"), "deleted": part["header"].get("status") == "deleted", "stamp": head.get("datestamp"),
                "payload": ElementTree.tostring(inside[0], encoding="unicode") if inside else None,
            })
    return found


def works_page(answer: str) -> dict:
    """A page from a cursor answer of works (message.items, next-cursor, total-results); payload is the item as JSON. An empty page ends the cursor."""
    message = json.loads(answer).get("message", {})
    items = message.get("items") or []
    stamp = lambda i: ((i.get("indexed") or {}).get("date-time") or "")
    records = [{"id": i.get("DOI"), "deleted": False, "stamp": stamp(i), "payload": json.dumps(i, sort_keys=True)} for i in items]
    return {"records": records, "token": message.get("next-cursor") if items else None, "total": message.get("total-results"), "error": None}


def harvested(pages: DataFrame) -> DataFrame:
    """(request, pages, records, deleted, reported_total, truncated) of a batch: whether all that was announced has come."""
    one = pages.groupBy("request").agg(
        (F.max("page") + 1).alias("pages"), F.count("id").alias("records"), F.count_if(F.coalesce("deleted", F.lit(False))).alias("deleted"), F.max("total").alias("reported_total")
    )
    return one.withColumn("truncated", F.coalesce(F.col("reported_total") > F.col("records"), F.lit(False)))
