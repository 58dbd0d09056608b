"""A cursor-paged source as a Python data source: batch and streaming, id-ordered and resumable.

``spark.dataSource.register(PagedNotes)``; options: ``pages`` names a folder of JSON pages standing in for a service
({"notes": [{"id", "text"}]}), ``page_size`` rows a page. The offset of a stream is the last id that was read, so a
restart goes on where the checkpoint ends. A page that doesn't move the cursor is an error.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def retry(call, attempts: int = 7, first: float = 1.0, most: float = 30.0, sleep=time.sleep):
    """Call until it succeeds, waiting twice as long each time, at most ``most`` seconds."""
    wait = first
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait)
            wait = min(most, wait * 2)


class Pages:
    """A stand-in for a service that gives rows in id order after a cursor: sorted JSON pages, read through once.

    Ids that don't rise from page to page mean that the service doesn't go on: an error, as going on would never end.
    """

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def fetch(self, path: str) -> list[tuple[str, str]]:
        with open(path) as f:
            return [(n["id"], n.get("text")) for n in json.load(f)["notes"]]

    def files(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.folder, "*.json")))

    def rows(self, cursor: str, fetch=None):
        """Rows after ``cursor``; each file is fetched once, with retries."""
        last = ""
        for path in self.files():
            page = (fetch or (lambda p: retry(lambda: self.fetch(p))))(path)
            if page and page[-1][0] <= last:
                raise RuntimeError(f"{os.path.basename(path)} doesn't move the cursor beyond {last!r}")
            for key, text in page:
                if key > last:  # a row that a page repeats counts once
                    last = key
                    if key > cursor:
                        yield key, text

    def after(self, cursor: str) -> list[tuple[str, str]]:
        return list(itertools.islice(self.rows(cursor), self.size))


class _File(InputPartition):
    def __init__(self, path: str, before: str):
        self.path, self.before = path, before


class _Batch(DataSourceReader):
    """A task for each file; it looks at the file before as well, to see that the ids rise."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self):
        paths = self.pages.files()
        return [_File(p, b) for p, b in zip(paths, ["", *paths])] or [_File("", "")]

    def read(self, partition):
        fetch = lambda path: retry(lambda: self.pages.fetch(path)) if path else []
        last = max((key for key, _ in fetch(partition.before)), default="")
        page = fetch(partition.path)
        if page and page[-1][0] <= last:
            raise RuntimeError(f"{os.path.basename(partition.path)} doesn't move the cursor beyond {last!r}")
        for key, text in page:
            if key > last:
                last = key
                yield key, text


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def initialOffset(self):
        return {"after": ""}

    def read(self, start):
        page = self.pages.after(start["after"])
        return iter(page), {"after": page[-1][0] if page else start["after"]}

    def readBetweenOffsets(self, start, end):
        return itertools.takewhile(lambda r: r[0] <= end["after"], self.pages.rows(start["after"]))


class PagedNotes(DataSource):
    @classmethod
    def name(cls):
        return "paged_notes"

    def schema(self):
        return "id string, text string"

    def _pages(self) -> Pages:
        return Pages(self.options["pages"], int(self.options.get("page_size", "100")))

    def reader(self, schema):
        return _Batch(self._pages())

    def simpleStreamReader(self, schema):
        return _Stream(self._pages())
