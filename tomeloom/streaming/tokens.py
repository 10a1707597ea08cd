"""Polling a change feed by tokens, as a stream whose offset is the token.

A feed answers a token with a page of changes and the token to ask with next; where it has no more for now, that token is kept for
the next poll. Every page is landed as a file before an offset tells of it, so that a failed batch is repeated from the same
pages, whatever the feed would say by then. Tasks read the landed pages; the driver holds one page at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PAGES = "page long, token string, reset boolean, text string"
#: Pages that one poll takes at most (the rest is for the next poll), and pages of a task.
MOST, TOGETHER = 10_000, 16


class TokenExpired(Exception):
    """The feed no longer knows a token."""


@dataclass(frozen=True)
class Page:
    text: str
    next_token: str
    last: bool


def as_page(text: str) -> Page:
    """A cloud drive's answer: a token or link of the next page, or one to begin the next poll with."""
    body = json.loads(text)
    more = body.get("nextPageToken") or body.get("@odata.nextLink")
    then = more or body.get("newStartPageToken") or body.get("@odata.deltaLink")
    if not then:
        raise ValueError("a page of changes without a token to go on with")
    return Page(text, then, not more)


def landed_feed(folder: str, first: str = "0") -> Callable[[str | None], Page | None]:
    """A feed of pages that lie in folders token=<token>: None for a token whose page has not landed yet."""

    def fetch(token: str | None) -> Page | None:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        found = files.get_file_info(arrow_fs.FileSelector(f"{root}/token={first if token is None else token}", allow_not_found=True))
        texts = [_read(files, f.path) for f in sorted(found, key=lambda f: f.path) if not f.base_name.startswith(("_", "."))]
        return as_page("".join(texts)) if any(texts) else None

    return fetch


def _read(files: arrow_fs.FileSystem, path: str) -> str:
    with files.open_input_stream(path) as stream:
        return stream.read().decode()


class _Landing:
    """Pages 1, 2, ... as files of a folder."""

    def __init__(self, folder: str):
        self.files, self.root = arrow_fs.FileSystem.from_uri(folder)

    def _path(self, page: int) -> str:
        return f"{self.root}/{page:012d}.json"

    def numbers(self) -> list[int]:
        found = self.files.get_file_info(arrow_fs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name[:12]) for f in found if f.base_name.endswith(".json"))

    def read(self, page: int) -> dict:
        return json.loads(_read(self.files, self._path(page)))

    def write(self, page: int, row: dict) -> None:
        self.files.create_dir(self.root, recursive=True)
        aside = f"{self.root}/{uuid.uuid4().hex}.part"
        with self.files.open_output_stream(aside) as stream:
            stream.write(json.dumps(row).encode())
        self.files.move(aside, self._path(page))

    def delete(self, page: int) -> None:
        self.files.delete_file(self._path(page))


@dataclass
class _Pages(InputPartition):
    first: int
    last: int


class _Reader(DataSourceStreamReader):
    def __init__(self, fetch: Callable[[str | None], Page | None], folder: str, most: int):
        self.fetch, self.folder, self.most = fetch, folder, most

    def initialOffset(self) -> dict:
        return {"page": 0, "token": None}

    def latestOffset(self) -> dict:
        landing = _Landing(self.folder)
        page = max(landing.numbers(), default=0)
        token = landing.read(page)["next"] if page else None
        for _ in range(self.most):
            asked, reset = token, False
            try:
                got = self.fetch(token)
            except TokenExpired:
                if token is None:
                    raise
                asked, reset, got = None, True, self.fetch(None)
            if got is None or (got.last and got.next_token == asked):
                break
            page, token = page + 1, got.next_token
            landing.write(page, {"token": asked, "next": token, "reset": reset, "text": got.text})
            if got.last:
                break
        return {"page": page, "token": token}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        there = set(_Landing(self.folder).numbers())
        wanted = range(start["page"] + 1, end["page"] + 1)
        if not there.issuperset(wanted):
            raise ValueError(f"{self.folder}: landed pages and checkpoint are not of one stream")
        return [_Pages(a, min(a + TOGETHER - 1, end["page"])) for a in wanted[::TOGETHER]]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        landing = _Landing(self.folder)
        for page in range(partition.first, partition.last + 1):
            row = landing.read(page)
            yield page, row["token"], row["reset"], row["text"]

    def commit(self, end: dict) -> None:
        """Pages of finished batches go, but for the last page of all, whose token is needed."""
        landing = _Landing(self.folder)
        for page in landing.numbers()[:-1]:
            if page <= end["page"]:
                landing.delete(page)


def polled(spark: SparkSession, fetch: Callable[[str | None], Page | None], landing: str, most: int = MOST) -> DataFrame:
    """The pages of a feed as a stream of (page, token, reset, text), a row for each page.

    fetch(token) gives the page of a token, None where there is none yet, the first page for no token, or raises TokenExpired. Then the
    feed is asked anew from its first page, which is marked `reset`: changes may have been missed, or come again. It runs beside
    the driver and is shipped there, so it must hold no session. landing: a folder of this stream alone that all
    machines share, best within its checkpoint; a lost checkpoint means a new landing folder. A poll lands `most` pages at most,
    so a run that takes what is available now takes no more; what is left is taken by the next.
    """

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"token_feed_{key}"

        def schema(self) -> str:
            return PAGES

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(fetch, landing, most)

    key = uuid.uuid4().hex
    spark.dataSource.register(Feed)
    return spark.readStream.format(f"token_feed_{key}").load()
