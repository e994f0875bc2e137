"""Paged chat as a Spark data source: a recording is read in ranges of time.

The transport is a callable ``fetch(video_id, offset, cursor) -> rows, cursor`` named by import
path in the option ``fetch``; a row has ``ts``, ``author`` and ``text``.  Without a cursor it
gives the page from ``offset`` seconds on, with one the page that the cursor stands for; the
cursor it returns stands for the page after, and is null after the last.  So pages join without a
gap, however many messages a second has.  Each range is an input partition: ranges are
read in parallel and a lost one is read again.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from crestline.sources.schemas import MESSAGES

RANGE_SECONDS = 1800
#: Steps ahead, in stream seconds, where a page and all after it are empty: doubled from the first up to the last.
FIRST_SKIP, LAST_SKIP = 60, 600


class ChatRange(InputPartition):
    """Messages from ``start`` up to ``end`` seconds of one recording."""

    def __init__(self, video_id: str, start: int, end: int):
        self.video_id, self.start, self.end = video_id, start, end


def page_through(fetch: Callable, video_id: str, start: int, end: int, keep: bool = False) -> Iterator[tuple[float, str, str]]:
    """Messages of ``start`` up to ``end``, page by page; those without a time are left out.

    An empty page without a cursor may be a quiet stretch: reading goes on a step ahead.  A page that fails
    fails the range, or, with ``keep``, ends it with what was read.  A cursor that does not move is an error.
    """
    offset, cursor, empty = start, None, 0
    while offset < end:
        try:
            rows, following = fetch(video_id, offset, cursor)
        except Exception:
            if keep:
                return
            raise
        for row in rows:
            ts = row.get("ts")
            if ts is not None and ts >= end:
                return
            if ts is not None and ts >= start:
                offset = max(offset, int(ts) + 1)
                yield float(ts), row.get("author") or "", row.get("text") or ""
        if following is None and rows:
            return
        if following is not None and following == cursor:
            raise ValueError(f"the cursor of recording {video_id} does not move on from {cursor!r}")
        if following is None:
            offset += min(FIRST_SKIP << min(empty, 10), LAST_SKIP)
            empty += 1
        cursor = following


def _read(fetch: str, partition: ChatRange, keep: bool) -> Iterator[tuple]:
    module, _, name = fetch.partition(":")
    function = getattr(importlib.import_module(module), name)
    for ts, author, text in page_through(function, partition.video_id, partition.start, partition.end, keep):
        yield partition.video_id, ts, author, text


class ChatReader(DataSourceReader):
    """Reads recordings in ranges of time."""

    def __init__(self, options: dict):
        self.videos = [v for v in options.get("videos", "").split(",") if v]
        self.start, self.end = 0, int(-(-float(options.get("duration", "0")) // 1))
        self.fetch, self.keep = options["fetch"], options.get("keep", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        first = self.start // RANGE_SECONDS * RANGE_SECONDS
        steps = range(first, max(first + 1, self.end), RANGE_SECONDS)
        found = [ChatRange(v, max(s, self.start), min(s + RANGE_SECONDS, self.end)) for v in self.videos for s in steps]
        return [p for p in found if p.start < p.end] or [ChatRange("", 0, 0)]

    def read(self, partition: ChatRange) -> Iterator[tuple]:
        return _read(self.fetch, partition, self.keep)


class FilteredChatReader(ChatReader):
    """Plans only the ranges that the filters leave: comparisons of ``ts`` and ``job_id`` with values; Spark still applies them to the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            yield f
            column = getattr(f, "attribute", None)
            if column == ("job_id",) and isinstance(f, (EqualTo, In)):
                wanted = [f.value] if isinstance(f, EqualTo) else f.value
                self.videos = [v for v in self.videos if v in wanted]
            elif column == ("ts",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, int(f.value // 1))
            if column == ("ts",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                # The end of a range is not in it.
                self.end = min(self.end, int(-(-f.value // 1)) if isinstance(f, LessThan) else int(f.value // 1) + 1)


class LiveChatReader(DataSourceStreamReader):
    """Chats that are still going on.  An offset is a second of the recordings, so a trigger, and its replay, reads a range of time.

    ``clock``, a callable named as ``fetch`` is, gives the second up to which chats are complete.
    """

    def __init__(self, options: dict):
        self.videos = [v for v in options.get("videos", "").split(",") if v]
        self.fetch, self.clock, self.begin = options["fetch"], options["clock"], int(options.get("begin", "0"))

    def initialOffset(self) -> dict:
        return {"second": self.begin}

    def latestOffset(self) -> dict:
        module, _, name = self.clock.partition(":")
        return {"second": max(self.begin, int(getattr(importlib.import_module(module), name)()))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["second"], end["second"]
        return [ChatRange(v, s, min(s + RANGE_SECONDS, b)) for v in self.videos for s in range(a, b, RANGE_SECONDS)]

    def read(self, partition: ChatRange) -> Iterator[tuple]:
        return _read(self.fetch, partition, False)


class ChatDataSource(DataSource):
    """``spark.read.format("chat_pages").option("videos", "1,2").option("duration", ...).option("fetch", "mod:fn")``.

    With the option ``pushdown`` filters narrow what is fetched; Spark takes that only with
    ``spark.sql.python.filterPushdown.enabled`` set.  With ``readStream`` the option ``clock`` takes the place of ``duration``.
    """

    @classmethod
    def name(cls) -> str:
        return "chat_pages"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> ChatReader:
        return (FilteredChatReader if self.options.get("pushdown", "false") == "true" else ChatReader)(self.options)

    def streamReader(self, schema) -> LiveChatReader:
        return LiveChatReader(self.options)
