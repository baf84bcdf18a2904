"""Pages of records as a data source, batch or stream, that goes on at any record.

A page is a JSON document with a list ``results``. Pages lie in a folder (``page-3.json``, or
a folder ``page=3``) on any file system that Arrow opens, or are asked of a web service
(``path`` is then its address; page and size go into the query string, and ``total`` names the
reply's count of records). A record comes as it is, as JSON text, with the offset behind it.

The stream's offset is (page, record). A batch is what has come since the last one,
with a task for each page, or for a run of pages where there are many; a task opens its pages by
name and holds one at a time. The last page may still grow. What an offset means doesn't depend on what was filtered later, so that a run may
also begin at the offset that another one has kept (option ``offset``).
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page int, place int, value string, resume_offset long"
_PAGE = re.compile(r"page[-=](\d+)(\.json)?$")
#: Pages of a batch are dealt to no more tasks than this. A fixed value.
MOST_TASKS = 256


class Pages:
    """Where the pages are."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("page_size", 100))
        self.total, self.web = options.get("total", "stats.total"), options["path"].startswith(("http://", "https://"))

    def _files(self):
        from pyarrow import fs

        where = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
        system, root = fs.FileSystem.from_uri(where)
        return system, fs.FileSelector(root, allow_not_found=True)

    def _folder(self) -> dict[int, str]:
        """Where each page lies, by one listing."""
        system, folder = self._files()
        return {int(m[1]): i.path for i in reversed(system.get_file_info(folder)) if (m := _PAGE.search(i.path))}

    def _reply(self, n: int, listed: dict[int, str] | None = None) -> dict:
        """listed: filled by a listing the first time that a page has a name of another form, with zeros in front."""
        if self.web:
            mark = "&" if "?" in self.path else "?"
            with urllib.request.urlopen(f"{self.path}{mark}page.from={n * self.size}&page.size={self.size}", timeout=60) as reply:
                return json.load(reply)
        from pyarrow import fs

        system, folder = self._files()
        names = [f"{folder.base_dir.rstrip('/')}/page{sign}{n}{end}" for sign in "-=" for end in ("", ".json")]
        info = next((i for i in system.get_file_info(names) if i.type != fs.FileType.NotFound), None)
        if info is None:
            listed = {} if listed is None else listed
            if not listed:
                listed.update(self._folder())
            info = system.get_file_info(listed[n]) if n in listed else None
        if info is None:
            return {}
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(info.path)) if f.is_file and f.base_name[0] not in "._"]
        text = b"".join(system.open_input_stream(f.path).read() for f in sorted(files, key=lambda f: f.path))
        return json.loads(text or b"{}")

    def records(self, n: int, listed: dict[int, str] | None = None) -> list[dict]:
        return self._reply(n, listed).get("results") or []

    def end(self) -> dict:
        """The offset behind the last record there is."""
        if self.web:
            count = self._reply(0)
            for part in self.total.split("."):
                count = count[part]
            return {"page": count // self.size, "record": count % self.size}
        numbers = self._folder()
        if not numbers:
            return {"page": 0, "record": 0}
        held = len(self.records(max(numbers)))
        return {"page": max(numbers), "record": held} if held < self.size else {"page": max(numbers) + 1, "record": 0}

    def parts(self, start: dict, end: dict) -> list[InputPartition]:
        """(page, first record, record behind the last) for each page between two offsets; lists of them where there are many."""
        last = end["page"] + (end["record"] > 0)
        pages = ((p, start["record"] if p == start["page"] else 0, end["record"] if p == end["page"] else self.size) for p in range(start["page"], last))
        held = [p for p in pages if p[1] < p[2]]
        if len(held) <= MOST_TASKS:
            return [InputPartition(p) for p in held]
        run = -(-len(held) // MOST_TASKS)
        return [InputPartition(held[i : i + run]) for i in range(0, len(held), run)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if part.value is None:
            return
        listed: dict[int, str] = {}
        for page, first, behind in part.value if isinstance(part.value, list) else [part.value]:
            for i, record in enumerate(self.records(page, listed)[:behind]):
                if i >= first:
                    yield page, i, json.dumps(record, ensure_ascii=False), page * self.size + i + 1


def place_of(offset: int, size: int) -> dict:
    return {"page": offset // size, "record": offset % size}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.offset = Pages(options), int(options.get("offset", 0))

    def partitions(self):
        return self.pages.parts(place_of(self.offset, self.pages.size), self.pages.end()) or [InputPartition(None)]

    def read(self, partition):
        return self.pages.read(partition)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages, self.offset = Pages(options), int(options.get("offset", 0))

    def initialOffset(self) -> dict:
        return place_of(self.offset, self.pages.size)

    def latestOffset(self) -> dict:
        first, end = self.initialOffset(), self.pages.end()
        return end if (end["page"], end["record"]) > (first["page"], first["record"]) else first

    def partitions(self, start: dict, end: dict):
        return self.pages.parts(start, end)

    def read(self, partition):
        return self.pages.read(partition)


class Paged(DataSource):
    """spark.dataSource.register(Paged); spark.readStream.format("paged").options(path=..., page_size=..., offset=...)"""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PagedReader(self.options)

    def streamReader(self, schema):
        return PagedStreamReader(self.options)
