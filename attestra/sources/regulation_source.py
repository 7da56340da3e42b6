"""``spark.read.format("regulation")``: regulation pages, fetched in parallel, one partition a source.

Options: ``codes`` (comma-separated; all registered ones unless given), ``at``
(where a source's page is; ``{code}`` and ``{celex}`` stand for its names, and
the registry's address is used unless given), ``attempts``, ``wait`` (seconds,
twice as long after every attempt), ``timeout``, ``least`` (characters).

A page over HTTP is taken only with status 200 and more than ``least``
characters, since a busy server answers with something else; a landed one (any
other address that Arrow's file systems open: a file, or a folder of parts) if
it has ``least`` or more.  What can't be had is a row without html whose
``problem`` says why: nothing else fails with it, and reading again asks again.
A filter on ``code`` keeps other sources from being fetched at all.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from attestra.functions import text as T
from attestra.operators.ingestion import REGISTRY, URL
from attestra.sources.readers import LEAST_CHARS

SCHEMA = "code string, celex string, url string, html string, attempts int, problem string"
# Attempts, and seconds before the second one.
ATTEMPTS, WAIT = 4, 3.0
_CELEX = {r[0]: r[3] for r in REGISTRY.rows}


class Waiting(Exception):
    """An answer that isn't the page, but may be one later."""


class Page(InputPartition):
    def __init__(self, code: str):
        super().__init__(code)


class RegulationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "regulation"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RegulationReader(dict(self.options))


class RegulationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.codes = [c.strip() for c in options.get("codes", ",".join(_CELEX)).split(",") if c.strip()]
        self.place = options.get("at", URL.replace("%s", "{celex}"))
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", WAIT))
        self.timeout, self.least = float(options.get("timeout", 60)), int(options.get("least", LEAST_CHARS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("code",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = [c for c in self.codes if c in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Page(c) for c in self.codes] or [Page("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        code = partition.value
        if not code:  # every source is filtered out
            return
        celex = _CELEX.get(code)
        if celex is None and "{celex}" in self.place:
            yield code, None, None, None, 0, "unknown source"
            return
        url, pause, problem = self.place.format(code=code, celex=celex), self.wait, None
        for attempt in range(1, self.attempts + 1):
            try:
                yield code, celex, url, self._page(url), attempt, None
                return
            except Waiting as e:
                problem = str(e)
            except Exception as e:
                yield code, celex, url, None, attempt, f"{type(e).__name__}: {e}"[:300]
                return
            if attempt < self.attempts:
                time.sleep(pause)
                pause *= 2
        yield code, celex, url, None, self.attempts, problem

    def _page(self, url: str) -> str:
        if not url.startswith(("http://", "https://")):
            html = _landed(url)
            if len(html) < self.least:
                raise ValueError(f"only {len(html)} characters")
            return html
        request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0", "Accept": "text/html", "Accept-Language": "fr"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            html = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            if answer.status != 200 or len(html) <= self.least:
                raise Waiting(f"status {answer.status} with {len(html)} characters")
            return html


def _landed(url: str) -> str:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(url)
    if files.get_file_info(path).type == fs.FileType.Directory:
        parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
    else:
        parts = [path]
    read = []
    for part in parts:
        with files.open_input_stream(part) as stream:
            read.append(stream.read())
    return b"".join(read).decode("utf-8", "replace")


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegulationSource)


def lines(pages: DataFrame) -> DataFrame:
    """source, line_no, line of the pages that were had: what :func:`ingestion.articles` takes."""
    had = pages.filter("html is not null").select(F.col("code").alias("source"), F.posexplode(T.html_lines(F.col("html"))).alias("line_no", "line"))
    return had.withColumn("line_no", F.col("line_no") + 1)
