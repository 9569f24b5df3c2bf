"""Tables that are stored as numbered pages of JSON, as paged interfaces give them, and a reader for them.

A page holds a fixed number of rows in ascending order of a key, the last one fewer; so a page's number
tells where its rows stand in the table, and reading ends at the first short page. A page file is a line
with its number of rows and the least and greatest value of every column, then a line for each row. The
reader takes ranges of pages in parallel, passes over pages whose first line rules out all rows, and
filters the rows of others itself.
"""

from __future__ import annotations

import datetime
import json
import operator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.numbering import numbered

#: Rows of a page, as the paged interface of the listings has it (a fixed value).
PAGE_ROWS = 1000
#: Pages that one task reads, at least.
PAGES_PER_TASK = 64
TIMES = (T.TimestampType, T.TimestampNTZType)
PLAIN = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, *TIMES)


def _opened(folder: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    return fs, path.rstrip("/")


def _page_name(number: int) -> str:
    return f"page-{number:012d}.jsonl"


def _plain(value):
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def _page(rows: list[dict]) -> bytes:
    head = {"rows": len(rows), "least": {}, "most": {}}
    for c in rows[0]:
        known = [r[c] for r in rows if r[c] is not None]
        if known:
            head["least"][c], head["most"][c] = _plain(min(known)), _plain(max(known))
    lines = [head, *({c: _plain(v) for c, v in r.items()} for r in rows)]
    return ("\n".join(map(json.dumps, lines)) + "\n").encode()


def write_pages(rows: DataFrame, folder: str, key: str, size: int = PAGE_ROWS) -> int:
    """Write rows of plain columns as pages in ascending order of ``key``, all in parallel; returns how many.

    A page that is written twice is the same page, so tasks may be tried again.
    """
    if other := [f.name for f in rows.schema.fields if not isinstance(f.dataType, PLAIN)]:
        raise ValueError(f"no plain columns: {other}")

    def run(batches):
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        number, held = None, []

        def close():
            with fs.open_output_stream(f"{root}/{_page_name(number)}", compression=None) as f:
                f.write(_page(held))

        written = []
        for batch in batches:
            for row in batch.to_pylist():
                page = row.pop("_page")
                if page != number:
                    if held:
                        close()
                    number, held = page, []
                    written.append(page)
                held.append(row)
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.int64())], ["page"])

    paged = numbered(rows, [key], "_row").withColumn("_page", F.floor((F.col("_row") - 1) / size)).drop("_row", "_row_total")
    paged = paged.repartition("_page").sortWithinPartitions("_page", key)
    return paged.mapInArrow(run, "page long").count()


#: Filters that the reader takes, with what a page's least and greatest values must be for a row to pass.
TESTS = {
    D.EqualTo: (operator.eq, lambda least, most, x: least <= x <= most),
    D.GreaterThan: (operator.gt, lambda least, most, x: most > x),
    D.GreaterThanOrEqual: (operator.ge, lambda least, most, x: most >= x),
    D.LessThan: (operator.lt, lambda least, most, x: least < x),
    D.LessThanOrEqual: (operator.le, lambda least, most, x: least <= x),
}


@dataclass
class PageRange(D.InputPartition):
    first: int
    end: int


class PagesReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.folder = schema, options["path"]
        self.size, self.key = int(options.get("pageSize", PAGE_ROWS)), options.get("key")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and column in self.schema.names:
                self.tests.append((column, type(f), f.value))
            elif not (isinstance(f, D.IsNotNull) and any(c == column for c, _, _ in self.tests)):
                yield f

    def partitions(self):
        fs, root = _opened(self.folder)
        names = [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))]
        count = sum(n.startswith("page-") for n in names)
        return [PageRange(a, min(a + PAGES_PER_TASK, count)) for a in range(0, count, PAGES_PER_TASK)] or [PageRange(0, 0)]

    def read(self, partition: PageRange):
        fs, root = _opened(self.folder)
        arrow, last = to_arrow_schema(self.schema), None
        read = {f.name: self._reader(f.dataType) for f in self.schema.fields}
        for number in range(partition.first, partition.end):
            with fs.open_input_stream(f"{root}/{_page_name(number)}") as stream:
                head, rest = self._head(stream)
                if self._may_pass(head, read):
                    rows = []
                    for line in (rest + stream.read()).decode().splitlines():
                        row = json.loads(line)
                        if self.key is not None:
                            if last is not None and row[self.key] is not None and row[self.key] < last:
                                raise ValueError(f"{_page_name(number)} is not in order of {self.key}")
                            last = row[self.key] if row[self.key] is not None else last
                        row = {c: read[c](row.get(c)) for c in arrow.names}
                        if all(row[c] is not None and TESTS[kind][0](row[c], x) for c, kind, x in self.tests):
                            rows.append(row)
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            if head["rows"] < self.size:
                return

    @staticmethod
    def _head(stream, step: int = 4096) -> tuple[dict, bytes]:
        """The first line and what was read beyond it."""
        got = b""
        while b"\n" not in got:
            more = stream.read(step)
            if not more:
                raise ValueError("a page without its first line")
            got += more
        line, rest = got.split(b"\n", 1)
        return json.loads(line), rest

    def _may_pass(self, head: dict, read: dict) -> bool:
        for c, kind, x in self.tests:
            if c not in head["least"] or not TESTS[kind][1](read[c](head["least"][c]), read[c](head["most"][c]), x):
                return False
        return True

    @staticmethod
    def _reader(kind: T.DataType):
        if isinstance(kind, TIMES):
            utc = isinstance(kind, T.TimestampType)
            parse = datetime.datetime.fromisoformat
            return lambda v: None if v is None else parse(v) if not utc or parse(v).tzinfo else parse(v).replace(tzinfo=datetime.UTC)
        if isinstance(kind, T.DateType):
            return lambda v: None if v is None else datetime.date.fromisoformat(v)
        return lambda v: v


class StoredPages(D.DataSource):
    """``spark.read.format("stored_pages").schema(...).option("path", ...)``; options pageSize and key.

    The schema names the columns wanted. With ``key`` rows must ascend in it, else reading fails.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self):
        raise ValueError("name the columns that are wanted, as a schema")

    def reader(self, schema: T.StructType) -> PagesReader:
        return PagesReader(schema, self.options)


def paged_table(spark: SparkSession, folder: str, schema: T.StructType | str, size: int = PAGE_ROWS, key: str | None = None) -> DataFrame:
    """The rows of stored pages; equality and range filters on columns go to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredPages)
    reader = spark.read.format("stored_pages").schema(schema).option("path", folder).option("pageSize", size)
    return (reader.option("key", key) if key else reader).load()
