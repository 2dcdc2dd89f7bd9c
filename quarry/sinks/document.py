"""One document from many tasks: a data source writer whose commit joins the parts in order.

Each task writes the lines of each section that it has to a file of its own beside the target. The
commit puts the document together from fixed texts and sections, reading a part at a time in blocks,
and moves it into place when it is whole; parts of attempts that failed are never read. So a report
of any number of rows is one valid file, and no row, task or driver holds more than a block of it.

Sections come in the order of the layout; in a section lines come by task, and in a task in the
order of its rows, so a sorted table gives a sorted section. An empty section leaves nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quarry.shipping import ship
from quarry.sinks import reports

BLOCK = 4 << 20


@dataclass
class Parts(WriterCommitMessage):
    #: (section, task, file, lines)
    files: list[tuple[int, int, str, int]] = field(default_factory=list)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z0-9+]+:", path) is None:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.layout, self.between = options["path"], json.loads(options["layout"]), options.get("between", ",\n")
        self.run = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        store, path = _store(self.path)
        return store, path, f"{path}.parts-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, _, folder = self._folder()
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        number, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        out: dict[int, list] = {}
        between = self.between.encode()
        for batch in iterator:
            for section, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if section not in out:
                    name = f"{folder}/{section}-{number}-{attempt}"
                    out[section] = [store.open_output_stream(name), name, 0]
                stream = out[section]
                if stream[2]:
                    stream[0].write(between)
                stream[0].write((line or "").encode("utf-8", "surrogatepass"))
                stream[2] += 1
        for stream, _, _ in out.values():
            stream.close()
        return Parts([(section, number, name, n) for section, (_, name, n) in out.items()])

    def commit(self, messages: list[Parts | None]) -> None:
        store, path, folder = self._folder()
        parts = sorted(f for m in messages if m is not None for f in m.files)
        store.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with store.open_output_stream(whole) as out:
            for piece in self.layout:
                if isinstance(piece, str):
                    out.write(piece.encode())
                    continue
                for k, (_, _, name, _) in enumerate(p for p in parts if p[0] == piece):
                    if k:
                        out.write(self.between.encode())
                    with store.open_input_stream(name) as part:
                        while block := part.read(BLOCK):
                            out.write(block)
        store.move(whole, path)
        store.delete_dir(folder)

    def abort(self, messages: list[Parts | None]) -> None:
        store, _, folder = self._folder()
        if store.get_file_info(folder).type != pafs.FileType.NotFound:
            store.delete_dir(folder)


class Document(DataSource):
    """Options: path, layout (a JSON list of texts and section numbers), between (what stands between lines)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(rows: DataFrame, path: str, layout: list[str | int], between: str = ",\n") -> None:
    """``rows``: section, line. ``path`` is replaced, if it is there, when the new document is whole."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Document)
    out = rows.select(F.col("section").cast("int").alias("section"), F.col("line").cast("string").alias("line"))
    out.write.format("quarry_document").options(layout=json.dumps(layout), between=between).mode("append").save(path)


def write_json_report(path: str, summary: DataFrame, **parts: DataFrame) -> None:
    """The document of ``reports.json_report``: the summary's fields and each part as an array."""
    line = lambda k, df: df.select(F.lit(k).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    rows, layout = line(0, summary), ['{"summary":', 0]
    for k, (name, df) in enumerate(parts.items(), 1):
        rows = rows.unionByName(line(k, df))
        layout += [f",{json.dumps(name)}:[", k, "]"]
    write_document(rows, path, [*layout, "}"])


def write_sarif(findings: DataFrame, path: str, tool: str, version: str = "1.0") -> None:
    """The document of ``reports.sarif``, whatever the number of findings; rules by name."""
    results = reports.sarif_results(findings)
    rules = results.select("rule").distinct().filter("rule IS NOT NULL").orderBy("rule").select(F.lit(0).alias("section"), F.to_json(F.struct(F.col("rule").alias("id"))).alias("line"))
    rows = rules.unionByName(results.select(F.lit(1).alias("section"), F.col("result").alias("line")))
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"version":' + json.dumps(version) + ',"rules":['
    write_document(rows, path, [head, 0, ']}},"results":[', 1, "]}]}"])
