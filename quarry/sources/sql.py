"""Parsers called from SQL, as a table function over a table of files.

    SELECT * FROM parse_code(TABLE(files) PARTITION BY (project, file))

The table has project, file, lang and content, in any order and among others; the rows are those of
``parse.parsed``. A reader that fails on a file gives an error row for it. ``parsers`` replaces or
adds readers by language, so one session can have several functions of different names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.shipping import ship
from quarry.sources import parse

NEEDED = ("project", "file", "lang", "content")


def table_function(parsers: dict[str, Callable[[str, str], list[dict]]] | None = None):
    """The function's class, for ``udtf``."""
    own, schema = dict(parsers or {}), StructType.fromDDL(parse.SCHEMA)

    class ParseCode:
        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable:
                raise ValueError("parse_code takes a table: parse_code(TABLE(files) PARTITION BY (project, file))")
            there = {f.name for f in files.dataType.fields}
            if missing := [c for c in NEEDED if c not in there]:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            return AnalyzeResult(schema=schema)

        def eval(self, files: Row):
            for r in parse.rows_of(*(files[c] for c in NEEDED), own):
                r["specifiers"] = [Row(**s) for s in r["specifiers"]]
                yield tuple(r[f] for f in parse.FIELDS)

    return ParseCode


def register(spark: SparkSession, name: str = "parse_code", parsers: dict[str, Callable[[str, str], list[dict]]] | None = None) -> None:
    ship(spark)
    spark.udtf.register(name, udtf(table_function(parsers)))
