"""Report tables: several small tables in one text file, each with a title line, a header and columns of fixed widths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "#:Table:"


def render(tables: dict[str, DataFrame], most_rows: int = 100_000) -> str:
    """The text of small tables (sorted by their columns); a table of more than ``most_rows`` rows is an error."""
    parts = []
    for name, df in tables.items():
        rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns]).orderBy(*df.columns).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        width = [max([len(c), *(len(r[k]) for r in rows)]) for k, c in enumerate(df.columns)]
        lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [df.columns, *rows]]
        parts.append("\n".join([f"{MARK}{name}:{len(df.columns)}:{len(rows)}", *lines]))
    return "\n\n".join(parts) + "\n"


def write_report(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """One text part below ``path``; the tables are aggregates, small by their kind."""
    spark.createDataFrame([(render(tables),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def parse(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(table, row number, column -> text) of a report; a cell ends at two blanks or the line's end."""
    name, header, left, row = "", None, 0, 0
    for line in text.splitlines():
        if line.startswith(MARK):
            title, _, rows = line[len(MARK) :].rsplit(":", 2)
            name, header, left, row = title, None, int(rows) + 1, 0
        elif left and line.strip():
            cells = [c for c in line.strip().split("  ") if c]
            cells = [c.strip() for c in cells]
            left -= 1
            if header is None:
                header = cells
                continue
            if len(cells) != len(header):
                raise ValueError(f"{name}: row {row} has {len(cells)} cells, not {len(header)}")
            yield name, row, dict(zip(header, cells, strict=True))
            row += 1


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, table, row, cells) for every row of the reports at ``path``; cells: column -> text. A file is read whole by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *x) for p, t in zip(b["path"], b["value"], strict=True) for x in parse(t)]
            yield pd.DataFrame(out, columns=["path", "table", "row", "cells"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, "path string, table string, row int, cells map<string,string>")
