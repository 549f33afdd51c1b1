"""Documents of **Field:** lines under headings, such as registers of sources, as rows; and flat settings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r"^\*\*([A-Za-z][\w-]*):\*\*\s*(.+?)\s*$")
_SETTING = re.compile(r"^\s*([A-Za-z_][\w-]*):\s*(.*?)\s*$")
FIELDS = "path string, section string, entry int, heading string, field string, value string, line int"
_SCHEMA = pa.schema([("path", pa.string()), ("section", pa.string()), ("entry", pa.int32()), ("heading", pa.string()), ("field", pa.string()), ("value", pa.string()), ("line", pa.int32())])


def field_lines(text: str | None) -> Iterator[tuple[str | None, int, str | None, str | None, str | None, int]]:
    """section, entry, heading, field, value, line of each field line and each entry's heading; comments over lines are left out.

    Entries are numbered through the document from 1; fields before a section's first entry have number 0.
    """
    section, entry, heading, number, commented = None, 0, None, 0, False
    for i, raw in enumerate((text or "").splitlines(), 1):
        line = raw.rstrip()
        if commented:
            commented = "-->" not in line
        elif line.lstrip().startswith("<!--") and "-->" not in line:
            commented = True
        elif line.startswith("## "):
            section, heading, entry = line[3:].strip().lower(), None, 0
        elif line.startswith("### "):
            number += 1
            heading, entry = line[4:].strip(), number
            yield section, entry, heading, None, None, i
        elif m := _FIELD.match(line):
            yield section, entry, heading, m[1].lower(), m[2].strip(), i


def fields(files: DataFrame) -> DataFrame:
    """field_lines of each of files (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *row) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in field_lines(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)

    return files.select("path", "text").mapInArrow(run, FIELDS)


def settings(text: str | None) -> dict[str, str]:
    """Flat settings, the last of equal names, without comments behind them."""
    found = {}
    for line in (text or "").splitlines():
        if m := _SETTING.match(line):
            found[m[1]] = m[2].split("#", 1)[0].strip().strip('"')
    return found


def setting_rows(files: DataFrame) -> DataFrame:
    """path, name, value of files (path, text) of flat settings; of equal names the last."""
    each = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("at", "line"))
    name, value = F.regexp_extract("line", r"^\s*([A-Za-z_][\w-]*):", 1), F.trim(F.substring_index(F.regexp_replace("line", r"^[^:]*:", ""), "#", 1))
    return each.select("path", "at", name.alias("name"), F.trim(F.regexp_replace(value, '^"|"$', "")).alias("value")).filter("name <> ''").groupBy("path", "name").agg(F.max_by("value", "at").alias("value"))
