"""Delimited text, in and out.

Fields are read as strings and converted column by column, so each type has its
own idea of what is missing: whatever is not a number for numbers, a chosen text
for strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import values as V
from quern.operators.table import Table

#: Fixed values.
ENCODINGS = {"utf8": "UTF-8", "ascii": "US-ASCII", "iso88591": "ISO-8859-1", "utf16": "UTF-16"}


@dataclass(frozen=True)
class Field:
    """One column of a file: where it stands (from 0), its type, and how to read it."""

    index: int
    kind: str
    missing: str | None = None
    pattern: str | None = None

    def read(self, raw: Column) -> Column:
        if self.kind == "int":
            return V.to_int(F.trim(raw))
        if self.kind == "long":
            return V.to_long(F.trim(raw))
        if self.kind == "double":
            return V.to_double(F.trim(raw))
        if self.kind == "instant":
            return V.to_instant(V.parse_instant(F.nullif(raw, F.lit("NA")), self.pattern))
        raw = F.coalesce(raw, F.lit(""))  # the reader gives an empty field as NULL
        return F.nullif(raw, F.lit(self.missing)) if self.missing is not None else raw


def int_field(index: int) -> Field:
    return Field(index, "int")


def long_field(index: int) -> Field:
    return Field(index, "long")


def double_field(index: int) -> Field:
    return Field(index, "double")


def str_field(index: int, missing: str | None = None) -> Field:
    return Field(index, "str", missing)


def instant_field(index: int, pattern: str | None = None) -> Field:
    """ISO text, or local text of a pattern taken at UTC."""
    return Field(index, "instant", pattern=pattern)


def import_csv(
    spark: SparkSession,
    paths: str | list[str],
    fields: dict[str, Field] | list[Field],
    *,
    separator: str = ",",
    header: bool = False,
    record_separator: str | None = None,
    encoding: str = "utf8",
    strict: bool = False,
    line_breaks: bool = False,
    max_lines: int | None = None,
) -> Table:
    """Files (gzip by their ending) as one table of the given fields.

    A dict names them; a list takes names from the header, or ``V0``, ``V1``, ...
    A line with too few or too many fields is an error. Bytes that the encoding
    doesn't know become U+FFFD, or with ``strict`` an error (so does a U+FFFD).
    ``line_breaks`` allows quoted fields to hold them; each file is then read by
    one task, and ``record_separator`` keeps breaks of another kind as they are.
    ``max_lines`` are the first of each file and count its header.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("sep", separator).option("mode", "FAILFAST").option("encoding", ENCODINGS.get(encoding, encoding)).option("quote", '"').option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("multiLine", line_breaks)
    if record_separator:
        reader = reader.option("lineSep", record_separator)
    names = reader.option("header", header).csv(paths[0]).columns  # one line of one file
    raw = reader.option("header", header).option("enforceSchema", True).option("nullValue", "\0").option("emptyValue", "").schema(", ".join(f"`c{i}` string" for i in range(len(names))))
    if max_lines is None:
        raw = raw.csv(paths)
    else:
        place = (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # the order of lines in a file
        heads = [raw.csv(f).orderBy(*place).limit(max(0, max_lines - bool(header))) for f in raw.csv(paths).inputFiles()]
        raw = reduce(DataFrame.unionAll, heads)
    if strict:
        bad = F.raise_error(F.lit(f"bytes that are not {encoding}"))
        raw = raw.select(*(F.when(F.contains(c, F.lit("\ufffd")), bad).otherwise(F.col(c)).alias(c) for c in raw.columns))
    if not isinstance(fields, dict):
        fields = {(names[f.index] if header else f"V{f.index}"): f for f in sorted(fields, key=lambda f: f.index)}
    return Table(raw.select(*(f.read(F.col(f"c{f.index}")).alias(name) for name, f in fields.items())))


def export_csv(table: Table, path: str, *, separator: str = ",", record_separator: str = "\r\n", quote: str = '"', gzip: bool = True) -> list[str]:
    """One file a partition, without header; missing values as ``NA``, missing doubles as ``NaN``.

    Strings keep their blanks, and are quoted where they are empty or hold separators, quotes or line breaks.
    """
    special = f"[{re.escape(separator + quote)}\\r\\n]"

    def field(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "string":
            quoted = F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
            return F.coalesce(F.when((c == "") | c.rlike(special), quoted).otherwise(c), F.lit("NA"))
        return F.coalesce(V.to_iso(c) if kind == "timestamp" else c.cast("string"), F.lit("NaN" if kind == "double" else "NA"))

    lines = table.df.select(F.concat_ws(separator, *(field(c, t) for c, t in table.df.dtypes)).alias("line"))
    lines.write.option("lineSep", record_separator).option("compression", "gzip" if gzip else "none").text(path)
    return sorted(table.df.sparkSession.read.text(path).inputFiles())
