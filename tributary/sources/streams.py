"""Typed streams, and reading delimited files into them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARRIVAL = "arrival_timestamp"

#: SQL type names and the Spark types that stand for them.
TYPES = {
    "int2": "smallint", "smallint": "smallint", "int4": "int", "integer": "int", "int": "int", "int8": "bigint", "bigint": "bigint", "oid": "bigint", "serial": "int",
    "float4": "float", "real": "float", "float8": "double", "float": "double", "double precision": "double", "double": "double",
    "numeric": "decimal(38,10)", "decimal": "decimal(38,10)", "money": "decimal(19,2)",
    "text": "string", "varchar": "string", "character varying": "string", "char": "string", "name": "string", "uuid": "string", "inet": "string", "json": "string", "jsonb": "string", "string": "string",
    "bytea": "binary", "binary": "binary", "bool": "boolean", "boolean": "boolean", "bit": "int",
    "date": "date", "time": "string", "timetz": "string", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "timestamp_ltz": "timestamp", "interval": "interval day to second",
}


def spark_type(name: str) -> str:
    """The Spark type of an SQL type name; Spark's own names for arrays, structs and maps pass."""
    text = re.sub(r"\s+", " ", name.strip().lower())
    if text.endswith("[]"):
        return f"array<{spark_type(text[:-2])}>"
    if m := re.fullmatch(r"(numeric|decimal)\s*\((\d+)(?:\s*,\s*(\d+))?\)", text):
        return f"decimal({m[2]},{m[3] or 0})"
    base = re.sub(r"\s*\(\s*\d+\s*\)", "", text)
    if base in TYPES:
        return TYPES[base]
    if re.match(r"(array|struct|map)<|interval ", text):
        return name.strip()
    raise ValueError(f"unknown type {name!r}")


def split_top(text: str, sep: str = ",") -> list[str]:
    """The parts of SQL text between separators outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([<" and not (c == "<" and sep == ","  and text[i + 1 : i + 2] in " =>"):
            depth += 1
        elif c in ")]>" and depth:
            depth -= 1
        elif c == sep and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


@dataclass
class Stream:
    """A named relation of typed columns to which rows are only written. The last column, arrival_timestamp, is implicit."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, ddl: str | StructType) -> Stream:
        """ddl: 'x integer, y text' or a Spark schema."""
        if isinstance(ddl, StructType):
            found = {f.name: f.dataType.simpleString() for f in ddl.fields}
        else:
            pairs = [p.split(None, 1) for p in split_top(ddl)]
            if bad := [p for p in pairs if len(p) != 2]:
                raise ValueError(f"a column needs a name and a type: {' '.join(bad[0])!r}")
            found = {n.strip('"`'): spark_type(t) for n, t in pairs}
        if len(found) < (len(ddl.fields) if isinstance(ddl, StructType) else len(split_top(ddl))):
            raise ValueError("column names must differ")
        if ARRIVAL in found:
            raise ValueError(f"{ARRIVAL} is a reserved column")
        return cls(name, found)

    def add_column(self, name: str, kind: str) -> None:
        if name in self.columns or name == ARRIVAL:
            raise ValueError(f"column {name!r} exists already")
        self.columns[name] = spark_type(kind)

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in [*self.columns.items(), (ARRIVAL, "timestamp")])

    def coerce(self, df: DataFrame, columns: list[str] | None = None, now: Column | None = None) -> DataFrame:
        """df's columns, or its columns in order under the names given, as the stream's: cast, and null where missing.

        A value that its type can't hold is an error. Rows without a time of arrival get now.
        """
        if columns is not None:
            if len(columns) != len(df.columns):
                raise ValueError(f"{len(df.columns)} values for {len(columns)} columns")
            df = df.toDF(*columns)
        if unknown := [c for c in df.columns if c not in self.columns and c != ARRIVAL]:
            raise ValueError(f"stream {self.name!r} has no column {unknown[0]!r}")
        now = F.current_timestamp() if now is None else now
        there = {c: F.col(f"`{c}`") for c in df.columns}
        cast = [(there[n].cast(t) if n in there else F.lit(None).cast(t)).alias(n) for n, t in self.columns.items()]
        return df.select(*cast, F.coalesce(there.get(ARRIVAL, F.lit(None)).cast("timestamp"), now.cast("timestamp")).alias(ARRIVAL))


#: Options of COPY to those of Spark's CSV reader.
COPY_OPTIONS = {"delimiter": "sep", "null": "nullValue", "header": "header", "quote": "quote", "escape": "escape", "encoding": "encoding"}


def read_copy(spark: SparkSession, stream: Stream, path: str | list[str], format: str = "text", columns: list[str] | None = None, **options) -> DataFrame:
    """Rows of delimited files for a stream. format: text (tabs, \\N for null) or csv.

    Options are those of COPY: delimiter, null, header, quote, escape, encoding. A malformed line is an error.
    """
    if format not in ("text", "csv"):
        raise ValueError(f"format {format!r} can't be read")
    names = columns or list(stream.columns)
    if missing := [c for c in names if c not in stream.columns and c != ARRIVAL]:
        raise ValueError(f"stream {stream.name!r} has no column {missing[0]!r}")
    if odd := [o for o in options if o not in COPY_OPTIONS]:
        raise ValueError(f"unknown option {odd[0]!r}")
    if format == "text" and (bad := {"header", "quote", "escape"} & {k for k, v in options.items() if v}):
        raise ValueError(f"{min(bad)} is for csv only")
    base = {"sep": "\t", "nullValue": "\\N", "quote": "", "escape": "\\"} if format == "text" else {"sep": ",", "nullValue": "", "quote": '"', "escape": '"', "multiLine": "true"}
    base |= {COPY_OPTIONS[k]: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    schema = ", ".join(f"`{c}` {stream.columns.get(c, 'timestamp')}" for c in names)
    return spark.read.schema(schema).options(mode="FAILFAST", **base).csv(path)
