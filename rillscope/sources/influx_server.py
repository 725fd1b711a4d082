"""A live source: ranges of time are asked for by tasks of their own.

    spark.dataSource.register(InfluxServer)
    spark.read.format("rill_influx").options(url=..., org=..., token=..., query=..., start=..., stop=..., parts=16).load()

``query`` holds {start} and {stop}, which become the bounds of each part.  The
option ``transport`` names another function ("module:function") that takes the
options and a query and gives lines of annotated CSV, for other servers or an
archive; the default asks over HTTP.  A part that fails is asked for again by
Spark's own retries.
"""

from __future__ import annotations

import csv
import importlib
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .influx import NO_TAGS, VALUES

SCHEMA = "epoch double, rtt_value double, source string, destination string, tags map<string,string>"
ROWS = 10_000


def over_http(options: dict[str, str], query: str) -> Iterator[str]:
    """Lines of the answer to a query."""
    request = urllib.request.Request(f"{options['url'].rstrip('/')}/api/v2/query?org={options.get('org', '')}", query.encode(), {"Authorization": f"Token {options.get('token', '')}", "Content-Type": "application/vnd.flux", "Accept": "application/csv"})
    with urllib.request.urlopen(request, timeout=float(options.get("timeout", 60))) as answer:
        for line in answer:
            yield line.decode()


def _seconds(text: str) -> float | None:
    try:
        return int(text) / 1e9 if text.lstrip("-").isdigit() else datetime.fromisoformat(text).astimezone(UTC).timestamp()
    except ValueError:
        return None


def rows_of(lines: Iterable[str]) -> Iterator[tuple]:
    """(epoch, rtt_value, source, destination, tags) of lines of annotated CSV with several tables; rows without a time or number are left out."""
    names: list[str] | None = None
    defaults: list[str] = []
    for row in csv.reader(lines):
        if not any(row):
            names, defaults = None, []
        elif row[0].startswith("#"):
            names = None
            if row[0] == "#default":
                defaults = row
        elif names is None:
            names = row
            if {"error", "reference"} <= set(row):
                raise ValueError(f"the server answers with an error: {', '.join(row)}")
        else:
            if "error" in names:
                raise ValueError(f"the server answers with an error: {', '.join(row)}")
            got = {n: v or (defaults[i] if i < len(defaults) else "") for i, (n, v) in enumerate(zip(names, row, strict=False))}
            value = next((got[v] for v in VALUES if got.get(v)), "")
            epoch = _seconds(got.get("_time", ""))
            try:
                number = float(value)
            except ValueError:
                continue
            if epoch is not None:
                yield epoch, number, got.get("source") or None, got.get("destination") or None, {k: v for k, v in got.items() if k not in NO_TAGS and v}


class _Part(InputPartition):
    def __init__(self, start: float, stop: float):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Part]:
        start, stop, n = float(self.options["start"]), float(self.options["stop"]), int(self.options.get("parts", 1))
        edges = [start + (stop - start) * k / n for k in range(n)] + [stop]
        return [_Part(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        found: Callable[[dict[str, str], str], Iterable[str]] = over_http
        if name := self.options.get("transport"):
            module, function = name.split(":")
            found = getattr(importlib.import_module(module), function)
        stamp = lambda s: datetime.fromtimestamp(s, UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
        query = self.options["query"].replace("{start}", stamp(partition.start)).replace("{stop}", stamp(partition.stop))
        schema = pa.schema([("epoch", pa.float64()), ("rtt_value", pa.float64()), ("source", pa.string()), ("destination", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if f.name == "tags" else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for row in rows_of(found(self.options, query)):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()


class InfluxServer(DataSource):
    """The format "rill_influx"."""

    @classmethod
    def name(cls) -> str:
        return "rill_influx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        missing = [o for o in ("query", "start", "stop") if o not in self.options]
        if missing:
            raise ValueError(f"options are missing: {', '.join(missing)}")
        return _Reader(dict(self.options))


def read_server(spark: SparkSession, mode: str = "drop", series: str | None = None, **options: str) -> DataFrame:
    """Samples of a range of time from a server; see the module for the options."""
    from .influx import series_of
    from .readers import normalize

    spark.dataSource.register(InfluxServer)
    rows = spark.read.format("rill_influx").options(**{k: str(v) for k, v in options.items()}).load()
    name = series_of("tags") if series == "*" else F.try_element_at("tags", F.lit(series)) if series else F.lit("all")
    return normalize(rows.withColumn("series_id", name), "series_id", mode)
