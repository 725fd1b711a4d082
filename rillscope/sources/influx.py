"""Exports of a time-series database: annotated CSV and line protocol, read in splits.

A line of annotated CSV means what the header, the types and the defaults of its
table say, which stand somewhere before it in the file.  Lines are numbered by
the split that they are in and their order there; the last header (and types,
defaults) of each split is a small aggregate, carried over to the splits after
it, so a file is cut into as many tasks as Spark likes.

Broken lines (no header before them, a wrong time or number, an unfinished line
of the protocol) carry the reason and are left out or, in the mode "strict",
raise.  A field that holds a line break is not supported and gives broken lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VALUES = ("_value", "rtt", "latency", "values")
#: Columns of a table that say nothing about its series.
NO_TAGS = ("", "result", "table", "_start", "_stop", "_time", "_value", "rtt", "latency", "values")
#: Units of a line's time, as divisors to microseconds (ns) or factors.
PRECISION = {"ns": 0.001, "us": 1, "ms": 1_000, "s": 1_000_000}
HEADER = r'^(.*,)?"?_time"?(,.*)?$'
ERROR_TABLE = r'^,?"?error"?,"?reference"?$'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line): lines of text files; ``at`` is their order within a split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))


def fields(line: Column) -> Column:
    """The fields of a line of CSV, quotes taken off."""
    bare = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    quoted = F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), bare)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def carried(lines: DataFrame, **marks: Column) -> DataFrame:
    """With the last non-null value of each mark up to each line of its file."""
    marked = lines.withColumns({f"{n}_here": c for n, c in marks.items()})
    each = Window.partitionBy("file", "split").orderBy("at")
    upto = each.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda n: F.max_by(f"{n}_here", F.when(F.col(f"{n}_here").isNotNull(), F.col("at")))
    per_split = marked.groupBy("file", "split").agg(*(last(n).alias(n) for n in marks))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = per_split.select("file", "split", *(F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_before") for n in marks))
    found = marked.withColumns({n: F.last(f"{n}_here", ignorenulls=True).over(upto) for n in marks} | {"seq": F.col("split") + F.row_number().over(each)})
    # A line takes a byte at least, so split + rank rises within a file.
    joined = found.join(before, ["file", "split"])
    return joined.select("file", "seq", "line", *(F.coalesce(n, f"{n}_before").alias(n) for n in marks))


def _at(names: str, values: str, name: str) -> Column:
    """The value in the place where ``names`` has ``name``, or null."""
    return F.get(values, F.array_position(names, name).cast("int") - 1)


def _micros(text: str) -> Column:
    """Whole microseconds of a text of nanoseconds; null where it is no number."""
    return F.expr(f"(try_cast({text} AS bigint) - pmod(try_cast({text} AS bigint), 1000)) div 1000")


def annotated_csv(lines: DataFrame) -> DataFrame:
    """(file, seq, line, time_us, rtt_value, tags, broken) of the lines of annotated CSV (a header alone will do)."""
    line = F.col("line")
    blank, note = F.trim(line) == "", line.startswith("#")
    header = ~note & (line.rlike(HEADER) | line.rlike(ERROR_TABLE))
    ends = F.when(blank, "")
    rows = carried(lines, header=F.when(header, line).otherwise(ends), types=F.when(line.startswith("#datatype"), line).otherwise(ends), defaults=F.when(line.startswith("#default"), line).otherwise(ends))
    rows = rows.where(~blank & ~note & ~header).withColumns({"names": fields(F.col("header")), "given": fields(line), "kinds": fields(F.col("types")), "else_": fields(F.col("defaults"))})
    rows = rows.withColumn("values", F.transform("given", lambda v, i: F.when(v == "", F.coalesce(F.get("else_", i), v)).otherwise(v)))
    time, kind = F.nullif(_at("names", "values", "_time"), F.lit("")), _at("names", "kinds", "_time")
    numeric = kind.isin("dateTime:number", "long") | time.rlike(r"^\d{16,19}$")
    rows = rows.withColumn("time_text", time)
    rows = rows.withColumn("time_us", F.when(numeric, _micros("time_text")).otherwise(F.unix_micros(F.expr("try_cast(time_text AS timestamp)"))))
    value = F.coalesce(*(F.nullif(_at("names", "values", v), F.lit("")) for v in VALUES))
    rows = rows.withColumn("value_text", value).withColumn("rtt_value", F.expr("try_cast(value_text AS double)"))
    entries = F.filter(F.arrays_zip(F.col("names").alias("k"), F.slice("values", F.lit(1), F.size("names")).alias("v")), lambda e: ~e["k"].isin(*NO_TAGS) & e["k"].isNotNull() & (F.coalesce(e["v"], F.lit("")) != ""))
    tags = F.map_from_entries(F.array_distinct(F.transform(entries, lambda e: F.struct(e["k"], e["v"]))))
    broken = F.when(F.coalesce("header", F.lit("")) == "", "no header").when(F.col("header").rlike(ERROR_TABLE), "error table").when(F.size("given") != F.size("names"), "fields").when(F.col("time_us").isNull(), "time").when(F.col("rtt_value").isNull() | F.isnan("rtt_value"), "value")
    return rows.select("file", "seq", "line", "time_us", "rtt_value", F.when(broken.isNull(), tags).alias("tags"), broken.alias("broken"))


_KEY = r"((?:[^\\ ]|\\.)+)"
_FIELDS = r'((?:[^\\" ]|\\.|"(?:[^"\\]|\\.)*")+)'
_NAME = r"((?:[^\\,=]|\\.)+)"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([,= ])", "$1")


def line_protocol(lines: DataFrame, precision: str = "ns") -> DataFrame:
    """(file, seq, line, time_us, rtt_value, tags, broken) of the lines of the protocol; each line has its time."""
    each = Window.partitionBy("file", "split").orderBy("at")
    rows = lines.withColumn("seq", F.col("split") + F.row_number().over(each)).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    whole = f"^{_KEY} +{_FIELDS}(?: +(-?\\d+))? *$"
    part = lambda k: F.regexp_extract("line", whole, k)
    rows = rows.withColumns({"key": part(1), "pairs": part(2), "time_text": part(3)})
    value = r'(?:^|,)' + _NAME + r'=("(?:[^"\\]|\\.)*"|[^,"]*)'
    rows = rows.withColumns({"names": F.transform(F.regexp_extract_all("pairs", F.lit(value), F.lit(1)), _plain), "values": F.regexp_extract_all("pairs", F.lit(value), F.lit(2))})
    wanted = ("_value", "rtt", "latency", "values", "rtt_value", "value")
    text = F.regexp_replace(F.coalesce(*(_at("names", "values", v) for v in wanted)), "[iu]$", "")
    rows = rows.withColumn("value_text", text).withColumn("rtt_value", F.expr("try_cast(value_text AS double)"))
    unit = PRECISION[precision]
    us = _micros("time_text") if precision == "ns" else F.expr("try_cast(time_text AS bigint)") * int(unit)
    tag = r",((?:[^\\,=]|\\.)+)=((?:[^\\,]|\\.)+)"
    measurement = F.array(F.struct(F.lit("_measurement").alias("k"), _plain(F.regexp_extract("key", r"^((?:[^\\,]|\\.)+)", 1)).alias("v")))
    pairs = F.arrays_zip(F.regexp_extract_all("key", F.lit(tag), F.lit(1)).alias("k"), F.regexp_extract_all("key", F.lit(tag), F.lit(2)).alias("v"))
    tags = F.map_from_entries(F.concat(measurement, F.array_distinct(F.transform(pairs, lambda e: F.struct(_plain(e["k"]).alias("k"), _plain(e["v"]).alias("v"))))))
    rows = rows.withColumn("time_us", us)
    broken = F.when(F.col("key") == "", "line").when(F.col("time_us").isNull(), "time").when(F.col("rtt_value").isNull() | F.isnan("rtt_value"), "value")
    return rows.select("file", "seq", "line", "time_us", "rtt_value", F.when(broken.isNull(), tags).alias("tags"), broken.alias("broken"))


def export_kind(spark: SparkSession, path: str) -> str:
    """annotated or protocol, by the first line that is no comment."""
    head = [r.value for r in spark.read.text(path).where("trim(value) != ''").limit(20).collect()]
    notes = [h for h in head if h.startswith("#")]
    if any(h.split(",")[0] in ("#datatype", "#group", "#default") for h in notes):
        return "annotated"
    first = next((h for h in head if not h.startswith("#")), "")
    return "annotated" if "_time" in first.replace('"', "").split(",") else "protocol"


def influx_lines(spark: SparkSession, path: str, kind: str | None = None, precision: str = "ns") -> DataFrame:
    """All lines of an export with what they say, the broken ones with a reason."""
    lines = numbered_lines(spark, path)
    return annotated_csv(lines) if (kind or export_kind(spark, path)) == "annotated" else line_protocol(lines, precision)


def series_of(tags: str) -> Column:
    """One text of all tags in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def read_influx(spark: SparkSession, path: str, mode: str = "drop", series: str | None = None, kind: str | None = None, precision: str = "ns") -> DataFrame:
    """Samples from an export; ``series`` is a tag that tells series apart, "*" takes all tags, "file" each file, None makes all rows one series."""
    from .readers import normalize

    rows = influx_lines(spark, path, kind, precision)
    if mode == "strict":
        bad = rows.where("broken is not null").limit(1).collect()
        if bad:
            raise ValueError(f"a broken line ({bad[0].broken}) in {bad[0].file}: {bad[0].line[:200]}")
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    good = rows.where("broken is null").select((F.col("time_us") / 1e6).alias("epoch"), "rtt_value", "seq", tag("source").alias("source"), tag("destination").alias("destination"), (series_of("tags") if series == "*" else F.col("file") if series == "file" else tag(series) if series else F.lit("all")).alias("series_id"))
    return normalize(good, "series_id", mode)


def concat_exports(parts: list[DataFrame]) -> DataFrame:
    """Samples of several exports in one relation."""
    return reduce(DataFrame.unionByName, parts)
