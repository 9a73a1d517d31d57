"""Readers for vendor tick files and terminal quote files. Everything is read as text, so no pass infers a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import clock
from ..functions.joins import MOST_ROWS
from ..operators import ticks
from ..session import settled

#: Texts that stand for null.
NULLS = ("", "NULL", "null")
REQUIRED = ("trade_date", "execution_date", "time", "trade_price", "trade_volume", "contract_month", "price_type", "no", "sco_category")
#: Names by which a column may stand in a header, the first that is there being read; the others of REQUIRED have their own.
OTHER_NAMES = {"execution_date": ("execution_date", "make_date", "trade_date")}
#: Columns that a file may lack: rows are numbered, and the category is 0.
OPTIONAL = ("no", "sco_category")


def lines(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """value, path, split, id: the lines of files and folders, folders at any depth, each file once.

    split is the byte at which the part of a file that one task reads begins; ids rise by one from line to line of it.
    With a pattern, such as future_tick_*.csv.gz, only files of such names are read.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    tops = sorted({p.rstrip("/") for p in paths})
    apart = [p for p in tops if not any(p.startswith(f"{q}/") for q in tops)]  # a file whose folder is given too
    at = F.col("_metadata")
    return reader.text(apart).select("value", at["file_path"].alias("path"), at["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"))


def layouts(read: DataFrame, sep: str | None = None) -> DataFrame:
    """A row for each (path, split) of lines: first (its least id), before (lines of the file before it), sep and names.

    One pass counts lines by split and takes each split's first line; a file's header is that of its first split, and its
    separator a comma if the header has as many commas as tabs, else a tab. Sums of counts over a file's splits place
    them, so a line's number in its file is id - first + before, however the file was cut.
    """
    cuts = read.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("rows"), F.min_by("value", "id").alias("line"))
    of = W.partitionBy("path").orderBy("split")
    header = F.translate(F.first("line").over(of), "\ufeff", "")
    marks = lambda mark: F.regexp_count("header", F.lit(mark))
    placed = cuts.select("path", "split", "first", F.coalesce(F.sum("rows").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), header.alias("header"))
    found = F.lit(sep) if sep else F.when(marks(",") >= marks("\t"), ",").otherwise("\t")
    names = F.transform(F.split("header", found), lambda x: F.lower(F.trim(x, F.lit('" '))))
    return placed.withColumn("sep", found).select("path", "split", "first", "before", "sep", names.alias("names"))


def separators(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Separator -> the files under the paths that use it, in order."""
    rows = layouts(lines(spark, paths)).select("sep", "path").distinct().groupBy("sep").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {r["sep"]: r["paths"] for r in rows.collect()}  # names of files alone


def fields(spark: SparkSession, paths: list[str], sep: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of REQUIRED, as texts, of every line below a header, each file by its own header and separator.

    Names may be in capitals and in any order. make_date stands for execution_date, and trade_date if both are missing;
    no is the line's number in its file, from 1, where the file has none, rows that hold nulls and blank lines counted;
    sco_category is 0. A file that lacks another column raises. A quoted field may hold separators, but no line end. Two
    passes and no more read the files, however many there are and whatever their headers.
    """
    read = lines(spark, paths, pattern)
    known = settled(layouts(read, sep))
    place = lambda c: F.coalesce(*[F.nullif(F.array_position("names", x), F.lit(0)) for x in OTHER_NAMES.get(c, (c,))])
    need = [c for c in REQUIRED if c not in OPTIONAL]
    missing = F.concat_ws(", ", *[F.when(place(c).isNull(), c) for c in need])
    splits, width, bad = known.agg(F.count("*"), F.max(F.size("names")), F.max(F.when(missing != "", F.struct(missing, F.col("path"))))).first()
    if bad is not None:
        raise ValueError(f"columns are missing: {bad[0]} ({bad[1]})")
    at = known.select("path", "split", "first", "before", "sep", *[place(c).cast("int").alias(f"_{c}") for c in REQUIRED])
    met = read.join(F.broadcast(at) if splits <= MOST_ROWS else at, ["path", "split"]).withColumn("_line", F.col("id") - F.col("first") + F.col("before")).filter("_line > 0 and value <> ''")
    schema = ", ".join(f"c{i} string" for i in range(width or 1))
    # a parser is only needed where there are quotes
    cut = lambda mark: F.from_csv("value", schema, {"sep": mark, "mode": "PERMISSIVE", "inputBufferSize": "4096"})
    quoted = F.transform(F.array(F.when(F.col("sep") == "\t", cut("\t")).otherwise(cut(","))), lambda row: F.array(*[row[f"c{i}"] for i in range(width or 1)]))
    held = met.withColumn("_all", F.when(F.contains("value", F.lit('"')), quoted[0]).otherwise(F.split("value", F.col("sep"), -1)))
    default = {"no": F.col("_line").cast("string"), "sco_category": F.lit("0")}
    # headers have null fields: Spark may look at a cast of a field before it drops them
    field = lambda c: F.when(F.col("_line") > 0, F.when(F.col(f"_{c}").isNotNull(), F.get("_all", F.col(f"_{c}") - 1)).otherwise(default.get(c, F.lit(None))))
    return held.select(*[field(c).alias(c) for c in REQUIRED])


def _none(c: Column) -> Column:
    return F.when(F.trim(c).isin(*NULLS), None).otherwise(c)


def typed_ticks(df: DataFrame) -> DataFrame:
    """Texts to typed ticks; rows whose time can't be read go; a number that can't be read raises."""
    df = df.select(*[_none(F.col(x).cast("string")).alias(x) for x in REQUIRED])
    return df.select(
        clock.padded(F.col("trade_date"), 8).alias("trade_date"),
        clock.padded(F.col("execution_date"), 8).alias("execution_date"),
        clock.vendor_timestamp(F.col("execution_date"), F.col("time")).alias("trade_ts"),
        F.col("contract_month").cast("int").alias("contract_month"),
        F.col("no").cast("long").alias("sequence_no"),
        "price_type",
        F.col("sco_category").cast("tinyint").alias("sco_category"),
        F.col("trade_price").cast("double").alias("price"),
        F.col("trade_volume").cast("long").alias("trade_volume"),
    ).filter(F.col("trade_ts").isNotNull())


def read_ticks(spark: SparkSession, paths: list[str], symbol: str, sep: str | None = None, pattern: str | None = None) -> DataFrame:
    """Normalised ticks of vendor files and folders, comma- or tab-separated, plain or gzipped, each file by its own header
    (see fields). With `sep`, nothing is sniffed. Typed ticks are written once: texts aren't parsed again for the nearest
    contract and the tick rule."""
    return ticks.normalised(settled(typed_ticks(fields(spark, paths, sep, pattern))), symbol)


LEGACY = StructType([StructField(x, StringType()) for x in ("trade_date", "make_date", "time", "trade_price", "trade_volume", "contract_month", "price_type", "no")])


def read_legacy_ticks(spark: SparkSession, paths: list[str], schema: StructType = LEGACY) -> DataFrame:
    """Ticks of older tab-separated files with a fixed schema; malformed lines become nulls."""
    rows = spark.read.schema(schema).option("header", True).option("sep", "\t").option("mode", "PERMISSIVE").csv(paths)
    given = {"execution_date": F.col("make_date"), "sco_category": F.lit("0")}
    return typed_ticks(rows.withColumns({k: v for k, v in given.items() if k not in rows.columns}))


def read_quotes(spark: SparkSession, paths: list[str] | str, symbol: str | None = None, zone: str = "EET") -> DataFrame:
    """Bid and ask of terminal files, with or without a header, in Tokyo time.

    The symbol is the name of the folder above the year's, or its value where the folder is a partition. Lines that can't
    be read go. A file without a line of three columns has no quotes to read and raises: one narrow pass looks at all.
    """
    widths = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max(F.regexp_count("value", F.lit("\t"))).alias("tabs"))
    if bad := widths.filter("tabs < 2").first():
        raise ValueError(f"quote files need three columns: {bad['path']}")
    names = StructType([StructField(x, StringType()) for x in ("timestamp", "bid", "ask")])
    rows = spark.read.schema(names).option("sep", "\t").option("header", False).csv(paths).filter(F.col("timestamp") != "timestamp")
    of = F.lit(symbol) if symbol else from_path(F.col("_metadata.file_path"), "symbol")
    read = rows.select(
        clock.tokyo_time(F.col("timestamp").try_cast("timestamp_ntz"), zone).alias("trade_ts"),
        of.alias("symbol"),
        F.col("bid").try_cast("double").alias("bid"),
        F.col("ask").try_cast("double").alias("ask"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    known = read.filter(F.col("trade_ts").isNotNull() & F.col("bid").isNotNull() & F.col("ask").isNotNull())
    return known.select("trade_ts", F.to_date("trade_ts").alias("calendar_date_jst"), "symbol", "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), "row_id")


def from_path(path: Column, what: str) -> Column:
    """symbol (the folder above the year's), date (the file's stem) or period (the digits after the last _) of a path."""
    if what == "symbol":
        return F.regexp_replace(F.element_at(F.split(path, "/"), -3), "^symbol=", "")
    return F.regexp_extract(path, {"date": r"([^/]+)\.[a-z]+$", "period": r"_(\d{6,8})\.tsv"}[what], 1)
