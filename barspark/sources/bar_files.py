"""Reading and writing bar files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.bars import OHLCV
from barspark.operators.quality import dedup_bars, require_valid, validate_bars, with_values
from barspark.session import cut_lineage

# Date layout of bar files, and the layouts tried on foreign ones, in order.
BAR_DATE = "yyyy.MM.dd HH:mm"
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy.MM.dd HH:mm",
    "yyyy.MM.dd HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "yyyy/MM/dd HH:mm",
    "MM/dd/yyyy HH:mm",
)
# Delimiters in the order they are looked for, and header words per column.
DELIMITERS = (";", ",", "\t", "|")
SYNONYMS = {
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("v", "vol"),
}
IGNORED = ("not_", "irrelevant")


def _ntz(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def _line() -> Column:
    """Position of a row in its file: file, block, then order inside the block."""
    return F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_bars(
    spark: SparkSession,
    path: str,
    symbol: str,
    years: Sequence[int] | None = None,
    *,
    strict: bool = True,
    sep: str = ";",
    rules: bool = True,
) -> DataFrame:
    """Yearly bar files: drop bad dates, validate, keep the first row of a repeated timestamp.

    ``years`` keeps files whose name ends in ``_YYYY``. ``strict`` raises on rule breaks (one counting
    job over the files); otherwise such rows are left out. ``rules=False`` is for series that are no prices and may be
    zero or below: rows that break the price rules stay, and only lines without a date or numbers are dropped.
    """
    names = ["Date", "Open", "High", "Low", "Close", "Volume"]
    raw = spark.read.schema(", ".join(f"{n} STRING" for n in names)).csv(path, sep=sep, header=True, mode="PERMISSIVE")
    if years is not None:
        # On the file's name alone, before anything is numbered: files of other years are never opened.
        year = F.regexp_extract("_metadata.file_name", r"_(\d{4})\.[A-Za-z]+$", 1)
        raw = raw.where(year.isin([str(y) for y in years]))
        if raw.isEmpty():
            raise ValueError(f"no bar files for years {sorted(years)}")
    raw = raw.select("*", _line().alias("line"))
    bars = raw.select(
        F.lit(symbol).alias("symbol"),
        _ntz(F.trim("Date"), BAR_DATE).alias("ts"),
        *[F.trim(n).alias(n.lower()) for n in names[1:]],
        "line",
    ).where(F.col("ts").isNotNull())
    checked = validate_bars(bars, rules=rules)
    if strict:
        require_valid(checked.report, rules=rules)
    return dedup_bars(checked.clean, "first").drop("line")


# -- foreign layouts -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How the cells of a line map to bar columns."""

    sep: str
    header: str | None
    date: tuple[int, ...]
    cells: dict[str, int]


def detect_layout(first_line: str) -> Layout:
    """Layout from a file's first line: a header with known words, or a headerless date-time row."""
    sep = next((d for d in DELIMITERS if d in first_line), None)
    pattern = r"\s+" if sep is None else re.escape(sep)
    cells = [c.strip() for c in re.split(pattern, first_line.strip())]
    if re.fullmatch(r"\d{4}[-.]\d{2}[-.]\d{2}", cells[0]) and len(cells) >= 7:
        return Layout(pattern, None, (0, 1), {c: i + 2 for i, c in enumerate(OHLCV)})
    if re.match(r"\d{2,4}[-./]\d{2}[-./]\d{2,4}[ T]\d", cells[0]) and len(cells) >= 6:
        return Layout(pattern, None, (0,), {c: i + 1 for i, c in enumerate(OHLCV)})
    dates: list[int] = []
    found: dict[str, int] = {}
    for i, cell in enumerate(c.lower() for c in cells):
        if any(word in cell for word in IGNORED):
            continue
        if "date" in cell or "time" in cell:
            dates.append(i)
            continue
        for name, words in SYNONYMS.items():
            if (cell in words or (name == "volume" and "volume" in cell)) and name not in found:
                found[name] = i
    return Layout(pattern, first_line, tuple(dates[:2]) or (0,), found)


def number(text: Column) -> Column:
    """Decimal comma and inner blanks accepted; null when it is no number."""
    return F.regexp_replace(F.regexp_replace(text, ",", "."), " ", "").try_cast("double")


def parse_ts_any(
    df: DataFrame, col: str, formats: Sequence[str] = DATE_FORMATS, out: str = "ts", *, by: str | None = None
) -> DataFrame:
    """Parse with the first format that reads every row of a group (``by``; else of the frame), else row by row.

    One aggregate keeps, per group, the set of formats that failed somewhere as bits. A group in which no date can be
    read is an error.
    """
    text = F.trim(F.col(col))
    tries = [_ntz(text, f) for f in formats]
    any_of = F.coalesce(*tries, text.try_cast("timestamp_ntz"))
    failed = F.lit(0).cast("long")
    for i, t in enumerate(tries):
        failed = failed.bitwiseOR(F.when(t.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    group = F.col(by) if by else F.lit("")
    # One row per group, looked at here and joined below.
    seen = cut_lineage(df.groupBy(group.alias("_group")).agg(F.bit_or(failed).alias("_failed"), F.count(any_of).alias("_read")))
    unread = seen.where(F.col("_read") == 0).first()
    if unread is not None:
        raise ValueError(f"no date in column {col} could be read{': ' + str(unread['_group']) if by else ''}")
    parsed = any_of
    for i, t in reversed(list(enumerate(tries))):
        parsed = F.when(F.col("_failed").bitwiseAND(F.lit(1 << i).cast("long")) == 0, t).otherwise(parsed)
    joined = df.withColumn("_g", group).join(seen, F.col("_g").eqNullSafe(F.col("_group")))
    return joined.withColumn(out, parsed).drop("_g", "_group", "_failed", "_read")


_LAYOUT = "sep string, header string, date array<int>, cells map<string, int>"


def file_layouts(lines: DataFrame) -> DataFrame:
    """(file, layout), one row per file of text lines (file, line, value), from its first line that is not blank."""
    first = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "line").alias("value"))
    detect = F.udf(lambda text: (lambda x: (x.sep, x.header, list(x.date), x.cells))(detect_layout(text)), _LAYOUT)
    return first.select("file", detect("value").alias("layout"))


def normalize_bars(spark: SparkSession, path: str, symbol: str, *, layout: Layout | None = None) -> DataFrame:
    """Bars from foreign text files; missing columns are null, missing volume is 0.

    Each file has its own separator, header, column order and date format, found from its own lines; ``layout`` holds
    for all files. Files without a line give no rows; no line at all is an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _line().alias("line"), "value")
    if layout is None:
        layouts = cut_lineage(file_layouts(lines))
        if layouts.isEmpty():
            raise ValueError(f"empty file: {path}")
        body = lines.join(layouts, "file")
    else:
        pairs = [F.lit(x) for pair in layout.cells.items() for x in pair]
        given = F.struct(
            F.lit(layout.sep).alias("sep"),
            F.lit(layout.header).cast("string").alias("header"),
            F.array(*[F.lit(i) for i in layout.date]).alias("date"),
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string, int>")).alias("cells"),
        )
        body = lines.withColumn("layout", given)
    header = F.trim("layout.header")
    body = body.where((F.trim("value") != "") & (header.isNull() | (F.trim("value") != header)))
    body = body.withColumn("cells", F.split(F.trim("value"), F.col("layout.sep")))
    # A position past the end of a line is a missing cell.
    date = F.array_join(F.transform("layout.date", lambda i: F.trim(F.get(F.col("cells"), i))), " ")
    values = {c: number(F.trim(F.get("cells", F.try_element_at("layout.cells", F.lit(c))))) for c in OHLCV}
    shaped = body.select("file", F.lit(symbol).alias("symbol"), date.alias("_date"), *[v.alias(c) for c, v in values.items()])
    shaped = shaped.withColumn("volume", F.floor(F.coalesce("volume", F.lit(0.0))).cast("double"))
    dated = parse_ts_any(shaped, "_date", by="file")
    return dated.select("symbol", "ts", *OHLCV).where(F.col("ts").isNotNull())


def read_tab_export(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Tab file with ``yyyy-MM-dd HH:mm:ss`` times; rows with fewer than six usable fields are skipped."""
    cells = F.split("value", "\t")
    picked = spark.read.text(path).where(F.size(cells) >= 6).select(
        F.lit(symbol).alias("symbol"),
        _ntz(F.trim(F.get(cells, F.lit(0))), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        *[F.trim(F.get(cells, F.lit(i + 1))).try_cast("double").alias(c) for i, c in enumerate(OHLCV)],
    )
    return with_values(picked, ["ts", *OHLCV])


def read_candles(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """``;`` or ``,`` file with the bar date layout or any other readable date; bad lines are skipped."""
    cells = F.split("value", "[;,]")
    text = F.trim(F.get(cells, F.lit(0)))
    when = F.coalesce(_ntz(text, BAR_DATE), *[_ntz(text, f) for f in DATE_FORMATS], text.try_cast("timestamp_ntz"))
    picked = (
        spark.read.text(path)
        .where(F.size(cells) >= 6)
        .select(
            F.lit(symbol).alias("symbol"),
            when.alias("ts"),
            *[F.trim(F.get(cells, F.lit(i + 1))).try_cast("double").alias(c) for i, c in enumerate(OHLCV)],
        )
    )
    return with_values(picked, ["ts", *OHLCV])


# -- sinks -----------------------------------------------------------------------------------------


def bar_text(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Text columns of the bar file layout: date and six-decimal numbers."""
    return bars.select(
        F.date_format(ts, BAR_DATE).alias("Date"),
        *[F.format_string("%.6f", F.col(c).cast("double")).alias(c.capitalize()) for c in OHLCV],
    )


def write_bars_csv(bars: DataFrame, path: str, *, files: int | None = None, ts: str = "ts", mode: str = "error") -> None:
    """Sorted ``;`` files: part files follow each other in time (range partitioning, no single writer)."""
    ranged = bars.repartitionByRange(files, ts) if files else bars.repartitionByRange(ts)
    bar_text(ranged.sortWithinPartitions(ts), ts).write.mode(mode).csv(path, sep=";", header=True)


def write_bars_by_year(bars: DataFrame, path: str, *, ts: str = "ts", mode: str = "error") -> None:
    """Parquet folders per year, so later reads prune by year."""
    dated = bars.withColumn("year", F.year(ts))
    # One shuffle by (year, symbol, month) keeps files few without one task per year.
    month = F.month(ts)
    dated.repartition("year", "symbol", month).sortWithinPartitions("symbol", ts).write.mode(mode).partitionBy(
        "year"
    ).parquet(path)


def read_bars_by_year(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("year").isin(list(years))) if years is not None else df


def write_features(features: DataFrame, bars: DataFrame, path: str, *, on: Sequence[str] = ("symbol", "ts"), mode: str = "error") -> None:
    """Aligned features with the close, one parquet table."""
    close = bars.select(*on, F.col("close").alias("price"))
    features.join(close, list(on)).write.mode(mode).parquet(path)
