"""Tab-separated extracts with a header row, possibly with repeated column names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_of(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names of the header row, repeats included."""
    return spark.read.text(path).first()[0].rstrip("\r").split(sep)


def extract_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an extract as ``value``, without the header of each file. No job runs beforehand.

    Read as a table of one column, so that Spark drops each file's first line, whatever it says.
    """
    # A control character that separates nothing, and no quoting.
    return spark.read.csv(path, schema="value string", sep="\x01", quote="", header=True)


def _cells(line: Column, sep: str) -> Column:
    return F.split(F.rtrim(line, F.lit("\r")), sep, -1)


def read_extract(
    spark: SparkSession,
    path: str,
    columns: Mapping[int, tuple[str, str]],
    width: int,
    sep: str = "\t",
    null_text: str = "NULL",
    keep_empty: bool = False,
) -> DataFrame:
    """Read the wanted columns of a wide extract by position.

    ``columns`` maps a 1-based position to (name, type). Names in the file are not
    used, so a name that occurs twice is no problem. Both ``null_text`` and an empty
    cell become null; with ``keep_empty`` an empty text cell stays an empty string.
    A cell that cannot be cast becomes null, cells beyond ``width`` are cut off: see ``check_lines``.
    """
    if keep_empty:
        rows = extract_lines(spark, path).select(_cells(F.col("value"), sep).alias("cells"))

        def cell(i):
            return F.nullif(F.get("cells", F.lit(i - 1)), F.lit(null_text))
    else:
        layout = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(1, width + 1)])
        rows = spark.read.csv(path, sep=sep, header=True, schema=layout, nullValue=null_text, quote="")

        def cell(i):
            return F.col(f"c{i}")

    return rows.select(
        *[
            (cell(i) if kind == "string" else cell(i).try_cast(kind)).alias(name)
            for i, (name, kind) in sorted(columns.items())
        ]
    )


def check_lines(
    lines: DataFrame,
    columns: Mapping[int, tuple[str, str]],
    width: int,
    sep: str = "\t",
    null_text: str = "NULL",
) -> DataFrame:
    """Lines (``value``) as the wanted columns, with ``reasons`` for which a line is to be rejected and then the ``line``
    itself: accepted and rejected rows from one scan.

    A line is rejected for a cell with text that cannot be cast (the reason is the column's name) and for another number
    of cells than ``width`` (``too many cells``, ``too few cells``). Accepted rows have no reasons and no line.
    """
    wanted = sorted(columns.items())
    parsed = lines.select("value", _cells(F.col("value"), sep).alias("cells"))
    texts = [F.nullif(F.nullif(F.get("cells", F.lit(i - 1)), F.lit(null_text)), F.lit("")) for i, _ in wanted]
    # Lines and texts pass as one value each: otherwise a filter on the reasons goes through to the lines, which are then
    # made and split once for every column, and once more for what is left.
    parsed = _once(parsed, F.col("value"), F.size("cells").alias("size"), *(t.alias(f"t{k}") for k, t in enumerate(texts)))
    cells, bad = {}, []
    for k, (_, (name, kind)) in enumerate(wanted):
        text = F.col(f"t{k}")
        cells[name] = text if kind == "string" else text.try_cast(kind)
        if kind != "string":
            bad.append(F.when(text.isNotNull() & cells[name].isNull(), F.lit(name)))
    many = F.when(F.col("size") > width, "too many cells").when(F.col("size") < width, "too few cells")
    reasons = F.array_compact(F.array(many, *bad))
    checked = parsed.select("value", *(c.alias(n) for n, c in cells.items()), reasons.alias("reasons"))
    line = F.when(F.size("reasons") > 0, F.col("value")).alias("line")
    return _once(checked, *(F.col(n) for n in cells), line, F.col("reasons"))


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Like ``select``, but a row's columns are made once: filters on them stay above, and are not put in their place."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("line", "reasons")


def rejected(checked: DataFrame) -> DataFrame:
    """line and reasons of the rejected rows."""
    return checked.where(F.size("reasons") > 0).select("line", "reasons")


def count_rejects(
    spark: SparkSession,
    path: str,
    columns: Mapping[int, tuple[str, str]],
    width: int,
    sep: str = "\t",
    null_text: str = "NULL",
) -> DataFrame:
    """What ``read_extract`` loses, counted in one scan: (item, lost).

    One row for each typed column (cells with text that can't be cast), and one for lines with more cells than
    ``width`` (item ``lines longer than <width>``).
    """
    checked = check_lines(extract_lines(spark, path), columns, width, sep, null_text)
    items = {f"lines longer than {width}": "too many cells"}
    items |= {name: name for _, (name, kind) in sorted(columns.items()) if kind != "string"}
    counts = checked.agg(*(F.count_if(F.array_contains("reasons", r)).alias(str(k)) for k, r in enumerate(items.values())))
    cells = [F.struct(F.lit(n).alias("item"), F.col(str(k)).alias("lost")) for k, n in enumerate(items)]
    return counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


# The 21 columns of the month-end transaction extract.
MONTH_END_COLUMNS = {
    1: ("month_end", "date"),
    2: ("window_side", "string"),
    3: ("biz_day_rank", "int"),
    4: ("trade_date", "date"),
    5: ("settle_date", "date"),
    6: ("company", "string"),
    7: ("fund_code", "string"),
    8: ("settlement_period", "int"),
    9: ("status_code", "int"),
    10: ("status_mnemonic", "string"),
    11: ("status_description", "string"),
    12: ("allows_order_entry", "string"),
    13: ("trx_code", "int"),
    14: ("trx_description", "string"),
    15: ("direction", "string"),
    16: ("gross", "decimal(18,2)"),
    17: ("signed_gross", "decimal(18,2)"),
    18: ("units", "decimal(18,4)"),
    19: ("price", "decimal(18,4)"),
    20: ("open_balance", "decimal(18,4)"),
    21: ("close_balance", "decimal(18,4)"),
}
MONTH_END_WIDTH = 21

# The columns in use of the wide transaction extract (transaction joined to its type).
TYPED_TRX_COLUMNS = {
    1: ("company", "string"),
    3: ("trx_id", "bigint"),
    4: ("investor_id", "bigint"),
    6: ("plan_id", "bigint"),
    7: ("account_id", "bigint"),
    8: ("investment_id", "bigint"),
    9: ("fund_code", "string"),
    10: ("trx_status", "string"),
    11: ("trx_code", "int"),
    12: ("trade_date", "date"),
    13: ("settle_time", "string"),
    14: ("order_id", "bigint"),
    32: ("region_id", "bigint"),
    33: ("branch_id", "bigint"),
    34: ("representative_id", "bigint"),
    38: ("open_balance", "decimal(18,4)"),
    39: ("close_balance", "decimal(18,4)"),
    44: ("units", "decimal(18,4)"),
    45: ("price", "decimal(18,4)"),
    46: ("gross", "decimal(18,2)"),
    59: ("net", "decimal(18,2)"),
    61: ("currency", "string"),
    196: ("open_book_cost", "decimal(18,4)"),
    197: ("book_cost", "decimal(18,4)"),
    223: ("type_code", "int"),
    226: ("flow_code", "string"),
    240: ("trx_category", "string"),
    253: ("unit_factor", "int"),
    334: ("summary_type", "string"),
}
TYPED_TRX_WIDTH = 334


def read_month_end_extract(spark: SparkSession, path: str) -> DataFrame:
    return read_extract(spark, path, MONTH_END_COLUMNS, MONTH_END_WIDTH)


def read_typed_trx_extract(spark: SparkSession, path: str) -> DataFrame:
    return read_extract(spark, path, TYPED_TRX_COLUMNS, TYPED_TRX_WIDTH)
