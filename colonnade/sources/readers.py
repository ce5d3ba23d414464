"""Loading tables from CSV, JSON, XML and Parquet files, folders or globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.columns import nan_to_null, quoted, string_columns
from colonnade.operators.cleaning import type_columns
from colonnade.sources.splits import Splits

# Texts a delimited file uses for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Takes what stands behind the last column of the header.
_SURPLUS = "__surplus"

EXTENSIONS = ("csv", "txt", "json", "xml", "parquet")


class UnsupportedFormat(ValueError):
    pass


def _tokens_to_null(df: DataFrame) -> DataFrame:
    names = string_columns(df)
    return df.withColumns({c: F.when(~quoted(c).isin(*NA_TOKENS), quoted(c)) for c in names}) if names else df


def load_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: str | None = None,
    infer: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Comma-separated text with a header.  Columns come in as text and turn numeric only where every
    value is a number; dates stay text.  Short rows are padded; a row with more fields than the header
    raises when it is read.  With a `schema` the typing pass is skipped and rows must have just its fields.
    Files are read in parallel splits; a first pass finds out whether records cross line ends inside quotes.
    It is spared for files known to hold no such line break (`multi_line` off)."""
    # The reader quotes with a doubled quote, as spreadsheets write it.
    reader = spark.read.option("header", True).option("escape", '"')
    splits = Splits(spark, path) if multi_line else None
    records = splits.records() if splits and not splits.plain else None

    def parsed(kind: str | T.StructType, **options) -> DataFrame:
        if records is None:
            return reader.options(**options).schema(kind).csv(path)
        text = kind.toDDL() if isinstance(kind, T.StructType) else kind
        return records.select(F.from_csv("record", text, {"escape": '"', **options}).alias("r")).select("r.*")

    if schema:
        return nan_to_null(parsed(schema, mode="FAILFAST"))
    names = reader.option("multiLine", multi_line).option("inferSchema", False).csv(path).columns
    reader = reader.option("multiLine", False)
    wide = parsed(T.StructType([T.StructField(n, T.StringType()) for n in [*names, _SURPLUS]]))
    surplus = F.raise_error(F.lit(f"a row has more fields than the header of {path}")).cast("boolean")
    df = wide.where(F.when(F.col(_SURPLUS).isNotNull(), surplus).otherwise(True)).drop(_SURPLUS)
    df = _tokens_to_null(df)
    return type_columns(df) if infer else df


def load_json(spark: SparkSession, path: str, *, lines: bool = False, schema: str | None = None) -> DataFrame:
    """An array of records per file, or one record per line (`lines`, which splits large files)."""
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    if schema:
        reader = reader.schema(schema)
    return nan_to_null(reader.json(path))


def load_xml(
    spark: SparkSession, path: str, *, row_tag: str = "row", schema: str | None = None, infer: bool = True
) -> DataFrame:
    """One row per `row_tag` element."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST")
    if schema:
        return nan_to_null(reader.schema(schema).load(path))
    df = _tokens_to_null(reader.option("inferSchema", False).load(path))
    return type_columns(df) if infer else df


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table as stored, so that filters and columns reach the scan; operators read NaN as missing."""
    return spark.read.parquet(path)


def extension_of(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    return tail.rsplit(".", 1)[-1].lower() if "." in tail else ""


def load_by_extension(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by the lower-cased extension of a file, folder or glob."""
    loaders = {
        "csv": load_csv, "txt": load_csv, "json": load_json, "xml": load_xml, "parquet": load_parquet,
    }
    kind = extension_of(path)
    if kind not in loaders:
        raise UnsupportedFormat(f"unsupported file type: .{kind}; known: {', '.join(EXTENSIONS)}")
    return loaders[kind](spark, path, **options)
