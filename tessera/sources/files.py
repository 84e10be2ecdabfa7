"""CSV and JSON lines by a given schema: records that don't fit it are kept as rejects, never dropped or guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_CORRUPT = "_corrupt_record"
#: Written and read alike: NULL and the empty text stay apart, quotes double, infinities have names.
_CSV = {"nullValue": "\\N", "quote": '"', "escape": '"', "positiveInf": "Infinity", "negativeInf": "-Infinity", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_JSON = {"ignoreNullFields": "false"}


def _options(kind: str) -> dict:
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown format {kind!r}")
    return _CSV if kind == "csv" else _JSON


def write_rows(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    """df as CSV without a header (flat columns, texts without line breaks) or as JSON lines."""
    df.write.mode(mode).options(compression=compression, **_options(kind)).format(kind).save(path)


def read_rows(spark: SparkSession, path: str, schema: StructType, kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and a table of the records that don't: file, record. Empty lines are no records.

    Files are read as lines and parsed by column functions, so a file that isn't compressed can be split between tasks.
    """
    wide = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT} | _options(kind)
    parse = F.from_csv(F.col("value"), _ddl(wide), options) if kind == "csv" else F.from_json(F.col("value"), wide, options)
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"), parse.alias("r"))
    fits = F.col("r").isNotNull() & F.col(f"r.{_CORRUPT}").isNull()
    good = lines.filter(fits).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])
    return good, lines.filter(~fits).select("file", F.col("value").alias("record"))


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
