"""Read an attendance CSV of unknown layout into the schedule.

The driver only ever sees the header line of the first file (to pick the
separator); everything else is a Spark scan + projection + filter.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shiftspark import constants as K
from shiftspark.functions import timeparts as T


class InvalidCsvError(ValueError):
    """The upload cannot be turned into a schedule."""


@dataclass(frozen=True)
class ColumnMapping:
    """User names of the four required columns."""

    id: str = K.DEFAULT_COLUMN_NAMES["id"]
    date: str = K.DEFAULT_COLUMN_NAMES["date"]
    start_time: str = K.DEFAULT_COLUMN_NAMES["start_time"]
    end_time: str = K.DEFAULT_COLUMN_NAMES["end_time"]

    def clean(self) -> "ColumnMapping":
        """Only blanks become underscores; the mapping is not stripped."""
        return replace(self, **{f.name: getattr(self, f.name).replace(" ", "_")
                                for f in fields(self)})


def header_line(spark: SparkSession, path: str) -> str | None:
    """First line of the first file (one short row reaches the driver)."""
    rows = (spark.read.text(path)
            .where(F.col("_metadata.file_block_start") == 0)
            .select("value").limit(1).collect())
    return rows[0][0] if rows else None


def pick_separator(header: str, min_columns: int = len(K.SCHEDULE_COLUMNS)) -> str:
    """The first separator giving enough columns, else the last one tried."""
    for sep in K.CSV_SEPARATORS:
        n = len(next(csv.reader([header], delimiter=sep)))
        if n >= min_columns:
            return sep
    return K.CSV_SEPARATORS[-1]


CORRUPT = "_corrupt_record"


def read_raw_csv(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = True) -> DataFrame:
    """All-text scan with cleaned header names and a file-order sequence.

    Quotes are doubled inside quoted fields.  ``multi_line`` (the default, as an
    upload has at most 50 MB) reads line ends inside quotes and one task a file;
    without it, large files are split and a quoted line end breaks its row.
    Every file must have the header of the first one.

    The schema is the header's own fields (all text) plus ``_corrupt_record``,
    so rows whose field count differs from the header are kept and marked
    rather than cut silently.
    """
    header = header_line(spark, path)
    if header is None:
        raise InvalidCsvError("the file is empty")
    sep = sep or pick_separator(header)
    names = next(csv.reader([header], delimiter=sep))
    cleaned = [T.clean_header(c) for c in names]
    dup = {c for c in cleaned if cleaned.count(c) > 1}
    if dup:
        raise InvalidCsvError(f"header names collide after cleaning: {sorted(dup)}")
    schema = StructType([StructField(c, StringType()) for c in names]
                        + [StructField(CORRUPT, StringType())])
    raw = (spark.read.schema(schema).option("sep", sep).option("header", True)
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("enforceSchema", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    # Rows of one file keep file order in the id; it orders "last record wins".
    return (raw.toDF(*cleaned, CORRUPT)
            .withColumn("row_seq", F.monotonically_increasing_id())
            .withColumn("_fields_expected", F.lit(len(cleaned)))
            .withColumn("_sep_re", F.lit(re.escape(sep))))


def long_rows(raw: DataFrame) -> DataFrame:
    """Rows with more fields than the header (a pandas reader refuses the file).

    Fields are counted by the separators of the raw line outside quoted fields (those that
    begin with a quote).
    """
    quoted = F.concat(F.lit("(?<=^|"), F.col("_sep_re"), F.lit(')"[^"]*+(?:""[^"]*+)*+"'))
    fields = F.size(F.split(F.regexp_replace(F.col(CORRUPT), quoted, F.lit("")), F.col("_sep_re")))
    # A row counts as malformed only for the columns the scan parses, and a
    # scan may not need the corrupt-record column alone: require every field.
    data_cols = raw.columns[:raw.columns.index(CORRUPT)]
    parsed = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in data_cols])) >= 0
    return raw.where(F.col(CORRUPT).isNotNull() & (fields > F.col("_fields_expected")) & parsed)


def check_columns(raw: DataFrame, mapping: ColumnMapping) -> ColumnMapping:
    """S3: all four mapped columns exist (no job runs)."""
    m = mapping.clean()
    missing = [getattr(m, f.name) for f in fields(m) if getattr(m, f.name) not in raw.columns]
    if missing:
        raise InvalidCsvError(f"missing columns: {', '.join(missing)}")
    return m


def _choose_date(raw: DataFrame, text: Column) -> Column:
    """Q2: one format for the whole input -- ISO if any row parses as ISO, else d/m/Y.

    "Any row" is an EXISTS subquery, which Spark runs with LIMIT 1: for an
    ISO file it stops at the first ISO row instead of scanning the input
    twice.  If neither format parses, every row is dropped; a validated load
    then reports it.
    """
    iso = T.parse_date(text, K.DATE_FORMATS[0])
    dmy = T.parse_date(text, K.DATE_FORMATS[1])
    return F.when(raw.where(iso.isNotNull()).exists(), iso).otherwise(dmy)


def _any_date(raw: DataFrame, text: Column) -> bool:
    """Does any row parse in either format (validation only, one limit-1 job)."""
    parsed = T.parse_date(text, K.DATE_FORMATS[0]).isNotNull() | \
        T.parse_date(text, K.DATE_FORMATS[1]).isNotNull()
    return not raw.where(parsed).isEmpty()


def clean_schedule(raw: DataFrame, mapping: ColumnMapping = ColumnMapping(),
                   keep_row_seq: bool = True) -> DataFrame:
    """P1-P4 + F1 + F3: the canonical schedule from raw text rows."""
    m = check_columns(raw, mapping)
    ident = F.col(f"`{m.id}`").cast("string")
    out = raw.select(
        ident.alias(K.ID),
        _choose_date(raw, F.col(f"`{m.date}`")).cast("date").alias(K.DATE),
        T.time_to_minutes(F.col(f"`{m.start_time}`")).alias(K.START),
        T.time_to_minutes(F.col(f"`{m.end_time}`")).alias(K.END),
        *(["row_seq"] if keep_row_seq and "row_seq" in raw.columns else []))
    return (out.where(F.col(K.DATE).isNotNull() & ~T.is_na_token(K.ID))
            .where((F.col(K.START) > 0) & (F.col(K.END) > 0))
            .where(F.col(K.END) > F.col(K.START)))


def load_schedule_csv(spark: SparkSession, path: str, mapping: ColumnMapping = ColumnMapping(),
                      validate: bool = True, multi_line: bool = True) -> DataFrame:
    """S1-S4 end to end.

    ``validate`` runs limit-1 jobs: the file has rows, no row is longer than
    the header, something is left after cleaning (and, if not, whether any
    date parsed, for the error message).  Without it the load stays lazy.
    """
    raw = read_raw_csv(spark, path, multi_line=multi_line)
    out = clean_schedule(raw, mapping)
    if validate:
        if raw.isEmpty():
            raise InvalidCsvError("the file has a header but no rows")
        # The first offending row is enough (limit 1): no full count.
        bad = long_rows(raw).select(CORRUPT).limit(1).collect()
        if bad:
            raise InvalidCsvError(f"rows have more fields than the header, e.g. {bad[0][0]!r}")
        if out.isEmpty():
            m = mapping.clean()
            if not _any_date(raw, F.col(f"`{m.date}`")):
                raise InvalidCsvError("dates match none of the supported formats")
            raise InvalidCsvError("no valid row left after cleaning")
    return out
