"""Forecasts for batches of requests.

The stored history is first reduced to the requested (id, date) keys with a semi
join, then de-duplicated and joined back.  The requested days are counted first:
few are broadcast, so the big table is never shuffled whole; many are merged.
Spark's own choice goes by file sizes, which know nothing of the days that a
request explodes into, and would build millions of them in the driver.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T
from shiftspark.operators.features import add_features, last_record
from shiftspark.session import write_and_read

HIST_START = "hist_start"
HIST_END = "hist_end"
REQUEST_COLS = [K.ID, "target_date", "window_size"]
#: Up to this many requested days are joined by a broadcast.
FEW_DAYS = 50_000


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Accept text target dates (``d/M/yyyy``) as well as DATE columns; a request
    without a window size gets the default one."""
    dtype = dict(requests.dtypes)["target_date"]
    if dtype == "string":
        requests = requests.withColumn("target_date", T.parse_date("target_date", "d/M/yyyy"))
    if "window_size" not in requests.columns:
        return requests.withColumn("window_size", F.lit(K.DEFAULT_WINDOW_SIZE))
    return requests.withColumn("window_size", F.coalesce("window_size", F.lit(K.DEFAULT_WINDOW_SIZE)))


def calendar(requests: DataFrame) -> DataFrame:
    """one row per request and day of its window."""
    r = normalise_requests(requests)
    return r.select(*REQUEST_COLS,
                    F.explode(T.window_dates("target_date", "window_size")).alias(K.DATE))


def request_rejects(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requests that cannot be served, with the reason.

    A bad date is reported before an unknown id, as the service checks it first.
    """
    r = normalise_requests(requests)
    known = index.select(K.ID, F.lit(True).alias("_known"))
    reason = (F.when(F.col("target_date").isNull(), F.lit("invalid_date"))
              .when(F.col("_known").isNull(), F.lit("unknown_id")))
    return (r.join(known, K.ID, "left")
            .select(*REQUEST_COLS, reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def forecast_frame(requests: DataFrame, history: DataFrame, index: DataFrame) -> DataFrame:
    """J1 + J2 + J3: calendar rows of known ids with their recorded times, if any."""
    r = normalise_requests(requests).where(F.col("window_size") >= 0)
    half = F.floor(F.col("window_size") / 2).cast("int")
    # Every requested day lies in [lo, hi]: history outside it is dropped before any
    # shuffle.  The figures come from the requests (no calendar explode), in one row.
    dated = r.where("target_date IS NOT NULL")
    span = dated.agg(F.min(F.date_sub("target_date", half)).alias("lo"), F.max(F.date_add("target_date", half)).alias("hi"))
    days = dated.agg(F.sum(2 * half.cast("long") + 1)).first()[0]
    join = "broadcast" if (days or 0) <= FEW_DAYS else "merge"
    # The ids' codes are joined to the requests, before these become days.
    cal = r.hint(join).join(index, K.ID).select(
        *REQUEST_COLS, *[c for c in index.columns if c != K.ID],
        F.explode(T.window_dates("target_date", "window_size")).alias(K.DATE))
    hist = history.where(F.col(K.DATE).between(span.select("lo").scalar(), span.select("hi").scalar()))
    hist = hist.join(cal.select(K.ID, K.DATE).hint(join), [K.ID, K.DATE], "left_semi")
    # One row per (id, date), so the left join below never multiplies rows:
    # the last in file order (A13), or without an order the largest pair.
    if "row_seq" in hist.columns:
        hist = last_record(hist.select(K.ID, K.DATE, K.START, K.END, "row_seq"))
    else:
        hist = (hist.groupBy(K.ID, K.DATE).agg(F.max(F.struct(K.START, K.END)).alias("_p"))
                .select(K.ID, K.DATE, F.col(f"_p.{K.START}").alias(K.START),
                        F.col(f"_p.{K.END}").alias(K.END)))
    hist = hist.select(K.ID, K.DATE, F.col(K.START).alias(HIST_START), F.col(K.END).alias(HIST_END))
    return (cal.join(hist.hint(join), [K.ID, K.DATE], "left")
            .withColumn("historical", F.col(HIST_START).isNotNull()))


def _output(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.select(*REQUEST_COLS,
                     F.col(K.DATE).alias("day"),
                     T.display_date(K.DATE).alias("date"),
                     T.weekday_name(K.DATE).alias("weekday"),
                     start.alias("start_time"), end.alias("end_time"),
                     "historical")


def forecast_history(requests: DataFrame, history: DataFrame, index: DataFrame) -> DataFrame:
    """The recorded half of a forecast: predicted days carry null times."""
    f = forecast_frame(requests, history, index)
    hist = F.col("historical")
    return _output(f, F.when(hist, T.minutes_to_time(HIST_START)),
                   F.when(hist, T.minutes_to_time(HIST_END)))


def mask_prediction(start: Column, end: Column) -> tuple[Column, Column]:
    """An unusable predicted pair becomes ``NA``/``NA``."""
    bad = (start < 0) | (end < 0) | (end <= start) | start.isNull() | end.isNull()
    na = F.lit(K.NA_VALUE)
    return (F.when(bad, na).otherwise(T.minutes_to_time(start)),
            F.when(bad, na).otherwise(T.minutes_to_time(end)))


def forecast(requests: DataFrame, history: DataFrame, model: PipelineModel,
             index: DataFrame) -> DataFrame:
    """Recorded days as stored, other days predicted by both forests.

    Only days without a record are scored (a map-side operation with the model
    shipped once per executor).  The calendar is written once, as both halves read it.
    """
    frame = write_and_read(forecast_frame(requests, history, index), "forecast")
    scored = model.transform(add_features(frame.where(~F.col("historical"))))
    p_start, p_end = mask_prediction(F.col("pred_start"), F.col("pred_end"))
    known = frame.where("historical")
    return (_output(known, T.minutes_to_time(HIST_START), T.minutes_to_time(HIST_END))
            .unionByName(_output(scored, p_start, p_end)))


def forecast_single_day(requests: DataFrame, history: DataFrame, model: PipelineModel,
                        index: DataFrame) -> DataFrame:
    """M7: one day per request (window of size 1)."""
    r = normalise_requests(requests).withColumn("window_size", F.lit(1))
    return forecast(r, history, model, index)


def ordered(forecast_df: DataFrame) -> DataFrame:
    """Rows in (id, day) order, for a sink that needs them sorted."""
    return forecast_df.orderBy(K.ID, "target_date", "window_size", "day")
