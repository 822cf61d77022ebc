"""Registered queries over the forests of many data sets, with forests in SQL as their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators import features, forests
from shiftspark.operators.forests import DATASET, MICRO, POISSON_STEPS
from shiftspark.plans import oracle as O
from shiftspark.plans.catalog import _CALENDAR_SQL, register
from shiftspark.plans.oracle import with_fixtures as W
from shiftspark.sources.tables import Fixtures

# Fewer and flatter trees than a model's 100 of depth 10, since the oracle grows them in SQL too.
PARAMS = forests.ForestsParams(num_trees=10, max_depth=5)
FIRST_DAYS, STEP_DAYS = 10, 5

# A third of the ids are of one data set, and few of the last.
_DATASET_SQL = "CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'set0' ELSE concat('set', 1 + CAST(id AS BIGINT) % 101 % 7) END"


def dataset_of(id_col: str = K.ID) -> F.Column:
    n = F.col(id_col).cast("long")
    return F.when(n % 3 == 0, "set0").otherwise(F.concat(F.lit("set"), (1 + n % 101 % 7).cast("string")))


def forest_sql(p: forests.ForestsParams) -> str:
    """Common table expressions that grow ``forest`` from ``train`` (dataset_id, id, date, ys, ye, x)."""
    steps = " + ".join(f"CAST(u >= {t} AS BIGINT)" for t in POISSON_STEPS)
    key = "dataset_id, target, tree, node"
    sql = f"""
drawn AS MATERIALIZED (
  SELECT *, {steps} AS w FROM (
    SELECT *, CAST(concat('0x', substr(md5(concat_ws(':', '{p.seed}', tree, id, date, ys, ye)), 1, 8)) AS BIGINT) AS u
    FROM train, (SELECT CAST(range AS INTEGER) AS tree FROM range({p.num_trees})))),
rows0 AS MATERIALIZED (
  SELECT dataset_id, 'start' AS target, tree, CAST(1 AS BIGINT) AS node, w, x, ys AS y FROM drawn WHERE w > 0
  UNION ALL SELECT dataset_id, 'end', tree, 1, w, x, ye FROM drawn WHERE w > 0)"""
    for level in range(p.max_depth + 1):
        leaf = "TRUE" if level == p.max_depth else "lo = hi OR score IS NULL"
        sql += f""",
cells{level} AS (
  SELECT {key}, f, x[f + 1] AS v, sum(w) AS n, sum(w * y) AS s, min(y) AS lo, max(y) AS hi
  FROM rows{level}, (SELECT CAST(range AS INTEGER) AS f FROM range({len(K.FEATURES)})) GROUP BY ALL),
cuts{level} AS (
  SELECT {key}, f, v, sum(n) OVER (q) AS n, sum(s) OVER (q) AS s, min(lo) OVER (q) AS lo, max(hi) OVER (q) AS hi,
         sum(n) OVER (q ORDER BY v) AS nl, sum(s) OVER (q ORDER BY v) AS sl, lead(v) OVER (q ORDER BY v) AS nxt
  FROM cells{level} WINDOW q AS (PARTITION BY {key}, f)),
scored{level} AS (
  SELECT *, (v + nxt) / 2.0 AS t, CASE WHEN nxt IS NOT NULL THEN CAST(sl AS DOUBLE) * CAST(sl AS DOUBLE) / CAST(nl AS DOUBLE)
            + CAST(s - sl AS DOUBLE) * CAST(s - sl AS DOUBLE) / CAST(n - nl AS DOUBLE) END AS score FROM cuts{level}),
nodes{level} AS MATERIALIZED (
  SELECT {key}, {level} AS level, CAST(n AS BIGINT) AS n, CAST((s * {MICRO}) // n AS BIGINT) AS value,
         CASE WHEN NOT ({leaf}) THEN f END AS feature, CASE WHEN NOT ({leaf}) THEN CAST(t AS DOUBLE) END AS threshold
  FROM scored{level} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC NULLS LAST, f, t) = 1)"""
        if level < p.max_depth:
            sql += f""",
rows{level + 1} AS MATERIALIZED (
  SELECT r.dataset_id, r.target, r.tree, 2 * r.node + CAST(r.x[n.feature + 1] > n.threshold AS BIGINT) AS node, w, x, y
  FROM rows{level} r JOIN nodes{level} n USING ({key}) WHERE n.feature IS NOT NULL)"""
    return sql + ",\nforest AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM nodes{i}" for i in range(p.max_depth + 1)) + ")"


def guess_sql(p: forests.ForestsParams) -> str:
    """``guess`` (dataset_id, id, date, ps, pe) of the days in ``ask`` (dataset_id, id, date, x)."""
    sql = f""",
at0 AS (
  SELECT *, CAST(1 AS BIGINT) AS node FROM ask, (SELECT CAST(range AS INTEGER) AS tree FROM range({p.num_trees})),
         (SELECT unnest(['start', 'end']) AS target))"""
    for level in range(p.max_depth):
        sql += f""",
at{level + 1} AS MATERIALIZED (
  SELECT a.* REPLACE (CASE WHEN n.feature IS NULL THEN a.node ELSE 2 * a.node + CAST(a.x[n.feature + 1] > n.threshold AS BIGINT) END AS node)
  FROM at{level} a LEFT JOIN nodes{level} n USING (dataset_id, target, tree, node))"""
    mean = "CAST(sum(value) FILTER (target = '{t}') // count(value) FILTER (target = '{t}') AS BIGINT) / {m}.0"
    return sql + f""",
guess AS (
  SELECT dataset_id, id, date, CAST({mean.format(t="start", m=MICRO)} AS DOUBLE) AS ps, CAST({mean.format(t="end", m=MICRO)} AS DOUBLE) AS pe
  FROM at{p.max_depth} LEFT JOIN forest USING (dataset_id, target, tree, node) GROUP BY ALL)"""


_DAYS = f"""
codes AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT id FROM schedule)),
feats AS MATERIALIZED (
  SELECT id, date, CAST(start_time_by_minutes AS BIGINT) AS ys, CAST(end_time_by_minutes AS BIGINT) AS ye,
         [code, day_of_week, week_of_month, week_of_year, month, day_of_year] AS x
  FROM (SELECT *, {O.FEATURES_SQL} FROM schedule) JOIN codes USING (id))"""
_TRAIN = _DAYS + f""",
train AS (SELECT {_DATASET_SQL} AS dataset_id, * FROM feats),"""


def _schedule(spark, sf) -> tuple[Fixtures, DataFrame, DataFrame]:
    fx = Fixtures(spark, sf)
    sched = fx.schedule()
    return fx, sched.withColumn(DATASET, dataset_of()), features.id_index(sched)


@register("forests_by_dataset", W(_TRAIN + forest_sql(PARAMS) + """
SELECT * FROM forest""", "schedule"))
def q_forests_by_dataset(spark, sf):
    _, sched, index = _schedule(spark, sf)
    return forests.fit_forests(features.training_frame(sched, index), PARAMS)


@register("forecast_by_dataset", W(_CALENDAR_SQL.lstrip() + "," + _TRAIN + forest_sql(PARAMS) + f""",
days AS (
  SELECT {_DATASET_SQL.replace("id AS", "c.id AS")} AS dataset_id, c.*, k.code, s.start_time_by_minutes AS hs, s.end_time_by_minutes AS he
  FROM cal c JOIN codes k ON c.id = k.id LEFT JOIN schedule s ON s.id = c.id AND s.date = c.date),
ask AS (SELECT DISTINCT dataset_id, id, date, [code, day_of_week, week_of_month, week_of_year, month, day_of_year] AS x
        FROM (SELECT *, {O.FEATURES_SQL} FROM days) WHERE hs IS NULL)""" + guess_sql(PARAMS) + f""",
out AS (SELECT d.*, ps, pe, pe <= ps AS na FROM days d LEFT JOIN guess USING (dataset_id, id, date))
SELECT dataset_id, id, target_date, window_size, date AS day, strftime(date, '%d/%m/%Y') AS date, {O.WEEKDAY_SQL.format(d="out.date")} AS weekday,
       CASE WHEN hs IS NOT NULL THEN {O.minutes_to_time_sql("hs")} WHEN na THEN 'NA' ELSE {O.minutes_to_time_sql("ps")} END AS start_time,
       CASE WHEN hs IS NOT NULL THEN {O.minutes_to_time_sql("he")} WHEN na THEN 'NA' ELSE {O.minutes_to_time_sql("pe")} END AS end_time,
       hs IS NOT NULL AS historical
FROM out""", "prediction_requests", "schedule"))
def q_forecast_by_dataset(spark, sf):
    fx, sched, index = _schedule(spark, sf)
    nodes = forests.fit_forests(features.training_frame(sched, index), PARAMS)
    requests = fx.prediction_requests().withColumn(DATASET, dataset_of())
    return forests.forecast_by_dataset(requests, sched, nodes, index.withColumn(DATASET, dataset_of()), PARAMS)


_BACKTEST = _DAYS + f""",
cuts AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL {STEP_DAYS} DAY)) AS DATE) AS cut
  FROM (SELECT min(date) + {FIRST_DAYS} AS lo, max(date) AS hi FROM schedule)),
train AS (SELECT CAST(cut AS VARCHAR) AS dataset_id, f.* FROM feats f JOIN cuts ON f.date < cut),""" + forest_sql(PARAMS) + f""",
test AS (SELECT cut, CAST(cut AS VARCHAR) AS dataset_id, f.* FROM feats f JOIN cuts ON f.date >= cut AND f.date < cut + {STEP_DAYS}),
ask AS (SELECT t.dataset_id, id, date, x FROM test t WHERE EXISTS (FROM train b WHERE b.dataset_id = t.dataset_id AND b.id = t.id))""" + guess_sql(PARAMS) + f""",
means AS (
  SELECT dataset_id, id, isodow(date) AS wd, grouping(isodow(date)) AS on_all, CAST(sum(ys * {MICRO}) // count(*) AS BIGINT) / {MICRO}.0 AS bs,
         CAST(sum(ye * {MICRO}) // count(*) AS BIGINT) / {MICRO}.0 AS be
  FROM train GROUP BY GROUPING SETS ((dataset_id, id, isodow(date)), (dataset_id, id))),
tested AS (
  SELECT t.cut, t.id, t.date, CAST(t.date - t.cut + 1 AS INTEGER) AS horizon, a.id IS NOT NULL AS known, a.id IS NOT NULL AND pe > ps AS usable,
         CAST(ys AS DOUBLE) AS start_time_by_minutes, CAST(ye AS DOUBLE) AS end_time_by_minutes, ps AS pred_start, pe AS pred_end,
         CAST(coalesce(d.bs, a.bs) AS DOUBLE) AS base_start, CAST(coalesce(d.be, a.be) AS DOUBLE) AS base_end
  FROM test t LEFT JOIN means a ON a.dataset_id = t.dataset_id AND a.id = t.id AND a.on_all = 1
  LEFT JOIN means d ON d.dataset_id = t.dataset_id AND d.id = t.id AND d.on_all = 0 AND d.wd = isodow(t.date)
  LEFT JOIN guess g ON g.dataset_id = t.dataset_id AND g.id = t.id AND g.date = t.date)"""


def _backtest(spark, sf) -> DataFrame:
    sched = Fixtures(spark, sf).schedule()
    return forests.backtest(sched, features.id_index(sched), FIRST_DAYS, STEP_DAYS, PARAMS)


@register("forecast_backtest", W(_BACKTEST + """
SELECT * FROM tested""", "schedule"))
def q_forecast_backtest(spark, sf):
    return _backtest(spark, sf)


@register("backtest_errors", W(_BACKTEST + """
SELECT horizon, count(*) AS n_days, count(*) FILTER (NOT known) AS n_unknown, count(*) FILTER (known AND NOT usable) AS n_na,
       round(avg(abs(pred_start - start_time_by_minutes)) FILTER (usable), 3) AS model_error_start,
       round(avg(abs(pred_end - end_time_by_minutes)) FILTER (usable), 3) AS model_error_end,
       round(avg(abs(base_start - start_time_by_minutes)) FILTER (usable), 3) AS baseline_error_start,
       round(avg(abs(base_end - end_time_by_minutes)) FILTER (usable), 3) AS baseline_error_end
FROM tested GROUP BY horizon""", "schedule"))
def q_backtest_errors(spark, sf):
    errors = forests.backtest_errors(_backtest(spark, sf), "horizon")
    return errors.withColumns({c: F.round(c, 3) for c in errors.columns if "_error_" in c})
