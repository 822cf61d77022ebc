"""Registered queries that show orders and encodings as columns, so that SQL can check them."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T
from shiftspark.operators import audit, features, forecast, model
from shiftspark.operators.places import with_place
from shiftspark.plans import oracle as O
from shiftspark.plans.catalog import REGISTRY, register
from shiftspark.plans.oracle import with_fixtures as W
from shiftspark.sources.tables import Fixtures


def _placed(view: str, order: str, starts: str = "SELECT ") -> str:
    """The view's own oracle, whose last statement ``starts`` so, with each row's place."""
    ctes, body = REGISTRY[view].sql.rsplit("\n" + starts, 1)
    return f"{ctes},\nviewed AS ({starts}{body})\nSELECT *, row_number() OVER (ORDER BY {order}) AS place FROM viewed"


@register("active_sessions_in_order", _placed("active_sessions", "last_accessed DESC, session_id"))
def q_active_in_order(spark, sf):
    fx = Fixtures(spark, sf)
    return with_place(audit.active_sessions(fx.sessions(), fx.now(), ordered=True))


@register("expired_sessions_in_order", _placed("expired_sessions", "expires_at DESC, session_id"))
def q_expired_in_order(spark, sf):
    fx = Fixtures(spark, sf)
    return with_place(audit.expired_sessions(fx.sessions(), fx.now(), ordered=True))


@register("recent_security_events_in_order", _placed("recent_security_events", "created_at DESC, id DESC"))
def q_recent_in_order(spark, sf):
    fx = Fixtures(spark, sf)
    return with_place(audit.recent_security_events(fx.security_logs(), fx.now(), ordered=True))


@register("suspicious_ips_in_order", _placed("suspicious_ips", "violations_count DESC, ip_address"))
def q_suspicious_in_order(spark, sf):
    fx = Fixtures(spark, sf)
    return with_place(audit.suspicious_ips(fx.ip_quotas(), fx.now(), ordered=True))


@register("forecast_in_order", _placed("forecast_history", "id, target_date, window_size, day", "SELECT c.id"))
def q_forecast_in_order(spark, sf):
    fx = Fixtures(spark, sf)
    sched = fx.schedule()
    return with_place(forecast.ordered(forecast.forecast_history(fx.prediction_requests(), sched, features.id_index(sched))))


@register("first_session", W("""
SELECT * FROM sessions WHERE session_id = (SELECT min(session_id) FROM sessions)""", "sessions"))
def q_first_session(spark, sf):
    """One session by its id, here the least one."""
    sessions = Fixtures(spark, sf).sessions()
    return audit.first_session(sessions, sessions.agg(F.min("session_id")).first()[0])


@register("feature_vectors", W(f"""
codes AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT DISTINCT id FROM schedule))
SELECT id, date, concat_ws(',', code, day_of_week, week_of_month, week_of_year, month, day_of_year) AS vector,
       day_of_week AS pair_weekday, day_of_year AS pair_day
FROM (SELECT *, {O.FEATURES_SQL} FROM schedule) JOIN codes USING (id)""", "schedule"))
def q_feature_vectors(spark, sf):
    """The vector that the forests see, in its order; F10: the pair of date features."""
    sched = Fixtures(spark, sf).schedule()
    rows = model.feature_vector().transform(features.training_frame(sched, features.id_index(sched)))
    numbers = F.transform(vector_to_array("features"), lambda x: x.cast("long").cast("string"))
    pair = T.date_features(K.DATE)
    return rows.select(K.ID, K.DATE, F.concat_ws(",", numbers).alias("vector"),
                       pair.getField(K.DAY_OF_WEEK).alias("pair_weekday"), pair.getField(K.DAY_OF_YEAR).alias("pair_day"))
