"""Queries over events, which stand for responses: a user is a host, a type a status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import outcomes, reports
from . import query, table

_STATUS = "CASE event_type WHEN 'error' THEN 403 WHEN 'click' THEN 200 WHEN 'view' THEN 404 WHEN 'signup' THEN 503 ELSE 302 END"
_T = "floor(epoch(ts))::BIGINT"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 404).when(F.col("event_type") == "signup", 503).otherwise(302)
    return e.withColumn("status", status).withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("bigint"))


@query(f"SELECT event_id, CASE WHEN s = 503 THEN 'retry_exhausted' WHEN s = 200 THEN 'success' WHEN s = 404 THEN 'candidate' WHEN s = 403 THEN 'auth_gated' ELSE 'odd_response' END AS outcome FROM (SELECT event_id, {_STATUS} AS s FROM events)")
def outcome_classification(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", outcomes.outcome(F.col("status"), F.lit(None).cast("string")).alias("outcome"))


_STREAK = f"e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t, ({_STATUS} = 403)::INT AS d FROM events), r AS (SELECT *, sum(1 - d) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), k AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS pos FROM r WHERE d = 1), st AS (SELECT user_id, event_id, t, pos FROM k WHERE pos % 2 = 0)"


@query(f"WITH {_STREAK} SELECT user_id, event_id, (pos // 2)::INT AS streak FROM st")
def lockout_streaks(spark, sf_dir):
    return outcomes.lockout_streaks(_events(spark, sf_dir), "user_id", "event_id", "status", threshold=2)


@query(f"WITH {_STREAK}, q AS (SELECT user_id, t, event_id FROM st), c AS (SELECT user_id, event_id, event_id AS event_at, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS strike FROM q), f AS (SELECT *, least(60.0 * power(2, strike - 1), 1800.0)::DOUBLE AS cooldown FROM c) SELECT user_id, event_id, strike, cooldown, max(event_at + cooldown) OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS until FROM f")
def cooldown_escalation(spark, sf_dir):
    strikes = outcomes.lockout_streaks(_events(spark, sf_dir), "user_id", "event_id", "status", threshold=2).select("user_id", "event_id")
    return outcomes.cooldowns(strikes, "user_id", "event_id")


@query(f"WITH e AS (SELECT user_id, event_id, {_T} AS t, event_type FROM events), w AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'purchase'), s AS (SELECT DISTINCT user_id, t AS s FROM e WHERE event_type = 'click'), j AS (SELECT w.user_id, w.t, s.s, abs(w.t - s.s) AS distance, row_number() OVER (PARTITION BY w.user_id, w.t ORDER BY abs(w.t - s.s) NULLS LAST, s.s) AS k FROM w LEFT JOIN s USING (user_id)) SELECT user_id, t, s AS snapshot, distance FROM j WHERE k = 1")
def nearest_snapshot(spark, sf_dir):
    e = _events(spark, sf_dir)
    wanted = e.where("event_type = 'purchase'").select("user_id", "t").distinct()
    shots = e.where("event_type = 'click'").select("user_id", F.col("t").alias("snapshot")).distinct()
    return outcomes.nearest(wanted, shots, "user_id", "t", "snapshot")


@query(f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'timeout' WHEN event_type = 'error' THEN 'refused' WHEN event_type = 'click' THEN 'tls' WHEN event_type = 'signup' THEN 'dns' ELSE 'unreachable' END AS kind FROM events")
def error_kinds(spark, sf_dir):
    text = F.create_map(*[F.lit(x) for x in ("view", "ReadTimeout: 30 s", "error", "('Connection aborted.', RemoteDisconnected())", "click", "[SSL: CERTIFICATE_VERIFY_FAILED]", "signup", "Temporary failure in name resolution", "purchase", "no tls here")])
    return _events(spark, sf_dir).select("event_id", outcomes.error_kind(F.coalesce(text[F.col("event_type")], F.lit("odd"))).alias("kind"))


@query(f"SELECT event_id, CASE WHEN s = 404 THEN 'the page is gone' WHEN s = 403 THEN 'access is denied' WHEN s = 503 THEN 'the site reports a fault' WHEN s BETWEEN 300 AND 399 THEN 'the address leads nowhere definite' ELSE 'nobody could confirm the link' END AS reason FROM (SELECT event_id, {_STATUS} AS s FROM events)")
def plain_reasons(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", outcomes.plain_reason(F.lit(None).cast("string"), F.col("status")).alias("reason"))


@query("SELECT event_type AS level, 'user ' || user_id AS message, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, level, message LIMIT 50")
def log_issue_groups(spark, sf_dir):
    """A top-50 report."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"))
    return reports.message_groups(e, "level", "message")


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return reports.counts(_events(spark, sf_dir), "status")


@query(f"SELECT count(*) AS n_records, count(*) FILTER (s IN (403, 404, 503)) AS n_gaps, count(*) FILTER (s = 404) AS n_missing, count(*) FILTER (s = 403) AS n_gated FROM (SELECT {_STATUS} AS s FROM events)")
def gap_summary(spark, sf_dir):
    s = F.col("status")
    return _events(spark, sf_dir).agg(F.count("*").alias("n_records"), F.count_if(s.isin(403, 404, 503)).alias("n_gaps"), F.count_if(s == 404).alias("n_missing"), F.count_if(s == 403).alias("n_gated"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_walk(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(f"WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE {_STATUS} = 200) SELECT user_id, event_id FROM r WHERE k = 1")
def first_success(spark, sf_dir):
    return outcomes.first_success(_events(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN v >= 3600 THEN printf('%dh%02dm%02ds', v // 3600, (v // 60) % 60, v % 60) WHEN v >= 60 THEN printf('%dm%02ds', v // 60, v % 60) ELSE printf('%ds', v) END AS took FROM (SELECT event_id, (floor(abs(value)) * 40)::BIGINT AS v FROM events)")
def durations(spark, sf_dir):
    from ..functions import urls

    return _events(spark, sf_dir).select("event_id", urls.duration_text((F.floor(F.abs("value")) * 40).cast("bigint")).alias("took"))


@query("WITH d AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, array_to_string(list(event_type || '=' || n ORDER BY event_type), ',') AS kinds, sum(n)::BIGINT AS n FROM d GROUP BY 1")
def removals_by_page(spark, sf_dir):
    """Per page (a user) the removed elements (events) by category."""
    d = reports.counts(_events(spark, sf_dir), "user_id", "event_type")
    return d.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string")))), ",").alias("kinds"), F.sum("n").alias("n"))


@query(f"WITH c AS (SELECT user_id, count(*) FILTER (s = 403) AS a, count(*) FILTER (s = 302) AS m, count(*) FILTER (s = 503) AS u FROM (SELECT user_id, {_STATUS} AS s FROM events) GROUP BY 1) SELECT user_id, CASE WHEN a > 10 THEN 'attention' WHEN m > 10 THEN 'markup only' WHEN u > 10 THEN 'checks not run' ELSE 'clean' END AS headline FROM c")
def checklist_headline(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s) - 10
    c = _events(spark, sf_dir).groupBy("user_id").agg(n(403).alias("a"), n(302).alias("m"), n(503).alias("u"))
    return c.select("user_id", reports.headline(F.col("a"), F.col("m"), F.col("u")).alias("headline"))


@query(f"WITH e AS (SELECT event_id, user_id, {_STATUS} AS s FROM events), u AS (SELECT DISTINCT user_id, s FROM e), c AS (SELECT user_id, s, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, s AS status, n, rank() OVER (PARTITION BY user_id ORDER BY n DESC, s)::INT AS rank FROM c")
def status_ranks(spark, sf_dir):
    c = reports.counts(_events(spark, sf_dir), "user_id", "status")
    return c.withColumn("rank", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "status")))
