"""Fetch outcomes over a table of observed responses: classes, backoff, lockouts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS, BACKOFF, LOCKOUT, COOLDOWN, LONGEST_COOLDOWN = 4, 1.0, 5, 60.0, 1800.0
#: The first kind whose pattern an error's whole text holds; case counts, since these are names of exceptions.
ERROR_KINDS = (
    ("dns", "|".join(("NameResolutionError", "getaddrinfo", "nodename nor servname", "Name or service not known", "Temporary failure in name resolution"))),
    ("tls", "|".join(("SSLError", "SSLCertVerification", "certificate verify failed", "CERTIFICATE_VERIFY_FAILED", "UNSAFE_LEGACY", "WRONG_VERSION_NUMBER"))),
    ("timeout", "|".join(("timed out", "TimeoutError", "ReadTimeout", "ConnectTimeout"))),
    ("refused", "|".join(("ConnectionRefused", "Connection refused", "ConnectionResetError", "Connection aborted", "RemoteDisconnected", "ProtocolError"))),
    ("redirect_loop", "TooManyRedirects|exceeded 30 redirects"),
)


def transient(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def outcome(status: Column, error: Column) -> Column:
    """``success``, or the flag that the capture gets, or ``candidate`` for what is plainly gone."""
    return (
        F.when(error.isNotNull() | transient(status), F.lit("retry_exhausted"))
        .when(status.between(200, 299), F.lit("success"))
        .when(status.isin(404, 410), F.lit("candidate"))
        .when(status.isin(401, 403), F.lit("auth_gated"))
        .otherwise(F.lit("odd_response"))
    )


def error_kind(message: Column) -> Column:
    out = F.lit("unreachable")
    for name, pattern in reversed(ERROR_KINDS):
        out = F.when(message.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(message.isNotNull(), out)


def failure_kind(error: Column, flag: Column) -> Column:
    """Of a failed request: its error's kind, ``auth`` for a gated answer, else ``http``."""
    return F.when(error.isNotNull(), error_kind(error)).when(flag == "auth_gated", F.lit("auth")).otherwise(F.lit("http"))


def failure_text(error: Column, flag: Column, status: Column) -> Column:
    """The failure for a technical reader: an error's first line, at most 120 characters of it, or the status and what it means."""
    code = F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("None")))
    return (
        F.when(error.isNotNull(), F.concat(F.lit("unreachable ("), F.substring(F.get(F.split(error, "\\r\\n|\\n|\\r"), F.lit(0)), 1, 120), F.lit(")")))
        .when(flag == "auth_gated", F.concat(code, F.lit(" (auth-gated -- may not actually be broken)")))
        .when(flag == "retry_exhausted", F.concat(code, F.lit(" (retries exhausted)")))
        .otherwise(code)
    )


def plain_reason(kind: Column, status: Column) -> Column:
    """A failure in words: by kind, else by status, else by its range."""
    return (
        F.when(kind == "dns", F.lit("the site's name no longer exists"))
        .when(kind == "tls", F.lit("the secure connection fails"))
        .when(kind == "timeout", F.lit("the site does not answer in time"))
        .when(kind == "refused", F.lit("the site refuses connections"))
        .when(kind == "redirect_loop", F.lit("the site redirects in a circle"))
        .when(kind == "auth", F.lit("the site asks for a login, so nobody could check"))
        .when(kind == "unreachable", F.lit("the site cannot be reached"))
        .when(status == 400, F.lit("the address is malformed"))
        .when(status == 408, F.lit("the site does not answer in time"))
        .when(status == 429, F.lit("the site asks to slow down"))
        .when(status == 404, F.lit("the page is gone"))
        .when(status == 410, F.lit("the page was removed"))
        .when(status.isin(401, 403), F.lit("access is denied"))
        .when(status.between(500, 599), F.lit("the site reports a fault"))
        .when(status.between(300, 399), F.lit("the address leads nowhere definite"))
        .when(status.between(400, 499), F.concat(F.lit("the site turns the request away, code "), status.cast("string")))
        .otherwise(F.lit("nobody could confirm the link"))
    )


def backoff_schedule(base: float = BACKOFF, attempts: int = ATTEMPTS) -> Column:
    """Seconds to sleep after each failed attempt but the last."""
    return F.array(*[F.lit(base * 2**n) for n in range(attempts - 1)])


def unrecoverable(owned: Column) -> Column:
    return F.when(owned, F.lit("missing")).otherwise(F.lit("external_unfetchable"))


def lockout_streaks(responses: DataFrame, host: str, order: str, status: str, threshold: int = LOCKOUT) -> DataFrame:
    """(host, order, streak): every threshold-th consecutive denial (401, 403) of a host; 429 neither counts nor breaks a streak."""
    rows = responses.where(F.col(status) != 429).withColumn("__d", F.col(status).isin(401, 403).cast("int"))
    w = Window.partitionBy(host).orderBy(order)
    marked = rows.withColumn("__run", F.sum(1 - F.col("__d")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(host, "__run").orderBy(order))
    hits = marked.where("__d = 1").withColumn("pos", nth)
    return hits.where(F.pmod(F.col("pos"), F.lit(threshold)) == 0).select(host, order, (F.col("pos") / threshold).cast("int").alias("streak"))


def cooldowns(strikes: DataFrame, host: str, order: str, base: float = COOLDOWN, most: float = LONGEST_COOLDOWN) -> DataFrame:
    """Adds ``strike`` (from 1), ``cooldown`` (doubling, capped) and ``until``, the running maximum of time plus cooldown.

    ``order`` is in seconds.
    """
    w = Window.partitionBy(host).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = strikes.withColumn("strike", F.count("*").over(w))
    n = n.withColumn("cooldown", F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("strike") - 1, F.lit(40))), F.lit(most)))
    return n.withColumn("until", F.max(F.col(order) + F.col("cooldown")).over(w))


def nearest(wanted: DataFrame, snapshots: DataFrame, key: str, at: str, then: str) -> DataFrame:
    """Adds the snapshot of the key closest in time to ``at``: ``then`` and ``distance``; the earlier of equals.

    Two running lookups over the union of both sides, one shuffle by key and no join
    of all snapshots with all requests.
    """
    a = wanted.select(key, F.col(at).alias("t"), F.lit(None).cast(dict(snapshots.dtypes)[then]).alias("s"))
    both = a.unionByName(snapshots.select(key, F.col(then).alias("t"), F.col(then).alias("s")))
    w = Window.partitionBy(key).orderBy("t")
    # range frames: a snapshot at the very time counts on either side
    before = F.max("s").over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("s").over(w.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumn("b", before).withColumn("n", after).where(F.col("s").isNull())
    db, dn = F.col("t") - F.col("b"), F.col("n") - F.col("t")
    best = F.when(F.col("n").isNull() | (db <= dn), F.col("b")).otherwise(F.col("n"))
    return both.select(key, F.col("t").alias(at), best.alias(then), F.abs(F.col("t") - best).alias("distance"))


def first_success(responses: DataFrame, final_url: str, order: str) -> DataFrame:
    """The first successful response of each final URL."""
    ok = responses.where(F.col("status").between(200, 299))
    return ok.withColumn("__n", F.row_number().over(Window.partitionBy(final_url).orderBy(order))).where("__n = 1").drop("__n")
