"""Live forms: a host's rate limit as keyed state, and captures merged batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.captures import upsert
from ..operators.outcomes import COOLDOWN, LOCKOUT, LONGEST_COOLDOWN

_OUT = "host string, seq long, status int, allowed_at double, cooldown double, strikes int"
_STATE = "streak int, lockouts int, limits int, next_at double"


def _step(*, spacing: float = 1.0, threshold: int = LOCKOUT, base: float = COOLDOWN, most: float = LONGEST_COOLDOWN):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, lockouts, limits, next_at = state.get if state.exists else (0, 0, 0, 0.0)
        rows = []
        escalated = lambda n: min(base * 2.0 ** min(n, 60), most)
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            allowed = max(r.at, next_at)
            next_at, cool, strikes = allowed + spacing, 0.0, 0
            if r.status == 429:
                cool = min(float(r.retry_after), most) if pd.notna(r.retry_after) else escalated(limits)
                limits += 1
                strikes = limits
            elif threshold and r.status in (401, 403):
                streak += 1
                if streak >= threshold:
                    cool, lockouts, streak = escalated(lockouts), lockouts + 1, 0
                strikes = lockouts
            else:
                streak = 0
            next_at = max(next_at, r.at + cool)
            rows.append((key[0], r.seq, r.status, allowed, cool, strikes))
        state.update((streak, lockouts, limits, next_at))
        yield pd.DataFrame(rows, columns=["host", "seq", "status", "allowed_at", "cooldown", "strikes"])

    return step


class _Once:
    """A state that starts empty, for a table's whole history of a host."""

    exists = False

    def update(self, value: tuple) -> None:
        pass


def limiter(**options):
    """``rate_limited``'s step for ``applyInPandas`` over a table: every host's history at once."""
    step = _step(**options)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return next(step(key, iter([frame]), _Once()))

    return run


def rate_limited(responses: DataFrame, *, spacing: float = 1.0, threshold: int = LOCKOUT, base: float = COOLDOWN, most: float = LONGEST_COOLDOWN) -> DataFrame:
    """A stream (host, seq, status, at seconds, retry_after double) to each response's next allowed time.

    State a host: the denial streak, lockouts and rate limits so far, and the next allowed
    time, which only moves forward. Lockouts and rate limits escalate apart. A 429 waits
    for Retry-After up to ``most``, else for the escalated time, and leaves the streak
    alone; every ``threshold``-th denial in a row is a lockout and restarts it.
    ``strikes`` counts those of the row's own kind. A batch's rows of a host are handled
    in the order of ``seq``.
    """

    step = _step(spacing=spacing, threshold=threshold, base=base, most=most)
    return responses.groupBy("host").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def merge_captures(stream: DataFrame, table: str, checkpoint: str):
    """Merges a stream of captures into versioned Parquet folders ``table``/v<batch>; a batch run again writes the same version.

    Only the first batch starts from nothing: where the version before any other is missing, the stream fails.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        old = spark.read.schema(df.schema).parquet(f"{table}/v{n - 1}") if n else df.limit(0)
        upsert(old, df).write.mode("overwrite").parquet(f"{table}/v{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
