"""Alert episodes from ordered findings, as windows (batch). ``streaming.episodes`` has the fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groma.operators.ordered import Ordered


def episodes(events: DataFrame, *, allowed: float, visible_after: float, critical_after: float, key: str = "fingerprint", clock: str = "clock", kind: str = "kind", above: str = "above") -> DataFrame:
    """One row per episode: key, episode, first_seen, last_seen, status, duration, critical_duration, severity, suppressed.

    kind: F (a finding), C (none), N (nothing can be said). The clock rises strictly within
    a key. An episode goes on while findings follow each other within ``allowed``; a clean
    sample resolves it and moves its end, anything else interrupts it.
    """
    sample = {"_before": F.col(kind), "_before_clock": F.col(clock), "_before_above": F.col(above)}
    rows = Ordered.of(events, [key], [clock]).neighbours(before=sample, after={"_next": F.struct(F.col(kind).alias("kind"), F.col(clock).alias("clock"))})
    start = F.coalesce((F.col("_before") != "F") | (F.col(clock) - F.col("_before_clock") > allowed), F.lit(True))
    found = rows.having(rows.rows.filter(F.col(kind) == "F").withColumn("_start", start)).running(F.col("_start").cast("int"), "episode").done()
    # critical time counts from the first of the last samples above the ratio
    since = F.max(F.when(F.col(above) & (F.col("_start") | ~F.col("_before_above")), F.col(clock)))
    last = F.max_by(F.struct("_next", F.col(above).alias("above")), clock)
    whole = found.groupBy(key, "episode").agg(F.min(clock).alias("first_seen"), F.max(clock).alias("_end"), last.alias("_last"), since.alias("_since"))
    whole = whole.withColumn("duration", F.col("_end") - F.col("first_seen"))
    critical = F.when(F.col("_last.above"), F.col("_end") - F.col("_since")).otherwise(F.lit(0))
    seen = F.col("duration") >= visible_after
    after = F.col("_last._next.kind")
    status = F.when(after == "C", "resolved").when(after.isNotNull(), "interrupted").when(seen, "open").otherwise("unknown")
    return whole.select(
        key,
        F.col("episode").cast("long").alias("episode"),
        "first_seen",
        F.when(after == "C", F.col("_last._next.clock")).otherwise(F.col("_end")).alias("last_seen"),
        status.alias("status"),
        "duration",
        critical.alias("critical_duration"),
        F.when(F.col("_last.above") & (critical >= critical_after), "critical").otherwise("warning").alias("severity"),
        (~seen).alias("suppressed"),
    )


def open_alerts(alerts: DataFrame, *, key: str = "fingerprint") -> DataFrame:
    """key, alerts, open: suppressed rows go first, then all but the latest row of each episode."""
    rest = [c for c in alerts.columns if c not in (key, "episode")]
    latest = alerts.filter(~F.col("suppressed")).groupBy(key, "episode").agg(F.max_by(F.struct(*rest), F.struct("last_seen", "id")).alias("_a"))
    return latest.groupBy(key).agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("_a.status") == "open").alias("open"))


def relevant(alerts: DataFrame) -> DataFrame:
    """What belongs in a report: known status, a message, not suppressed, and not plainly unconfirmed (null is not)."""
    return alerts.filter("status <> 'unknown' and message is not null and not suppressed and confirmed is distinct from false")


def tabs(*, reviewed: Column) -> dict[str, Column]:
    """Conditions of the lists that alerts are shown in."""
    return {"open": F.col("status") == "open", "critical": (F.col("severity") == "critical") & ~F.col("suppressed"), "reviewed": reviewed}


def request_outcomes(requests: DataFrame, *, keys: Sequence[str], order: str, content: str) -> DataFrame:
    """requests with outcome: the first of a key is an insert, one of the same content a replay, another a conflict. One aggregate, joined back."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(order, content)).alias("_first"))
    joined = requests.join(first, list(keys))
    same = F.col(content).eqNullSafe(F.col(f"_first.{content}"))
    return joined.withColumn("outcome", F.when(F.col(order) == F.col(f"_first.{order}"), "insert").when(same, "replay").otherwise("conflict")).drop("_first")


def report(found: DataFrame, *, zone: str, classes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows of the event report: confirmed events with local times and whole minutes, and for each class what was expected and seen."""
    local = lambda c: F.date_format(F.from_utc_timestamp(F.timestamp_micros(F.col(c).cast("long")), zone), "dd.MM.yyyy HH:mm:ss")
    counts = [c.alias(f"{what}_{name}") for name, pair in classes.items() for what, c in zip(("expected", "seen"), pair, strict=True)]
    shown = found.filter(~F.col("suppressed") & (F.col("status") != "unknown"))
    return shown.select(F.concat_ws("#", "fingerprint", F.col("episode").cast("string")).alias("event"), local("first_seen").alias("begun"), local("last_seen").alias("ended"), F.floor(F.col("duration") / 60_000_000).cast("long").alias("minutes"), "status", "severity", *counts)
