"""The queue of events to publish: backlog, claims, outcomes. Transitions are functions of rows and a given time.

Rows have status (pending, publishing, published, quarantined), attempts, lease_owner, lease_expires_at and
last_error_code. The lease column is also the time before which a released row is not due again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "publishing", "published", "quarantined")
POISON_ATTEMPTS = 5
LONGEST_BACKOFF = 60


def backoff_seconds(attempts: Column) -> Column:
    """1, 2, 4, ... up to a minute; from the first attempt on."""
    return F.least(F.lit(LONGEST_BACKOFF).cast("long"), F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)) - 1, F.lit(6))).cast("long"))


def due(now: Column) -> Column:
    return F.col("status").isin("pending", "publishing") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))


def backlog(rows: DataFrame, created: str = "created_at") -> DataFrame:
    """Counts of all statuses, zero where there are none, and the oldest unpublished day."""
    oldest = F.min(F.when(F.col("status").isin("pending", "publishing"), F.col(created)))
    return rows.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.date_format(oldest, "yyyy-MM-dd").alias("oldest_unpublished"))


def oldest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a total order, by partial top-n in every task."""
    return rows.orderBy(*order).limit(n)


def claim(rows: DataFrame, now: Column, n: int, *order: str, owner: str = "relay", lease: str = "INTERVAL 30 SECONDS") -> DataFrame:
    """The oldest due rows, taken by an owner for the time of a lease."""
    taken = oldest(rows.where(due(now)), n, *order)
    return taken.withColumns({"status": F.lit("publishing"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(owner), "lease_expires_at": now + F.expr(lease)})


def finish(rows: DataFrame, outcomes: DataFrame, key: str, now: Column, owner: str = "relay") -> DataFrame:
    """``rows`` after outcomes (key, outcome, code): published only for the lease's owner; transient goes back with a
    backoff; malformed, unsupported and mismatched are quarantined; ambiguous stays as it is and may come twice."""
    fatal = ("malformed_envelope", "unsupported_contract", "aggregate_key_mismatch")
    own = (F.col("status") == "publishing") & (F.col("lease_owner") == owner)
    done, back, stop = own & (F.col("outcome") == "published"), own & (F.col("outcome") == "transient"), own & F.col("outcome").isin(*fatal)
    later = now + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    out = rows.join(outcomes, key, "left")
    return out.withColumns({
        "lease_expires_at": F.when(back, later).when(done | stop, None).otherwise(F.col("lease_expires_at")),
        "lease_owner": F.when(done | back | stop, None).otherwise(F.col("lease_owner")),
        "last_error_code": F.when(stop, F.col("outcome")).when(back, F.col("code")).otherwise(F.col("last_error_code")),
        "status": F.when(done, "published").when(back, "pending").when(stop, "quarantined").otherwise(F.col("status")),
    }).select(*rows.columns)


def release(rows: DataFrame, chosen: Column) -> DataFrame:
    """Quarantined rows that are chosen become pending; attempts and last error stay."""
    free = chosen & (F.col("status") == "quarantined")
    return rows.withColumns({"lease_owner": F.when(~free, F.col("lease_owner")), "lease_expires_at": F.when(~free, F.col("lease_expires_at")), "status": F.when(free, "pending").otherwise(F.col("status"))})
