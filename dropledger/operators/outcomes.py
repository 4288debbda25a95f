"""Download outcomes: month status, run summary, failure predicates, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcome, publication-status and check-result names.
SUCCEEDED, SKIPPED, FAILED = "succeeded", "skipped", "failed"
PENDING, PARTIAL, COMPLETE = "pending", "partial", "complete"
NO_UPDATE, NEW_FOUND, ERROR, NOT_RUN = "no_update", "new_found", "error", "skipped"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def publication_status(succeeded, skipped, failed, target_count) -> Column:
    """Status of a month from its outcome counts, decided in this order:

    no targets → pending; any failure → partial; succeeded + skipped covers
    the targets → complete; something landed → partial; else pending.
    """
    ok = _c(succeeded) + _c(skipped)
    return (F.when(_c(target_count) <= 0, F.lit(PENDING))
            .when(_c(failed) > 0, F.lit(PARTIAL))
            .when(ok >= _c(target_count), F.lit(COMPLETE))
            .when(ok > 0, F.lit(PARTIAL))
            .otherwise(F.lit(PENDING)))


def outcome_counts(outcomes: DataFrame, keys: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Long outcome table → per-group counts (a partial-aggregated groupBy)."""
    o = F.col(outcome)
    return outcomes.groupBy(*keys).agg(
        F.count_if(o == SUCCEEDED).alias("succeeded"),
        F.count_if(o == SKIPPED).alias("skipped"),
        F.count_if(o == FAILED).alias("failed"),
    )


def check_result(succeeded, skipped, failed, ran: Column | bool = True) -> Column:
    """Result label of a check run: error > new_found > no_update; not run → skipped."""
    ran_c = F.lit(ran) if isinstance(ran, bool) else ran
    return (F.when(~ran_c, F.lit(NOT_RUN))
            .when(_c(failed) > 0, F.lit(ERROR))
            .when(_c(succeeded) > 0, F.lit(NEW_FOUND))
            .otherwise(F.lit(NO_UPDATE)))


def contains_any(text, markers: Sequence[str]) -> Column:
    """True if the text contains any of the literal markers (no regex escaping needed)."""
    t = _c(text)
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.coalesce(F.contains(t, F.lit(m)), F.lit(False))
    return hit


def all_match(messages: DataFrame, keys: Sequence[str], message: str,
              markers: Sequence[str], member: Column | None = None,
              out: str = "all_match") -> DataFrame:
    """Per group: true iff the group's list is non-empty and every message has a marker.

    ``member`` selects which rows of the group belong to the list (all rows
    when omitted), so groups with an empty list still appear, with false.
    """
    m = member if member is not None else F.lit(True)
    return messages.groupBy(*keys).agg(
        ((F.count_if(m) > 0) & F.every(~m | contains_any(message, markers))).alias(out)
    )


def newline_rows(text) -> Column:
    """Data rows as the count of newline bytes minus one (header), floored at 0."""
    t = _c(text)
    n = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.greatest(n - 1, F.lit(0)).cast("long")


def content_hash(content) -> Column:
    """SHA-256 hex digest of a string or binary column."""
    return F.sha2(_c(content), 256)
