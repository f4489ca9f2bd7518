"""Scoring and classification scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def impact_score(total_ms, occurrences, peak_calls) -> Column:
    """round(ms * occ * factor / 1000, 2); factor 2 if peak > 100,
    1.5 if > 50, else 1; 0 when ms or occ is 0.

    Computed in integer hundredths so Spark and other engines round the same
    value: ms*occ*factor/10 with factor in halves -> (ms*occ*f2 + 10) div 20.
    """
    ms, occ, peak = _c(total_ms).cast("decimal(19,0)"), _c(occurrences).cast("decimal(18,0)"), _c(peak_calls)
    f2 = F.when(peak > 100, F.lit(4)).when(peak > 50, F.lit(3)).otherwise(F.lit(2))  # factor * 2
    num = (ms * occ).cast("decimal(37,0)") * f2.cast("decimal(1,0)")  # score*100 = num/20, beyond 64 bits
    hundredths = F.floor((num + 10) / F.lit(20))  # round half up of num/20
    return (F.when((ms == 0) | (occ == 0), F.lit(0.0))
            .otherwise(hundredths.cast("double") / 100.0))


def severity(score) -> Column:
    """>= 100 critical, >= 30 high, >= 5 medium, else low."""
    s = _c(score)
    return (F.when(s >= 100, "critical").when(s >= 30, "high")
            .when(s >= 5, "medium").otherwise("low"))


# Fixed values that must equal the reference's output text (C4).
SUGGESTION_READ = ("Use prefetch_fields or batch read: env['%s'].browse(ids).read([fields]) "
                   "instead of individual reads. Peak: %d calls in one window.")
SUGGESTION_SEARCH_READ = ("Combine search+read into a single search_read with domain filter. "
                          "If looping, collect IDs first then batch-read. Peak: %d calls.")
SUGGESTION_SEARCH = ("Cache search results or use a single search with a broader domain. "
                     "Avoid calling search inside loops. Peak: %d calls.")
SUGGESTION_WRITE = ("Batch writes: collect vals dicts and call write once on a recordset. "
                    "env['%s'].browse(ids).write(vals). Peak: %d calls.")
SUGGESTION_CREATE = "Batch creates: pass a list of dicts to env['%s'].create([vals_list]). Peak: %d calls."
SUGGESTION_UNLINK = "Batch deletes: env['%s'].browse(ids).unlink(). Peak: %d calls."
SUGGESTION_NAME_GET = ("Override _compute_display_name or use read(['display_name']) on the recordset. "
                       "Peak: %d calls.")
SUGGESTION_DEFAULT = ("Review %s.%s for loop-based calls. Consider batch operations or caching. "
                      "Peak: %d calls in one window.")


def n1_suggestion(model, method, peak_calls) -> Column:
    """C4: fix-suggestion text by method family."""
    m, me, p = _c(model), _c(method), _c(peak_calls).cast("int")
    return (F.when(me.isin("read", "browse"), F.format_string(SUGGESTION_READ, m, p))
            .when(me == "search_read", F.format_string(SUGGESTION_SEARCH_READ, p))
            .when(me.isin("search", "search_count"), F.format_string(SUGGESTION_SEARCH, p))
            .when(me == "write", F.format_string(SUGGESTION_WRITE, m, p))
            .when(me == "create", F.format_string(SUGGESTION_CREATE, m, p))
            .when(me == "unlink", F.format_string(SUGGESTION_UNLINK, m, p))
            .when(me == "name_get", F.format_string(SUGGESTION_NAME_GET, p))
            .otherwise(F.format_string(SUGGESTION_DEFAULT, m, me, p)))


def budget_alert_severity(overhead_pct, threshold_pct) -> Column:
    """Critical if pct >= 1.5 * threshold (threshold > 0), else warning."""
    pct, thr = _c(overhead_pct).cast("double"), _c(threshold_pct).cast("double")
    return F.when((thr > 0) & (pct >= thr * 1.5), "critical").otherwise("warning")


def pct_hundredths(part, total) -> Column:
    """C20: round(part / total * 100, 2) computed exactly in integer hundredths
    for integer inputs: (part * 20000 + total) div (2 * total).  total 0 -> 0."""
    p, t = _c(part).cast("long"), _c(total).cast("long")
    return F.when(t == 0, F.lit(0.0)).otherwise(
        F.floor((p * 20000 + t) / (t * 2)).cast("double") / 100.0)


def ratio_hundredths(num, den) -> Column:
    """round(num / den, 2), half up, exact for integer inputs (den > 0):
    floor((num * 200 + den) / (2 * den)) / 100.  den 0 -> 0."""
    n, d = _c(num).cast("long"), _c(den).cast("long")
    return F.when(d == 0, F.lit(0.0)).otherwise(
        F.floor((n * 200 + d) / (d * 2)).cast("double") / 100.0)


def safe_div_count(total, count) -> Column:
    """Total / greatest(count, 1) as double."""
    return _c(total).cast("double") / F.greatest(_c(count), F.lit(1)).cast("double")
