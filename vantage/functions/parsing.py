"""Parsing scalars for landed records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Module markers in source paths, in the order they are tried.
MODULE_MARKERS = ("/addons/", "/odoo/addons/", "/enterprise/")
# Default retention policy per plan (unknown plans get "cloud").
PLAN_POLICIES = {
    "cloud": {"error_traces_days": 7, "profiler_recordings_days": 7, "budget_samples_days": 30,
              "schema_snapshots_keep": 10, "raw_logs_days": 3},
    "onprem": {"error_traces_days": 30, "profiler_recordings_days": 30, "budget_samples_days": 90,
               "schema_snapshots_keep": 30, "raw_logs_days": 14},
    "enterprise": {"error_traces_days": -1, "profiler_recordings_days": -1, "budget_samples_days": -1,
                   "schema_snapshots_keep": -1, "raw_logs_days": 90},
}
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_IPV6 = r"^(?=.*:)(?!.*:::)(?!(?:.*::){2})[0-9A-Fa-f:]*(?:[0-9A-Fa-f]{1,4}|(?:[0-9]{1,3}\.){3}[0-9]{1,3}|:)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def module_from_source(path) -> Column:
    """The path segment after the first '/addons/' (then '/odoo/addons/',
    then '/enterprise/'); '' when none gives a non-empty segment."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    out = F.lit("")
    for m in reversed(MODULE_MARKERS):
        seg = F.regexp_extract(p, "^.*?" + m.replace("/", r"\/") + r"([^/]*)", 1)
        out = F.when(F.instr(p, m) > 0, F.when(seg != "", seg).otherwise(out)).otherwise(out)
    return out


def client_ip(remote_addr) -> Column:
    """Strip the port (and IPv6 brackets); NULL unless a valid address."""
    a = _c(remote_addr)
    bracket = a.startswith("[") & (F.instr(a, "]") > 0)
    inner = F.regexp_extract(a, r"^\[(.*)\][^\]]*$", 1)
    before_last_colon = F.regexp_extract(a, r"^(.*):[^:]*$", 1)
    host = (F.when(bracket, inner)
            .when(F.instr(a, ":") > 0, before_last_colon)
            .otherwise(a))
    ok = host.rlike(_IPV4) | host.rlike(_IPV6)
    return F.when(ok, host)


def many2one_id(json_value) -> Column:
    """N9: '[id, "name"]' -> id; a bare integer -> itself; false / bad -> NULL."""
    v = _c(json_value)
    first = F.get_json_object(v, "$[0]")
    return F.coalesce(first.try_cast("bigint"), v.try_cast("bigint"))


def many2many_ids(json_value) -> Column:
    """JSON list of ids -> non-zero ids."""
    arr = F.from_json(_c(json_value), T.ArrayType(T.LongType()))
    return F.filter(F.coalesce(arr, F.array().cast("array<bigint>")), lambda x: x != 0)


FLAGS_SCHEMA = T.StructType([T.StructField("sampling_mode", T.StringType()),
                             T.StructField("sample_rate", T.DoubleType()),
                             T.StructField("slow_threshold_ms", T.IntegerType())])


def sampler_config(flags_json) -> Column:
    """Feature flags -> sampler config; non-full modes always capture
    error, slow_query and n1."""
    f = F.from_json(_c(flags_json), FLAGS_SCHEMA)
    return F.struct(f["sampling_mode"].alias("mode"), f["sample_rate"].alias("sample_rate"),
                    F.when(F.coalesce(f["sampling_mode"], F.lit("")) != "full", F.lit("error,slow_query,n1"))
                    .otherwise(F.lit("")).alias("always_capture"),
                    f["slow_threshold_ms"].alias("slow_threshold_ms"))


def plan_policy(plan) -> Column:
    """Plan -> default retention policy struct (unknown -> cloud)."""
    def struct_of(d):
        return F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    p = _c(plan)
    return (F.when(p == "onprem", struct_of(PLAN_POLICIES["onprem"]))
            .when(p == "enterprise", struct_of(PLAN_POLICIES["enterprise"]))
            .otherwise(struct_of(PLAN_POLICIES["cloud"])))
