"""Audit events, compliance reports and electronic signatures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S

# Report types, actions that need a signature, event filters.
REPORT_TYPES = ("user_actions", "data_access", "data_modifications", "comprehensive")
CRITICAL_ACTIONS = ("activate_contract", "deactivate_contract", "modify_quality_rules", "approve_schema",
                    "export_data", "delete_data")
FILTER_COLUMNS = {"EventName": "event_name", "Username": "username"}
MODIFY_EVENT = "PutObject"
OBJECT_TYPE = "AWS::S3::Object"
PREVIEW_EVENTS = 50

EVENT_COLUMNS = ("event_id", "event_name", "event_time", "username", "resources", "cloud_trail_event")


class AuditError(ValueError):
    """An audit request is incomplete."""


def _check_window(start, end) -> None:
    if start >= end:
        raise AuditError("start_time must be before end_time")


def audit_rows(df: DataFrame) -> DataFrame:
    """Structured events from (event_type, user_id, action, resource, ts [, details]); incomplete rows carry an error."""
    needed = ("event_type", "user_id", "action", "resource")
    whole = F.lit(True)
    for c in needed:
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    event_id = F.concat(F.col("event_type"), F.lit("-"), S.epoch_ms(F.col("ts")).cast("string"))
    details = F.col("details") if "details" in df.columns else F.lit("{}")
    return df.select(F.when(whole, event_id).alias("event_id"), *needed, "ts",
                     F.coalesce(details, F.lit("{}")).alias("details"),
                     F.when(~whole, "event_type, user_id, action, and resource are required").alias("error"))


def query_events(df: DataFrame, start, end, filters: Mapping[str, str] | None = None) -> DataFrame:
    """All events of a time window (both ends included) matching the given attributes."""
    _check_window(start, end)
    out = df.where(F.col("event_time").between(F.lit(start), F.lit(end)))
    for key, value in (filters or {}).items():
        if key in FILTER_COLUMNS:
            out = out.where(F.col(FILTER_COLUMNS[key]) == value)
        elif key == "ResourceType":
            out = out.where(F.exists("resources", lambda r: r["ResourceType"] == value))
        elif key == "ResourceName":
            out = out.where(F.exists("resources", lambda r: r["ResourceName"] == value))
    return out


def touches_tenant(cmo_id: str) -> Column:
    """The raw record or any resource name holds the tenant id as a whole token: cmo-7's events, not cmo-70's."""
    in_resource = F.coalesce(F.exists("resources", lambda r: S.has_token(r["ResourceName"], cmo_id)), F.lit(False))
    return S.has_token(F.col("cloud_trail_event"), cmo_id) | in_resource


def tenant_text(columns: list[str]) -> Column:
    """The text that ``touches_tenant`` looks at, for an index over tokens: record and resource names, a line each."""
    return F.concat_ws("\n", "cloud_trail_event", F.transform("resources", lambda r: r["ResourceName"]))


def data_access(df: DataFrame, cmo_id: str, start, end) -> DataFrame:
    """Object events of one tenant in a window."""
    if not cmo_id:
        raise AuditError("cmo_id is required")
    return query_events(df, start, end, {"ResourceType": OBJECT_TYPE}).where(touches_tenant(cmo_id))


def merge_events(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists, each event id once, the first list winning; events without an id are all kept."""
    known = F.coalesce(F.col("event_id"), F.lit("")) != ""
    ids = first.where(known).select("event_id").distinct()
    extra = second.where(~known).unionByName(second.where(known).join(ids, "event_id", "left_anti").select(*second.columns))
    return first.unionByName(extra)


def distinct_events(events: DataFrame) -> DataFrame:
    """One row per event id (any id-less rows kept), lowest priority value first."""
    # an id-less row is its own group, so all are one aggregate over one scan
    key = F.when(F.coalesce(F.col("event_id"), F.lit("")) != "", F.struct(F.col("event_id"), F.lit(-1).cast("long").alias("row"))).otherwise(
        F.struct(F.col("event_id"), F.monotonically_increasing_id().alias("row")))
    payload = [c for c in events.columns if c not in ("event_id", "priority")]
    once = events.withColumn("_key", key).groupBy("_key").agg(
        F.min_by(F.struct(*payload), F.struct("priority", "event_time", "event_name", "username")).alias("e"))
    return once.select(F.col("_key.event_id").alias("event_id"), *[F.col(f"e.{c}").alias(c) for c in payload])


def compliance_events(df: DataFrame, report_type: str, cmo_id: str, start, end) -> DataFrame:
    """The events of a compliance report."""
    if report_type not in REPORT_TYPES:
        raise AuditError(f"Invalid report_type '{report_type}'. Must be one of {list(REPORT_TYPES)}")
    if not cmo_id:
        raise AuditError("cmo_id is required")
    names_tenant = S.record_has_token(df.columns, cmo_id)
    if report_type == "user_actions":
        return query_events(df, start, end).where(names_tenant)
    if report_type == "data_access":
        return data_access(df, cmo_id, start, end)
    if report_type == "data_modifications":
        return query_events(df, start, end, {"EventName": MODIFY_EVENT}).where(names_tenant)
    everything = query_events(df, start, end).withColumn("priority", F.lit(0))
    # a tenant's object events are among them: one source needs no second list; the first occurrence of an id
    # decides before the tenant filter is applied
    return distinct_events(everything).select(*df.columns).where(names_tenant)


def user_report(df: DataFrame, user_id: str, start, end) -> DataFrame:
    """Events of one user in a window."""
    if not user_id:
        raise AuditError("user_id is required")
    return query_events(df, start, end, {"Username": user_id})


def event_breakdown(events: DataFrame) -> DataFrame:
    """(event_name, n)."""
    return events.groupBy(F.coalesce("event_name", F.lit("unknown")).alias("event_name")).agg(
        F.count(F.lit(1)).alias("n"))


def report_summary(events: DataFrame) -> DataFrame:
    """One row: total events, distinct users and distinct event names; the counts per name are ``event_breakdown``.

    Counted per (event name, user) first, so the final step sees only those few rows.
    """
    name, user = (F.coalesce(c, F.lit("unknown")).alias(c) for c in ("event_name", "username"))
    cells = events.groupBy(name, user).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.count_distinct("username").alias("unique_users"),
                     F.count_distinct("event_name").alias("event_names"))


def preview(events: DataFrame, n: int = PREVIEW_EVENTS) -> DataFrame:
    """The report's first events in time order, numbered, each with the count of those not shown."""
    total = events.agg(F.count(F.lit(1))).scalar()
    first = events.orderBy("event_time", "event_id").limit(n)
    return first.select("event_id", "event_name", "username", "event_time",
                        F.greatest(total - n, F.lit(0).cast("bigint")).alias("more_events"))


def signature_hash() -> Column:
    return F.sha2(F.concat("user_id", "action", "resource", "intent", "timestamp_iso"), 256)


def sign(df: DataFrame) -> DataFrame:
    """Signatures of (user_id, action, resource, intent, auth_method, timestamp_iso) rows.

    Only critical actions can be signed; refused rows carry an ``error`` and no hash.
    """
    error = F.lit(None).cast("string")
    for c in reversed(("user_id", "action", "resource", "intent", "auth_method")):
        error = F.when(F.coalesce(F.col(c), F.lit("")) == "", f"{c} is required").otherwise(error)
    refused = F.concat(F.lit("Action '"), F.col("action"),
                       F.lit(f"' is not a critical action. Must be one of: {sorted(CRITICAL_ACTIONS)}"))
    error = F.coalesce(error, F.when(~F.col("action").isin(*CRITICAL_ACTIONS), refused))
    digest = F.when(error.isNull(), signature_hash())
    return df.withColumn("error", error).withColumn("content_hash", digest).withColumn(
        "signature_id", F.concat(F.lit("SIG-"), F.upper(F.left(F.sha2(F.concat_ws("|", digest, "auth_method"), 256),
                                                               F.lit(16)))))


def verify_signatures(df: DataFrame) -> DataFrame:
    """Adds ``valid``: the stored hash equals the recomputed one."""
    return df.withColumn("valid", F.coalesce(signature_hash() == F.col("content_hash"), F.lit(False)))


def signatures_for(df: DataFrame, start, end, resource: str | None = None, user: str | None = None) -> DataFrame:
    """Signatures on a resource or by a user, both ends of the time range included."""
    if not (resource or user):
        raise AuditError("resource or user is required")
    out = df.where(F.col("timestamp_iso").between(F.lit(start), F.lit(end)))
    if resource:
        out = out.where(F.col("resource") == resource)
    return out if not user else out.where(F.col("user_id") == user)
