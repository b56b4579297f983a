"""Failure handling as tables: error classes, retry queue, dead letters, idempotency ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.sources.tables import KeyedLog

# Error classes in order of precedence with the words that mark them.
NETWORK_WORDS = ("ConnectionError", "ConnectionRefusedError", "ConnectionResetError", "BrokenPipeError",
                 "ConnectionAbortedError", "EndpointConnectionError", "NetworkError", "SocketError", "DNSError")
TIMEOUT_WORDS = ("TimeoutError", "ReadTimeoutError", "ConnectTimeoutError", "SocketTimeoutError", "Timeout")
VALIDATION_WORDS = ("ValidationError", "SchemaValidationError", "ValueError", "InvalidSchema", "DataValidationError")
ERROR_TYPES = ("network", "validation", "timeout", "unknown")
RETRYABLE = ("network", "timeout")
# Suggested action per class.
ACTIONS = {
    "network": "Retry after verifying network connectivity.",
    "timeout": "Retry with increased timeout or check service health.",
    "validation": "Fix record data to match schema before resubmitting.",
    "unknown": "Investigate error details and retry if appropriate.",
}
MAX_RETRIES = 3
LEDGER_TTL_SECONDS = 24 * 3600
QUEUE_STATUSES = ("queued", "processing", "dead_letter")
LEDGER_DDL = ("idempotency_key string, status string, created_at double, ttl bigint, result string, "
              "error_message string")

# Advice per message keyword, first match wins (run advice, then screen advice).
RUN_ADVICE = (
    (("timeout",), "Try activating again. If the issue persists, check your network connectivity and contact support."),
    (("credential", "auth"), "Verify your connection credentials are correct and have the required permissions."),
    (("schema",), "Review your data contract schema definition and ensure it is valid."),
    ((), "Review the error details and try again. If the issue persists, contact support."),
)
RUN_UNKNOWN = "An unknown error occurred. Please try activating the pipeline again or contact support."
SCREEN_ADVICE = (
    (("timeout", "timed out"), "The request took too long. Check your network connection and try again."),
    (("network", "fetch"), "A network error occurred. Verify your internet connection and try again."),
    (("401", "unauthorized"), "Your session may have expired. Please sign in again."),
    (("403", "forbidden"), "You do not have permission to perform this action. Contact your administrator."),
    (("404", "not found"), "The requested resource was not found. It may have been deleted or the ID is incorrect."),
    (("409", "conflict"), "A conflict occurred. The resource may have been modified by another user. "
                          "Refresh and try again."),
    (("500", "internal server"), "An internal server error occurred. Please try again later or contact support."),
    (("schema", "validation"), "Review your input data for correctness and try again."),
    (("credential", "auth", "password"), "Verify your credentials are correct and have the required permissions."),
    ((), "If this issue persists, please contact support."),
)


class InProgressError(RuntimeError):
    """The same operation is already running."""


def _mentions(name: Column, message: Column, words: tuple[str, ...]) -> Column:
    in_name = F.coalesce(name, F.lit("")).rlike("|".join(words))
    in_text = F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(w.lower() for w in words))
    return in_name | in_text


def classify_error(name: Column, message: Column) -> Column:
    """network, timeout, validation or unknown, from the error's name or message."""
    return (F.when(_mentions(name, message, NETWORK_WORDS), "network")
            .when(_mentions(name, message, TIMEOUT_WORDS), "timeout")
            .when(_mentions(name, message, VALIDATION_WORDS), "validation").otherwise("unknown"))


def classify_errors(df: DataFrame) -> DataFrame:
    """Adds ``error_type``, ``retryable`` and ``action`` to (error_name, error_message) rows."""
    typed = df.withColumn("error_type", classify_error(F.col("error_name"), F.col("error_message")))
    return typed.withColumn("retryable", is_retryable(F.col("error_type"))).withColumn(
        "action", suggested_action(F.col("error_type")))


def is_retryable(error_type: Column) -> Column:
    return F.coalesce(error_type.isin(*RETRYABLE), F.lit(False))


def suggested_action(error_type: Column) -> Column:
    """Action text; unknown types get the unknown class's."""
    pairs = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, error_type), F.lit(ACTIONS["unknown"]))


def enqueue(df: DataFrame, now: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Queue rows for failed records (record_id, contract_id, error_type, error_message [, record_data])."""
    kind = F.when(F.col("error_type").isin(*ERROR_TYPES), F.col("error_type")).otherwise("unknown")
    data = F.col("record_data") if "record_data" in df.columns else F.lit("{}")
    queue_id = F.sha2(F.concat_ws("|", "record_id", "contract_id", "error_message", now.cast("string")), 256)
    return df.select(queue_id.alias("queue_id"), "record_id", "contract_id", kind.alias("error_type"),
                     "error_message", F.coalesce(data, F.lit("{}")).alias("record_data"),
                     F.lit(0).alias("retry_count"), F.lit(max_retries).alias("max_retries"),
                     F.lit("queued").alias("status"), now.alias("ts"))


def take_queued(queue: DataFrame, n: int = 10) -> DataFrame:
    """The queue with its ``n`` oldest queued records marked as processing."""
    chosen = (queue.where(F.col("status") == "queued").orderBy("ts", "queue_id").limit(n)
              .select("queue_id", F.lit(True).alias("_taken")))
    return (queue.join(chosen, "queue_id", "left")
            .withColumn("status", F.when(F.col("_taken"), "processing").otherwise(F.col("status"))).drop("_taken"))


def advance_queue(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queue after an attempt: (queue_id, success, error_message) outcomes applied.

    Adds ``disposition``: untouched, done, requeued or dead_letter. An attempt beyond the retry limit
    goes to the dead letters whatever its outcome; done rows are the ones to drop.
    """
    tried = outcomes.groupBy("queue_id").agg(F.bool_or("success").alias("_ok"),
                                             F.max("error_message").alias("_error"))
    joined = queue.join(tried, "queue_id", "left")
    attempted = F.col("_ok").isNotNull()
    count = F.col("retry_count") + attempted.cast("int")
    disposition = (F.when(~attempted, "untouched").when(count > F.col("max_retries"), "dead_letter")
                   .when(F.col("_ok"), "done").otherwise("requeued"))
    return joined.select(
        *[c for c in queue.columns if c not in ("retry_count", "status", "error_message")],
        count.alias("retry_count"), disposition.alias("disposition"),
        F.when(disposition == "requeued", "queued").when(disposition == "dead_letter", "dead_letter")
        .otherwise(F.col("status")).alias("status"),
        F.when(disposition == "requeued", F.coalesce("_error", "error_message"))
        .otherwise(F.col("error_message")).alias("error_message"))


def dead_letters(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status") == "dead_letter")


def error_logs(events: DataFrame) -> DataFrame:
    return events.where(F.col("severity") == "ERROR")


def queue_stats(queue: DataFrame) -> DataFrame:
    """(status, n) for the three statuses, zero when absent."""
    counted = queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATUSES])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in QUEUE_STATUSES])))


def backoff_seconds(retry: Column, base: float = 1.0, zero_based: bool = False,
                    jitter: Column | None = None) -> Column:
    """``base * 2^(retry - 1)`` (or ``2^retry`` counting from zero), plus ``jitter * base`` if given."""
    delay = F.lit(float(base)) * F.pow(F.lit(2.0), retry if zero_based else retry - 1)
    return delay if jitter is None else delay + jitter * base


def error_log(df: DataFrame, now: Column) -> DataFrame:
    """Structured log rows with the suggested action."""
    step = F.coalesce("step", F.lit("unknown")) if "step" in df.columns else F.lit("unknown")
    return df.select(now.alias("ts"), F.lit("ERROR").alias("severity"), "record_id", "contract_id", "error_type",
                     "error_message", step.alias("step"), suggested_action(F.col("error_type")).alias("action"))


def deployment_alerts(df: DataFrame, at: Column) -> DataFrame:
    """Critical alert rows for failed deployments (contract_id, cmo_id, step, error_message)."""
    contract = F.coalesce("contract_id", F.lit("unknown"))
    tenant = F.coalesce("cmo_id", F.lit("unknown"))
    message = F.concat(F.lit("Pipeline deployment failed for contract "), contract, F.lit(" (tenant: "), tenant,
                       F.lit(") at step '"), F.coalesce("step", F.lit("unknown")), F.lit("'. Error: "),
                       F.col("error_message"))
    return df.select(at.alias("ts"), F.lit("deployment_failed").alias("alert_type"),
                     F.lit("critical").alias("severity"), contract.alias("contract_id"), tenant.alias("cmo_id"),
                     message.alias("message"), F.array().cast("array<string>").alias("failed_rules"))


def _advise(message: Column, advice, sep: str) -> Column:
    lower, out = F.lower(message), None
    for words, text in reversed(advice):
        line = F.concat(message, F.lit(f"{sep}{text}"))
        if not words:
            out = line
            continue
        hit = F.lit(False)
        for w in words:
            hit = hit | lower.contains(w)
        out = F.when(hit, line).otherwise(out)
    return out


def error_guidance(message: Column, sep: str = " — ") -> Column:
    """Advice for a failed run's message."""
    return F.when(F.coalesce(message, F.lit("")) == "", RUN_UNKNOWN).otherwise(_advise(message, RUN_ADVICE, sep))


def screen_guidance(message: Column, sep: str = " — ") -> Column:
    """Advice for a message shown to a user."""
    return _advise(message, SCREEN_ADVICE, sep)


def idempotency_key(contract_id: Column, operation: Column, payload_json: Column) -> Column:
    """SHA-256 of ``contract|operation|payload``; the payload is JSON text with sorted keys."""
    return F.sha2(F.concat(contract_id, F.lit("|"), operation, F.lit("|"), payload_json), 256)


def sorted_json(mapping: Column) -> Column:
    """JSON text of a map with its keys in order, spaced as ``{"a": 1, "b": 2}``."""
    entries = F.array_sort(F.map_entries(mapping))
    pairs = F.transform(entries, lambda e: F.concat(
        F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "),
        F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _live(ledger: DataFrame, now: Column) -> DataFrame:
    return ledger.where(F.col("ttl").isNull() | (now < F.col("ttl")))


def pending(df: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """Work still to do, with ``verdict``: new, retry (failed) or conflict (still running).

    Completed, unexpired keys drop out through an anti join; ``now`` is in epoch seconds.
    """
    live = _live(ledger, now).groupBy("idempotency_key").agg(F.max_by("status", "created_at").alias("_status"))
    done = live.where(F.col("_status") == "completed")
    open_ = live.where(F.col("_status") != "completed")
    verdict = (F.when(F.col("_status") == "in_progress", "conflict").when(F.col("_status") == "failed", "retry")
               .otherwise("new"))
    return (df.join(done, "idempotency_key", "left_anti").join(open_, "idempotency_key", "left")
            .withColumn("verdict", verdict).drop("_status"))


def ledger_at(spark: SparkSession, root: str) -> KeyedLog:
    """The append-only ledger of ``run_once`` under a folder."""
    return KeyedLog(spark, root, LEDGER_DDL, "idempotency_key")


def run_once(spark: SparkSession, ledger: KeyedLog, key: str, work: Callable[[], str | None],
             now: float, ttl_seconds: int = LEDGER_TTL_SECONDS) -> str | None:
    """Run ``work`` unless its key is completed; its status, not its result, decides.

    Every state change is a row appended under the key. A run needs the key's next place, which one caller only can
    claim; a running key is an error for the others. A failed or expired one runs again, at the next place.
    """
    def put(status: str, result: str | None = None, error: str | None = None) -> None:
        ledger.append(key, [(key, status, float(now), int(now + ttl_seconds), result, error)])

    # two rows a run at most, and only those of this key
    rows = sorted(ledger.rows(key).collect(), key=lambda r: (r["created_at"], r["status"] != "in_progress"))
    last = rows[-1] if rows else None
    if last is not None and (last["ttl"] is None or now < last["ttl"]):
        if last["status"] == "completed":
            return last["result"]
        if last["status"] == "in_progress":
            raise InProgressError(key)
    if not ledger.claim(key, len(rows)):
        raise InProgressError(key)
    put("in_progress")
    try:
        result = work()
    except Exception as exc:
        put("failed", error=str(exc))
        raise
    put("completed", result=result)
    return result
