"""Batches and their data elements: creation, receipts, deadlines, boards, delivery status.

A batch row carries its elements as an array of struct<element_type, received, received_at, s3_path,
overdue>. Elements are changed in place with array functions; receipts are reduced to one row per
batch before they meet the batches, so nothing is exploded and collected again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S

# Element types and their labels.
REQUIRED_ELEMENTS = ("bmr", "coa", "in_process", "yield")
OPTIONAL_ELEMENTS = ("deviation", "env_monitoring", "equipment_logs")
ELEMENT_LABELS = {
    "bmr": "Batch Manufacturing Record (BMR)",
    "coa": "Certificate of Analysis (CoA)",
    "in_process": "In-Process Test Results",
    "yield": "Yield / Reconciliation Data",
}

ELEMENTS_TYPE = ("array<struct<element_type:string,received:boolean,received_at:timestamp,"
                 "s3_path:string,overdue:boolean>>")


def element(kind, received: Column, received_at: Column, s3_path: Column, overdue: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.alias("element_type"), received.alias("received"), received_at.alias("received_at"),
                    s3_path.alias("s3_path"), overdue.alias("overdue"))


def missing_list(elements: Column) -> Column:
    """Required element types not yet received."""
    return F.transform(F.filter(elements, lambda e: e["element_type"].isin(*REQUIRED_ELEMENTS)
                                & ~F.coalesce(e["received"], F.lit(False))), lambda e: e["element_type"])


def with_missing(batches: DataFrame) -> DataFrame:
    """Adds ``missing_elements`` and ``is_complete`` from the elements."""
    missing = missing_list(F.col("data_elements"))
    return batches.withColumn("missing_elements", missing).withColumn("is_complete", F.size(missing) == 0)


def new_batches(requests: DataFrame, now: Column) -> DataFrame:
    """Batches for requests (lot_number, product_id, manufacturing_date, cmo_id [, contract_id]).

    The id is derived from the request, so a retried task produces the same batch. Requests with
    missing fields or no tenant come back with an ``error`` and no batch id.
    """
    needed = ("lot_number", "product_id", "manufacturing_date")
    gaps = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in needed]))
    error = (F.when(F.size(gaps) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(gaps, ", ")))
             .when(F.coalesce(F.col("cmo_id"), F.lit("")) == "", "user must be linked to an organization"))
    key = F.sha2(F.concat_ws("|", "cmo_id", *[F.col(c).cast("string") for c in needed]), 256)
    blank = F.array(*[element(e, F.lit(False), F.lit(None).cast("timestamp"), F.lit(None).cast("string"),
                              F.lit(False)) for e in REQUIRED_ELEMENTS]).cast(ELEMENTS_TYPE)
    contract = F.col("contract_id") if "contract_id" in requests.columns else F.lit(None).cast("string")
    return requests.select(
        F.when(error.isNull(), F.concat(F.lit("batch-"), F.left(key, F.lit(12)))).alias("batch_id"),
        "lot_number", "product_id", "cmo_id", contract.alias("contract_id"), "manufacturing_date",
        F.lit("in_progress").alias("status"), blank.alias("data_elements"), F.lit(False).alias("is_complete"),
        F.array(*[F.lit(e) for e in REQUIRED_ELEMENTS]).alias("missing_elements"),
        now.alias("created_at"), now.alias("updated_at"), error.alias("error"))


def apply_receipts(batches: DataFrame, receipts: DataFrame) -> DataFrame:
    """Mark received elements from (batch_id, element_type, received_at, s3_path) rows.

    The first receipt time is kept, the latest non-null path wins. An optional element is added to its batch when it
    is received. Receipts of no or an unknown element change nothing; ``rejected_receipts`` returns them. Receipts are aggregated to one row
    per batch and element, then to one small map per batch, before the single join.
    """
    newest = F.max_by("s3_path", F.when(F.col("s3_path").isNotNull(), F.struct("received_at", "s3_path")))
    known = receipts.where(F.col("element_type").isin(*REQUIRED_ELEMENTS, *OPTIONAL_ELEMENTS))
    per_element = known.groupBy("batch_id", "element_type").agg(
        F.min("received_at").alias("first_at"), newest.alias("path"))
    per_batch = per_element.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(
        F.struct("element_type", F.struct("first_at", "path")))).alias("_receipts"))

    def received(e: Column) -> Column:
        hit = F.try_element_at(F.col("_receipts"), e["element_type"])
        return F.when(hit.isNull(), e).otherwise(element(
            e["element_type"], F.lit(True),
            F.coalesce(e["received_at"], hit["first_at"].cast("timestamp")),
            F.coalesce(hit["path"], e["s3_path"]), e["overdue"]))

    def added(kind: Column) -> Column:
        hit = F.try_element_at(F.col("_receipts"), kind)
        return element(kind, F.lit(True), hit["first_at"].cast("timestamp"), hit["path"], F.lit(False))

    joined = batches.join(per_batch, "batch_id", "left")
    optional = F.filter(F.array(*[F.lit(e) for e in OPTIONAL_ELEMENTS]), lambda k: F.map_contains_key("_receipts", k)
                        & ~F.exists("data_elements", lambda e: e["element_type"] == k))
    updated = joined.withColumn("data_elements", F.when(F.col("_receipts").isNull(), F.col("data_elements")).otherwise(
        F.concat(F.transform("data_elements", received), F.transform(optional, added))))
    return with_missing(updated.drop("_receipts")).select(*dict.fromkeys(
        [*batches.columns, "missing_elements", "is_complete"]))


def rejected_receipts(batches: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts that ``apply_receipts`` can't use, with a ``reason``."""
    known = batches.select(F.col("batch_id").alias("_batch")).distinct()
    joined = receipts.join(known, receipts["batch_id"] == known["_batch"], "left")
    reason = (F.when(F.col("element_type").isNull(), "element_type is missing")
              .when(~F.col("element_type").isin(*REQUIRED_ELEMENTS, *OPTIONAL_ELEMENTS), "element_type is unknown")
              .when(F.col("batch_id").isNull(), "batch_id is missing").when(F.col("_batch").isNull(), "batch is unknown"))
    return joined.select(*receipts.columns, reason.alias("reason")).where("reason is not null")


def flag_overdue(batches: DataFrame, contracts: DataFrame, now: Column) -> DataFrame:
    """Set ``overdue`` on unreceived elements past their deadline; adds ``newly_flagged``.

    Only batches in progress are checked. The deadline is the manufacturing date's midnight plus the
    contract's calendar days for the element; no limit or an unreadable date skips it. The flag stays
    once set. ``contracts`` has (contract_id, element_slas: array<struct<element_type, max_days>>).
    """
    limits = contracts.select("contract_id", "element_slas")
    joined = batches.join(limits, "contract_id", "left")
    made = F.try_to_date(F.col("manufacturing_date").cast("string"), "yyyy-MM-dd")

    def late(e: Column) -> Column:
        days = F.try_element_at(F.filter(
            F.col("element_slas"), lambda s: s["element_type"] == e["element_type"]), F.lit(-1))["max_days"]
        past = now.cast("timestamp") > F.date_add(made, days.cast("int")).cast("timestamp")
        return (F.col("status") == "in_progress") & ~F.coalesce(e["received"], F.lit(False)) & F.coalesce(
            past, F.lit(False))

    def is_new(e: Column) -> Column:
        return late(e) & ~F.coalesce(e["overdue"], F.lit(False))

    flagged = F.transform("data_elements", lambda e: element(
        e["element_type"], e["received"], e["received_at"], e["s3_path"],
        F.coalesce(e["overdue"], F.lit(False)) | late(e)))
    return joined.select(
        *[flagged.alias(c) if c == "data_elements" else F.col(c) for c in batches.columns],
        F.coalesce(F.size(F.filter("data_elements", is_new)), F.lit(0)).alias("newly_flagged"))


def overdue_counts(flagged: DataFrame) -> DataFrame:
    """One row: batches checked and elements newly flagged."""
    return flagged.agg(F.count_if(F.col("status") == "in_progress").alias("checked"),
                       F.coalesce(F.sum("newly_flagged"), F.lit(0)).cast("bigint").alias("flagged"))


def completeness(batches: DataFrame) -> DataFrame:
    """Adds ``received_count`` of four and its colour band."""
    received = F.lit(len(REQUIRED_ELEMENTS)) - F.coalesce(F.size("missing_elements"), F.lit(0))
    band = F.when(received == len(REQUIRED_ELEMENTS), "green").when(received == 0, "red").otherwise("blue")
    return batches.withColumn("received_count", received).withColumn("completeness_band", band)


def submit(batches: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(batches after submission, outcome per requested id); only batches in progress are accepted."""
    asked = ids.select("batch_id").distinct()
    marked = batches.join(asked.withColumn("_asked", F.lit(True)), "batch_id", "left")
    go = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == "in_progress")
    submitted_at = F.col("submitted_at") if "submitted_at" in batches.columns else F.lit(None).cast("timestamp")
    after = marked.select(
        *[F.when(go, "submitted").otherwise(F.col("status")).alias(c) if c == "status" else F.col(c)
          for c in batches.columns if c != "submitted_at"],
        F.when(go, now).otherwise(submitted_at).alias("submitted_at"))
    found = asked.join(batches.select("batch_id", "status"), "batch_id", "left")
    error = (F.when(F.col("status").isNull(), F.concat(F.lit("Batch "), F.col("batch_id"), F.lit(" not found")))
             .when(F.col("status") != "in_progress",
                   F.concat(F.lit("Batch already submitted (status: "), F.col("status"), F.lit(")"))))
    return after, found.select("batch_id", error.isNull().alias("accepted"), error.alias("error"))


def batch_board(batches: DataFrame, suppliers: DataFrame, products: DataFrame,
                labels: Mapping[str, str] = ELEMENT_LABELS, sort_by: str | None = "manufacturing_date") -> DataFrame:
    """Display rows: supplier and product names (ids when unknown), completeness, overdue and missing labels."""
    names = suppliers.select("cmo_id", "organization_name")
    items = products.select("product_id", "product_name")
    rows = completeness(batches).join(names, "cmo_id", "left").join(items, "product_id", "left")
    if sort_by is not None:
        # before the display columns, so the sort's sampling pass does not compute them
        rows = rows.orderBy(F.desc(sort_by), "batch_id")
    late = F.transform(F.filter("data_elements", lambda e: F.coalesce(e["overdue"], F.lit(False))),
                       lambda e: e["element_type"])
    return rows.select(
        "batch_id", "lot_number", F.coalesce("organization_name", "cmo_id").alias("supplier"),
        F.coalesce("product_name", "product_id").alias("product"), "manufacturing_date",
        F.concat(F.col("received_count").cast("string"), F.lit(f"/{len(REQUIRED_ELEMENTS)}")).alias("completeness"),
        "completeness_band",
        F.when(F.size(late) > 0, S.join_labels(late, labels)).otherwise("None").alias("overdue"),
        F.when(F.size("missing_elements") > 0, S.join_labels(F.col("missing_elements"), labels))
        .otherwise("All received").alias("missing"))


def file_status(manifest: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per secure-transfer contract: files received and the newest one.

    The manifest is reduced per tenant and domain before the join, so the prefix match is an
    equality on parsed path parts.
    """
    landed = (manifest.where(~F.col("is_incoming")).groupBy("cmo_id", "data_domain")
              .agg(F.count(F.lit(1)).alias("total_files"),
                   F.max(F.struct("modified", "key", "size")).alias("newest")))
    chosen = contracts.where(F.col("connection_type") == "secure-transfer").select("contract_id", "cmo_id", "data_domain")
    total = F.coalesce("total_files", F.lit(0).cast("bigint"))
    return chosen.join(landed, ["cmo_id", "data_domain"], "left").select(
        "contract_id", "cmo_id", "data_domain", total.alias("total_files"),
        S.file_name(F.col("newest.key")).alias("last_file"), F.col("newest.size").alias("last_size"),
        F.col("newest.modified").alias("last_received_at"),
        F.when(total == 0, "No files received yet").alias("message"))


def document_status(manifest: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per document contract: processed and manual-review JSON results, and the newest processed one."""
    results = manifest.where(F.col("key").endswith(".json"))
    review = F.col("key").contains("/manual-review/")
    done = ~review & F.col("key").contains("/year=")
    counted = results.groupBy("cmo_id", "data_domain").agg(
        F.count_if(done).alias("processed"), F.count_if(review).alias("in_review"),
        F.max(F.when(done, F.struct("modified", "key"))).alias("newest"))
    chosen = contracts.where(F.col("connection_type") == "ai-unstructured").select("contract_id", "cmo_id", "data_domain")
    zero = F.lit(0).cast("bigint")
    return chosen.join(counted, ["cmo_id", "data_domain"], "left").select(
        "contract_id", F.coalesce("processed", zero).alias("total_processed"),
        F.coalesce("in_review", zero).alias("manual_review_pending"),
        F.col("newest.modified").alias("last_processed_at"), S.file_name(F.col("newest.key")).alias("last_document"))


def latest_run(executions: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """The last run of each contract: status, start, duration, rows; never run gives a message."""
    newest = executions.groupBy("contract_id").agg(F.max_by(
        F.struct("execution_id", "status", "ts", "execution_time_seconds", "records_processed"),
        F.struct("ts", "execution_id")).alias("r"))
    if contracts is not None:
        newest = contracts.select("contract_id").join(newest, "contract_id", "left")
    return newest.select(
        "contract_id", F.col("r.execution_id").alias("execution_id"), F.col("r.status").alias("last_status"),
        F.col("r.ts").alias("last_started_at"), F.col("r.execution_time_seconds").alias("last_duration"),
        F.col("r.records_processed").alias("rows_extracted"),
        F.when(F.col("r").isNull(), "Connection active. No runs yet.").alias("message"))


def pipeline_board(contracts: DataFrame, status: DataFrame) -> DataFrame:
    """Contracts with their run status, else the contract's own."""
    known = status.select("contract_id", F.col("status").alias("_run_status"))
    return contracts.join(known, "contract_id", "left").withColumn(
        "resolved_status", F.coalesce("_run_status", "status")).drop("_run_status")


def contract_connections(contracts: DataFrame, connections: DataFrame) -> DataFrame:
    """Contracts with their connection's type and name, null when unset."""
    conn = connections.select("connection_id", "connection_type", F.col("name").alias("connection_name"))
    return contracts.join(conn, "connection_id", "left")


def with_lot(files: DataFrame, batches: DataFrame) -> DataFrame:
    """Files with their batch's lot number, the batch id when the batch is unknown."""
    lots = batches.select("batch_id", F.col("lot_number").alias("_lot"))
    return files.join(lots, "batch_id", "left").withColumn("lot", F.coalesce("_lot", "batch_id")).drop("_lot")
