"""Row and column filters, lookups, searches and file acceptance."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S

# Accepted file extensions and size.
TRANSFER_EXTENSIONS = (".csv", ".parquet", ".json")
ARRIVAL_EXTENSIONS = (".csv", ".json", ".parquet", ".pdf", ".png", ".jpg", ".jpeg", ".tiff")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tiff")
MAX_FILE_BYTES = 500 * 1024 * 1024


class AccessDenied(PermissionError):
    """The principal may not see this data."""


def row_filter(df: DataFrame, cmo_id: str) -> DataFrame:
    """Rows of one tenant."""
    return df.where(F.col("cmo_id") == S.check_tenant_id(cmo_id))


def column_filter(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the allowed columns, in the table's order."""
    return df.select(*[c for c in df.columns if c in set(allowed)])


def combined_filter(df: DataFrame, cmo_id: str, allowed: Sequence[str]) -> DataFrame:
    """Rows of one tenant, allowed columns; the tenant column itself need not be visible."""
    return column_filter(row_filter(df, cmo_id), allowed)


def without(df: DataFrame, hidden: Sequence[str]) -> list[str]:
    """All columns minus the hidden ones."""
    return [c for c in df.columns if c not in set(hidden)]


def tenant_scope(df: DataFrame, principal: Mapping, requested: str | None = None) -> DataFrame:
    """Tenant users see their own rows whatever they ask for; admins may filter by tenant.

    ``principal`` holds ``is_admin`` and ``cmo_id``; a tenant user without an organisation is denied.
    """
    if principal.get("is_admin"):
        return df if not requested else df.where(F.col("cmo_id") == requested)
    own = principal.get("cmo_id")
    if not own:
        raise AccessDenied("user must be linked to an organization")
    return df.where(F.col("cmo_id") == own)


def by_product(df: DataFrame, product_id: str) -> DataFrame:
    return df.where(F.col("product_id") == product_id)


def by_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("status") == status)


def by_supplier_status(df: DataFrame, cmo_id: str, status: str | None = None) -> DataFrame:
    out = df.where(F.col("cmo_id") == cmo_id)
    return out if status is None else by_status(out, status)


def active_connections(batches: DataFrame, connections: DataFrame) -> DataFrame:
    """(batch_id, connection columns): active connections of each batch's supplier."""
    live = connections.where(F.col("status") == "active")
    return batches.select("batch_id", "cmo_id").join(live, "cmo_id")


def active_connection_counts(batches: DataFrame, connections: DataFrame) -> DataFrame:
    """(batch_id, cmo_id, connections, first_connection): number and least id of the active ones of a batch's supplier.

    Connections are reduced to one row per supplier before the join, so the result has one row per batch.
    """
    live = connections.where(F.col("status") == "active").groupBy("cmo_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("connection_id").alias("first_connection"))
    return batches.select("batch_id", "cmo_id").join(live, "cmo_id", "left").select(
        "batch_id", "cmo_id", F.coalesce("_n", F.lit(0).cast("bigint")).alias("connections"), "first_connection")


def text_search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive contains over any of the columns."""
    needle = term.lower()
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(needle), F.lit(False))
    return df.where(hit)


def is_overdue(elements: Column) -> Column:
    return F.coalesce(F.exists(elements, lambda e: e["overdue"]), F.lit(False))


def has_overdue(batches: DataFrame) -> DataFrame:
    """Batches with at least one overdue element."""
    return batches.where(is_overdue(F.col("data_elements")))


def has_missing(batches: DataFrame) -> DataFrame:
    """Batches with at least one missing element."""
    return batches.where(F.size("missing_elements") > 0)


def standard_filters(df: DataFrame, cmo_id: str | None = None,
                     date_range: tuple[dt.date, dt.date] | None = None, data_domain: str | None = None,
                     date_col: str = "manufacture_date") -> DataFrame:
    """Dashboard filter bar: tenant, inclusive date range, domain; unset controls do not filter."""
    if cmo_id is not None:
        df = df.where(F.col("cmo_id") == cmo_id)
    if date_range is not None:
        df = df.where(F.col(date_col).between(*[F.lit(d) for d in date_range]))
    if data_domain is not None:
        df = df.where(F.col("data_domain") == data_domain)
    return df


def accept_files(manifest: DataFrame, allowed: Sequence[str] = TRANSFER_EXTENSIONS,
                 max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds ``extension``, ``accepted`` and ``reject_reason`` to (path, size) rows."""
    listed = manifest.withColumn("extension", S.file_extension(F.col("path")))
    ext_ok, size_ok = F.col("extension").isin(*allowed), F.col("size") <= max_bytes
    reason = (F.when(~ext_ok, F.concat(F.lit("File extension '"), F.col("extension"),
                                       F.lit(f"' is not allowed. Allowed: {sorted(allowed)}")))
              .when(~size_ok, F.concat(F.lit("File size "), F.col("size").cast("string"),
                                       F.lit(f" bytes exceeds maximum {max_bytes} bytes"))))
    return listed.withColumn("accepted", ext_ok & size_ok).withColumn("reject_reason", reason)


def document_type(manifest: DataFrame) -> DataFrame:
    """Adds ``document_type``: pdf, image or unsupported."""
    ext = S.file_extension(F.col("path"))
    kind = F.when(ext == ".pdf", "pdf").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("unsupported")
    return manifest.withColumn("document_type", kind)


def page(df: DataFrame, order_by: Sequence[Column | str], number: int = 1, size: int = 10) -> DataFrame:
    """The ``number``-th page (from 1) of the ordered rows."""
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size)
