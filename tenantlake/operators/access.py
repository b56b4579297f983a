"""Tenant isolation: grants, filtered views, verification and row-level security."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.functions.scalars import check_tenant_id
from tenantlake.operators.filters import column_filter, combined_filter, row_filter, without

GRANTS_DDL = "principal string, database string, table_name string, permission string"
ALL_TABLES = "ALL_TABLES"
TABLE_PERMISSIONS = ("SELECT", "DESCRIBE")
DATABASE = "data_lake"


def grant_rows(spark: SparkSession, principal: str, table_name: str | None, permissions: Sequence[str],
               database: str = DATABASE) -> DataFrame:
    """Grant entries; a null table grants on the database."""
    return spark.createDataFrame([(principal, database, table_name, p) for p in permissions], GRANTS_DDL)


def grant(grants: DataFrame, entries: DataFrame) -> DataFrame:
    """Grants with entries added once."""
    return grants.unionByName(entries).distinct()


def revoke(grants: DataFrame, entries: DataFrame) -> DataFrame:
    """Grants without the entries (nulls in the table name match nulls)."""
    return grants.subtract(entries.select(*grants.columns))


def list_grants(grants: DataFrame, principal: str | None = None) -> DataFrame:
    return grants if principal is None else grants.where(F.col("principal") == principal)


def tenant_table(cmo_id: str, domain: str) -> str:
    """``{tenant}_{domain}_silver``, hyphens as underscores."""
    return f"{check_tenant_id(cmo_id)}_{domain}_silver".replace("-", "_")


def isolation_grants(spark: SparkSession, principal: str, tables: Sequence[str], database: str = DATABASE) -> DataFrame:
    """Database DESCRIBE and per-table SELECT and DESCRIBE of a tenant's principal."""
    rows = [(principal, database, None, "DESCRIBE")]
    rows += [(principal, database, t, p) for t in tables for p in TABLE_PERMISSIONS]
    return spark.createDataFrame(rows, GRANTS_DDL)


def view_names(cmo_id: str, table: str) -> dict[str, str]:
    base = f"{cmo_id}_{table}".replace("-", "_")
    return {"row": f"{base}_rows", "column": f"{base}_columns", "combined": base}


def isolation_views(cmo_id: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, dict[str, str]]:
    """Per table (DataFrame, personal-data columns): a row view, a column view and a view with both filters.

    The filters sit below the view's projection, so they reach the Parquet scan.
    """
    check_tenant_id(cmo_id)
    made = {}
    for name, (df, pii) in tables.items():
        names, allowed = view_names(cmo_id, name), without(df, pii)
        row_filter(df, cmo_id).createOrReplaceTempView(names["row"])
        column_filter(df, allowed).createOrReplaceTempView(names["column"])
        combined_filter(df, cmo_id, allowed).createOrReplaceTempView(names["combined"])
        made[name] = names
    return made


def revoke_isolation(spark: SparkSession, cmo_id: str, tables: Sequence[str]) -> int:
    """Drop a tenant's views; the number dropped."""
    check_tenant_id(cmo_id)
    return sum(spark.catalog.dropTempView(v) for t in tables for v in view_names(cmo_id, t).values())


def grant_user(cmo_id: str, user: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]],
               grants: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """A user gets the tenant's views and the same grants."""
    entries = isolation_grants(grants.sparkSession, user, list(tables))
    return grant(grants, entries), isolation_views(cmo_id, tables)


def grant_users(cmo_id: str, users: DataFrame, tables: Mapping[str, tuple[DataFrame, Sequence[str]]],
                grants: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """``grant_user`` for every ``principal`` of ``users`` at once: each is crossed with the few entries of a user."""
    entries = isolation_grants(grants.sparkSession, "", list(tables)).drop("principal").collect()
    each = F.explode(F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in e.asDict().items()]) for e in entries]))
    new = users.select("principal", each.alias("_e")).select("principal", "_e.*")
    return grant(grants, new), isolation_views(cmo_id, tables)


def isolation_violations(grants: DataFrame) -> DataFrame:
    """Granted tables that do not carry the tenant's prefix, for grants with a ``cmo_id`` column."""
    prefix = F.concat(F.replace("cmo_id", F.lit("-"), F.lit("_")), F.lit("_"))  # cmo_1_ doesn't own cmo_10_...
    return grants.where((F.coalesce("table_name", F.lit("")) != "") & ~F.col("table_name").startswith(prefix)).select(
        "cmo_id", "principal", "table_name", "permission",
        F.concat(F.lit("Table does not belong to "), F.col("cmo_id")).alias("reason"))


def verify_isolation(grants: DataFrame) -> DataFrame:
    """Per tenant and principal: permissions checked, violations, passed."""
    prefix = F.concat(F.replace("cmo_id", F.lit("-"), F.lit("_")), F.lit("_"))  # cmo_1_ doesn't own cmo_10_...
    foreign = (F.coalesce("table_name", F.lit("")) != "") & ~F.col("table_name").startswith(prefix)
    return grants.groupBy("cmo_id", "principal").agg(
        F.count(F.lit(1)).alias("permissions_checked"),
        F.count_if(foreign).alias("violations")).withColumn("passed", F.col("violations") == 0)


def rls_rules(spark: SparkSession, mappings: Mapping[str, Sequence[str]]) -> DataFrame:
    """(user_name, cmo_id) rows of a tenant -> users mapping."""
    return spark.createDataFrame([(u, c) for c, users in mappings.items() for u in users],
                                 "user_name string, cmo_id string")


def rls_join(df: DataFrame, rules: DataFrame, user: str) -> DataFrame:
    """Rows of the tenants the user is mapped to."""
    mine = rules.where(F.col("user_name") == user).select("cmo_id")
    return df.join(mine, "cmo_id", "left_semi")


def rls_valid(rules: DataFrame, user: str, cmo_id: str) -> bool:
    """Whether the user is mapped to the tenant."""
    return not rules.where((F.col("user_name") == user) & (F.col("cmo_id") == cmo_id)).isEmpty()


def accessible_tables(spark: SparkSession, grants: DataFrame, principal: str, database: str = "default") -> DataFrame:
    """(database, table_name) granted to a role; an identifier that is no role sees every catalog table."""
    if not principal:
        raise ValueError("user_id is required")
    if principal.startswith("arn:"):
        return (list_grants(grants, principal)
                .where(F.coalesce("table_name", F.lit("")) != "").where(F.col("table_name") != ALL_TABLES)
                .select("database", "table_name").distinct())
    rows = [(database, t.name) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "database string, table_name string")


def schema_context(spark: SparkSession, tables: Sequence[tuple[str | None, str]]) -> DataFrame:
    """(table_name, column_name, data_type, is_partition); a missing table gives one 'unavailable' row."""
    rows = []
    for database, table in tables:
        full = f"{database}.{table}" if database else table
        if not spark.catalog.tableExists(full):
            rows.append((full, None, "unavailable", False))
            continue
        rows += [(full, c.name, c.dataType, c.isPartition) for c in spark.catalog.listColumns(full)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_partition boolean")
