"""Whole flows: delivered data to silver through the gate, and silver to gold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tenantlake.operators import cleanse, gold, quality
from tenantlake.operators.gate import GateOutcome, gate
from tenantlake.operators.schema import TableSchema
from tenantlake.session import stage
from tenantlake.sources import sinks


def load_batch(df: DataFrame, root: str, cmo_id: str, domain: str, contract_id: str, schema: TableSchema,
               rules: Sequence[quality.QualityRule], keys: Sequence[str], order_by: Sequence[str], at: dt.datetime,
               defaults: Mapping[str, object] | None = None, database: str | None = None) -> GateOutcome:
    """Cleanse a delivery, evaluate its contract's rules, promote or quarantine it.

    The cleansed rows are staged once: the rules read only their own columns of them, and the write
    that follows does not repeat the cleansing.
    """
    silver, invalid = cleanse.bronze_to_silver(df, schema, keys, order_by, defaults, at)
    silver = stage(silver, "silver")
    report = quality.quality_report(quality.evaluate_rules(silver, rules))
    return gate(silver, invalid, report, root, cmo_id, domain, contract_id, at, database)


def silver_to_gold(silver: DataFrame, root: str, date: dt.date, date_col: str = "_validation_timestamp",
                   database: str | None = None) -> dict:
    """Daily summary, monthly quality and supplier scorecard, each written and registered.

    Each summary is its own column-pruned scan: silver is columnar, so reading three narrow column
    sets costs less than caching the whole table.
    """
    spark: SparkSession = silver.sparkSession
    products = {"batch-summary-daily": gold.batch_summary(silver, "daily", date_col),
                "quality-metrics-monthly": gold.quality_trend(silver, "monthly", date_col),
                "cmo-performance-dashboard": gold.supplier_scorecard(silver)}
    done: dict = {"paths": {}, "tables_registered": []}
    for name, df in products.items():
        done["paths"][name] = sinks.write_gold(df, root, name, date)
        if done["paths"][name] and database:
            done["tables_registered"].append(sinks.register_gold_table(spark, root, name, database, date))
    return done
