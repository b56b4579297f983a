"""Contracts in bulk: validation, ids, status changes, deployment checks, upserts.

Contract documents are JSON text. They are read as variants, so a field of the wrong type is seen as
such rather than lost in a fixed schema, and each contract yields the array of everything wrong with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.operators.keywords import KEYWORDS
from tenantlake.operators.windows import sequence_numbers
from tenantlake.session import spread, stage

# What a contract must hold and may say.
REQUIRED_FIELDS = ("cmoId", "dataDomain", "schemaId", "schemaVersion", "qualityRules", "sla", "deliverySchedule",
                   "governance")
TEXT_FIELDS = ("cmoId", "dataDomain", "schemaId", "schemaVersion")
RULE_FIELDS = ("ruleId", "ruleName", "ruleType", "expression", "threshold", "severity")
RULE_TYPES = ("accuracy", "completeness", "consistency", "uniqueness")
SEVERITIES = ("error", "warning")
FREQUENCIES = ("daily", "hourly", "monthly", "real-time", "weekly")
CLASSIFICATIONS = ("confidential", "internal", "public", "restricted")
STATUSES = ("active", "draft", "suspended")
PATTERNS = ("ai-unstructured", "native-connector", "secure-transfer")
UPDATABLE = ("schema_id", "schema_version", "quality_rules", "sla", "delivery_schedule", "governance")

CONTRACT_ID_RE = r"^CMO-[A-Z0-9\-]+-[A-Z0-9\-]+-\d{3}$"


class _Node:
    """A JSON value held in a variant column (null when absent): its kind and scalar forms."""

    def __init__(self, value: Column):
        self.value = value
        self.kind = F.schema_of_variant(value)
        self.absent = value.isNull()

    @property
    def text(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    @property
    def is_text(self) -> Column:
        return F.coalesce(self.kind == "STRING", F.lit(False))

    @property
    def is_bool(self) -> Column:
        return F.coalesce(self.kind == "BOOLEAN", F.lit(False))

    @property
    def is_whole(self) -> Column:
        # true and false count as whole numbers, as they do for the contract authors' tools
        return F.coalesce(self.kind.rlike(r"^(BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DECIMAL\((19|[23]\d),0\))$"), F.lit(False))

    @property
    def is_number(self) -> Column:
        return F.coalesce(self.kind.rlike("^(BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))

    @property
    def is_list(self) -> Column:
        return F.coalesce(self.kind.startswith("ARRAY"), F.lit(False))

    @property
    def is_object(self) -> Column:
        return F.coalesce(self.kind.startswith("OBJECT"), F.lit(False))

    @property
    def number(self) -> Column:
        flag = F.when(self.is_bool, F.try_variant_get(self.value, "$", "boolean").cast("double"))
        return F.coalesce(flag, F.try_variant_get(self.value, "$", "double"))

    @property
    def filled(self) -> Column:
        """Text with something other than blanks in it."""
        return self.is_text & (F.length(F.btrim(self.text, F.lit(" \t\n\r\f\x0b"))) > 0)


def _field(parent: Column, name: str) -> Column:
    """A field's value; JSON null reads as absent."""
    raw = F.try_variant_get(parent, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(raw), raw)


# The fields read from each section.
_SECTIONS = {
    "sla": ("timeliness", "availability", "quality"),
    "deliverySchedule": ("frequency", "cronExpression"),
    "governance": ("dataClassification", "retentionYears", "allowedUsers", "allowedGroups", "piiFields",
                   "encryptionRequired"),
}
_SLA_FIELDS = {"timeliness": "maxDelayHours", "availability": "uptimePercentage", "quality": "minQualityScore"}


def _unpacked(df: DataFrame, doc: str) -> DataFrame:
    """The document's parts as variant columns, one nesting level per projection.

    Each projection is kept apart by the optimizer because its columns are read many times, so the
    document is parsed once and each field looked up once.
    """
    out = spread(df).withColumn("_root", F.try_parse_json(F.col(doc)))
    out = out.withColumns({f"_{n}": _field(F.col("_root"), n) for n in REQUIRED_FIELDS})
    parts = {f"_{s}_{n}": _field(F.col(f"_{s}"), n) for s, names in _SECTIONS.items() for n in names}
    rules = F.try_variant_get(F.col("_qualityRules"), "$", "array<variant>")
    parts["_rules"] = F.transform(rules, lambda r: F.struct(
        r.alias("raw"), *[_field(r, n).alias(n) for n in RULE_FIELDS]))
    out = out.withColumns(parts)
    return out.withColumns({f"_sla_{s}_{n}": _field(F.col(f"_sla_{s}"), n)
                            for s, own in _SLA_FIELDS.items() for n in (own, "measurementWindow")})


def _when(cond: Column, message) -> Column:
    return F.when(cond, message if isinstance(message, Column) else F.lit(message))


def _listed(values) -> str:
    return str(sorted(values))


def _node(name: str) -> _Node:
    return _Node(F.col(f"_{name}"))


def rule_errors() -> Column:
    """Errors of the rule list."""
    def one(rule: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("qualityRules["), i.cast("string"), F.lit("]: "))

        def err(cond: Column, text) -> Column:
            return F.when(cond, F.concat(prefix, text if isinstance(text, Column) else F.lit(text)))

        field = {name: _Node(rule[name]) for name in RULE_FIELDS}
        checks = [err(field[n].absent, f"missing required field '{n}'") for n in RULE_FIELDS]
        kind, sev, limit, text = field["ruleType"], field["severity"], field["threshold"], field["expression"]
        checks.append(err(~kind.absent & ~F.coalesce(kind.text.isin(*RULE_TYPES), F.lit(False)), F.concat(
            F.lit("invalid ruleType '"), F.coalesce(kind.text, F.lit("")),
            F.lit(f"'. Must be one of {_listed(RULE_TYPES)}"))))
        checks.append(err(~limit.absent & ~limit.is_number, "threshold must be a number"))
        checks.append(err(limit.is_number & ~limit.number.between(0, 100), "threshold must be between 0 and 100"))
        checks.append(err(~sev.absent & ~F.coalesce(sev.text.isin(*SEVERITIES), F.lit(False)), F.concat(
            F.lit("invalid severity '"), F.coalesce(sev.text, F.lit("")),
            F.lit(f"'. Must be one of {_listed(SEVERITIES)}"))))
        starts = F.btrim(text.text, F.lit(" \t\n\r\f\x0b")).rlike("^(" + "|".join(KEYWORDS) + ")")
        checks.append(err(text.filled & ~starts,
                          "expression is not valid DQDL. Must start with a recognised DQDL keyword "
                          "(e.g. Completeness, ColumnExists, Uniqueness, …)"))
        return F.when(_Node(rule["raw"]).is_object, F.array_compact(F.array(*checks))).otherwise(
            F.array(F.concat(prefix, F.lit("must be a dictionary"))))

    return (F.when(~_node("qualityRules").is_list, F.array(F.lit("qualityRules must be a list")))
            .when(F.size("_rules") == 0, F.array(F.lit("qualityRules must contain at least one rule")))
            .otherwise(F.flatten(F.transform("_rules", one))))


def sla_errors() -> Column:
    """Errors of the service-level section."""
    checks = []
    bad_number = {
        "timeliness": (lambda n: ~n.is_number | (n.number <= 0), "must be a positive number"),
        "availability": (lambda n: ~n.is_number | ~n.number.between(0, 100), "must be between 0 and 100"),
        "quality": (lambda n: ~n.is_number | ~n.number.between(0, 100), "must be between 0 and 100"),
    }
    for section, name in _SLA_FIELDS.items():
        bad, text = bad_number[section]
        part = _node(f"sla_{section}")
        value, span = _node(f"sla_{section}_{name}"), _node(f"sla_{section}_measurementWindow")
        checks += [
            _when(part.absent, f"sla: missing required section '{section}'"),
            _when(~part.absent & ~part.is_object, f"sla.{section} must be a dictionary"),
            _when(part.is_object & value.absent, f"sla.{section}: missing '{name}'"),
            _when(part.is_object & ~value.absent & F.coalesce(bad(value), F.lit(True)), f"sla.{section}.{name} {text}"),
            _when(part.is_object & span.absent, f"sla.{section}: missing 'measurementWindow'"),
            _when(part.is_object & ~span.absent & ~span.filled,
                  f"sla.{section}: measurementWindow must be a non-empty string"),
        ]
    return F.when(_node("sla").is_object, F.array_compact(F.array(*checks))).otherwise(
        F.array(F.lit("sla must be a dictionary")))


def schedule_errors() -> Column:
    """Errors of the delivery schedule."""
    often, cron = _node("deliverySchedule_frequency"), _node("deliverySchedule_cronExpression")
    fields = F.size(F.split(F.btrim(cron.text, F.lit(" \t\n\r\f\x0b")), r"\s+"))
    checks = [
        _when(often.absent, "deliverySchedule: missing required field 'frequency'"),
        _when(~often.absent & ~F.coalesce(often.text.isin(*FREQUENCIES), F.lit(False)), F.concat(
            F.lit("deliverySchedule: invalid frequency '"), F.coalesce(often.text, F.lit("")),
            F.lit(f"'. Must be one of {_listed(FREQUENCIES)}"))),
        _when(~cron.absent & ~cron.filled, "deliverySchedule: cronExpression must be a non-empty string"),
        _when(cron.filled & ~fields.isin(5, 6), "deliverySchedule: cronExpression is not a valid cron format. "
                                                "Expected 5 or 6 space-separated fields"),
    ]
    return F.when(_node("deliverySchedule").is_object, F.array_compact(F.array(*checks))).otherwise(
        F.array(F.lit("deliverySchedule must be a dictionary")))


def governance_errors() -> Column:
    """Errors of the governance section."""
    level, years = _node("governance_dataClassification"), _node("governance_retentionYears")
    checks = [
        _when(level.absent, "governance: missing required field 'dataClassification'"),
        _when(~level.absent & ~F.coalesce(level.text.isin(*CLASSIFICATIONS), F.lit(False)), F.concat(
            F.lit("governance: invalid dataClassification '"), F.coalesce(level.text, F.lit("")),
            F.lit(f"'. Must be one of {_listed(CLASSIFICATIONS)}"))),
        _when(years.absent, "governance: missing required field 'retentionYears'"),
        _when(~years.absent & (~years.is_whole | (years.number <= 0)),
              "governance: retentionYears must be a positive integer"),
    ]
    for name in ("allowedUsers", "allowedGroups", "piiFields"):
        node = _node(f"governance_{name}")
        checks += [_when(node.absent, f"governance: missing required field '{name}'"),
                   _when(~node.absent & ~node.is_list, f"governance: {name} must be a list")]
    crypt = _node("governance_encryptionRequired")
    checks += [_when(crypt.absent, "governance: missing required field 'encryptionRequired'"),
               _when(~crypt.absent & ~crypt.is_bool, "governance: encryptionRequired must be a boolean")]
    return F.when(_node("governance").is_object, F.array_compact(F.array(*checks))).otherwise(
        F.array(F.lit("governance must be a dictionary")))


def validate_contracts(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``errors`` and ``is_valid`` to contract documents (JSON text).

    With a top-level field missing, only the missing fields are reported.
    """
    missing = F.array_compact(F.array(*[
        _when(_node(name).absent, f"Missing required field: {name}") for name in REQUIRED_FIELDS]))
    blank = F.array_compact(F.array(*[
        _when(~_node(name).filled, f"{name} must be a non-empty string") for name in TEXT_FIELDS]))
    lists = _unpacked(df, doc).select(
        *df.columns, missing.alias("_missing"), rule_errors().alias("_e1"), sla_errors().alias("_e2"),
        schedule_errors().alias("_e3"), governance_errors().alias("_e4"), blank.alias("_e5"))
    errors = F.when(F.size("_missing") > 0, F.col("_missing")).otherwise(F.concat("_e1", "_e2", "_e3", "_e4", "_e5"))
    return lists.select(*df.columns, errors.alias("errors")).withColumn("is_valid", F.size("errors") == 0)


def name_part(name: Column) -> Column:
    """Upper-case name for an id: spaces to hyphens, hyphens collapsed and trimmed, UNKNOWN when empty."""
    upper = F.regexp_replace(F.replace(F.upper(name), F.lit(" "), F.lit("-")), "-+", "-")
    return F.coalesce(F.nullif(F.btrim(upper, F.lit("-")), F.lit("")), F.lit("UNKNOWN"))


def contract_id(name: Column, domain: Column, number: Column) -> Column:
    """``CMO-{NAME}-{DOMAIN}-{nnn}``; numbers over 999 keep all their digits."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0"))
    return F.concat(F.lit("CMO-"), name_part(name), F.lit("-"), F.upper(domain), F.lit("-"), padded)


def assign_contract_ids(df: DataFrame, existing: DataFrame | None, order: list[str]) -> DataFrame:
    """Adds ``contract_id``: numbered per supplier and domain, after those that exist already.

    Numbering is a balanced running count, so one supplier may own a large share of the rows. A row without a
    supplier is numbered as supplier UNKNOWN; one without a domain stays, with a null id.
    """
    numbered = sequence_numbers(df, ["cmo_id", "data_domain"], order, "_seq")
    if existing is not None:
        counts = existing.groupBy(F.col("cmo_id").alias("_cmo"), F.col("data_domain").alias("_domain")).agg(
            F.count(F.lit(1)).alias("_before"))
        same = numbered["cmo_id"].eqNullSafe(counts["_cmo"]) & numbered["data_domain"].eqNullSafe(counts["_domain"])
        numbered = numbered.join(counts, same, "left").drop("_cmo", "_domain")
    else:
        numbered = numbered.withColumn("_before", F.lit(0))
    number = F.col("_seq") + F.coalesce("_before", F.lit(0))
    return (numbered.withColumn("contract_id", contract_id(F.col("cmo_id"), F.col("data_domain"), number))
            .drop("_seq", "_before"))


def create_contracts(requests: DataFrame, existing: DataFrame | None, order: list[str], now: Column,
                     doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(created, rejected) of new contract documents: the valid ones get an id and start as draft.

    Created rows carry the request's columns, ``cmo_id``, ``data_domain``, ``contract_id``, ``status`` and both
    times; rejected ones their ``errors``.
    """
    # validated once: numbering samples and sorts its input, and the rejected rows are read apart
    checked = stage(validate_contracts(requests, doc), "checked")
    named = checked.where("is_valid").select(
        *requests.columns, F.get_json_object(doc, "$.cmoId").alias("cmo_id"), F.get_json_object(doc, "$.dataDomain").alias("data_domain"))
    created = assign_contract_ids(named, existing, order).withColumns(
        {"status": F.lit("draft"), "created_at": now, "updated_at": now})
    return created, checked.where(~F.col("is_valid")).select(*requests.columns, "errors")


def contract_id_valid(col: Column) -> Column:
    return F.coalesce(col.rlike(CONTRACT_ID_RE), F.lit(False))


def parse_contract_id(col: Column) -> Column:
    """struct<cmo_name, data_domain, number>; null when malformed.

    The name is the second token only, so the parse of a multi-word name keeps just its first word.
    """
    parts = F.split(col, "-")
    domain = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "-")
    return F.when(contract_id_valid(col), F.struct(
        F.get(parts, F.lit(1)).alias("cmo_name"), domain.alias("data_domain"),
        F.element_at(parts, -1).try_cast("int").alias("number")))


def transitions(owner: str) -> tuple[tuple[str, tuple[str, ...], str], ...]:
    """(action, allowed statuses, next status); ``owner`` names the approving organisation."""
    review, approval = "pending_cmo_review", f"pending_{owner}_approval"
    return (("submit", ("draft",), review), ("accept", (review,), approval), ("approve", (approval,), "active"),
            ("reject", (review, approval), "rejected"))


def _numbered(changes: DataFrame, order_by: Sequence[str]) -> DataFrame:
    ordering = [F.col(c).asc_nulls_last() for c in order_by or sorted(c for c in changes.columns if c != "contract_id")]
    return changes.withColumn("_place", F.row_number().over(Window.partitionBy("contract_id").orderBy(*ordering)))


def superseded(changes: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Changes that give way to an earlier one of the same contract in ``order_by``, with an ``error``."""
    return _numbered(changes, order_by).where("_place > 1").drop("_place").withColumn(
        "error", F.concat(F.lit("Superseded by an earlier change of contract '"), F.coalesce("contract_id", F.lit("")), F.lit("'")))


def apply_transitions(contracts: DataFrame, actions: DataFrame, now: Column, owner: str = "owner",
                      order_by: Sequence[str] = ()) -> DataFrame:
    """Contracts after one action each: (contract_id, action, actor [, reason]).

    Of several actions of one contract the first in ``order_by`` (all columns, by name, if not given) is applied;
    ``superseded`` returns the others.

    Adds ``error`` (illegal or unknown action), ``changed_by`` and ``changed_at``; a refused action
    leaves the contract as it was. Actions for unknown contracts come back with an error, too.
    """
    known = contracts.withColumn("_known", F.lit(True))
    actions = _numbered(actions, order_by).where("_place = 1")
    joined = known.join(actions.select("contract_id", "action", "actor"), "contract_id", "full")
    target, legal = F.lit(None).cast("string"), F.lit(False)
    for action, allowed, to in transitions(owner):
        hit = F.col("action") == action
        target = F.when(hit & F.col("status").isin(*allowed), F.lit(to)).otherwise(target)
        legal = legal | hit
    error = (F.when(F.col("action").isNull(), None)
             .when(F.col("_known").isNull(), F.concat(F.lit("Contract '"), F.col("contract_id"), F.lit("' not found")))
             .when(~legal, F.concat(F.lit("Unknown action: "), F.col("action")))
             .when(target.isNull(), F.concat(F.lit("Cannot "), F.col("action"), F.lit(" contract in status: "),
                                             F.col("status"))))
    moved = F.col("action").isNotNull() & target.isNotNull()
    return joined.select(
        *[F.coalesce(F.when(moved, target), F.col("status")).alias(c) if c == "status" else F.col(c)
          for c in contracts.columns],
        F.when(moved, F.col("actor")).alias("changed_by"), F.when(moved, now).alias("changed_at"),
        error.alias("error"))


def deployable(contracts: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``is_deployable``: required fields, active status, known integration pattern.

    The checks run in that order and stop at the first kind that fails.
    """
    fields = (("contract_id", "contractId"), ("cmo_id", "cmoId"), ("data_domain", "dataDomain"),
              ("integration_pattern", "integrationPattern"))
    gaps = F.array_compact(F.array(*[
        _when(F.coalesce(F.col(c), F.lit("")) == "", f"Missing required field: {label}") for c, label in fields]))
    status = F.coalesce("status", F.lit("draft"))
    not_active = F.concat(F.lit("Contract must be 'active' to deploy, current status: '"), status, F.lit("'"))
    bad_pattern = F.concat(F.lit("Invalid integration pattern '"), F.col("integration_pattern"),
                           F.lit(f"'. Must be one of {_listed(PATTERNS)}"))
    errors = (F.when(F.size(gaps) > 0, gaps).when(status != "active", F.array(not_active))
              .when(~F.col("integration_pattern").isin(*PATTERNS), F.array(bad_pattern))
              .otherwise(F.array().cast("array<string>")))
    return contracts.withColumn("errors", errors).withColumn("is_deployable", F.size("errors") == 0)


def upsert_contracts(contracts: DataFrame, changes: DataFrame, now: Column, order_by: Sequence[str] = ()) -> DataFrame:
    """The contract table after a set of changes, to be written as its next version.

    Of several changes of one contract the first in ``order_by`` (all columns, by name, if not given) is applied;
    ``superseded`` returns the others.

    ``changes``: (contract_id, status, and any of the updatable columns). Unknown ids are created as
    draft; known ones take the given updatable fields, and a status only if it is one of the settable
    ones. Other columns of existing contracts never change.
    """
    given = [c for c in changes.columns if c not in ("contract_id", "status")]
    changes = _numbered(changes, order_by).where("_place = 1")
    side = changes.select("contract_id", *[F.col(c).alias(f"_new_{c}") for c in given],
                          (F.col("status") if "status" in changes.columns else F.lit(None).cast("string"))
                          .alias("_new_status"), F.lit(True).alias("_changed"))
    joined = contracts.withColumn("_exists", F.lit(True)).join(side, "contract_id", "full")
    exists, changed = F.coalesce("_exists", F.lit(False)), F.coalesce("_changed", F.lit(False))
    out = []
    for c in contracts.columns:
        if c == "contract_id":
            out.append(F.col(c))
        elif c == "status":
            settable = F.col("_new_status").isin(*STATUSES)
            out.append(F.when(~exists, "draft").when(settable, F.col("_new_status")).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            out.append(F.when(exists, F.col(c)).otherwise(now).alias(c))
        elif c == "updated_at":
            out.append(F.when(changed, now).otherwise(F.col(c)).alias(c))
        elif c in given:
            fresh = F.col(f"_new_{c}")
            allowed = (~exists) | F.lit(c in UPDATABLE)
            out.append(F.when(allowed, F.coalesce(fresh, F.col(c))).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
