"""Who may see what: role-based row and column rules, attribute-based decisions, consent, purposes."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import ACCESS_ORDER, level

OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "IN": lambda c, v: c.isin(list(v)), "NOT IN": lambda c, v: c.isNotNull() & ~c.isin([x for x in v if x is not None]),
}


@dataclass
class AccessPolicy:
    """Globs of tables and columns, deny before allow, nothing without allow; row filters are all applied."""

    role: str
    allow_tables: list[str] = field(default_factory=list)
    deny_tables: list[str] = field(default_factory=list)
    allow_columns: list[str] = field(default_factory=lambda: ["*"])
    deny_columns: list[str] = field(default_factory=list)
    row_filters: list[tuple[str, str, Any]] = field(default_factory=list)
    #: Columns granted one by one, by table; tables not named here follow the globs.
    granted: dict[str, set[str]] = field(default_factory=dict)

    @staticmethod
    def _permits(name: str, allow: list[str], deny: list[str]) -> bool:
        return not any(fnmatch.fnmatchcase(name, p) for p in deny) and any(fnmatch.fnmatchcase(name, p) for p in allow)

    def rows(self, table: str, df: DataFrame) -> DataFrame:
        """The rows of a base relation that the role sees. Filters may use columns that it doesn't see."""
        if not self._permits(table, self.allow_tables, self.deny_tables):
            raise PermissionError(f"{self.role} may not read {table}")
        filters = [OPERATORS[op](F.col(c), v) for c, op, v in self.row_filters if c in df.columns]
        return reduce(lambda d, r: d.filter(r), filters, df)

    def columns(self, table: str, df: DataFrame) -> list[str]:
        grants = self.granted.get(table)
        seen = [c for c in df.columns if self._permits(c, self.allow_columns, self.deny_columns) and (grants is None or c in grants)]
        if not seen:
            raise PermissionError(f"{self.role} sees no column of {table}")
        return seen

    def secure(self, table: str, df: DataFrame) -> DataFrame:
        """The part of a base relation that the role sees."""
        rows = self.rows(table, df)
        return rows.select(*self.columns(table, rows))


def standard_policy(role: str, tenant: int | None = None) -> AccessPolicy:
    """admin and analyst read all, user its tenant's rows, auditor the audit tables."""
    if role in ("admin", "analyst"):
        return AccessPolicy(role, ["*"])
    if role == "user":
        return AccessPolicy(role, ["*"], row_filters=[("tenant_id", "=", tenant)])
    if role == "auditor":
        return AccessPolicy(role, ["audit_*"])
    raise ValueError(f"unknown role {role}")


@dataclass
class Rule:
    """An attribute rule: its conditions are columns over the requests, all of which must hold."""

    name: str
    effect: str
    priority: int
    conditions: list[Column]


def condition(kind: str, value: Any = None) -> Column:
    """A condition over request columns role, clearance, department, tenant_id, data_class, stream, hour, weekday, country, retention_days, correction_allowed, requested_fields, legal_hold.

    incident_deadline and sequencing name a duty, not a fact about the request: they always hold.
    """
    if kind == "stream_matches":
        pattern = "^" + "".join(".*" if x == "*" else "." if x == "?" else "\\" + x if not x.isalnum() and x != "_" else x for x in value) + "$"
        return F.col("stream").rlike(pattern)
    return {
        "role": lambda: F.col("role") == value, "clearance_at_least": lambda: F.col("clearance") >= value, "department": lambda: F.col("department") == value,
        "tenant": lambda: F.col("tenant_id") == value, "class_at_most": lambda: level(F.col("data_class")) <= ACCESS_ORDER.index(value),
        "business_hours": lambda: F.col("hour").between(9, 16) & ~F.col("weekday").isin(0, 6), "country_in": lambda: F.col("country").isin(list(value)),
        "country_not_in": lambda: ~F.col("country").isin(list(value)), "retention_at_least": lambda: F.coalesce(F.col("retention_days") >= value, F.lit(False)),
        "correction_allowed": lambda: F.col("correction_allowed"), "legal_hold": lambda: F.col("legal_hold"), "incident_deadline": lambda: F.lit(True), "sequencing": lambda: F.lit(True),
        "fields": lambda: F.col("requested_fields").isNull() | (F.size(F.array_except("requested_fields", F.array(*[F.lit(v) for v in value]))) == 0),
    }[kind]()


def decide(requests: DataFrame, rules: list[Rule], default: str = "Deny") -> DataFrame:
    """requests with effect and matched_rule: the matching rule of highest priority, the first listed among equals."""
    out_effect, out_rule = F.lit(default), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: r.priority):
        holds = F.coalesce(reduce(lambda a, b: a & b, rule.conditions, F.lit(True)), F.lit(False))
        out_effect, out_rule = F.when(holds, F.lit(rule.effect)).otherwise(out_effect), F.when(holds, F.lit(rule.name)).otherwise(out_rule)
    return requests.withColumn("effect", out_effect).withColumn("matched_rule", out_rule)


# The classes that a purpose may not use.
PURPOSES = ["Marketing", "Analytics", "Contractual", "LegalObligation", "VitalInterests", "PublicTask", "Research", "Security"]
FORBIDDEN = {
    "Marketing": ["PHI", "Sensitive", "PCI", "Financial", "Confidential"], "Analytics": ["PHI", "Sensitive", "PCI", "Confidential"], "Contractual": [], "LegalObligation": [],
    "VitalInterests": ["PCI", "Financial", "Confidential"], "PublicTask": ["PCI", "Financial", "Confidential"], "Research": ["PCI", "Financial", "Confidential"], "Security": [],
}
NEEDS_CONSENT = ["Marketing", "Research"]
LAWFUL_BASIS = {
    "Marketing": "Article 6(1)(a) - Consent", "Analytics": "Article 6(1)(f) - Legitimate interest", "Contractual": "Article 6(1)(b) - Contract",
    "LegalObligation": "Article 6(1)(c) - Legal obligation", "VitalInterests": "Article 6(1)(d) - Vital interests", "PublicTask": "Article 6(1)(e) - Public task",
    "Research": "Article 6(1)(f) or Article 9(2)(j) - Research", "Security": "Article 6(1)(f) - Legitimate interest",
}
NOT_MINIMAL = {"Marketing": ["PHI", "PCI", "Sensitive", "Confidential", "Financial"], "Analytics": ["PHI", "PCI", "Sensitive", "Confidential"]}


def purpose_allowed(purpose: Column, data_class: Column) -> Column:
    pairs = [f"{p}/{c}" for p, classes in FORBIDDEN.items() for c in classes]
    return purpose.isin(PURPOSES) & ~F.concat(purpose, F.lit("/"), data_class).isin(pairs)


def consent_needed(purpose: Column) -> Column:
    return purpose.isin(NEEDS_CONSENT)


def lawful_basis(purpose: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LAWFUL_BASIS.items() for x in pair]), purpose)


def is_minimal(purpose: Column, data_class: Column) -> Column:
    """Whether the purpose may use the class under data minimisation."""
    return ~F.concat(purpose, F.lit("/"), data_class).isin([f"{p}/{c}" for p, classes in NOT_MINIMAL.items() for c in classes])


def has_consent(consents: DataFrame, subject: Any, purpose: str, at: Any) -> bool:
    """Whether a consent of the subject for the purpose is live at a time."""
    one = consents.filter(F.col("subject_id") == subject)
    return not with_consent(one.select(F.col("subject_id").alias("_who")), "_who", one, purpose, F.lit(at)).isEmpty()


def with_consent(df: DataFrame, subject: str, consents: DataFrame, purpose: str, at: Column, scope: str | None = None) -> DataFrame:
    """Rows whose subject has a consent for the purpose (and scope) that is neither withdrawn nor expired."""
    live = consents.filter((F.col("purpose") == purpose) & F.col("withdrawn_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > at)))
    if scope is not None:
        live = live.filter(F.col("scope") == scope)
    return df.join(live.select(F.col("subject_id").alias("_s")), F.col(subject) == F.col("_s"), "left_semi")
