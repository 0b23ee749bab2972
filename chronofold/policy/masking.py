"""Column masks as expressions, policies that assign them, and secured relations.

Masks apply at the base relation, below the user's query, so no alias or function gets round them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _checked(c: Column, low: int, high: int, prefix: str, what: str) -> Column:
    d = _digits(c)
    n = F.length(d)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(n.between(low, high), F.concat(F.lit(prefix), F.right(d, F.lit(4)))).otherwise(F.raise_error(F.lit(f"not a {what}")).cast("string"))


def redact_ssn(c: Column) -> Column:
    return _checked(c, 9, 9, "***-**-", "social security number")


def redact_phone(c: Column) -> Column:
    return _checked(c, 10, 1 << 30, "***-***-", "phone number")


def redact_card(c: Column) -> Column:
    return _checked(c, 13, 19, "****-****-****-", "card number")


def redact_email(c: Column) -> Column:
    at = F.instr(c, "@")
    return F.when(at > 1, F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring(c, at + 1, F.length(c)))).otherwise(F.raise_error(F.lit("not an address")).cast("string"))


def hash_hex(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def tokenize(c: Column) -> Column:
    """tok_ and 16 hexadecimal digits of SHA-256; Spark has no BLAKE3."""
    return F.concat(F.lit("tok_"), F.substring(hash_hex(c), 1, 16))


def truncate(c: Column, n: int) -> Column:
    """Texts of more than n bytes: the first n characters and '...'."""
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), F.lit("...")))


MASKS = {
    "REDACT_SSN": redact_ssn, "REDACT_PHONE": redact_phone, "REDACT_CC": redact_card, "REDACT_EMAIL": redact_email,
    "HASH": hash_hex, "TOKENIZE": tokenize, "NULL": lambda c: F.nullif(c, c),
}


@dataclass
class MaskPolicy:
    name: str
    strategy: str
    argument: str | int | None = None
    exempt: frozenset[str] = frozenset()

    def apply(self, c: Column) -> Column:
        if self.strategy == "REDACT_CUSTOM":
            return F.lit(self.argument)
        if self.strategy == "TRUNCATE":
            return truncate(c, int(self.argument))
        return MASKS[self.strategy](c)


@dataclass
class MaskRegistry:
    """CREATE / DROP MASKING POLICY and ALTER COLUMN SET / DROP MASKING POLICY."""

    policies: dict[str, MaskPolicy] = field(default_factory=dict)
    attached: dict[tuple[str, str], str] = field(default_factory=dict)

    def create(self, name: str, strategy: str, argument: str | int | None = None, exempt: tuple[str, ...] = ()) -> None:
        if name in self.policies:
            raise ValueError(f"policy {name} exists")
        self.policies[name] = MaskPolicy(name, strategy, argument, frozenset(r.lower() for r in exempt))

    def drop(self, name: str) -> None:
        if name in self.attached.values():
            raise ValueError(f"policy {name} is attached")
        del self.policies[name]

    def attach(self, table: str, column: str, name: str) -> None:
        if (table, column) in self.attached:
            raise ValueError(f"{table}.{column} has a policy")
        self.attached[table, column] = self.policies[name].name

    def detach(self, table: str, column: str) -> None:
        del self.attached[table, column]

    def secure(self, table: str, df: DataFrame, role: str) -> DataFrame:
        out = []
        for c in df.columns:
            policy = self.policies.get(self.attached.get((table, c), ""))
            out.append(F.col(c) if policy is None or role.lower() in policy.exempt else policy.apply(F.col(c)).alias(c))
        return df.select(*out)
