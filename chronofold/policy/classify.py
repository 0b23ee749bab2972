"""Data classes by name and by content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword cascade and the term lists that define the classes.
NAME_KEYWORDS = [
    ("Deidentified", ["deidentified", "anonymized", "aggregate"]),
    ("PHI", ["patient", "medical", "health", "diagnosis", "prescription", "lab_result", "clinical"]),
    ("PCI", ["credit_card", "payment", "card_transaction", "cvv", "pan"]),
    ("Financial", ["financial", "ledger", "accounting", "audit_trail", "balance_sheet", "revenue"]),
    ("Sensitive", ["biometric", "genetic", "racial", "ethnic", "political", "religious", "sexual_orientation", "trade_union"]),
    ("PII", ["user", "customer", "person", "profile", "contact", "email", "phone", "address"]),
    ("Confidential", ["internal", "confidential", "proprietary", "trade_secret", "strategy"]),
    ("Public", ["public", "announcement", "press_release", "blog", "documentation"]),
]
MEDICAL_TERMS = ["diagnosis", "icd-10", "icd-9", "procedure", "medication", "prescription", "dosage", "mg ", "ml ", "blood pressure", "heart rate", "bmi", "hemoglobin", "cholesterol", "glucose", "mrn", "medical record", "patient id", "dob", "date of birth", "insurance", "copay", "deductible", "hipaa"]
FINANCIAL_TERMS = ["account number", "routing number", "iban", "swift", "bic", "balance", "transaction", "wire transfer", "ach", "tax id", "ein", "tin", "1099", "w-2", "w-9", "sox", "gaap", "ebitda", "revenue", "profit"]
#: Least to most restrictive, as labels rank.
LABEL_ORDER = ["Public", "Deidentified", "Confidential", "PII", "Financial", "PCI", "Sensitive", "PHI"]
#: Least to most restrictive, as access decisions rank.
ACCESS_ORDER = ["Public", "Deidentified", "Confidential", "Financial", "PII", "PCI", "Sensitive", "PHI"]


def level(c: Column, order: list[str] = ACCESS_ORDER) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in order]), c) - 1).cast("int")


def class_of_name(name: Column) -> Column:
    """The first group with a keyword in the name; Confidential if none has."""
    low = F.lower(name)
    out = F.when(F.lit(False), F.lit(""))
    for label, words in NAME_KEYWORDS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(label))
    return out.otherwise(F.lit("Confidential"))


def has_ssn(text: Column) -> Column:
    return text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def has_card(text: Column) -> Column:
    """Thirteen digits with nothing but blanks and hyphens between them."""
    return text.rlike(r"[0-9](?:[ -]*[0-9]){12}")


def has_email(text: Column) -> Column:
    return text.rlike(r"(?:^|\s)[^\s@]+@(?=\S*\.)\S{3,}")


def term_count(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms])


def class_of_content(text: Column) -> Column:
    """The most restrictive class that the content shows, Public if none."""
    return F.when(term_count(text, MEDICAL_TERMS) >= 2, F.lit("PHI")).when(has_card(text), F.lit("PCI")).when(term_count(text, FINANCIAL_TERMS) >= 2, F.lit("Financial")).when(has_ssn(text) | has_email(text), F.lit("PII")).otherwise(F.lit("Public"))


def higher(a: Column, b: Column) -> Column:
    """The more restrictive of two classes, as labels rank; a if they're equal."""
    return F.when(level(b, LABEL_ORDER) > level(a, LABEL_ORDER), b).otherwise(a)


def verdict(name: Column, text: Column) -> Column:
    """(data_class, confidence, matched_patterns) from a stream's name and its content.

    The more restrictive of both classes. With no pattern the name alone speaks (0.6); if the content doesn't raise
    the name's class it confirms it (0.95); else 0.7 and 0.05 for each pattern, 0.9 at most.
    """
    medical, financial = term_count(text, MEDICAL_TERMS), term_count(text, FINANCIAL_TERMS)
    found = F.array(
        F.when(has_ssn(text), F.lit("ssn_pattern")), F.when(has_card(text), F.lit("credit_card_pattern")), F.when(has_email(text), F.lit("email_pattern")),
        F.when(medical >= 2, F.concat(F.lit("medical_terms("), medical.cast("string"), F.lit(")"))), F.when(financial >= 2, F.concat(F.lit("financial_terms("), financial.cast("string"), F.lit(")"))),
    )
    patterns = F.array_compact(found)
    by_name = class_of_name(name)
    final = higher(by_name, class_of_content(text))
    sure = F.when(F.size(patterns) == 0, F.lit(0.6)).when(final == by_name, F.lit(0.95)).otherwise(0.7 + F.least(F.size(patterns) * 0.05, F.lit(0.2)))
    return F.struct(final.alias("data_class"), sure.alias("confidence"), patterns.alias("matched_patterns"))
