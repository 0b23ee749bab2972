"""Attribute policies for named regulations, as rules for access.decide()."""

from __future__ import annotations

from .access import Rule, condition

# For each policy its rules as (name, effect, priority, conditions). All deny by default.
EU = ["DE", "FR", "NL", "IT", "ES", "BE", "AT", "PT", "IE", "FI", "SE", "DK", "PL", "CZ", "RO", "BG", "HR", "SK", "SI", "LT", "LV", "EE", "CY", "MT", "LU", "HU", "GR"]
POLICIES = {
    "hipaa": [
        ("hipaa-phi-access", "Allow", 10, [("clearance_at_least", 2), ("business_hours", None)]),
        ("hipaa-non-phi-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "fedramp": [
        ("fedramp-us-only", "Deny", 100, [("country_not_in", ["US"])]),
        ("fedramp-allow-us", "Allow", 50, [("country_in", ["US"])]),
    ],
    "pci": [
        ("pci-server-access", "Allow", 10, [("clearance_at_least", 2), ("department", "Server")]),
        ("pci-non-pci-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "hitech": [
        ("hitech-phi-minimum-necessary", "Allow", 10, [("clearance_at_least", 2), ("business_hours", None), ("fields", ["patient_id", "patient_name", "patient_dob"])]),
        ("hitech-non-phi-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "cfr21_part11": [
        ("cfr21-electronic-records", "Allow", 10, [("clearance_at_least", 3), ("sequencing", ["Authorship", "Review", "Approval"])]),
        ("cfr21-read-access", "Allow", 5, [("clearance_at_least", 2)]),
    ],
    "sox": [
        ("sox-financial-access", "Allow", 10, [("clearance_at_least", 2), ("retention_at_least", 2555)]),
        ("sox-non-financial-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "glba": [
        ("glba-financial-us-only", "Allow", 10, [("clearance_at_least", 2), ("country_in", ["US"])]),
        ("glba-non-financial-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "ccpa": [
        ("ccpa-pii-access", "Allow", 10, [("clearance_at_least", 1), ("correction_allowed", None)]),
        ("ccpa-non-pii-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "ferpa": [
        ("ferpa-student-data", "Allow", 10, [("clearance_at_least", 2), ("business_hours", None)]),
        ("ferpa-non-pii-access", "Allow", 5, [("class_at_most", "Confidential")]),
    ],
    "nist_800_53": [
        ("nist-sensitive-us-only", "Allow", 10, [("clearance_at_least", 2), ("country_in", ["US"])]),
        ("nist-public-access", "Allow", 5, [("class_at_most", "Public")]),
    ],
    "cmmc": [
        ("cmmc-controlled-us-only", "Allow", 10, [("clearance_at_least", 2), ("country_in", ["US"])]),
        ("cmmc-public-access", "Allow", 5, [("class_at_most", "Public")]),
    ],
    "legal": [
        ("legal-hold-block-deletion", "Deny", 100, [("legal_hold", None)]),
        ("legal-confidential-access", "Allow", 10, [("clearance_at_least", 2)]),
    ],
    "nis2": [
        ("nis2-eu-access", "Allow", 10, [("country_in", EU), ("incident_deadline", 24)]),
    ],
    "dora": [
        ("dora-financial-eu-only", "Allow", 10, [("clearance_at_least", 2), ("country_in", EU)]),
        ("dora-non-financial-eu", "Allow", 5, [("country_in", EU)]),
    ],
    "eidas": [
        ("eidas-qualified-signatures", "Allow", 10, [("country_in", EU), ("sequencing", ["Identification", "Authentication", "Signing"])]),
        ("eidas-basic-eu-access", "Allow", 5, [("country_in", EU)]),
    ],
    "gdpr": [
        ("gdpr-pii-access", "Allow", 10, [("clearance_at_least", 1), ("country_in", EU), ("correction_allowed", None)]),
        ("gdpr-non-pii-eu", "Allow", 5, [("country_in", EU)]),
    ],
    "iso27001": [
        ("iso27001-confidential-access", "Allow", 10, [("clearance_at_least", 2), ("business_hours", None)]),
        ("iso27001-public-access", "Allow", 5, [("class_at_most", "Public")]),
    ],
    "aus_privacy": [
        ("aus-privacy-pii-access", "Allow", 10, [("clearance_at_least", 1), ("country_in", ["AU"]), ("correction_allowed", None)]),
        ("aus-privacy-non-pii", "Allow", 5, [("country_in", ["AU"])]),
    ],
    "apra_cps234": [
        ("apra-financial-au-only", "Allow", 10, [("clearance_at_least", 2), ("country_in", ["AU"])]),
        ("apra-non-financial-au", "Allow", 5, [("country_in", ["AU"])]),
    ],
}


def builtin_policy(name: str) -> list[Rule]:
    return [Rule(rule, effect, priority, [condition(kind, value) for kind, value in conditions]) for rule, effect, priority, conditions in POLICIES[name]]
