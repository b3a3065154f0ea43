"""Redaction, risk findings and injection rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Redaction patterns in their order, and what replaces a match.
REDACTIONS = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "***@***.***"),
    (r"\b\d{3}[-.\s]?\d{4}[-.\s]?\d{4}\b", "***-****-****"),
    (r"sk-[a-zA-Z0-9]{20,}", "sk-***"),
    (r"ghp_[a-zA-Z0-9]{20,}", "ghp_***"),
    (r"AKIA[a-zA-Z0-9]{16}", "AKIA***"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "****-****-****-****"),
    (r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", "$1.$2.***.***"),
)
# Risk patterns, their level and category.
RISKS = (
    ("high", "PII", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("medium", "PII", "phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("critical", "PII", "ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("critical", "API_KEY", "github", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("critical", "API_KEY", "openai", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("critical", "API_KEY", "aws", r"\bAKIA[A-Z0-9]{16}\b"),
    ("critical", "API_KEY", "hex", r"\b[A-Fa-f0-9]{40,64}\b"),
    ("critical", "API_KEY", "slack", r"\bxox[bpors]-[A-Za-z0-9-]{10,}\b"),
    ("critical", "API_KEY", "jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
)
SENSITIVE_WORDS = ("password", "secret", "confidential", "proprietary", "classified", "private key", "credentials")
# Injection and imperative patterns.
INJECTIONS = (
    ("ignore_previous", r"(?i)\bignore\s+(all\s+)?previous\s+(instructions?|prompts?|rules?)\b"),
    ("system_prompt", r"(?i)\b(system\s+prompt|you\s+are\s+(now|a)\s+|new\s+instructions?:|override\s+instructions?)\b"),
    ("role_change", r"(?i)\byou\s+are\s+now\s+\w+"),
    ("forget_rules", r"(?i)\bforget\s+(all\s+)?(your\s+)?(instructions?|rules?|training)\b"),
    ("pretend", r"(?i)\b(pretend|act\s+as\s+if|behave\s+as\s+if|your\s+new\s+role)\b"),
    ("exfiltrate", r"(?i)\b(send|post|upload|exfiltrate)\s+(all\s+)?(memories?|data|information)\s+to\b"),
    ("delete_all", r"(?i)\b(delete|erase|remove|wipe)\s+(all\s+)?(memories?|data|everything)\b"),
    ("forget_all", r"(?i)\bforget\s+(everything|all)\b"),
    ("reset", r"(?i)\b(reset|clear|purge)\s+(the\s+)?(memory|memories|database|store)\b"),
    ("bypass", r"(?i)\b(disable|bypass|circumvent)\s+(security|safety|filters?|guardrails?|protections?)\b"),
)


def redact(text: Column) -> Column:
    """Patterns are replaced in order; an IPv4 address keeps two octets."""
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def redact_map(values: Column) -> Column:
    """T17 for a map of strings."""
    return F.transform_values(values, lambda _, v: redact(v))


def risk_findings(df: DataFrame, id: str = "id", text: str = "content") -> DataFrame:
    """One row for each match: id, level, category, rule, found."""

    def finding(level: str, category: str, rule: str):
        return lambda x: F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(rule).alias("rule"), x.alias("found"))

    rows = []
    for level, category, rule, pattern in RISKS:
        rows.append(F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), finding(level, category, rule)))
    for word in SENSITIVE_WORDS:
        found = F.when(F.lower(F.col(text)).contains(word), F.array(F.lit(word))).otherwise(F.array().cast("array<string>"))
        rows.append(F.transform(found, finding("medium", "SENSITIVE", word)))
    return df.select(F.col(id), F.explode(F.concat(*rows)).alias("f")).select(id, "f.*")


def injection_labels(text: Column) -> Column:
    """Names of the injection rules that match."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in INJECTIONS)))


def noise_scale(mechanism: str, sensitivity: float, epsilon: float, delta: float = 1e-5, least: float = 0.0, most: float = 1e6) -> float:
    """Sigma of the Gaussian or the scale of the Laplace mechanism, clipped; ``most`` where epsilon <= 0."""
    if epsilon <= 0:
        return most
    scale = sensitivity / epsilon
    if mechanism == "gaussian":
        scale *= math.sqrt(2 * math.log(1.25 / delta))
    return max(least, min(most, scale))


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM, base 64."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")
