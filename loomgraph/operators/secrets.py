"""Secrets in sources, by patterns of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

# fixed values: type, severity, label, pattern; its group is the secret
PATTERNS = [
    ("assigned-token", "error", "token in an assignment", r"(?i)\b(?:token|secret|api_?key|passw(?:or)?d)\s*[:=]\s*[\"']([0-9a-f]{32,64})[\"']"),
    ("cloud-key-id", "error", "access key id", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("private-key", "error", "private key block", r"(-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)"),
    ("signed-token", "warning", "signed web token", r"\b(eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"),
    ("url-password", "warning", "password in an address", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]{3,})@"),
]


def scan(files: DataFrame, patterns: list[tuple[str, str, str, str]] = PATTERNS) -> DataFrame:
    """(file_path, type, severity, label, value, line) of files (file_path, content); equal values in a file count once.
    ``patterns``: other rules than ours; the first group of each is the secret."""
    one = lambda kind, severity, label, p: F.transform(F.array_distinct(F.regexp_extract_all("content", F.lit(p), 1)), lambda v: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(label).alias("label"), v.alias("value")))
    found = files.where("content is not null").select("file_path", "content", F.explode(F.flatten(F.array(*(one(*p) for p in patterns)))).alias("s"))
    at = F.expr("cast(locate(s.value, content) - 1 as int)")
    return found.select("file_path", "s.type", "s.severity", "s.label", "s.value", S.line_number(F.col("content"), at).alias("line"))
