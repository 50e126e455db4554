"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secrets to hide and their replacements.
SECRETS = (
    (r"(?i)\bbearer\s+[^\s,;]+", "Bearer [REDACTED]"),
    (r"(?i)\b(token|password|secret|authorization|credential)\b\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]"),
)


def redact(text: Column) -> Column:
    """Hide bearer tokens and key-value secrets in whole texts."""
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text
