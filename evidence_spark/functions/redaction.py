"""Secret redaction as a chain of column replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from .text import col, sval

_FIELDS = "|".join(sorted(K.SENSITIVE_FIELDS, key=len, reverse=True))
_KEY = f"(?i)([\"']?(?:{_FIELDS})[\"']?\\s*:\\s*)"
# fixed values: the five secret forms, applied in this order
REDACTION_STEPS = [
    ("([a-zA-Z][a-zA-Z0-9+.-]*://)([^/\\s@]+@)", "$1[REDACTED]@"),
    ("(?i)(\\bAuthorization\\b\\s*[:=]\\s*Bearer\\s+)(\\S+)", "$1[REDACTED]"),
    (_KEY + "([\"'])(.*?)(\\2)", "$1$2[REDACTED]$4"),
    (_KEY + "([^,\\s\\}\\]]+)", "$1[REDACTED]"),
    (f"(?i)(\\b(?:{_FIELDS})\\b\\s*=\\s*)(\\S+)", "$1[REDACTED]"),
]


def redact_text(c, secrets=(), max_length: int | None = None) -> Column:
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    for pattern, repl in REDACTION_STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(repl))
    for secret in sorted({str(s).strip() for s in secrets if str(s).strip()}, key=len, reverse=True):
        escaped = (secret.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"))
        for form in sorted({secret, escaped}, key=len, reverse=True):
            text = F.replace(text, F.lit(form), F.lit(K.REDACTED))
    if max_length is None:
        return text
    return F.when(F.length(text) > max_length, F.concat(F.substring(text, 1, max_length), F.lit("..."))).otherwise(text)


def is_sensitive_key(name: str) -> bool:
    return any(part in name.strip().lower() for part in K.SENSITIVE_KEY_PARTS)


def redact(df: DataFrame, text_cols=(), map_cols=(), secrets=(), max_length: int | None = None) -> DataFrame:
    """Redacts text columns; a column or map entry with a sensitive name loses its value."""
    for c in text_cols:
        value = F.lit(K.REDACTED) if is_sensitive_key(c) else redact_text(c, secrets, max_length)
        df = df.withColumn(c, value)
    for c in map_cols:
        def clean(k, v):
            key = F.lower(sval(k))
            hot = F.lit(False)
            for part in K.SENSITIVE_KEY_PARTS:
                hot = hot | key.contains(part)
            return F.when(hot, F.lit(K.REDACTED)).otherwise(redact_text(v, secrets, max_length))
        df = df.withColumn(c, F.transform_values(c, clean))
    return df
