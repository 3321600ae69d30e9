"""Base64 and UTF-8 with the exact rules of the request contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The possessive group keeps the matcher from recursing over a long body.
STRICT_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def is_strict_base64(text: Column) -> Column:
    """Whole text is padded base64 and nothing else; null is not."""
    return F.coalesce(text.rlike(STRICT_BASE64), F.lit(False))


def utf8_text(body: Column) -> Column:
    """Bytes as text; each malformed sequence becomes U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))
