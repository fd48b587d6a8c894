"""Text normalisation as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(c: Column, build) -> Column:
    """``build`` applied to a value that is computed once, for expressions that use an
    expensive part many times (keeps plans and generated code small)."""
    return F.transform(F.array(c), build)[0]


def clean_text(c: Column) -> Column:
    """NULL becomes '', the non-breaking hyphen a plain one, white space one blank."""
    plain = F.translate(F.coalesce(c.cast("string"), F.lit("")), "‑", "-")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def compact_text(c: Column) -> Column:
    return F.regexp_replace(clean_text(c), r"(?U)\s+", "")


def compact_identifier(c: Column) -> Column:
    """Lower-case identity of a name, without separators and brackets."""
    return F.lower(F.regexp_replace(clean_text(c), r"(?U)[\s_\-—–:：/\\（）()【】\[\]]+", ""))


def header_key(c: Column) -> Column:
    """Identity of a header cell: as an identifier, percent signs ignored."""
    return F.regexp_replace(compact_identifier(c), "[%％]", "")
