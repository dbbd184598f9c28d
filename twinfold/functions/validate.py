"""Validation predicates (P11-P16).  Each returns TRUE for an acceptable value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats.
SAFE_NAME = r"^[a-zA-Z0-9._:/\-]+$"
SAFE_FILE = r"^[a-zA-Z0-9._/\-]+$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
BASE64 = r"^[A-Za-z0-9+/=\s]+$"


def no_blank_item(c: Column) -> Column:
    return F.forall(c, lambda x: F.trim(x) != "")


def valid_names(c: Column) -> Column:
    """A non-empty list without blank items."""
    return F.coalesce((F.size(c) > 0) & no_blank_item(c), F.lit(False))


def valid_addresses(c: Column) -> Column:
    """NULL, or a list without blank items."""
    return c.isNull() | F.coalesce(no_blank_item(c), F.lit(False))


def valid_emails(c: Column) -> Column:
    """NULL, or a list in which every item looks like an e-mail address."""
    return c.isNull() | F.coalesce(F.forall(c, lambda x: x.rlike(EMAIL)), F.lit(False))


def valid_date_text(c: Column) -> Column:
    """NULL, or text of the form YYYY-MM-DD."""
    return c.isNull() | c.rlike(ISO_DATE)


def safe_name(c: Column) -> Column:
    """Identifier made of letters, digits and ``. _ : / -``."""
    return F.coalesce(c.rlike(SAFE_NAME), F.lit(False))


def safe_file(c: Column) -> Column:
    """Relative path made of letters, digits and ``. _ / -``."""
    return F.coalesce(c.rlike(SAFE_FILE), F.lit(False))


def base64_like(c: Column) -> Column:
    """NULL, or characters of the base64 alphabet only."""
    return c.isNull() | c.rlike(BASE64)


def probability(c: Column) -> Column:
    """A number in [0, 1]."""
    return F.coalesce(c.between(0.0, 1.0), F.lit(False))


def positive_limit(c: Column) -> Column:
    """NULL (no limit) or at least 1."""
    return c.isNull() | (c >= 1)
