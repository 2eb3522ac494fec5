"""Scalar functions of the translated routines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of status codes, by routine: fixed values.
SALES_ORDER_STATUS = {1: "In process", 2: "Approved", 3: "Backordered", 4: "Rejected", 5: "Shipped", 6: "Cancelled"}
PURCHASE_ORDER_STATUS = {1: "Pending", 2: "Approved", 3: "Rejected", 4: "Complete"}
DOCUMENT_STATUS = {1: "Pending approval", 2: "Approved", 3: "Obsolete"}


def status_text(code: Column, texts: dict[int, str], other: str = "** Invalid **") -> Column:
    found = F.lit(other)
    for n, text in reversed(texts.items()):
        found = F.when(code == n, text).otherwise(found)
    return found


def leading_zeros(number: Column, width: int = 8) -> Column:
    """At least `width` digits; a longer number keeps all of its own."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def fiscal_year(date: Column) -> Column:
    """The fiscal year starts in July."""
    return F.year(F.add_months(date, 6))


def visible_length(text: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(text))


def sanitized(name: Column) -> Column:
    """A field name as a column name: other than letters, digits and underscores becomes an underscore; f_ before a leading digit; lower case."""
    plain = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")
    return F.lower(F.when(plain.rlike(r"^\p{N}"), F.concat(F.lit("f_"), plain)).otherwise(plain))


def dealer_price(price: Column, discount: str = "0.60") -> Column:
    return (price.cast("decimal(18,2)") * F.lit(discount).cast("decimal(3,2)")).cast("decimal(20,4)")


def path_parent(path: Column) -> Column:
    """/1/2/ for /1/2/3/; null for the root."""
    return F.when(path == "/", None).otherwise(F.regexp_replace(path, "[^/]+/$", ""))


def accounting_start(year: Column) -> Column:
    return F.make_timestamp_ntz(year, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def accounting_end(year: Column) -> Column:
    return accounting_start(year + 1) - F.expr("INTERVAL '0.002' SECOND")


def cut_text(value: Column, n: int) -> Column:
    """The first n characters of the value as text."""
    return F.substring(value.cast("string"), 1, n)


def day_112(text: Column) -> Column:
    """The day that yyyymmdd names."""
    return F.to_timestamp_ntz(text, F.lit("yyyyMMdd"))


def day_101(text: Column) -> Column:
    """The day that mm/dd/yyyy names."""
    return F.to_timestamp_ntz(text, F.lit("MM/dd/yyyy"))
