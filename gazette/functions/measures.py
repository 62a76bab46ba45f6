"""Money and distance column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Multipliers to rupees, by what the text names; the first that is found holds.
TO_INR = (("(?i)crore|\\bcr\\b", 1e7), ("(?i)lakh", 1e5), ("(?i)\\$|usd", 87.0), ("(?i)€|eur", 94.0), ("(?i)£|gbp", 110.0))
MOST_INR = 5e8


def distance_km(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Great-circle distance to a point, one decimal, halves to even."""
    dlat, dlng = F.radians(lat - F.lit(lat0)), F.radians(lng - F.lit(lng0))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(dlng / 2), 2)
    return F.bround(F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 1)


def prize_inr(text: Column) -> Column:
    """The first number of a prize text in rupees; 0 without one or when it is beyond belief."""
    number = F.try_to_number(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), "(\\d+(?:\\.\\d+)?)", 1), F.lit("999999999999999.99")).cast("double")
    factor = F.lit(None)
    for pattern, by in reversed(TO_INR):
        factor = F.when(text.rlike(pattern), by).otherwise(factor)
    value = F.coalesce(number * F.coalesce(factor, F.lit(1.0)), F.lit(0.0))
    return F.when(value > MOST_INR, 0.0).otherwise(value)


def prize_exact(text: Column) -> Column:
    """currency and amount where the text names a currency without doubt; a bare '$' does not."""
    currency = (
        F.when(text.rlike("\\b(USD|EUR|GBP|INR)\\b"), F.regexp_extract(text, "\\b(USD|EUR|GBP|INR)\\b", 1))
        .when(text.contains("US$"), "USD")
        .when(text.contains("₹"), "INR")
        .when(text.contains("€"), "EUR")
        .when(text.contains("£"), "GBP")
    )
    amount = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), "(\\d+(?:\\.\\d{1,2})?)", 1)
    return F.when(currency.isNotNull() & (amount != ""), F.concat_ws(" ", currency, amount))
