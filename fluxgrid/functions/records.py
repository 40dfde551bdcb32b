"""Fields of incident records: keys, dates, places and kinds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of incidents that count, matched anywhere in the lower-cased kind.
CLIMATE_KINDS = ("extreme temperature", "heat wave", "heatwave", "cold wave", "storm", "flood", "drought", "wildfire")


def record_key(number: Column) -> Column:
    """The leading YYYY-NNNN of an incident number, or null."""
    return F.nullif(F.regexp_extract(F.trim(number), r"^(\d{4}-\d{4})", 1), F.lit(""))


def whole_number(x: Column) -> Column:
    return F.floor(x.try_cast("double")).cast("int")


def assembled_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts: a missing month or day is 1, months are clipped to 1-12, days to 1-28; no year, no date."""
    month = F.least(F.greatest(F.coalesce(whole_number(month), F.lit(1)), F.lit(1)), F.lit(12))
    day = F.least(F.greatest(F.coalesce(whole_number(day), F.lit(1)), F.lit(1)), F.lit(28))
    year = whole_number(year)
    return F.when(year.between(1, 9999), F.make_date(year, month, day))


def geo_precision(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), "exact").otherwise("estimated")


def is_climate(kind: Column) -> Column:
    return F.lower(F.trim(kind)).rlike("|".join(CLIMATE_KINDS))


def find_column(names: list[str], *candidates: str) -> str | None:
    """The first name that contains a candidate, whatever the case; earlier candidates win over earlier names."""
    return next((name for candidate in candidates for name in names if candidate in name.lower()), None)
