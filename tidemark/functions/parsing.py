"""Lenient scalars: what cannot be read becomes null, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of dates and times by source, first one that fits wins.
DAILY_FORMATS = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy", "dd-MM-yyyy", "yyyy-MM-dd"]
PRICE_FORMATS = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm"]
DISPATCH_FORMATS = ["yyyy/MM/dd HH:mm:ss"]
UPLOAD_FORMATS = ["dd/MM/yyyy HH:mm", "dd/MM/yyyy hh:mm a", "dd/MM/yyyy hh:mma"]


#: What the parts of a form look like. Years of six digits do not all fit in a timestamp and are none.
SHAPES = {"yyyy": r"[+-]?\d{4,5}", "MMM": ".+", "MM": r"\d\d", "dd": r"\d\d", "HH": r"\d\d", "hh": r"\d\d", "mm": r"\d\d", "ss": r"\d\d", "a": ".+"}


def shape(form: str) -> str:
    """A pattern that every text of the form matches; other texts may too."""
    parts = re.split(r"([A-Za-z]+)", form)
    return "^" + "".join(SHAPES.get(p, ".+") if p.isalpha() else re.sub(r"([^\w\s/:-])", r"\\\1", p) for p in parts) + "$"


def multi_format_timestamp(value: Column, formats: list[str]) -> Column:
    """The first format that fits, else null. A text that does not look like a format is not tried on it, as a failed
    attempt costs many times a match."""
    text = F.trim(value)
    return F.coalesce(*[F.when(F.rlike(text, F.lit(shape(f))), F.try_to_timestamp(text, F.lit(f))) for f in formats])


def safe_float(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """A number without thousands separators and currency signs, within [low, high], else null."""
    plain = F.regexp_replace(F.trim(value.cast("string")), "[,$]", "").try_cast("double")
    number = F.when(~F.isnan(plain), plain)
    if low is not None:
        number = F.when(number.isNotNull(), F.greatest(F.lit(float(low)), number))
    if high is not None:
        number = F.when(number.isNotNull(), F.least(F.lit(float(high)), number))
    return number


def safe_int(value: Column, low: int | None = None, high: int | None = None) -> Column:
    """A whole number read by way of a float, so '12.0' is 12."""
    return safe_float(value, low, high).try_cast("long")


def safe_bool(value: Column) -> Column:
    word = F.upper(F.trim(value.cast("string")))
    return F.when(word.isin("TRUE", "1", "YES"), True).when(word.isin("FALSE", "0", "NO"), False)
