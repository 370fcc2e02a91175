"""Scalar functions: cleaning, conversions, indices. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """A number written with thousands commas or a plus sign; null if it isn't one."""
    return F.translate(F.trim(text), ",+", "").try_cast("double")


def to_date(text: Column, *formats: str) -> Column:
    """The date by the first of the formats that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def date_of_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("date")


def sentinel_to_null(value: Column, sentinel: float = -999) -> Column:
    return F.nullif(value, F.lit(sentinel))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def flag(value: Column) -> Column:
    """Y, YES, 1, TRUE as true, N, NO, 0, FALSE as false, in either case; null otherwise."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text.isin("Y", "YES", "1", "TRUE"), True).when(text.isin("N", "NO", "0", "FALSE"), False)


def list_length(text: Column, separator: str = ",") -> Column:
    """Parts of a separated list; an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, separator)))


def id_list(ids: Column) -> Column:
    """[a, b] of an array, or '' of an empty one."""
    return F.when(F.size(ids) > 0, F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))).otherwise("")


def stem(path: Column) -> Column:
    """The file's name without folders and its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def captured_number(text: Column, before: str) -> Column:
    """The decimal number after a label; null without one."""
    return F.regexp_extract(text, before + r"\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def first_known(*values: Column) -> Column:
    """The first value that is neither null nor the text nan."""
    return F.coalesce(*[F.when(F.lower(v.cast("string")) != "nan", v) for v in values])


def feet_to_metres(feet: Column) -> Column:
    return feet * 0.3048


def quantized(share: Column) -> Column:
    """A share of 0 to 1 in 8 bits."""
    return F.least(F.greatest(F.floor(share * 255), F.lit(0)), F.lit(255)).cast("int")


def url_quoted(text: Column) -> Column:
    return F.url_encode(text)


# --- spectral indices, by their published formulas


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where either is negative or both are 0."""
    return F.when((a >= 0) & (b >= 0), F.try_divide(a - b, a + b))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    """Enhanced vegetation index (Huete et al. 2002)."""
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    """Soil-adjusted vegetation index (Huete 1988)."""
    return F.try_divide((nir - red) * (1 + soil), nir + red + soil)


def msavi(nir: Column, red: Column) -> Column:
    """Modified soil-adjusted vegetation index (Qi et al. 1994)."""
    return (2 * nir + 1 - F.sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) / 2


def recovery_metric(ndvi: Column, nbr: Column, ndmi: Column) -> Column:
    return ((ndvi + nbr) / 2 + ndmi) / 2


def saturated(limit: float, *bands: Column) -> Column:
    """True where any band reaches the limit."""
    return F.greatest(*bands) >= limit


def mss_error(b4: Column, b5: Column, b7: Column) -> Column:
    """True where early-sensor bands are out of their range."""
    return ~((b4 >= 0.065) & (b5 >= 0) & (b7 <= 0.32))


def mss_cloud(b4: Column, b5: Column) -> Column:
    return ((F.try_divide(b4 - b5, b4 + b5) > 0) & (b4 > 0.175)) | (b4 > 0.39)


def five_year_bucket(year: Column) -> Column:
    """The bucket's first year; 1984 and 2015 are buckets of their own, other years outside are null."""
    return F.when(year.isin(1984, 2015), year).when(year.between(1985, 2014), (F.floor(year / 5) * 5).cast("int"))


def remapped(value: Column, old: list, new: list, default: Column | None = None) -> Column:
    """new[k] where the value is old[k]; else the default, null without one."""
    found = F.lit(None)
    for a, b in reversed(list(zip(old, new, strict=True))):
        found = F.when(value == a, b).otherwise(found)
    return found if default is None else F.when(value.isin(old), found).otherwise(default)


def threshold_of(year: Column, thresholds: dict[int, float]) -> Column:
    """The year's threshold of a literal table; null for other years."""
    return F.create_map(*[F.lit(x) for pair in sorted(thresholds.items()) for x in pair])[year]


def labelled_blank(text: Column, label: str) -> Column:
    """The label where a text is null or blank."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", label).otherwise(text)


def cost_tiers(cubic_yards: Column) -> dict[str, Column]:
    """Least, middle and greatest cost to regrade a volume, by the published rates a cubic yard."""
    return {"min_cost": cubic_yards * 1.25, "mid_cost": cubic_yards * 1.875, "max_cost": cubic_yards * 2.5}


# --- masks of pixels: null is masked


def masked(value: Column, mask: Column) -> Column:
    """The value where the mask is set; null where it is 0 or null."""
    return F.when(mask != 0, value)


def unmasked(value: Column, fill: float = 0) -> Column:
    return F.coalesce(value, F.lit(fill))


def inverted(mask: Column) -> Column:
    """1 where the mask is 0, 0 where it is another number, null where it is masked."""
    return F.when(mask == 0, 1).when(mask != 0, 0)


def both_set(*masks: Column) -> Column:
    """1 where all are set, 0 where one is 0; null where any is masked."""
    found = F.lit(1)
    for m in masks:
        found = found * F.when(m != 0, 1).when(m == 0, 0)
    return found


# --- ages and bonds


def ages(first: Column, last: Column, now: int) -> dict[str, Column]:
    """max_age, min_age, mid_age and age_uncertainty of what was first and last seen in these years."""
    oldest, youngest = F.lit(now) - first, F.lit(now) - last
    return {"max_age": oldest, "min_age": youngest, "mid_age": (oldest + youngest) / 2, "age_uncertainty": (oldest - youngest) / 2}


def full_bond(state: Column, status: Column, current: Column, available: Column, amount: Column) -> Column:
    """The bond for all reclamation: in KY the current one once released, in VA the amount, elsewhere what is available."""
    return F.when((state == "KY") & (status == "Released"), current).when(state == "VA", amount).otherwise(available)


def share_of(part: Column, whole: Column) -> Column:
    """Percent of a positive whole; null otherwise."""
    return F.when(whole > 0, part / whole * 100)


def parsed_codes(text: str, names: list[str], codes: dict[str, list[int]], separator: str = ",") -> list[dict]:
    """Rows of a literal of separated lines; codes names integers made of several fields' digits, such as state and county."""
    rows = [[v.strip() for v in line.split(separator)] for line in text.strip().splitlines()]
    return [dict(zip(names, r, strict=False)) | {name: int("".join(r[k] for k in at)) for name, at in codes.items()} for r in rows]
