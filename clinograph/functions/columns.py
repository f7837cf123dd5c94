"""Column expressions: missing values, weights, units, calendars and longitudes.

Missing values are NULL throughout.  NaN never enters an aggregate, because Spark's would return it.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of the seasons, and days before each month in years of 365 and 366 days.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
BEFORE_MONTH_LEAP = (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_to_null(x: str | Column, below: float | None = None, above: float | None = None) -> Column:
    """NULL for NaN, infinities and fill values at or beyond the bounds."""
    x = col(x).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    if below is not None:
        bad = bad | (x <= below)
    if above is not None:
        bad = bad | (x >= above)
    return F.when(~bad, x)


def wavg(value: str | Column, weight: str | Column) -> Column:
    """Weighted mean; a weight counts only where its value is there, and no weight gives NULL."""
    value, weight = col(value), col(weight)
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def complete(aggregate: Column, value: str | Column) -> Column:
    """The aggregate, or NULL if any value of the group is missing."""
    return F.when(F.count(col(value)) == F.count(F.lit(1)), aggregate)


# What a value in the first unit is times and plus to be in the second.
UNITS = {("K", "degC"): (1.0, -273.15), ("kg m-2 s-1", "mm day-1"): (86400.0, 0.0), ("hPa", "Pa"): (100.0, 0.0), ("1", "%"): (100.0, 0.0)}


def convert(x: str | Column, unit: str, to: str) -> Column:
    """A value in another unit; ValueError for units that nothing leads between."""
    if unit == to:
        return col(x)
    if (unit, to) in UNITS:
        factor, offset = UNITS[unit, to]
        return col(x) * factor + offset
    if (to, unit) in UNITS:
        factor, offset = UNITS[to, unit]
        return (col(x) - offset) / factor
    raise ValueError(f"no way from {unit} to {to}")


def signed_flux(x: str | Column, positive_up: bool) -> Column:
    """Fluxes count downward as positive."""
    return -col(x) if positive_up else col(x)


def monthly_total_to_flux(x: str | Column, month: str | Column) -> Column:
    """mm per month as kg m-2 s-1."""
    return col(x) / (F.dayofmonth(F.last_day(col(month))) * 86400.0)


# calendars
def season(month: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(col(month).isin(*months), name).otherwise(out)
    return out


def season_year(date: str | Column) -> Column:
    """The year, with December counted to the next one."""
    return F.year(F.add_months(col(date), 1))


def _from_table(table: tuple[int, ...], month: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in table)), month.cast("int"))


def calendar_slot(month: str | Column, day: str | Column, calendar: str = "standard") -> Column:
    """Slot of a day: 0 to 365 with 29 February at 59, 0 to 364 without leap days, or (m-1)*30 + d-1."""
    month, day = col(month), col(day)
    if calendar == "360_day":
        return ((month - 1) * 30 + day - 1).cast("int")
    table = BEFORE_MONTH if calendar in ("noleap", "365_day") else BEFORE_MONTH_LEAP
    return (_from_table(table, month) + day - 1).cast("int")


def day_of_365(month: str | Column, day: str | Column) -> Column:
    """Day 1 to 365; 29 February counts as the 28th."""
    month, day = col(month), col(day)
    return (_from_table(BEFORE_MONTH, month) + F.when(month == 2, F.least(day, F.lit(28))).otherwise(day)).cast("int")


def month_start(x: str | Column) -> Column:
    return F.trunc(col(x), "MM")


# longitudes and places
def lon_0_360(x): return F.pmod(col(x), F.lit(360.0))
def lon_180_180(x): return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


def in_box(lat, lon, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Whether a place lies in a box; a box whose west is beyond its east goes round the date line."""
    lat, lon = col(lat), lon_0_360(lon)
    west, east = lon_min % 360.0, lon_max % 360.0
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return (lat >= lat_min) & (lat <= lat_max) & across


def in_polygon(lat: str | Column, lon: str | Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over the edges of (lon, lat) corners, in the longitude frame where they lie closest."""
    wide = [x % 360.0 for x, _ in corners]
    near = [(x + 180.0) % 360.0 - 180.0 for x, _ in corners]
    lons, lon = (wide, lon_0_360(lon)) if max(wide) - min(wide) <= max(near) - min(near) else (near, lon_180_180(lon))
    lat, hits = col(lat), F.lit(0)
    points = [(x, y) for x, (_, y) in zip(lons, corners)]
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 == y2:
            continue
        at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
        hits = hits + F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < at), 1).otherwise(0)
    return hits % 2 == 1


def great_circle(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    """Distance in km by the haversine formula."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def band_area(south, north, width, radius: float = 6371000.0) -> Column:
    """Area of a cell between two parallels, `width` degrees wide, on a sphere."""
    return F.lit(radius**2) * F.radians(col(width)) * (F.sin(F.radians(col(north))) - F.sin(F.radians(col(south))))


# scores
def added_value(error1: str | Column, error2: str | Column) -> Column:
    """(e1^2 - e2^2) / max(e1^2, e2^2): positive where the second is better; 0 if both are 0."""
    a, b = col(error1) * col(error1), col(error2) * col(error2)
    top = F.greatest(a, b)
    return F.when(a.isNull() | b.isNull(), None).when(top == 0, 0.0).otherwise(F.try_divide(a - b, top))


def change(future: str | Column, reference: str | Column, floor: float | None = None) -> Column:
    """Percent change where a floor is given and the reference reaches it, else the difference or NULL."""
    f, r = col(future), col(reference)
    return f - r if floor is None else F.when(r >= floor, F.try_divide(100.0 * (f - r), r))


def relative_bias(bias: str | Column, obs: str | Column, floor: float = 0.1) -> Column:
    return F.when(col(obs) > floor, F.try_divide(100.0 * col(bias), col(obs)))


# text
def safe_name(x: str | Column) -> Column:
    """Letters, digits and underscores only, not beginning with a digit."""
    clean = F.regexp_replace(col(x), r"[^0-9A-Za-z_]+", "_")
    return F.when(clean.rlike(r"^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def json_of_reply(x: str | Column) -> Column:
    """The outermost braces of a reply, without code fences and trailing commas; NULL if there are none."""
    body = F.regexp_replace(col(x), r"(?s)```(?:json)?", "")
    body = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.when(body != "", body)


def redact(x: str | Column) -> Column:
    """Values of keys that name secrets, blanked."""
    return F.regexp_replace(col(x), r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)\S+", "$1***")


def family_of(member: str | Column) -> Column:
    """A member's name without its run number."""
    return F.regexp_replace(col(member), r"-r\d+$", "")


def variant_numbers(variant: str | Column) -> list[Column]:
    """The numbers of realisation, initialisation, physics and forcing of a variant label such as r1i1p1f1."""
    return [F.regexp_extract(col(variant), r"^r(\d+)i(\d+)p(\d+)f(\d+)$", k).cast("int") for k in (1, 2, 3, 4)]
