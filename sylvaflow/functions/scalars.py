"""Scalar functions as column expressions: indices, codes, grids, labels, keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import clip, col, finite, holds, lookup
from sylvaflow.operators.zones import Registry

# --- spectral indices ---------------------------------------------------------
INDICES = Registry()


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def _register(name: str, first: str, second: str) -> None:
    @INDICES.register(name, bands=(first, second))
    def _index(bands, **_):
        return normalized_difference(F.col(bands[0]).cast("double"), F.col(bands[1]).cast("double"))


for _n, _a, _b in (("ndvi", "nir", "red"), ("nbr", "nir", "swir2"), ("ndmi", "nir", "swir1")):
    _register(_n, _a, _b)


def compute_indices(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Several indices at once; an index whose bands are missing is refused."""
    for name in names:
        missing = [b for b in INDICES._items[name][1]["bands"] if b not in df.columns]
        if missing:
            raise ValueError(f"{name} needs the bands {missing}")
    return df.withColumns({n: INDICES.build(n) for n in names})


# --- quality bits, reflectance, sensors ------------------------------------------
def qa_bitmask(names: Sequence[str]) -> int:
    unknown = [n for n in names if n not in P.QA_BITS]
    if unknown:
        raise KeyError(f"Unknown quality bits {unknown}. Known: {sorted(P.QA_BITS)}")
    return sum(1 << P.QA_BITS[n] for n in set(names))


def clear_pixel(qa: Column, names: Sequence[str] = P.QA_MASKED, medium_confidence: bool = False) -> Column:
    ok = qa.bitwiseAND(F.lit(qa_bitmask(names))) == 0
    if medium_confidence:
        ok = ok & (F.shiftright(qa, P.CLOUD_CONFIDENCE_SHIFT).bitwiseAND(F.lit(3)) < 2)
    return ok


def reflectance(dn: Column) -> Column:
    return dn.cast("double") * P.REFLECTANCE_SCALE + P.REFLECTANCE_OFFSET


def sensor_table(spark: SparkSession) -> DataFrame:
    """Sensors with their active years, native band numbers and saturation bits (five rows)."""
    rows = [(n, a, b, *bands, *bits) for n, a, b, bands, bits in P.SENSORS]
    names = ("red", "nir", "swir1", "swir2")
    schema = ", ".join(["sensor string", "first_year int", "last_year int"] + [f"{n}_band int" for n in names] + [f"{n}_bit int" for n in names])
    return spark.createDataFrame(rows, schema)


def active_sensors(years: DataFrame, spark: SparkSession, year: str = "year") -> DataFrame:
    """Sensors active in each year, sorted, as one text."""
    s = F.broadcast(sensor_table(spark))
    on = (s["first_year"] <= years[year]) & (s["last_year"].isNull() | (years[year] <= s["last_year"]))
    return years.join(s, on).groupBy(year).agg(F.array_join(F.array_sort(F.collect_set("sensor")), ",").alias("sensors"))


def prepare_pixels(pixels: DataFrame, spark: SparkSession, *, reflect_range: tuple[float, float] = (0.0, 1.0), medium_confidence: bool = False) -> DataFrame:
    """Mask and scale pixel rows of any sensor, with harmonized band names.

    Input: sensor, qa, radsat and ``sr_b1`` to ``sr_b7``. A pixel with a masked
    quality bit, a saturated band or a band outside the range has null bands.
    """
    names = ("red", "nir", "swir1", "swir2")
    df = pixels.join(F.broadcast(sensor_table(spark)), "sensor")
    dn = F.array(*[F.col(f"sr_b{i}") for i in range(1, 8)])
    bands = {n: reflectance(F.get(dn, F.col(f"{n}_band") - 1)) for n in names}
    good = clear_pixel(F.col("qa"), medium_confidence=medium_confidence)
    for n in names:
        good = good & (F.expr(f"shiftright(radsat, {n}_bit)") % 2 == 0) & bands[n].between(*reflect_range)
    keep = [c for c in pixels.columns if not c.startswith("sr_b")]
    return df.select(*keep, *[F.when(holds(good), b).alias(n) for n, b in bands.items()])


# --- stand attributes ---------------------------------------------------------------
def cover_bounds(code: Column) -> tuple[Column, Column, Column]:
    """Lower, upper and middle fraction of a percent cover class, null when not assessed."""
    lo = lookup(code, {k: v[0] for k, v in P.COVER_RANGE.items()})
    hi = lookup(code, {k: v[1] for k, v in P.COVER_RANGE.items()})
    return lo, hi, (lo + hi) / 2


def disturbance_group(code: Column) -> Column:
    parent = (F.floor(code / 10) * 10).cast("int")
    return F.when(code == P.NON_DISTURBANCE, P.DIST_GROUPS[990]).otherwise(lookup(parent, P.DIST_GROUPS, "Unknown"))


def place_code(name: Column) -> Column:
    """Three letters of the name before the trailing compass letters, and those letters, upper case."""
    text = F.when(F.coalesce(name, F.lit("")) == "", F.lit("UNK")).otherwise(name)
    suffix = F.regexp_extract(text, r"([NSEW]*)$", 1)
    stem = F.substring(text, F.lit(1), F.least(F.lit(3), F.length(text) - F.length(suffix)))
    return F.upper(F.concat(stem, suffix))


# --- grids --------------------------------------------------------------------------
def quad_id(lon: Column, lat: Column) -> Column:
    """ID of the 7.5 minute cell, null unless west of Greenwich and north of the equator."""
    lat0, lon0 = F.floor(lat), F.floor(-lon)
    row = F.least(F.floor((lat0 + 1 - lat) / 0.125), F.lit(7))
    column = F.least(F.floor((lon + lon0 + 1) / 0.125), F.lit(7))
    text = F.format_string("q%02d%03d%02d", lat0, lon0, row * 8 + column + 1)
    return F.when((lon < 0) & (lat > 0), text)


QUARTERS = {"sw": (0, 0), "se": (1, 0), "nw": (0, 1), "ne": (1, 1)}


def quad_bounds(quad: Column, quarter: Column | None = None) -> Column:
    """west, south, east, north of a cell or of its quarter, null for text that is not a cell ID.

    An ID is two digits of latitude, three of longitude and the number of the cell in its
    degree, with or without a leading q. Counted in eighths of a degree, the number less one
    splits into rows from the north and columns from the west.
    """
    digits = F.when(quad.rlike("^q?[0-9]{7}$"), F.right(quad, F.lit(7))).cast("int")
    cell = digits % 100 - 1
    west = (cell % 8 - 8 * F.floor(digits / 100) % 8000) / 8 - 1
    south = F.floor(digits / 100000) + (7 - F.floor(cell / 8)) / 8
    ok, side = digits.isNotNull() & cell.between(0, 63), 0.125
    if quarter is not None:
        side /= 2
        step = lambda axis: F.coalesce(*[F.when(quarter == name, offset[axis] * side) for name, offset in QUARTERS.items()])
        ok, west, south = ok & quarter.isin(*QUARTERS), west + step(0), south + step(1)
    edges = {"west": west, "south": south, "east": west + side, "north": south + side}
    return F.when(ok, F.struct(*[c.cast("double").alias(n) for n, c in edges.items()]))


KM_PER_DEGREE = 111.32
WIDEST_KM = 8


def point_bounds(lon: Column, lat: Column, buffer_km: Column) -> Column:
    """Box of a given half side around a point; a half side outside (0, 8] km is an error, a null one gives null."""
    reach = buffer_km / KM_PER_DEGREE
    across = reach / F.cos(F.radians(lat))
    box = F.struct(*[F.round(c, 6).alias(n) for n, c in {"west": lon - across, "south": lat - reach, "east": lon + across, "north": lat + reach}.items()])
    refused = F.raise_error(F.concat(F.lit(f"half side outside (0, {WIDEST_KM}] km: "), buffer_km.cast("string")))
    return F.when((buffer_km > 0) & (buffer_km <= WIDEST_KM), box).when(buffer_km.isNotNull(), refused)


def chip_window(lo: Column, hi: Column, *, margin_m: float = 19.2, max_chips: int = 3, side_m: float = 307.2, anchor: Column | None = None) -> Column:
    """First lattice chip and number of chips along one axis that cover ``[lo, hi]`` with a margin."""
    first, last = F.floor((lo - margin_m) / side_m), F.floor((hi + margin_m) / side_m)
    centre = anchor if anchor is not None else (lo + hi) / 2
    start = F.floor(centre / side_m) - max_chips // 2
    wide = last - first + 1 > max_chips
    moved = F.least(F.greatest(start, first), last - max_chips + 1)
    return F.struct(F.when(wide, moved).otherwise(first).alias("first"), F.when(wide, max_chips).otherwise(last - first + 1).alias("count"))


def coarse_cell(fine: Column, fine_m: float, offset_m: float, cell_m: float) -> Column:
    """Coarse row or column under the centre of a fine one."""
    return F.floor(((fine + 0.5) * fine_m + offset_m) / cell_m)


# --- dates and names -------------------------------------------------------------------
def date_chunks(spark: SparkSession, first: int, last: int, granularity: str = "year") -> DataFrame:
    """Half-open date ranges of a year range by year, half year or month."""
    months = {"year": 12, "half_year": 6, "month": 1}
    if granularity not in months:
        raise ValueError(f"Unknown granularity {granularity!r}. Known: {sorted(months)}")
    if last < first:
        raise ValueError(f"end year {last} precedes start year {first}")
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return explode_chunks(years, months[granularity])


def explode_chunks(years: DataFrame, step: int) -> DataFrame:
    parts = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12), F.lit(step))).alias("m"))
    start = F.make_date(F.col("year"), F.col("m"), F.lit(1))
    label = {12: F.col("year").cast("string"), 6: F.concat("year", F.lit("H"), (F.col("m") / 6 + 1).cast("int")), 1: F.date_format(start, "yyyy-MM")}[step]
    return parts.select(label.alias("label"), F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(F.add_months(start, step), "yyyy-MM-dd").alias("end"))


def off_season(date: Column, first_month: int = 5, last_month: int = 9) -> Column:
    month = F.substring(date.cast("string"), 6, 2).cast("int")
    return (month < first_month) | (month > last_month)


def parse_item(name: Column) -> Column:
    """Quad, quarter, date and resolution of an image item name; null when it is none.

    The name is a row of tokens: m, seven digits of the quad, the quarter, the zone, the
    resolution (three digits are hundredths, one digit or a decimal is metres) and the date.
    """
    token = F.split(name, "_")
    at = lambda i, k: F.get(token, i + k)

    def item(i: Column) -> Column:
        return (
            (at(i, 0) == "m") & at(i, 1).rlike("^[0-9]{7}$") & at(i, 2).isin(*QUARTERS) & at(i, 3).rlike("^[0-9]{1,2}$") & (at(i, 4) != "") & at(i, 5).rlike("^[0-9]{8}")
        )

    start = F.get(F.filter(F.sequence(F.lit(0), F.size(token) - 1), lambda i: F.coalesce(item(i), F.lit(False))), F.lit(0))
    res = at(start, 4)
    metres = F.when(res.rlike("^[0-9]{3}$"), res.try_cast("double") / 100).when(res.rlike("^[0-9]$") | res.rlike("^[.][0-9]+$"), res.try_cast("double"))
    date = F.to_date(F.try_to_timestamp(F.left(at(start, 5), F.lit(8)), F.lit("yyyyMMdd")))
    return F.when(start.isNotNull(), F.struct(at(start, 1).alias("quad"), at(start, 2).alias("quarter"), date.alias("date"), metres.alias("gsd")))


def acquisition_date(path: Column) -> Column:
    """Date token ``_yyyymmdd_`` of a file name, null if there is none or it is no date."""
    token = F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r"_(\d{8})_", 1)
    return F.to_date(F.try_to_timestamp(token, F.lit("yyyyMMdd")))


def interval_label(before: Column, after: Column) -> Column:
    return F.concat_ws("-", before.cast("string"), after.cast("string"))


def interval_timing(detected: Column, reference: Column) -> Column:
    end = lambda c: F.get(F.split(c, "-"), F.lit(1)).try_cast("int")
    det, ref = end(detected), end(reference)
    unsure = reference.isNull() | (reference == "") | (reference == "unsure") | det.isNull() | ref.isNull()
    return F.when(unsure, "unsure").when(det == ref, "match").when(det > ref, "detected_late").otherwise("detected_early")


def params_tag(text: Column, length: int = 10) -> Column:
    return F.substring(F.sha1(text), 1, length)


# --- samples and labels -----------------------------------------------------------------
def sub_stratum(interval: Column, last_interval: Column, mean_prob: Column, area_ha: Column) -> Column:
    small, large = P.SIZE_EDGES_HA
    size = F.when(area_ha >= large, "large").when(area_ha >= small, "medium").otherwise("small")
    prob = F.when(holds(mean_prob >= P.PROB_EDGE), "high").otherwise("low")
    return F.concat_ws("-", F.when(interval == last_interval, "last").otherwise("earlier"), prob, size)


def audit_sub_stratum(stratum: Column, status: Column, change_type: Column, agent: Column) -> Column:
    spread = F.when(holds(change_type.isin(P.DIFFUSE_TYPES)), "diffuse").otherwise("other")
    group = F.coalesce(F.nullif(agent, F.lit("")), F.lit("mixed"))
    return F.when(stratum == "accepted", F.concat(F.lit("accepted_"), spread, F.lit("_"), group)).otherwise(status)


def change_label(reason: Column, policy: Mapping[str, int] = P.POLICY) -> Column:
    return F.coalesce(lookup(reason, {P.REASONS[n]: v for n, v in policy.items()}), F.lit(P.IGNORE))


def reason_group(reason: Column) -> Column:
    return lookup(reason, {P.REASONS[n]: g for g, names in P.REASON_GROUPS.items() for n in names})


def pair_target(change: Column, forest_before: Column, forest_after: Column, reverse: bool = False) -> Column:
    target = F.when(change == P.IGNORE, P.IGNORE).when(change > 0, 1).otherwise(0)
    if not reverse:
        return target
    return F.when(~forest_before & forest_after, P.IGNORE).when(target == 1, 0).otherwise(target)


def popescu_width(height: Column, coeffs: tuple = P.POPESCU) -> Column:
    a, b, c = coeffs
    h = col(height).cast("double")
    return a + b * h + c * h * h


def open_grown_width(height: Column) -> Column:
    return P.OPEN_GROWN * popescu_width(height)


# --- encodings --------------------------------------------------------------------------
def encode_z(z: Column) -> Column:
    value = finite(z)
    return F.coalesce(clip(F.rint(value * P.Z_SCALE), -P.Z_CLIP, P.Z_CLIP), F.lit(float(P.Z_NODATA))).cast("short")


def decode_z(code: Column) -> Column:
    return F.when(code != P.Z_NODATA, code / float(P.Z_SCALE))


def quantize_z(z: Column) -> Column:
    return decode_z(encode_z(z))


def encode_onset(year: Column) -> Column:
    """0 none, 255 never monitored, else the year counted from 2000."""
    code = clip(year - P.ONSET_BASE, 1, P.BYTE_NODATA - 1)
    return F.when(year < 0, P.BYTE_NODATA).when(year > 0, code).otherwise(0).cast("int")


def to_percent(prob: Column) -> Column:
    return clip(F.rint(prob.cast("double") * 100), 0, 100).cast("int")


def encode_peak(prob: Column) -> Column:
    """Aggregate: highest probability of a cell in percent, 255 where never decided."""
    return F.coalesce(to_percent(F.max(finite(prob))), F.lit(P.BYTE_NODATA))


def encode_height(height: Column) -> Column:
    code = clip(F.rint(finite(height) / P.HEIGHT_STEP_M), 0, P.BYTE_NODATA - 1)
    return F.coalesce(code.cast("int"), F.lit(P.BYTE_NODATA))


def flagged_code(code: Column, percent: Column, threshold: float) -> Column:
    cut = round(threshold * 100)
    hit = (percent != P.BYTE_NODATA) & (percent >= cut) & (code != P.BYTE_NODATA)
    return F.when(holds(hit), code).otherwise(0)


def to_uint8(value: Column, lo: Column, hi: Column) -> Column:
    """Linear scale to a byte, 0 for missing values and for an empty range."""
    scaled = clip((finite(value) - lo) / (hi - lo), 0.0, 1.0)
    return F.when(hi <= lo, 0).otherwise(F.floor(F.coalesce(scaled, F.lit(0.0)) * 255.0 + 0.5)).cast("int")


def stored_scale(dtype: Column, factor: Column | None = None) -> Column:
    given = factor if factor is not None else F.lit(None).cast("double")
    return F.coalesce(given, F.when(dtype.rlike("^u?int"), 0.01).otherwise(1.0))


def soil_code(label: Column, mapping: Mapping[str, int]) -> Column:
    return F.coalesce(lookup(label, {k: v for k, v in mapping.items() if k != "unknown"}), F.lit(0))
