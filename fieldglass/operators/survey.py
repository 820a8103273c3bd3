"""Metrics of a coded household survey: sums of its variables, their integrity, and how values and places are written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.exprs import ColumnOrName, col
from fieldglass.operators import cleanse

# Each metric and the variables that it adds up.
METRICS = {
    "pop": "B01003_001E", "kids": "B09001_001E", "kids_u3": "B09001_003E", "kids_3to5": "B09001_004E + B09001_005E", "kids_u6": "B09001_003E + B09001_004E + B09001_005E",
    "kids_6to17": "B09001_006E + B09001_007E + B09001_008E + B09001_009E", "kids_6to11": "B09001_006E + B09001_007E", "kids_12to17": "B09001_008E + B09001_009E",
    "hh": "B11005_001E", "hh_kids": "B11005_002E", "u19": "B27010_002E", "u19_employer": "B27010_004E", "u19_medicaid": "B27010_007E", "u19_uninsured": "B27010_017E",
    "kids_pov": "B17020_003E + B17020_004E + B17020_005E", "kids_pov_universe": "B17020_003E + B17020_004E + B17020_005E + B17020_011E + B17020_012E + B17020_013E",
    "mhi": "B19013_001E", "mfi_kids": "B19125_002E", "dis_u5": "B18101_004E + B18101_023E", "dis_u5_universe": "B18101_003E + B18101_022E", "dis_5to17": "B18101_007E + B18101_026E", "dis_5to17_universe": "B18101_006E + B18101_025E",
    "cog_5to17": "B18104_004E + B18104_020E", "cog_universe": "B18104_003E + B18104_019E", "hh_internet_universe": "B28002_001E", "hh_no_internet": "B28002_013E", "hh_vehicle_universe": "B08201_001E", "hh_no_vehicle": "B08201_002E",
    "commute_minutes": "B08013_001E", "commuters": "B08303_001E", "lep_universe": "C16002_001E", "lep_hh": "C16002_004E + C16002_007E + C16002_010E + C16002_013E", "u6_parent_universe": "B23008_002E", "u6_working_parents": "B23008_004E + B23008_010E + B23008_013E",
}
# Parts and their wholes, in the order in which they are tested.
PARTS = [
    ("kids", "pop"), ("kids_u6", "kids"), ("kids_6to17", "kids"), ("kids_6to11", "kids_6to17"), ("kids_12to17", "kids_6to17"), ("hh_kids", "hh"), ("u19_employer", "u19"), ("u19_medicaid", "u19"), ("u19_uninsured", "u19"),
    ("kids_pov", "kids_pov_universe"), ("dis_u5", "dis_u5_universe"), ("dis_5to17", "dis_5to17_universe"), ("cog_5to17", "cog_universe"), ("hh_no_internet", "hh_internet_universe"), ("hh_no_vehicle", "hh_vehicle_universe"), ("lep_hh", "lep_universe"), ("u6_working_parents", "u6_parent_universe"),
]
# A table's metrics, its universe, the count of children that it must be in proportion to, and the proportion's limits.
UNIVERSES = [
    (["u19", "u19_employer", "u19_medicaid", "u19_uninsured"], "u19", "kids", 0.85, 1.3),
    (["kids_pov", "kids_pov_universe"], "kids_pov_universe", "kids", 0.75, 1.1),
    (["dis_5to17", "dis_5to17_universe"], "dis_5to17_universe", "kids_6to17", 0.9, 1.3),
    (["cog_5to17", "cog_universe"], "cog_universe", "kids_6to17", 0.9, 1.3),
    (["u6_working_parents", "u6_parent_universe"], "u6_parent_universe", "kids_u6", 0.75, 1.1),
]
VARIABLES = sorted({v for text in METRICS.values() for v in text.split(" + ")})
# The program of a metric, by the part of its name before the point.
PROGRAMS = {
    "acs": "census-acs5", "saipe": "census-saipe", "sahie": "census-sahie", "cbp": "census-cbp", "tiger": "census-tiger", "hrsa": "hrsa-hpsa-mh",
    "lic": "state-childcare-licensing", "nppes": "cms-nppes-county", "osm": "osm-county",
}
# States whose names places end in.
STATES = ["missouri", "kansas", "colorado", "mo", "ks", "co"]


def derived(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and the 34 metrics. A variable below 0 stands for none, and a sum without one of its variables is null."""
    known = rows.select(*keep, *(F.when(F.col(v) >= 0, F.col(v).cast("double")).alias(v) for v in VARIABLES))
    return known.select(*keep, *(F.expr(text).alias(name) for name, text in METRICS.items()))


def checked(metrics: DataFrame) -> DataFrame:
    """The metrics without those that contradict each other, with `issues`, an array of what was found, in order."""
    out = cleanse.part_of_whole(metrics, PARTS)
    for columns, total, base, low, high in UNIVERSES:
        out = cleanse.universe_ratio(out, columns, total, base, low, high)
    off = [F.when(F.col(f"{total}_off"), F.lit(f"{total} out of proportion to {base}")) for _, total, base, _, _ in UNIVERSES]
    return out.withColumn("issues", F.concat("issues", F.array_compact(F.array(*off)))).drop(*(f"{total}_off" for _, total, *_ in UNIVERSES))


def missing_programs(rows: DataFrame, keys: list[str], uses: dict[str, list[str]]) -> DataFrame:
    """For each row and indicator, the distinct programs of its metrics, and those of which the row lacks a metric, both sorted.

    rows: keys, and `metrics`, a map of metric (as "cbp.hospitals") to value; absent and null alike are lacking. Nothing is shuffled.
    """
    of = lambda m: PROGRAMS[m.split(".")[0]]
    lacking = lambda ms: F.array_compact(F.array(*(F.when(F.try_element_at("metrics", F.lit(m)).isNull(), F.lit(of(m))) for m in ms)))
    use = lambda name, ms: F.struct(F.lit(name).alias("indicator"), F.array(*map(F.lit, sorted({*map(of, ms)}))).alias("programs"), F.array_sort(F.array_distinct(lacking(ms))).alias("missing"))
    return rows.select(*keys, F.explode(F.array(*(use(*x) for x in uses.items()))).alias("__use")).select(*keys, "__use.*")


def without_state(place: ColumnOrName) -> Column:
    """A place without the state at its end, so Kansas City keeps its name; commas and runs of spaces become a space."""
    bare = F.regexp_replace(F.trim(col(place)), rf"(?i)(?:,\s*|\s+)(?:{'|'.join(map(re.escape, STATES))})\.?\s*$", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ",+", " "), r"\s+", " "))


def age_text(years: ColumnOrName) -> Column:
    """0.12 as "6 wks", 2 as "2 yrs", 2.5 as "2.5 yrs"."""
    x = col(years).cast("double")
    weeks = F.greatest(F.lit(1), F.floor(x * 52 + 0.5).cast("int")).cast("string")
    whole = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))
    return F.when(x < 1, F.concat(weeks, F.lit(" wks"))).when(x >= 1, F.concat(whole, F.lit(" yrs")))


def value_text(x: ColumnOrName) -> Column:
    """Two decimals below 1, one below 100, whole numbers with separators from there; a dash for none."""
    v = col(x).cast("double")
    size = F.abs(v)
    return F.when(v.isNull(), F.lit("—")).when(size < 1, F.format_string("%.2f", v)).when(size < 100, F.format_string("%.1f", v)).otherwise(F.format_number(F.floor(v + 0.5), 0))
