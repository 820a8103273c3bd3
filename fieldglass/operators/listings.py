"""Boards, rosters, routes and published listings: which rows answer a request, which may be scored, and what they show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import ColumnOrName, clamp, col, half_up

# Miles in a degree of latitude, and of longitude at the equator.
MILES_LAT, MILES_LON = 69.0, 69.172
# Words that name no organisation in particular.
GENERIC = ["the", "and", "of", "a", "aba", "therapy", "therapies", "behavior", "behavioral", "autism", "services", "center", "centers", "clinic", "clinics", "health", "care", "child", "children"]
# The roster that applies to a state and an engine.
ROUTES = [("MO", "client", "missouriChildCare"), ("KS", "client", "kansasEarlyIntervention"), ("CO", "client", "coloradoChildCare")]
# Clues that can document capacity.
CAPACITY = r"^(service-capacity|clinic-market-movement|school-service-access)\."


def bounds(lat: ColumnOrName, lon: ColumnOrName, miles: ColumnOrName | float) -> Column:
    """west, south, east and north of a box that holds the circle; towards the poles its width grows no further."""
    r = F.lit(miles) if isinstance(miles, int | float) else col(miles)
    up, side = r / MILES_LAT, r / (MILES_LON * F.greatest(F.lit(0.2), F.cos(F.radians(col(lat)))))
    return F.struct((col(lon) - side).alias("west"), (col(lat) - up).alias("south"), (col(lon) + side).alias("east"), (col(lat) + up).alias("north"))


def circle(lat: ColumnOrName, lon: ColumnOrName, miles: float, steps: int = 72) -> Column:
    """The circle's rim as steps + 1 points, the first again at the end."""
    angle = lambda i: i / F.lit(float(steps)) * 2 * F.pi()
    width = F.lit(float(miles)) / (MILES_LON * F.cos(F.radians(col(lat))))
    point = lambda i: F.struct((col(lon) + width * F.cos(angle(i))).alias("lon"), (col(lat) + F.lit(miles / MILES_LAT) * F.sin(angle(i))).alias("lat"))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)


def board_search(rows: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Rows whose fields, joined by spaces (arrays too, nulls and blanks not), hold the text; case and the amount of spaces don't count. No text: all rows."""
    wanted = " ".join(text.lower().split())
    if not wanted:
        return rows
    arrays = {f.name for f in rows.schema if f.dataType.typeName() == "array"}
    part = lambda c: F.array_join(c, " ") if c in arrays else F.nullif(F.col(c).cast("string"), F.lit(""))
    return rows.where(F.contains(F.regexp_replace(F.lower(F.concat_ws(" ", *(part(c) for c in fields))), r"\s+", " "), F.lit(wanted)))


def evidence_floor(coverage: ColumnOrName, observed: ColumnOrName, score: ColumnOrName, label: ColumnOrName, least: int = 12) -> tuple[Column, Column]:
    """A stored run's score and label; 0 and "Insufficient Evidence" where coverage or observations are below the least or unknown."""
    ok = (col(coverage) >= least) & (col(observed) >= least)
    return F.when(ok, col(score)).otherwise(F.lit(0)), F.when(ok, col(label)).otherwise(F.lit("Insufficient Evidence"))


def roster_for(programs: DataFrame, name: str, location: str, state: tuple[str, ...] = ("kansas", "ks")) -> DataFrame:
    """Programs for a place: all for the whole state, those named after the county for a county, none for any other place."""
    place = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.lit(location))), r"[.,]", " "), r"\s+", " ")
    county = F.trim(F.regexp_extract(place, r"\b([a-z][a-z '-]*?)\s+county\b", 1))
    return programs.where(place.isin("", *state) | ((county != "") & F.contains(F.lower(F.col(name)), F.concat(county, F.lit(" county")))))


def listing_density(rows: DataFrame, by: list[str], archived: str, people: str, per: float = 10000) -> DataFrame:
    """Listings of each source, and their density (for so many people) and its score only where none of them comes from an archived snapshot. A density of 20 and more scores 100, that of no known people 0."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("listings"), F.coalesce(F.bool_or(archived), F.lit(False)).alias("snapshot"), F.max(people).alias("people"))
    out = out.withColumn("density", F.when(~F.col("snapshot") & (F.col("people") > 0), F.col("listings") / F.col("people") * F.lit(float(per))))
    return out.withColumn("score", F.when(~F.col("snapshot"), F.coalesce(clamp(half_up(F.col("density") / F.lit(20.0) * 100)), F.lit(0))).cast("long"))


def routed(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows with the roster of their state and engine; rows without one go. The three routes are a literal, so their join is by broadcast."""
    routes = spark.createDataFrame(ROUTES, "state string, engine string, roster string")
    return rows.join(F.broadcast(routes), ["state", "engine"])


def demand_status(clues: DataFrame, by: list[str]) -> DataFrame:
    """Whether corroborated clues on capacity, by two publishers or more, document an area's demand.

    clues: by, indicator, corroborated and publishers (array). Every area of the clues has a row.
    """
    counts = F.col("corroborated") & F.col("indicator").rlike(CAPACITY)
    rows = clues.select(*by, F.explode_outer(F.when(counts, F.col("publishers"))).alias("publisher"))
    out = rows.groupBy(*by).agg(F.count_distinct(F.nullif("publisher", F.lit(""))).alias("publishers"))
    return out.withColumn("status", F.when(F.col("publishers") >= 2, "documented_public_capacity_signal").otherwise("unverified"))


def plain_name(x: ColumnOrName) -> Column:
    """Lower case, with one space for all that is neither a-z nor a digit. Letters with marks count as neither."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def review_name(x: ColumnOrName) -> Column:
    """plain_name without the site's own ending of a title."""
    return plain_name(F.regexp_replace(F.lower(col(x)), r"\s*[|–—-]\s*(?:reviews?|ratings?|yelp|google maps).*", ""))


def review_belongs(title: ColumnOrName, name: ColumnOrName) -> Column:
    """A title that holds the organisation's name, or each of its two or more distinctive words."""
    n, t = review_name(name), review_name(title)
    words = F.filter(F.split(n, " "), lambda w: (F.length(w) > 2) & ~w.isin(GENERIC))
    every = (F.size(words) >= 2) & (F.size(F.array_except(words, F.split(t, " "))) == 0)
    return F.coalesce((F.size(words) > 0) & (F.length(n) >= 8) & (F.contains(t, n) | every), F.lit(False))


def named(name: ColumnOrName) -> Column:
    """A name of ten characters and two words or more."""
    n = plain_name(name)
    return (F.length(n) >= 10) & F.contains(n, F.lit(" "))


def mentions(name: ColumnOrName, *texts: ColumnOrName) -> Column:
    """A named business that one of the texts holds by its whole name."""
    hits = reduce(Column.__or__, (F.coalesce(F.contains(plain_name(t), plain_name(name)), F.lit(False)) for t in texts))
    return F.coalesce(named(name), F.lit(False)) & hits


def first_named(rows: DataFrame, by: list[str], name: str, rank: str, most: int = 3) -> DataFrame:
    """The first candidates of each group by rank, one for each name; `most` is the report's length, 0 to 5."""
    order = [F.col(rank), F.col("plain")]
    one = rows.where(named(name)).groupBy(*by, plain_name(name).alias("plain")).agg(F.min(rank).alias(rank))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= max(0, min(5, most)))
