"""Is a record in the locality that was asked for: by its words, else by its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milap.functions.text import js_round, locality_string
from milap.operators.slabs import haversine_km

#: Words beside which a locality's name is a street's (fixed values).
ROAD = "marg|marga|mg|road|rd|street|st|sadak|path|lane"


def street_name_only(said: Column, name: Column) -> Column:
    """Does the name occur, and each time directly before a word for a street. Both in lower case with single spaces."""
    all_ = F.regexp_count(said, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))
    roads = F.regexp_count(said, F.concat(F.lit(r"\b\Q"), name, F.lit(rf"\E\s+({ROAD})\b")))
    return (all_ > 0) & (all_ == roads)


def requested_status(rows: DataFrame, localities: DataFrame, *, id_col: str, title: str, address: str, requested: str, lat: str, lng: str) -> DataFrame:
    """``(id, status, reason)``: inside, outside or ambiguous.

    The locality asked for is the one whose name, else whose alias, the request contains (the smaller id of several). The words of title and address decide first: its name, then its aliases (inside), then the
    names of other localities (outside); names that stand for streets don't count. Then the position: within its radius or not, in hundredths of a km. Ambiguous is what nothing decides, and a request
    for no known locality. Localities are a registry of names: they are met by the words of a text, never each with each row.
    """
    regs = localities.where("locality_id is not null").select("locality_id", F.lower("canonical_name").alias("loc_name"), F.col("centroid.lat").alias("c_lat"), F.col("centroid.lng").alias("c_lng"), "max_radius_km", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), locality_string).alias("aliases"))
    said = locality_string(F.concat_ws(" ", title, address))
    base = rows.select(F.col(id_col).alias("id"), said.alias("said"), locality_string(F.col(requested)).alias("asked"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) > 2))).alias("loc_name")
    asked = base.select("asked").distinct().select("asked", words(F.col("asked"))).join(regs, "loc_name").groupBy("asked").agg(F.min_by(F.struct("locality_id", "loc_name", "c_lat", "c_lng", "max_radius_km", "aliases"), "locality_id").alias("r"))
    # other localities named in the text
    named = base.select("id", "asked", "said", words(F.col("said"))).join(regs.select("loc_name", F.col("locality_id").alias("other")), "loc_name").where(~street_name_only(F.col("said"), F.col("loc_name")))
    other = named.join(asked.select("asked", F.col("r.locality_id").alias("mine")), "asked").where("other <> mine").groupBy("id").agg(F.min("other").alias("other"))
    full = base.join(asked, "asked", "left").join(other, "id", "left")
    by_name = F.contains("said", "r.loc_name") & ~street_name_only(F.col("said"), F.col("r.loc_name"))
    by_alias = F.exists("r.aliases", lambda a: (a != "") & F.contains(F.col("said"), a) & ~street_name_only(F.col("said"), a))
    km = js_round(haversine_km(F.col("r.c_lat"), F.col("r.c_lng"), F.col("lat"), F.col("lng")), 2)
    out = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    verdict = (
        F.when(F.col("r").isNull(), out("ambiguous", "unknown locality"))
        .when(by_name, out("inside", "name"))
        .when(by_alias, out("inside", "alias"))
        .when(F.col("other").isNotNull(), out("outside", "other locality"))
        .when(km.isNull(), out("ambiguous", "no position"))
        .when(km <= F.col("r.max_radius_km"), out("inside", "position"))
        .otherwise(out("outside", "position"))
    )
    return full.select("id", verdict.alias("v")).select("id", "v.status", "v.reason")


def clamped_radius(x: Column) -> Column:
    """A geocoded radius with a quarter's margin, between 2 and 8 km, in tenths."""
    return js_round(F.least(F.greatest(x * 1.25, F.lit(2.0)), F.lit(8.0)), 1)


def box_radius(lat: Column, lng: Column, south: Column, north: Column, west: Column, east: Column, missing: float = 2.5) -> Column:
    """Km from the centre to the farthest corner of a bounding box; ``missing`` if any is null."""
    corners = [haversine_km(lat, lng, y, x) for y in (south, north) for x in (west, east)]
    whole = lat.isNotNull() & lng.isNotNull() & south.isNotNull() & north.isNotNull() & west.isNotNull() & east.isNotNull()
    return F.when(whole, F.greatest(*corners)).otherwise(missing)
