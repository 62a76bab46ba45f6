"""Places to coordinates: a location is looked up under ever shorter keys, and the first that is known counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import clean

#: Locations that are no places.
NO_PLACES = ("online", "virtual", "remote", "tba", "hybrid", "")


def lookup_keys(location: Column, country: str = "india") -> Column:
    """Keys in the order they are tried: the location, with the country where it names none, and then without its
    first part, its first two, and so on ("hall 4, campus, pune" leads to "campus, pune" and "pune")."""
    x = F.lower(clean(location))
    parts = F.transform(F.split(x, ","), lambda p: F.trim(p))
    shorter = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, k, F.greatest(F.size(parts) - k + 1, F.lit(0))), ", "))
    own = F.array_join(parts, ", ")
    named = F.when(~x.contains(country) & ~x.contains(","), F.array(F.concat(own, F.lit(f", {country}"))))
    keys = F.concat(F.array(own), F.coalesce(named, F.array().cast("array<string>")), F.filter(shorter, lambda k: k != ""))
    return F.when(x.isNotNull() & ~x.isin(*NO_PLACES), F.array_distinct(keys))


def geocoded(rows: DataFrame, gazetteer: DataFrame, id_col: str = "id", location_col: str = "location", country: str = "india") -> DataFrame:
    """rows with lat, lng and place (the key that was found), null where none is known. One join of distinct
    locations: a location that a third of all rows name is looked up once. gazetteer: place, lat, lng; of repeated places the least counts."""
    known = gazetteer.select(F.lower(F.trim("place")).alias("key"), F.struct("lat", "lng").alias("at")).groupBy("key").agg(F.min("at").alias("at"))
    asked = rows.select(F.col(location_col).alias("_asked")).distinct().select("_asked", F.posexplode(lookup_keys(F.col("_asked"), country)).alias("n", "key"))
    found = asked.join(known, "key").groupBy("_asked").agg(F.min(F.struct("n", "key", "at")).alias("f")).select("_asked", F.col("f.at.lat").alias("lat"), F.col("f.at.lng").alias("lng"), F.col("f.key").alias("place"))
    return rows.join(found, rows[location_col] == found["_asked"], "left").drop("_asked")
