"""A lookup that remembers for good: places of a city are fetched once, kept in a table, and served from there; a fixed list stands in
where nothing was found.

The table is a row of whole snapshots, each under a number of its own. Readers take the newest that was written to its end; a writer that
dies leaves one that nobody reads. Snapshots before the last two are deleted, so that a reader that has begun can end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.streaming.written import Batches

PLACES = "city string, name string, kind string, latitude double, longitude double"
#: Longest name of a place, and decimals by which two are one.
LONGEST_NAME, DECIMALS = 160, 4


def city_key(city: Column) -> Column:
    """Cities are one city whatever their case and the blanks around them."""
    return F.lower(F.trim(city))


class Lookup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.snapshots = Batches(spark, path, PLACES)

    def places(self) -> DataFrame:
        numbers = self.snapshots.numbers()
        return self.snapshots.read(numbers[-1]).drop("batch") if numbers else self.snapshots.read().drop("batch")

    def missing(self, cities: DataFrame) -> DataFrame:
        """The cities (city) that the table does not know, each once."""
        known = self.places().select(city_key(F.col("city")).alias("key")).distinct()
        asked = cities.where("city is not null").groupBy(city_key(F.col("city")).alias("key")).agg(F.min(F.trim("city")).alias("city"))
        return asked.join(known, "key", "left_anti").select("city")

    def learn(self, found: DataFrame) -> None:
        """Puts in what was found (city, name, kind, latitude, longitude, rank): all places of those cities are replaced. Of places of one city
        on one spot, the one of the lowest rank stays; names are cut; places without a name or a position are left out."""
        key, spot = city_key(F.col("city")).alias("key"), [F.round(c, DECIMALS).alias(f"{c}_at") for c in ("latitude", "longitude")]
        good = found.where("city is not null and trim(name) != '' and latitude is not null and longitude is not null")
        best = good.groupBy(key, *spot).agg(F.min(F.struct("rank", "name", "kind", "latitude", "longitude", "city")).alias("p"))
        fresh = best.select("key", F.trim("p.city").alias("city"), F.substring(F.trim("p.name"), 1, LONGEST_NAME).alias("name"), "p.kind", "p.latitude", "p.longitude")
        old = self.places().join(fresh.select("key").distinct(), city_key(F.col("city")) == F.col("key"), "left_anti")
        numbers = self.snapshots.numbers()
        number = numbers[-1] + 1 if numbers else 0
        self.snapshots.put(number, old.unionByName(fresh.drop("key")))
        for n in numbers[:-1]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.snapshots.path}/batch={n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def resolve(self, cities: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None = None, fallback: DataFrame | None = None, refresh: bool = False) -> DataFrame:
        """(city, source, name, kind, latitude, longitude): a row for each place of each city asked, by name; cities without any have one row with nulls.

        source is `cache`; `fetched` for cities that fetch(missing cities) told of just now, which are kept; else `fallback`: the rows of
        the list (prefix, name, kind, latitude, longitude) whose prefix the city begins with. refresh fetches all cities anew, and
        keeps what was known of those that nothing is found of.
        """
        asked = cities.where("city is not null").groupBy(city_key(F.col("city")).alias("key")).agg(F.min(F.trim("city")).alias("city"))
        told = None
        if fetch is not None:
            wanted = asked.select("city") if refresh else self.missing(cities)
            before = set(self.snapshots.numbers())
            found = fetch(wanted)
            if found.limit(1).count():
                self.learn(found)
            if set(self.snapshots.numbers()) != before:
                told = wanted.select(city_key(F.col("city")).alias("key"))
        known = self.places().select(city_key(F.col("city")).alias("key"), "name", "kind", "latitude", "longitude")
        served = asked.join(known, "key")
        source = F.lit("cache")
        if told is not None:
            served = served.join(told.withColumn("new_", F.lit(True)), "key", "left")
            source = F.when(F.col("new_"), "fetched").otherwise("cache")
        out = served.select("key", "city", source.alias("source"), "name", "kind", "latitude", "longitude")
        rest = asked.join(out.select("key").distinct(), "key", "left_anti")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("kind", "string"), ("latitude", "double"), ("longitude", "double"))]
        if fallback is None:
            return out.unionByName(rest.select("key", "city", F.lit("fallback").alias("source"), *none)).drop("key")
        own = rest.join(F.broadcast(fallback), F.col("key").startswith(F.lower("prefix")), "left")  # a fixed list of a few places
        return out.unionByName(own.select("key", "city", F.lit("fallback").alias("source"), "name", "kind", "latitude", "longitude")).drop("key")
