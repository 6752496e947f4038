"""Structured Streaming: listings and run logs that arrive as files, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import is_long
from ..operators import ingest as I
from ..operators.ingest import gate
from ..operators.storage import discard, kept, scratch, short_methods

EVENT_SCHEMA = (
    "id long, source_id long, name string, date_start date, venue_id long, date_end date, discipline string, event_type string, spectator boolean, hidden boolean, "
    "description string, classes string, tags string, raw_extract string, venue_match_type string, url string, first_seen_at timestamp, last_seen_at timestamp"
)
VENUE_SCHEMA = "id long, name string, postcode string, latitude double, longitude double, source string"
RUN_SCHEMA = "source_id long, competitions long, others long, exact long, alias long, postcode long, new long, inserted long"
#: Tables of the ingest: columns, and those that they are partitioned by.
LAYOUT = {
    "events": (EVENT_SCHEMA, "first_batch int, month string"), "changes": (f"{EVENT_SCHEMA}, first_batch int", "batch int, month string"),
    "venues": (VENUE_SCHEMA, "batch int"), "runs": (RUN_SCHEMA, "batch int"), "marks": ("largest long", "batch int"),
}


#: Rows of a landed file and of a task that tags listings, as a rule.
LANDED, TAGGED = 50_000, 10_000


def landed(rows: DataFrame, path: str, batches: int | None = None, form: str = "parquet", most: int | None = None) -> int:
    """Adds files of rows (`most` in one, as a rule) to a folder, in number as the rows ask for, and tells how many of
    them make one of so many batches: a batch of any size is written and read by many tasks. Where all are one batch,
    however many files it has, rows are written where they are, without a shuffle."""
    each = max(1, -(-rows.count() // ((most or LANDED) * (batches or 1))))
    dealt = rows.repartition(each * batches) if batches else rows
    dealt.write.mode("append").format(form).option("maxRecordsPerFile", 0 if batches else most or LANDED).save(path)
    return each


class Rolling:
    """A rolling state as a log of changes: each batch writes the new values of the keys that it changed, and nothing
    else, under its number; the state is the last value of each key. Values are whole, not increments, and a batch that
    runs again replaces what it wrote, so the table is the same. compacted() writes the state anew, as one batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema
        self.log(spark.createDataFrame([], schema), -1)

    def log(self, changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        changes = self.spark.read.schema(f"{self.schema}, batch long").parquet(self.path)
        values = [c for c in changes.columns if c not in (*self.keys, "batch")]
        return changes.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*self.keys, "v.*")

    def compacted(self, path: str) -> Rolling:
        """A state at another path that holds what this one does, with its first batch only."""
        out = Rolling(self.spark, path, self.keys, self.schema)
        out.log(self.read(), -1)
        return out


def rolling_ingest(extracted: DataFrame, files: int = 4) -> DataFrame:
    """name, date_start, first_seq, deliveries: the rows are written as files and read as a stream in so many batches,
    gated, and aggregated by key in the stream's state store, which writes what changes; each batch logs the keys
    that it changed (Rolling), of which the latest values are returned."""
    spark = extracted.sparkSession
    landing, offsets = scratch(spark, "landing"), scratch(spark, "offsets")
    each = landed(extracted, landing, files)
    state = Rolling(spark, scratch(spark, "state"), ["name", "date_start"], "name string, date_start date, first_seq long, deliveries long")
    stream = spark.readStream.schema(extracted.schema).option("maxFilesPerTrigger", each).parquet(landing)
    counted = gate(stream).groupBy("name", "date_start").agg(F.min("batch_seq").alias("first_seq"), F.count("*").alias("deliveries"))
    query = counted.writeStream.outputMode("update").foreachBatch(state.log).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    query.awaitTermination()
    discard(spark, landing, offsets)
    return state.read()


class Listings:
    """The tables that the ingest keeps under one folder: events as they came first, by batch and month of their start;
    changes, the later values of events, by the batch that hit them and month; venues that were made for unknown names,
    counters of runs, and the largest id, each by batch.

    A batch reads only the months that it has rows of and writes what it brings or changes, nothing else, so its work
    follows its own size; an event is its last change, or else as it came. A batch starts from the venues and the
    largest id of the batches before it. If it runs again after a failure, rows that it had stored already are
    found and refreshed; it counts as inserted what no batch before it had; and its events, changes, venues, counters and
    largest id replace those of its first try, so nothing is taken twice.
    """

    def __init__(self, spark: SparkSession, base: str, venues: DataFrame, aliases: DataFrame, postcodes: DataFrame | None = None):
        self.spark, self.base, self.aliases, self.postcodes = spark, base, aliases, postcodes
        self.known = venues.select("id", "name", "postcode", *[(F.col(c) if c in venues.columns else F.lit(None)).cast(k).alias(c) for c, k in (("latitude", "double"), ("longitude", "double"), ("source", "string"))])

        for name, (schema, _) in LAYOUT.items():
            spark.createDataFrame([], f"{schema}, {LAYOUT[name][1]}").write.mode("append").partitionBy(*self.parts(name)).parquet(f"{base}/{name}")

    @staticmethod
    def parts(name: str) -> list[str]:
        return [x.split()[0] for x in LAYOUT[name][1].split(", ")]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(", ".join(LAYOUT[name])).parquet(f"{self.base}/{name}")

    def events(self) -> DataFrame:
        first, changes = self.read("events"), self.read("changes")
        last = changes.groupBy("id").agg(F.max("batch").alias("batch"))
        return first.join(last.select("id"), "id", "left_anti").unionByName(changes.join(last, ["id", "batch"], "left_semi").drop("batch"))

    def venues(self, before: int | None = None) -> DataFrame:
        made = self.read("venues")
        return self.known.unionByName((made if before is None else made.where(F.col("batch") < before)).drop("batch"))

    def runs(self) -> DataFrame:
        return self.read("runs")

    def put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts(name)).parquet(f"{self.base}/{name}")

    def merge(self, batch: DataFrame, number: int, seen_at: Column | None = None) -> None:
        """One batch of extracted rows: validated, normalised, resolved against the venues, with venues made for names
        that no one knows, classified and tagged, counted, and upserted."""
        steps: list[str] = []
        try:
            with short_methods(self.spark):
                self.store(self.ready(batch, number, steps), number, seen_at, steps)
        finally:
            discard(self.spark, *steps)

    def ready(self, batch: DataFrame, number: int, steps: list[str]) -> tuple[DataFrame, DataFrame]:
        """The batch's rows with their venues, without the columns that their listings have, and the different listings,
        classified and tagged. Places and listings repeat, so each different one is worked on once."""
        rows, venues = gate(batch).withColumn("place", F.struct("venue_name", "venue_postcode")), self.venues(number)
        found = kept(self.spark, I.matched(kept(self.spark, I.places(rows), "places", steps), venues, self.aliases), "found", steps)
        made = kept(self.spark, I.new_venues(found.where("venue_id IS NULL"), venues), "made", steps)
        blank = made.select("id", "name", "postcode", F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
        if self.postcodes is not None:
            told = made.select(F.col("id").alias("venue_id"), "batch_seq", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.col("postcode").alias("row_postcode"))
            blank = I.resolve_coordinates(blank, told, self.postcodes)
        self.put(blank.withColumns({"source": F.lit("dynamic"), "batch": F.lit(number)}), "venues")

        known = kept(self.spark, I.with_new_venues(found, made).select("place", "venue_name", "venue_id", "venue_match_type"), "known", steps)
        placed = rows.drop("venue_name").join(known, "place")
        own = ["batch_seq", "source_id", "date_start", "date_end", "url", "venue_id", "venue_postcode", "venue_match_type"]
        placed = kept(self.spark, placed.select(*own, I.listing(placed).alias("listing")), "placed", steps)
        different = kept(self.spark, placed.select("listing").distinct(), "different", steps)
        dealt = different.repartition(max(1, -(-different.count() // TAGGED))).select("listing", "listing.*")
        listings = kept(self.spark, I.classified(dealt).withColumn("listing_id", F.monotonically_increasing_id()), "listings", steps)
        told = placed.join(listings.select("listing", "listing_id", "event_type", "booking"), "listing")
        hidden = is_long(F.col("date_start"), F.col("date_end")) | F.col("booking")
        return kept(self.spark, told.select(*own, F.col("listing.name").alias("name"), hidden.alias("hidden"), "event_type", "listing_id"), "ready", steps), listings

    def store(self, ready: tuple[DataFrame, DataFrame], number: int, seen_at: Column | None, steps: list[str]) -> None:
        """Counts the run, and writes the events that the batch brings and those that it changes."""
        rows, listings = ready
        listings = listings.select("listing_id", "discipline", "event_type", "spectator", "tags", "class_list", *[F.col(f"listing.{c}").alias(c) for c in ("description", "classes", "feed_affiliation")])
        month = F.date_format("date_start", "yyyy-MM")
        months = [r[0] for r in rows.select(month).distinct().collect()]  # bounded by the calendar
        stored = self.read("events").where(F.col("month").isin(months))
        earlier, own = stored.where(F.coalesce(F.col("first_batch") < number, F.lit(True))), stored.where(F.col("first_batch") == number)
        self.put(I.run_counters(rows, earlier).withColumn("batch", F.lit(number)), "runs")
        # the largest id of the batches before, and of what a first try of this one has stored
        marked = self.read("marks").where(F.col("batch") < number).agg(F.coalesce(F.max("largest"), F.lit(0))).first()[0]
        largest = max(marked, own.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        seen = F.timestamp_micros(F.lit(self.spark.range(1).select(F.unix_micros(F.current_timestamp() if seen_at is None else seen_at)).first()[0]))

        def whole(news: DataFrame) -> DataFrame:
            extract = I.raw_extract(F.col("description"), F.col("class_list"), F.col("feed_affiliation"), F.col("venue_postcode"))
            return news.join(listings, "listing_id").withColumn("raw_extract", extract)

        news = kept(self.spark, I.changes(stored, rows, ["listing_id", "hidden", "venue_postcode", "venue_match_type"]), "news", steps)
        hits = kept(self.spark, whole(news.where("t_id IS NOT NULL")), "hits", steps)
        hit = I.refreshed_rows(self.events().where(F.col("month").isin(months)), hits, I.REFRESHED, seen, "inner")
        fresh = whole(I.new_rows(news, largest, seen, {"first_batch": F.lit(number), "month": month})).select(*stored.columns)
        later = hit
        tried = self.read("changes").where((F.col("batch") == number) & F.col("month").isin(months)).drop("batch")
        if not (own.isEmpty() and tried.isEmpty()):
            # what a first try wrote is replaced, so it is read before: events that it brought, changes that it made
            mine, others = F.col("first_batch") == number, F.coalesce(F.col("first_batch") != number, F.lit(True))
            ids = hits.select(F.col("t_id").alias("id"))
            before = kept(self.spark, hit.where(mine).unionByName(own.join(ids, "id", "left_anti")), "before", steps)
            later = kept(self.spark, hit.where(others).unionByName(tried.join(ids, "id", "left_anti")), "later", steps)
            fresh = kept(self.spark, fresh, "fresh", steps).unionByName(before)
        count = news.where("t_id IS NULL").count()
        self.put(self.spark.createDataFrame([(largest + count, number)], "largest long, batch int"), "marks")
        # a month in as few files as its size asks for, not one for each task
        self.put(later.withColumn("batch", F.lit(number)).hint("rebalance", "month"), "changes")
        self.put(fresh.hint("rebalance", "month"), "events")


def stream_upsert(extracted: DataFrame, venues: DataFrame, aliases: DataFrame, postcodes: DataFrame | None = None, files: int = 4, base: str | None = None) -> Listings:
    """The tables after extracted rows have arrived in so many deliveries, each of whole sources and a batch of its own,
    as Listings. A delivery is as many files as its rows ask for; the stream goes on from its offsets with each."""
    spark = extracted.sparkSession
    landing, offsets = scratch(spark, "landing"), scratch(spark, "offsets")
    tables = Listings(spark, base or scratch(spark, "listings"), venues, aliases, postcodes)
    with short_methods(spark):
        for k in range(files):
            landed(extracted.where(F.pmod(F.hash("source_id"), F.lit(files)) == k), landing)
            stream = spark.readStream.schema(extracted.schema).parquet(landing)
            stream.writeStream.foreachBatch(tables.merge).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    discard(spark, landing, offsets)
    return tables


def run_log(scans: DataFrame, files: int = 3) -> DataFrame:
    """The run log after runs have been appended as they complete (file sink of a stream)."""
    spark = scans.sparkSession
    landing, log, offsets = (scratch(spark, x) for x in ("runs", "log", "offsets"))
    each = landed(scans, landing, files)
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", each).parquet(landing)
    query = stream.writeStream.format("parquet").option("path", log).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    query.awaitTermination()
    discard(spark, landing, offsets)
    return spark.read.schema(scans.schema).parquet(log)
