"""Stored tables as append-only Parquet under one root, in folders by generation and platform.

Listings lie in hash buckets of their key below that, so an insert looks only into the buckets its batch touches. Scores and events lie in epochs: ``compact`` folds what
there is into one row per listing or application and begins the next epoch, and reads take these rows and the epochs from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.stages import job_status
from ..functions.text import blank_to_null
from ..operators.dedup import first_wins
from ..operators.lifecycle import latest_rows, merged_state, partial_state, state_values
from ..operators.normalize import normalize_listings, stored_form
from ..operators.ordering import with_position
from ..operators.purge import DEPRECATED_PLATFORMS
from ..schemas import EVENTS, LISTINGS, SCORES
from ..session import materialise, read_or_empty
from .layout import Layout, log_rows, read_layout

ARRIVAL = "arrival"
TABLES = {"listings": LISTINGS, "scores": SCORES, "events": EVENTS}
FOLDERS = {"listings": ["gen", "platform_key", "bucket"], "scores": ["gen", "epoch", "platform_key"], "events": ["gen", "epoch", "platform_key"]}
KEYS = ["platform_key", "job_id_on_platform"]
SCORE_VALUES = ["match_score", "match_reasoning", "evaluation_details"]
SCORE_ORDER = ["scored_at", "call", "ordinal"]
BUCKETS = 4
LEGACY = "v000000"    # files of a store without folders


def single_requests(rows: DataFrame, keys: list[str], order: str) -> None:
    """Raise unless every key occurs once, as nothing tells which of several rows comes first."""
    if not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"several rows for one {', '.join(keys)}: a column {order!r} must tell their order")


def counted(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """A written table, and metrics taken while it was written; a task that is run again may only make a count too high."""
    seen = Observation()
    return materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), *metrics), name), seen.get


class ListingStore:
    """``buckets`` is fixed by the first write; about a million listings to a bucket and platform keep an insert's reads small."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- versions --------------------------------------------------------------------------

    def layout(self) -> Layout:
        found = read_layout(self.spark, self.root)
        found.buckets = found.buckets or self.buckets
        return found

    def snapshot(self) -> tuple[int, str]:
        """Number of the current version, and the root its files are under."""
        return self.layout().version, self.root

    def rows(self, table: str, layout: Layout | None = None) -> DataFrame:
        """Visible rows with the columns of their folders; columns missing from older files read as null."""
        layout, schema = layout or self.layout(), TABLES[table]
        parts = [T.StructField(c, T.IntegerType()) for c in FOLDERS[table] if c != "platform_key"]
        full = T.StructType([*schema.fields, *parts])
        found = read_or_empty(self.spark, f"{self.root}/{table}", full).select(*full.fieldNames())
        older = read_or_empty(self.spark, f"{self.root}/{LEGACY}/{table}", schema)
        if older.inputFiles():
            own = {"gen": F.lit(0), "epoch": F.lit(0), "bucket": self._bucket(layout) if table == "listings" else F.lit(0)}
            found = found.unionByName(older.withColumns({p.name: own[p.name].cast("int") for p in parts}).select(*full.fieldNames()))
        return found.where(layout.visible())

    def read(self, table: str, layout: Layout | None = None) -> DataFrame:
        found = self.rows(table, layout)
        if table == "scores":
            found = found.where(F.col("epoch") >= (layout or self.layout()).values.get("epoch", 0))
        return found.select(*TABLES[table].fieldNames())

    def _bucket(self, layout: Layout) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(layout.buckets)).cast("int")

    def append(self, table: str, rows: DataFrame, folder: str | None = None, layout: Layout | None = None) -> None:
        """Add rows to a table, or, of a given folder, to files that no read finds."""
        schema = TABLES[table]
        shaped = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields])
        if folder is not None:
            return shaped.write.mode("append").parquet(f"{self.root}/{folder}/{table}")
        layout = layout or self.layout()
        shaped = shaped.withColumn("gen", F.lit(layout.version))
        if table == "listings":
            # One file for a folder, but as many as its size asks for.
            inner = KEYS
            shaped = shaped.withColumn("bucket", self._bucket(layout)).hint("rebalance", "platform_key", "bucket")
        else:
            inner = ["application_id", "created_at"] if table == "events" else ["job_id"]
            shaped = shaped.withColumn("epoch", F.lit(layout.values.get("epoch", 0)).cast("int"))
        # Sorted within each file, so that a look-up of one key skips row groups.
        writer = shaped.sortWithinPartitions(*FOLDERS[table], *inner).write.mode("append").partitionBy(*FOLDERS[table])
        for key in ("application_id",) if table == "events" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self.root}/{table}")

    def reset(self) -> None:
        """No rows from here on; ids start at 1 again."""
        log_rows(self.spark, self.root, self.layout().version + 1, ("reset", None, None))

    # -- listings --------------------------------------------------------------------------

    def upsert_listings(self, batch: DataFrame, now: Column, order: list[str] | None = None) -> DataFrame:
        """Insert what is not there yet; return ``id, platform_key, job_id_on_platform, is_new``.

        Of several arrivals with one key the first counts. ``order`` names the columns that tell the order of arrival, by default
        ``arrival``; a batch without them must not repeat a key. A stored listing is left as it is. Doing the same batch twice changes nothing.
        """
        order = order or ([ARRIVAL] if ARRIVAL in batch.columns else [])
        layout = self.layout()
        normal = normalize_listings(batch)
        unique = stored_form(first_wins(normal, order) if order else normal)
        unique, seen = counted(unique.drop("id").withColumn("bucket", self._bucket(layout)), "batch",
                               F.collect_set("platform_key").alias("platforms"), F.collect_set("bucket").alias("buckets"))
        if not order:
            single_requests(unique, KEYS, ARRIVAL)
        stored = self.stored_keys(seen["platforms"], seen["buckets"], layout)
        # The batch's keys are sent to the stored ones if they are the smaller side, which is then never shuffled.
        known, found = counted(stored.join(unique.select(*KEYS), KEYS).select("id", *KEYS), "known")
        fresh = unique.join(known.select(*KEYS), KEYS, "left_anti")
        last = layout.values.get("listings")
        if last is None:
            last = self.rows("listings", layout).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # Only the keys are sorted to get their numbers; the listings themselves are joined to them.
        numbered = with_position(fresh.select(*KEYS), KEYS).select((F.col("pos") + 1 + F.lit(last)).alias("id"), *KEYS)
        if seen["n"] > found["n"]:
            # Ids are taken before they are used: a run that fails leaves a gap, never two listings with one id.
            log_rows(self.spark, self.root, layout.version, ("listings", None, last + seen["n"] - found["n"]), ("buckets", None, layout.buckets))
            self.append("listings", fresh.drop("bucket").join(numbered, KEYS).withColumns({"scraped_at": now, "created_at": now}), layout=layout)
        return known.withColumn("is_new", F.lit(False)).unionByName(numbered.withColumn("is_new", F.lit(True)))

    def stored_keys(self, platforms: list[str], buckets: list[int], layout: Layout | None = None) -> DataFrame:
        """(id, keys) of the stored listings in the folders of these platforms and buckets; no list is longer than the store has folders or the batch platforms."""
        stored = self.rows("listings", layout)
        return stored.where(F.col("bucket").isin(sorted(buckets)) & F.col("platform_key").isin(sorted(platforms))).select("id", *KEYS)

    def platforms_of(self, jobs: DataFrame) -> DataFrame:
        """``jobs`` with the platform_key of their job_id, null where there is no such listing."""
        wanted = jobs.select("job_id").distinct()
        found = self.read("listings").select(F.col("id").alias("job_id"), "platform_key").join(wanted, "job_id")
        return jobs.drop("platform_key").join(found, "job_id", "left")

    def apply_scores(self, scores: DataFrame, now: Column) -> None:
        """``job_id, match_score[, match_reasoning][, evaluation_details][, ordinal]``; the latest one counts.

        Calls follow each other, and scores of one call their ordinal; without it, a job has one score in a call. Details may be text, a struct or a
        JSON object; without a reasoning, their ``reasoning`` is it, else the details as a whole.
        """
        names = scores.columns
        details = next((F.col(c) for c in ("evaluation_details", "match_reasoning") if c in names), F.lit(None).cast("string"))
        if "evaluation_details" in names and scores.schema["evaluation_details"].dataType.typeName() in ("struct", "map"):
            details = F.to_json(details)
        told = blank_to_null(F.get_json_object(details, "$.reasoning"))
        given = F.col("match_reasoning") if "match_reasoning" in names else F.lit(None).cast("string")
        if "ordinal" not in names:
            single_requests(scores, ["job_id"], "ordinal")
        ordinal = F.col("ordinal").cast("long") if "ordinal" in names else F.lit(0).cast("long")
        layout = self.layout()
        call = layout.values.get("scores", 0) + 1
        log_rows(self.spark, self.root, layout.version, ("scores", None, call))
        kept = scores if "platform_key" in names else self.platforms_of(scores)
        self.append("scores", kept.select("job_id", "match_score", F.coalesce(given, told, details).alias("match_reasoning"),
                                          details.alias("evaluation_details"), ordinal.alias("ordinal"), "platform_key").withColumns(
            {"scored_at": now, "call": F.lit(call)}), layout=layout)

    def state(self, layout: Layout | None = None) -> DataFrame:
        """Merged state of every application: that of the last compaction and the events since."""
        layout = layout or self.layout()
        epoch = layout.values.get("epoch", 0)
        tail = partial_state(self.rows("events", layout).where(F.col("epoch") >= epoch))
        if not epoch:
            return tail
        schema = T.StructType([*tail.schema.fields, T.StructField("gen", T.IntegerType()), T.StructField("epoch", T.IntegerType())])
        folded = read_or_empty(self.spark, f"{self.root}/state", schema).where(layout.visible() & (F.col("epoch") == epoch))
        return merged_state(folded.select(*tail.columns).unionByName(tail))

    def applications(self) -> DataFrame:
        return state_values(self.state()).withColumnRenamed("application_id", "id")

    def compact(self) -> int:
        """Fold scores and events into one row per listing and application and begin the next epoch, whose number is returned.

        The log of events stays as it is. What a failed attempt leaves behind belongs to an epoch that is not yet current; rows that are found twice there change nothing.
        """
        layout = self.layout()
        epoch = layout.values.get("epoch", 0) + 1
        latest = self.read("scores", layout).groupBy("job_id").agg(
            F.max_by(F.struct(*SCORE_VALUES, *SCORE_ORDER, "platform_key"), F.struct(*SCORE_ORDER)).alias("__last")).select("job_id", "__last.*")
        after = Layout(layout.version, layout.buckets, values={"epoch": epoch})
        self.append("scores", latest, layout=after)
        self.state(layout).withColumns({"gen": F.lit(layout.version), "epoch": F.lit(epoch)}).write.mode("append").partitionBy(
            "gen", "epoch", "platform_key").parquet(f"{self.root}/state")
        log_rows(self.spark, self.root, layout.version, ("epoch", None, epoch))
        return epoch

    def listings(self) -> DataFrame:
        """Listings with their latest score and with the status that follows from both logs."""
        layout = self.layout()
        base = self.read("listings", layout)
        scored = latest_rows(self.read("scores", layout), ["job_id"], SCORE_ORDER, SCORE_VALUES)
        scored = scored.select(F.col("job_id").alias("id"), F.lit(True).alias("__scored"),
                               *[F.col(c).alias(f"__{c}") for c in SCORE_VALUES])
        # The log does not keep a job from having two applications; the newest one counts.
        applications = state_values(self.state(layout)).select(F.col("application_id").alias("app"), F.col("job_id").alias("id"), "status")
        staged = applications.groupBy("id").agg(F.max_by("status", "app").alias("status")).select(
            "id", job_status(F.col("status")).alias("__stage"))
        joined = base.join(scored, "id", "left").join(staged, "id", "left")
        is_scored = F.coalesce("__scored", F.lit(False))
        return joined.withColumns({
            **{c: F.when(is_scored, F.col(f"__{c}")).otherwise(F.col(c))
               for c in SCORE_VALUES},
            "status": F.coalesce("__stage", F.when(is_scored, F.lit("evaluated")), "status"),
        }).select(*LISTINGS.fieldNames())

    # -- events ----------------------------------------------------------------------------

    def next_event_id(self) -> int:
        return (self.read("events").agg(F.max("event_id")).first()[0] or 0) + 1

    def append_events(self, events: DataFrame) -> None:
        self.append("events", events)

    # -- purge -----------------------------------------------------------------------------

    def purge(self, platforms: list[str] = DEPRECATED_PLATFORMS) -> int:
        """Drop all listings of the given platforms with everything that refers to them.

        All of it lies in the platforms' folders, which no later read opens; no file is written or copied.
        """
        layout, names = self.layout(), sorted({p.lower() for p in platforms})
        count = self.rows("listings", layout).where(F.col("platform_key").isin(names)).count()
        if count:
            log_rows(self.spark, self.root, layout.version + 1, ("purge", names, None))
        return count
