"""The crosswalk as it goes on: batches of arrivals, append-only tables, and no look at what is settled.

A batch looks only at its own records, at those that still wait, and at the keys that these name. Keys lie in buckets by their hash, so a small
batch reads few of them. Every table is written by step and never changed; a step that is run again replaces its own files.

Records may be late. A batch whose first moment lies before moments already judged reopens what was judged from that moment on. So
a row of an earlier step holds only if its moment is before the first one of every later step; nothing is deleted for that. However arrivals
are cut into batches, what holds at the end is what one batch of them all gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.crosswalk import KEY, anchor_keys, fitting, settled, why
from tallyloom.operators.matching import ATTACHED, PARK_REASONS
from tallyloom.sources.landing import discard, stored

MOMENT = "struct<at:string,by:string,depth:int>"
_SCHEMAS = {
    "keys": f"key_type string, key_value string, since {MOMENT}, target string, target_entity string, anchor boolean, bucket int, step int",
    "judged": f"record_id string, at string, since {MOMENT}, episode_id string, reason string, step int",
    "waiting": "record_id string, at string, entity string, key_type string, key_value string, published boolean, step int",
    "steps": "first string, last string, step int",
}


class Pool:
    """Keys, judgements and waiting records under ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _SCHEMAS[name])

    def _write(self, df: DataFrame, name: str, step: int, *parts: str) -> None:
        columns = [c for c in df.columns if c != "step"]
        rows = df.select(*columns, F.lit(step).alias("step"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step", *parts).parquet(f"{self.folder}/{name}")

    def steps(self) -> list[tuple[int, str, str]]:
        """``step, first, last``: the moments that each step's own records span, one row a step."""
        return sorted((r["step"], r["first"], r["last"]) for r in self._table("steps").collect())

    def _holds(self, before: int | None = None) -> Column:
        """Whether a row's moment lies before the first one of every later step."""
        holds, first = F.lit(True), None
        for step, start, _ in reversed(self.steps()):
            if before is not None and step >= before:
                continue
            if first is not None:
                holds = F.when(F.col("step") == step, F.col("since.at") < first).otherwise(holds)
            first = start if first is None else min(first, start)
        return holds

    def _judged(self, before: int | None = None) -> DataFrame:
        rows = self._table("judged").where(self._holds(before))
        return rows if before is None else rows.where(F.col("step") < before)

    def advance(self, lookups: DataFrame, anchors: DataFrame, publishes: DataFrame, everything: tuple[DataFrame, DataFrame] | None = None, step: int | None = None) -> DataFrame:
        """Takes in a batch (tables as for ``crosswalk.attach``); returns ``record_id, episode_id`` of links that are new or gone.

        ``everything`` is ``lookups, publishes`` of all records so far; only a late batch reads it. ``step`` numbers the batch: one that is
        done again has no other effect than the first time.
        """
        known = [s for s in self.steps() if step is None or s[0] < step]
        step = (known[-1][0] + 1 if known else 0) if step is None else step
        stamps = lookups.select("at").unionAll(anchors.select(F.col("first_seen_at").alias("at"))).agg(F.min("at"), F.max("at")).first()
        if stamps[0] is None:
            self._write(self._table("waiting").where(F.col("step") == (known[-1][0] if known else -1)), "waiting", step)
            self._write(self.spark.createDataFrame([], _SCHEMAS["steps"]), "steps", step)
            return self.spark.createDataFrame([], "record_id string, episode_id string")
        first, late = stamps[0], bool(known) and stamps[0] <= max(s[2] for s in known)
        waits = self._table("waiting").where(F.col("step") == (known[-1][0] if known else -1))
        look = lookups.select("record_id", "at", "entity", *KEY).unionByName(waits.where("NOT published").select("record_id", "at", "entity", *KEY))
        said = publishes.select("record_id", *KEY).unionByName(waits.where("published").select("record_id", *KEY))
        before = self._judged(step)
        undone = stored(before.where(F.col("since.at") >= first), "undone") if late else None
        if undone is not None and everything is not None:
            again = undone.select("record_id")
            look = look.unionByName(everything[0].join(again, "record_id", "left_semi").select("record_id", "at", "entity", *KEY))
            said = said.unionByName(everything[1].join(again, "record_id", "left_semi").select("record_id", *KEY))
        look, said = stored(look.distinct(), "look"), stored(said.distinct(), "said")
        keyed = look.where("key_type IS NOT NULL AND key_value IS NOT NULL")
        own = anchor_keys(anchors).withColumn("anchor", F.lit(True))
        found = settled(keyed, own.drop("anchor").unionByName(self._keys_for(keyed, step, first if late else None)), said)
        records = look.groupBy("record_id").agg(F.min("at").alias("at"))
        final = stored(records.join(found, "record_id").select("record_id", "at", "since", F.when(fitting(), F.col("target")).alias("episode_id"), why().alias("reason"), "target_entity"), "final")
        linked = final.where("episode_id IS NOT NULL")
        more = said.join(linked, "record_id").select(*KEY, "since", F.col("episode_id").alias("target"), "target_entity", F.lit(False).alias("anchor"))
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket")
        self._write(own.select(*more.columns).unionByName(more).select("*", bucket), "keys", step, "bucket")
        self._write(final.drop("target_entity"), "judged", step)
        rest = final.select("record_id")
        waiting = look.select("record_id", "at", "entity", *KEY, F.lit(False).alias("published")).unionByName(
            said.join(records, "record_id").select("record_id", "at", F.lit(None).cast("string").alias("entity"), *KEY, F.lit(True).alias("published"))
        )
        self._write(waiting.join(rest, "record_id", "left_anti"), "waiting", step)
        self._write(self.spark.createDataFrame([(*stamps, step)], _SCHEMAS["steps"]), "steps", step)
        changed = linked.select("record_id", "episode_id")
        if undone is not None:
            old = undone.where("episode_id IS NOT NULL").select("record_id", "episode_id")
            changed = changed.exceptAll(old).unionByName(old.exceptAll(changed))
        changed = stored(changed, "changed")
        for done in (look, said, found, final, *([undone] if undone is not None else [])):
            discard(done)
        return changed

    def _keys_for(self, keyed: DataFrame, step: int, redone_from: str | None) -> DataFrame:
        """Known keys that the look-ups name, from their buckets alone."""
        wanted = keyed.select(*KEY).distinct()
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")).distinct().collect()]
        keys = self._table("keys").where(F.col("bucket").isin(buckets) & (F.col("step") < step) & (F.col("anchor") | self._holds(step)))
        if redone_from is not None:
            keys = keys.where(F.col("anchor") | (F.col("since.at") < redone_from))
        return keys.join(wanted, KEY, "left_semi").select(*KEY, "since", "target", "target_entity", F.lit(False).alias("suspect"))

    def attachments(self) -> DataFrame:
        """``record_id, episode_id, attached_at`` as things are."""
        return self._judged().where("episode_id IS NOT NULL").select("record_id", "episode_id", F.col("since.at").alias("attached_at"))

    def _waiting(self) -> DataFrame:
        known = self.steps()
        rows = self._table("waiting").where(F.col("step") == (known[-1][0] if known else -1)).where("NOT published")
        keyed = F.bool_or(F.col("key_type").isNotNull() & F.col("key_value").isNotNull())
        return rows.groupBy("record_id").agg(F.min("at").alias("at"), F.when(keyed, PARK_REASONS[1]).otherwise(PARK_REASONS[0]).alias("reason"))

    def parked(self) -> DataFrame:
        """``record_id, reason`` of what is not attached as things are."""
        torn = self._judged().where(F.col("reason") != ATTACHED).select("record_id", "reason")
        return torn.unionByName(self._waiting().select("record_id", "reason"))

    def parks(self) -> DataFrame:
        """``record_id, parked_at, reason``: every record that did not attach when it arrived, whatever came of it."""
        rows = self._judged().where((F.col("since.by") != F.col("record_id")) | (F.col("reason") != ATTACHED))
        at_once = F.col("since.by") == F.col("record_id")
        return rows.select("record_id", F.col("at").alias("parked_at"), F.when(at_once, F.col("reason")).otherwise(PARK_REASONS[1]).alias("reason")).unionByName(
            self._waiting().select("record_id", F.col("at").alias("parked_at"), "reason")
        )

    def resolutions(self) -> DataFrame:
        """``record_id, resolved_at, episode_id, resolved_by``: parked records that a later arrival led somewhere."""
        rows = self._judged().where((F.col("since.by") != F.col("record_id")) & F.col("episode_id").isNotNull())
        return rows.select("record_id", F.col("since.at").alias("resolved_at"), "episode_id", F.col("since.by").alias("resolved_by"))
