"""Attaching records to episodes in event time: what a replay in the order of arrival gives, found without replaying.

A record is judged at the first moment, its own arrival or later, at which one of its keys is known. It attaches if all keys known by then
lead to one episode of no other covered entity; otherwise it stays parked. An attached record makes keys of its own known from that moment.

Moments are relaxed like shortest paths, starting from the episodes' own keys: every round judges all carriers (records that look keys up and
publish keys) by the keys known so far, and moments only become earlier. On this way everybody is taken to attach. A carrier that sees
several episodes is a suspect, and so is what rests on a suspect. A carrier that would see several episodes even without the
suspects is parked for good: it is blocked, and the relaxation starts again without it. The earliest suspect never rests on another one, so
each start settles one at least; mostly one or two settle all. Records that publish nothing are judged once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.matching import ATTACHED, PARK_REASONS, contradicts
from tallyloom.sources.landing import discard, stored

KEY = ["key_type", "key_value"]
_KNOWN = [*KEY, "since", "target", "target_entity", "suspect"]


def _moment(at: Column, by: Column, depth: Column) -> Column:
    """A moment is an arrival (its time and its record) and how many records attached in turn because of it."""
    return F.struct(at.alias("at"), by.alias("by"), depth.cast("int").alias("depth"))


def _best(known: DataFrame, suspects: bool) -> DataFrame:
    """Of every key the two episodes that it leads to first, with and without suspects: more of them decide nothing.

    The limits are taken before the shuffle as well, so a key with very many episodes does not meet in one task. Without
    suspects among ``known`` the two are the same.
    """
    by_target = known.groupBy(*KEY, "target").agg(
        F.min("since").alias("since"), F.min(F.when(~F.col("suspect"), F.col("since"))).alias("sure"), F.max("target_entity").alias("target_entity")
    )
    rank = lambda when: F.row_number().over(Window.partitionBy(*KEY).orderBy(when, "target"))
    any_ = by_target.withColumn("n", rank("since")).where("n <= 2").withColumn("suspect", ~F.col("since").eqNullSafe(F.col("sure"))).select(*_KNOWN)
    if not suspects:
        return any_
    sure = by_target.where("sure IS NOT NULL").withColumn("since", F.col("sure")).withColumn("n", rank("since")).where("n <= 2").withColumn("suspect", F.lit(False))
    return any_.unionByName(sure.select(*_KNOWN)).dropDuplicates()


def _asked(keys: DataFrame, lookups: DataFrame) -> DataFrame:
    """Those of ``keys`` that some look-up names: what nobody asks for is not ranked, stored or joined again."""
    return keys.join(lookups.select(*KEY).distinct(), KEY, "left_semi")


def judged(lookups: DataFrame, known: DataFrame) -> DataFrame:
    """``record_id, since, target, most, target_entity, clash, suspect, sure`` of records that one of their keys leads to an episode.

    ``target`` and ``most`` are the least and the largest episode at that moment; ``sure`` that even without suspects it cannot attach.
    """
    hits = lookups.join(known, KEY)
    before = F.struct(F.col("since.at"), F.col("since.by")) < F.struct(F.col("at"), F.col("record_id"))
    hits = hits.withColumn("when", F.when(before, _moment(F.col("at"), F.col("record_id"), F.lit(0))).otherwise(_moment(F.col("since.at"), F.col("since.by"), F.col("since.depth") + 1)))
    hits = hits.select("record_id", "when", "target", "target_entity", "suspect", contradicts(F.col("entity"), F.col("target_entity")).alias("differs"))
    hits = hits.withColumn("first", F.min("when").over(Window.partitionBy("record_id"))).where(F.col("when") == F.col("first"))
    sure = F.when(~F.col("suspect"), F.col("target"))
    found = hits.groupBy("record_id").agg(
        F.min("first").alias("since"), F.min("target").alias("target"), F.max("target").alias("most"), F.min_by("target_entity", "target").alias("target_entity"), F.bool_or("differs").alias("clash"),
        F.bool_or("suspect").alias("rests"), F.coalesce((F.min(sure) != F.max(sure)) | F.bool_or(F.col("differs") & ~F.col("suspect")), F.lit(False)).alias("sure"),
    )
    torn = (F.col("target") != F.col("most")) | F.col("clash")
    return found.select("record_id", "since", "target", "most", "target_entity", "clash", (F.col("rests") | torn).alias("suspect"), "sure")


def _state(known: DataFrame) -> tuple:
    h = F.xxhash64(*_KNOWN)
    return tuple(known.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first())


def _torn(labels: DataFrame) -> bool:
    return not labels.where("suspect").isEmpty()


def _relaxed(carriers: DataFrame, first: DataFrame, publishes: DataFrame) -> DataFrame:
    """Labels of the carriers as if suspects attached. ``first`` and ``publishes`` hold keys that carriers look up.

    What two targets of a key came first, anchors and published keys taken together, follows from the first two of either, so a round
    ranks ``first`` and not all anchors again.
    """
    known, state = first, _state(first)
    while True:
        labels = stored(judged(carriers, known), "labels")
        more = publishes.join(labels, "record_id").select(*_KNOWN)
        wider = stored(_best(first.unionByName(more), _torn(labels)), "known")
        before, state = state, _state(wider)
        if known is not first:
            discard(known)
        known = wider
        if state == before:
            discard(known)
            return labels
        discard(labels)


def anchor_keys(anchors: DataFrame) -> DataFrame:
    return anchors.select(*KEY, _moment(F.col("first_seen_at"), F.col("target"), F.lit(0)).alias("since"), "target", "target_entity", F.lit(False).alias("suspect"))


def fitting() -> Column:
    """Whether a judged record attaches."""
    return (F.col("target") == F.col("most")) & ~F.col("clash")


def why() -> Column:
    """The decision of a record with keys, from the columns of ``judged``, which are null where no key led anywhere."""
    return F.when(F.col("target").isNull(), PARK_REASONS[1]).when(F.col("target") != F.col("most"), PARK_REASONS[2]).when(F.col("clash"), PARK_REASONS[3]).otherwise(ATTACHED)


def settled(keyed: DataFrame, known_before: DataFrame, publishes: DataFrame) -> DataFrame:
    """``judged`` of all ``keyed`` look-ups: by the keys known before, none of them a suspect's, and by those that attached records publish."""
    carriers = stored(keyed.join(publishes.select("record_id").distinct(), "record_id", "left_semi"), "carriers")
    asked = stored(_asked(known_before, keyed), "asked")
    said = stored(_asked(publishes, keyed), "said")
    inner = stored(_asked(said, carriers), "inner")
    first, free = stored(_best(_asked(asked, carriers), False), "known"), carriers
    while True:
        labels = _relaxed(free, first, inner)
        wrong = stored(labels.where("sure").select("record_id"), "blocked")
        if wrong.isEmpty():
            break
        discard(labels)
        rest = stored(free.join(wrong, "record_id", "left_anti"), "carriers")
        if free is not carriers:
            discard(free)
        free = rest
    known = stored(_best(asked.unionByName(said.join(labels, "record_id").select(*_KNOWN)), _torn(labels)), "known")
    found = stored(judged(keyed, known), "judged")
    for done in (known, labels, first, inner, said, asked, *({id(d): d for d in (free, carriers)}.values())):
        discard(done)
    return found


def attach(lookups: DataFrame, anchors: DataFrame, publishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attached`` (``record_id, episode_id, attached_at``) and ``parked`` (``record_id, reason``).

    ``lookups``: ``record_id, at, key_type, key_value, entity``, one row a key and one with a null key for a record without keys.
    ``anchors``: ``key_type, key_value, first_seen_at, target, target_entity`` of episodes, whose records are named by ``target``.
    ``publishes``: ``record_id, key_type, key_value`` of keys that a record makes known once it is attached. Records count in the order of
    their time, and of their id at one time. The reason is that of the moment at which the record was judged; one that no key ever led
    anywhere has none but ``NO_KEY_MATCH``. Repeated rows change nothing. Ids and episodes are strings.
    """
    keyed = lookups.where("key_type IS NOT NULL AND key_value IS NOT NULL")
    found = settled(keyed, anchor_keys(anchors), publishes.select("record_id", *KEY))
    fits = fitting()
    attached = found.where(fits).select("record_id", F.col("target").alias("episode_id"), F.col("since.at").alias("attached_at"))
    everyone = lookups.groupBy("record_id").agg(F.bool_or(F.col("key_type").isNotNull() & F.col("key_value").isNotNull()).alias("keyed"))
    reason = F.when(~F.col("keyed"), PARK_REASONS[0]).otherwise(why())
    parked = everyone.join(found, "record_id", "left").select("record_id", reason.alias("reason")).where(F.col("reason") != ATTACHED)
    out = stored(attached, "attached"), stored(parked, "parked")
    discard(found)
    return out
