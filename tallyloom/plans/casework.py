"""Queries on cases, codes and vendors' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import codes
from tallyloom.operators import cases, reads, vendors
from tallyloom.plans.registry import EVENT_CURSOR, ORDER_CURSOR, ntz, query, tables


@query("""SELECT event_type AS element, count(DISTINCT user_id) AS episodes FROM events GROUP BY event_type ORDER BY episodes DESC, element LIMIT 15""")
def top_reasons(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return reads.top(reads.spread(events.select("user_id", F.array("event_type").alias("reasons")), "reasons", "user_id"), "episodes", 15, "element")


@query("SELECT o_orderpriority, count(*) AS verdicts FROM orders GROUP BY o_orderpriority ORDER BY verdicts DESC, o_orderpriority LIMIT 12")
def verdict_mix(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return reads.top(orders.groupBy("o_orderpriority").agg(F.count("*").alias("verdicts")), "verdicts", 12, "o_orderpriority")


@query("""SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS net_effect FROM lineitem
    WHERE l_returnflag = 'R' GROUP BY ALL""")
def net_reversals(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    return vendors.net_reversals(lines, F.col("l_returnflag") == "R", ["l_partkey", "l_suppkey"])


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) > 1 AS ambiguous FROM orders
    WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def raw_record_lookup(spark, sf_dir):
    orders, events = tables(spark, sf_dir, "orders", "events")
    asked = events.where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return cases.raw_lookup(orders.select("o_custkey", "o_orderkey", "o_orderstatus"), asked, "o_custkey")


@query(f"""SELECT c_custkey, c_mktsegment AS track,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '{ORDER_CURSOR}') AS records,
    (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_shipdate <= TIMESTAMP '{ORDER_CURSOR}') AS cash_allocations,
    (SELECT count(*) FROM events WHERE user_id = c_custkey AND ts <= TIMESTAMP '{EVENT_CURSOR}') AS verdicts_written FROM customer""")
def case_heads(spark, sf_dir):
    customer, orders, lines, events = tables(spark, sf_dir, "customer", "orders", "lineitem", "events")
    own = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    paid = lines.where(F.col("l_shipdate") <= ntz(ORDER_CURSOR)).join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    return cases.counted(customer.select("c_custkey", F.col("c_mktsegment").alias("track")), "c_custkey", {
        "records": own.where(F.col("o_orderdate") <= ntz(ORDER_CURSOR)), "cash_allocations": paid,
        "verdicts_written": events.where(F.col("ts") <= ntz(EVENT_CURSOR)).select(F.col("user_id").alias("c_custkey")),
    })


_PLB = list(codes.PROVIDER_LEVEL)
_SIGNS = ", ".join(f"({i}, '{c}', {s}, {t})" for i, (c, (s, t)) in enumerate(codes.PROVIDER_LEVEL.items(), 1))


@query(f"""WITH plb(place, code, sign, traceable) AS (VALUES {_SIGNS})
    SELECT code, count(*) AS lines, CAST(sum(sign * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS effect_cents, count(*) FILTER (WHERE traceable) AS traceable
    FROM lineitem LEFT JOIN plb ON place = l_linenumber GROUP BY code""")
def adjustment_semantics(spark, sf_dir):
    """Lines under the code of their number: how each code moves a deposit; a number beyond the codes has none."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    code = F.try_element_at(F.array(*map(F.lit, _PLB)), F.col("l_linenumber").cast("int"))
    rows = lines.select(code.alias("code"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    return rows.groupBy("code").agg(
        F.count("*").alias("lines"), F.sum(codes.provider_level_sign(F.col("code")) * F.col("c")).alias("effect_cents"), F.count_if(codes.provider_level_traceable(F.col("code"))).alias("traceable")
    )


#: What a level of records knows after the one before it: the first moment, and whether all that was known then leads to one episode of the same entity.
_LEVEL = """hits{n} AS (SELECT r.event_id, r.entity, CASE WHEN row(k.t, k.who) < row(r.ts, r.event_id) THEN r.ts ELSE k.t END AS t, CASE WHEN row(k.t, k.who) < row(r.ts, r.event_id) THEN r.event_id ELSE k.who END AS who,
        k.target, k.target_entity FROM looks r JOIN known{n} k USING (key_type, key_value) WHERE r.event_type = '{kind}'),
    first{n} AS (SELECT event_id, min(row(t, who)) AS f FROM hits{n} GROUP BY event_id),
    judged{n} AS (SELECT h.event_id, min(h.target) AS target, max(h.target) AS most, bool_or(coalesce(h.entity <> h.target_entity, false)) AS clash, min(h.t) AS t, min(h.who) AS who,
        min(h.target_entity) AS target_entity FROM hits{n} h JOIN first{n} f ON f.event_id = h.event_id AND f.f = row(h.t, h.who) GROUP BY h.event_id),
    known{m} AS (SELECT * FROM known{n} UNION ALL SELECT p.key_type, p.key_value, j.t, j.who, j.target, j.target_entity
        FROM judged{n} j JOIN gives p USING (event_id) WHERE j.target = j.most AND NOT j.clash)"""
_KINDS = ("view", "click", "purchase", "error")
_EVENT_KEYS = {  # what each kind looks up, and what it publishes
    "signup": ((), ("DAY",)), "view": (("DAY",), ("K",)), "click": (("DAY", "K"), ("VALUE",)), "purchase": (("VALUE", "K"), ("PAIR",)), "error": (("PAIR", "VALUE"), ()),
}
_VALUE_SQL = {"DAY": "user_id || '|' || strftime(ts, '%Y-%m-%d')", "K": "user_id || '|' || json_extract_string(props, '$.k')", "VALUE": "user_id || '|' || CAST(floor(value) AS BIGINT)", "PAIR": "CAST(floor(value) AS BIGINT) || '|' || json_extract_string(props, '$.k')"}


def _keys_sql(which: int) -> str:
    parts = [f"SELECT event_id, event_type, ts, entity, '{k}' AS key_type, {_VALUE_SQL[k]} AS key_value FROM e WHERE event_type = '{kind}'" for kind, pair in _EVENT_KEYS.items() for k in pair[which]]
    return " UNION ALL ".join(parts)


def event_levels_sql() -> str:
    """``judged`` of events, level by level: no kind of event reaches one that comes after it in ``_KINDS``."""
    return f"""WITH e AS (SELECT *, CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'X' WHEN CAST(floor(value) AS BIGINT) % 4 = 1 THEN 'Y' END AS entity FROM events),
    looks AS ({_keys_sql(0)}), gives AS ({_keys_sql(1)}),
    known0 AS (SELECT key_type, key_value, ts AS t, event_id AS who, event_id AS target, entity AS target_entity FROM gives WHERE event_type = 'signup'),
    {", ".join(_LEVEL.format(n=n, m=n + 1, kind=kind) for n, kind in enumerate(_KINDS))},
    judged AS ({" UNION ALL ".join(f"SELECT * FROM judged{n}" for n in range(len(_KINDS)))})"""


@query(f"""{event_levels_sql()}
    SELECT event_id AS record_id, CASE WHEN target = most AND NOT clash THEN target END AS episode_id,
        CASE WHEN target = most AND NOT clash THEN strftime(t, '%Y-%m-%d %H:%M:%S.%f') END AS attached_at,
        CASE WHEN target IS NULL THEN 'NO_KEY_MATCH' WHEN target <> most THEN 'AMBIGUOUS_KEY_MATCH' WHEN clash THEN 'COVERED_ENTITY_MISMATCH' ELSE 'ATTACHED' END AS decision
    FROM events LEFT JOIN judged USING (event_id) WHERE event_type <> 'signup'""")
def crosswalk_event_time(spark, sf_dir):
    """Signups open cases; other events reach them over keys, some of which become known only when another event attaches."""
    from tallyloom.operators.crosswalk import attach

    attached, parked = attach(*event_keys(spark, sf_dir))
    both = attached.withColumn("decision", F.lit("ATTACHED")).unionByName(parked.withColumnRenamed("reason", "decision"), allowMissingColumns=True)
    return both.select(F.col("record_id").cast("long").alias("record_id"), F.col("episode_id").cast("long").alias("episode_id"), "attached_at", "decision")


def event_keys(spark, sf_dir):
    """Events as look-ups, keys of signups, and keys that other events publish."""
    (events,) = tables(spark, sf_dir, "events")
    whole = F.floor("value").cast("string")
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    value = {"DAY": F.concat_ws("|", user, F.date_format("ts", "yyyy-MM-dd")), "K": F.concat_ws("|", user, k), "VALUE": F.concat_ws("|", user, whole), "PAIR": F.concat_ws("|", whole, k)}
    entity = F.when(F.floor("value") % 4 == 0, "X").when(F.floor("value") % 4 == 1, "Y")
    padded = F.lpad(F.col("event_id").cast("string"), 12, "0")
    rows = events.select(padded.alias("record_id"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), entity.alias("entity"), *[v.alias(n) for n, v in value.items()])

    def keyed(which: int):
        choice = None
        for kind, pair in _EVENT_KEYS.items():
            if not pair[which]:
                continue
            own = F.array(*[F.struct(F.lit(n).alias("key_type"), F.col(n).alias("key_value")) for n in pair[which]])
            choice = F.when(F.col("event_type") == kind, own) if choice is None else choice.when(F.col("event_type") == kind, own)
        return rows.select("record_id", "event_type", "at", "entity", F.explode(choice).alias("key")).select("record_id", "event_type", "at", "entity", "key.*")

    given = keyed(1)
    anchors = given.where("event_type = 'signup'").select("key_type", "key_value", F.col("at").alias("first_seen_at"), F.col("record_id").alias("target"), F.col("entity").alias("target_entity"))
    return keyed(0).drop("event_type"), anchors, given.where("event_type <> 'signup'").select("record_id", "key_type", "key_value")
