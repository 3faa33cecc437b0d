"""Queries on histories: as-of reads, change detection, orders of a queue, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.dates import age_days, monthly_cursors
from tallyloom.operators import asof, matching, reads
from tallyloom.plans.registry import EVENT_CURSOR, ORDER_CURSOR, STATE_SQL, cents, cents_sql, ntz, query, state_of, tables

_LATEST_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
    FROM events WHERE ts <= TIMESTAMP '{EVENT_CURSOR}') WHERE place = 1"""


def _latest(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return asof.latest(events, ["user_id"], ["ts", "event_id"], ntz(EVENT_CURSOR))


@query(f"SELECT user_id, event_id, event_type, {cents_sql('value')} AS value_cents FROM ({_LATEST_SQL})")
def asof_latest_verdict(spark, sf_dir):
    return _latest(spark, sf_dir).select("user_id", "event_id", "event_type", cents("value").alias("value_cents"))


@query(f"""WITH latest AS ({_LATEST_SQL}), states(disposition) AS (VALUES ('CLOSED'), ('PENDING'), ('EXCEPTION'))
    SELECT s.disposition, count(l.user_id) AS episodes, CAST(coalesce(sum({cents_sql('l.value')}), 0) AS BIGINT) AS amount_cents,
           CAST(coalesce(sum(abs({cents_sql('l.value')} - 5000)), 0) AS BIGINT) AS variance_cents,
           count(*) FILTER (WHERE l.event_type = 'error') AS errors
    FROM states s LEFT JOIN latest l ON s.disposition = {STATE_SQL.replace('event_type', 'l.event_type')} AND l.user_id IS NOT NULL GROUP BY s.disposition""")
def asof_overview(spark, sf_dir):
    latest = _latest(spark, sf_dir).select("user_id", "event_type", state_of().alias("disposition"), cents("value").alias("c"))
    return reads.overview(latest, "disposition", ["CLOSED", "PENDING", "EXCEPTION"], {
        "episodes": F.count("*"), "amount_cents": F.sum("c"), "variance_cents": F.sum(F.abs(F.col("c") - 5000)), "errors": F.count_if(F.col("event_type") == "error"),
    })


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS pairs FROM orders GROUP BY ALL
    ORDER BY pairs DESC, o_orderstatus, o_orderpriority LIMIT 25""")
def verdict_pair_spread(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return reads.pair_spread(orders, ["o_orderstatus", "o_orderpriority"], "pairs")


@query("SELECT event_type, count(DISTINCT user_id) AS episodes FROM events GROUP BY event_type")
def reason_spread_distinct(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count_distinct("user_id").alias("episodes"))


def _queue_sql(order: str) -> str:
    return f"""SELECT o_orderkey, o_orderstatus, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDER_CURSOR}') AS BIGINT) AS age_days,
        {cents_sql('o_totalprice')} AS variance_cents FROM orders WHERE o_orderdate <= TIMESTAMP '{ORDER_CURSOR}' ORDER BY {order}, o_orderkey LIMIT 100"""


def _queue(name):
    def f(spark, sf_dir):
        (orders,) = tables(spark, sf_dir, "orders")
        rows = asof.visible(orders, ntz(ORDER_CURSOR), "o_orderdate").select(
            "o_orderkey", "o_orderstatus", age_days(F.lit(ORDER_CURSOR), F.col("o_orderdate")).alias("age_days"), cents("o_totalprice").alias("variance_cents")
        )
        return reads.queue(rows, name, key="o_orderkey", age="age_days", variance="variance_cents", state="o_orderstatus", ranks={"F": 0, "O": 1})

    f.__name__ = f"queue_{name}"
    return f


for _name, _order in {"age_desc": "age_days DESC", "age_asc": "age_days", "variance_desc": "abs(variance_cents) DESC", "reopened_first": "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END", "episode_id": "1"}.items():
    query(_queue_sql(_order))(_queue(_name))


@query(f"""WITH latest AS ({_LATEST_SQL})
    SELECT l.user_id, l.event_type, list(e.event_type ORDER BY e.ts, e.event_id) AS reasons, count(*) AS n_reasons
    FROM latest l JOIN events e ON e.user_id = l.user_id AND e.ts <= l.ts AND e.ts > l.ts - INTERVAL 2 DAY GROUP BY l.user_id, l.event_type""")
def queue_with_reasons(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    latest = _latest(spark, sf_dir).select("user_id", F.col("event_type").alias("_type"), F.col("ts").alias("_ts"))
    near = events.join(latest, "user_id").where((F.col("ts") <= F.col("_ts")) & (F.col("ts") > F.col("_ts") - F.expr("interval 2 day")))
    return near.groupBy("user_id", F.col("_type").alias("event_type")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda r: r["event_type"]).alias("reasons"), F.count("*").alias("n_reasons")
    )


@query(f"""SELECT c_mktsegment AS track, CAST(sum(abs({cents_sql('o_totalprice')})) AS BIGINT) AS amount_cents, count(*) AS episodes
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def money_by_track(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("track")).agg(
        F.sum(F.abs(cents("o_totalprice"))).alias("amount_cents"), F.count("*").alias("episodes")
    )


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS arrivals FROM lineitem GROUP BY ALL")
def arrivals_by_month(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(F.count("*").alias("arrivals"))


@query(f"""WITH cursors AS (SELECT unnest([DATE '2024-01-05', DATE '2024-01-12', DATE '2024-01-19', DATE '2024-01-26']) AS "cursor"),
    placed AS (SELECT c."cursor", e.user_id, e.event_type, row_number() OVER (PARTITION BY c."cursor", e.user_id ORDER BY ts DESC, event_id DESC) AS place
        FROM cursors c JOIN events e ON e.ts <= c."cursor")
    SELECT "cursor", {STATE_SQL} AS disposition, count(*) AS episodes FROM placed WHERE place = 1 GROUP BY ALL""")
def disposition_over_time(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    cursors = spark.range(1).select(F.explode(F.array(*[F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-12", "2024-01-19", "2024-01-26")])).alias("cursor"))
    at = asof.latest_at_each(events, ["user_id"], ["ts", "event_id"], cursors)
    return at.groupBy("cursor", state_of().alias("disposition")).agg(F.count("*").alias("episodes"))


@query("""WITH span AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders)
    SELECT CAST(month AS DATE) AS "cursor" FROM (SELECT unnest(generate_series(a + INTERVAL 1 MONTH, CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS month, b FROM span) WHERE month < b""")
def monthly_cursor_series(spark, sf_dir):
    """The firsts of months between the first and the last order."""
    (orders,) = tables(spark, sf_dir, "orders")
    span = orders.agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    return monthly_cursors(spark, *span)


@query("SELECT source, sha256(text) AS payload_sha256, count(*) AS deliveries FROM documents GROUP BY source, sha256(text) HAVING count(*) > 1")
def duplicate_deliveries(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return reads.repeated(docs.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("payload_sha256")), ["source", "payload_sha256"], "deliveries")


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, {cents_sql('l_extendedprice')} AS price_cents FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS place FROM lineitem) WHERE place = 1""")
def record_dedup_first_delivery(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    once = asof.first_delivery(
        lines.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"),
        ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"],
    )
    return once.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", cents("l_extendedprice").alias("price_cents"))


@query(f"""SELECT o_orderkey, {cents_sql('o_totalprice')} AS deposit_cents FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate <= TIMESTAMP '{ORDER_CURSOR}')""")
def orphan_deposits(spark, sf_dir):
    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    shipped = asof.visible(lines, ntz(ORDER_CURSOR), "l_shipdate").select(F.col("l_orderkey").alias("o_orderkey"))
    return matching.unclaimed(orders, shipped, "o_orderkey").select("o_orderkey", cents("o_totalprice").alias("deposit_cents"))


@query(f"""SELECT o.o_orderkey, o.o_custkey FROM orders o LEFT JOIN
    (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '{ORDER_CURSOR}') r ON l_orderkey = o_orderkey
    WHERE o_orderdate <= TIMESTAMP '{ORDER_CURSOR}' AND l_orderkey IS NULL""")
def unresolved_parked(spark, sf_dir):
    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    pool = asof.visible(orders, ntz(ORDER_CURSOR), "o_orderdate").select("o_orderkey", "o_custkey")
    resolutions = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return matching.unresolved(pool, resolutions, "o_orderkey", "l_shipdate", ntz(ORDER_CURSOR))


_K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""SELECT DISTINCT user_id FROM events a WHERE event_type = 'signup' AND ts <= TIMESTAMP '{EVENT_CURSOR}' AND NOT EXISTS (
    SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND {_K_SQL.replace('props', 'b.props')} >= 50 AND b.ts <= TIMESTAMP '{EVENT_CURSOR}')""")
def awaiting_decision(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    seen = asof.visible(events, ntz(EVENT_CURSOR), "ts")
    k = F.get_json_object("props", "$.k").cast("long")
    return matching.waiting(seen, "user_id", F.col("event_type") == "signup", (F.col("event_type") == "purchase") & (k >= 50))


@query(f"SELECT event_id, user_id, {_K_SQL} AS k FROM events WHERE {_K_SQL} IN (7, 42) AND ts <= TIMESTAMP '{EVENT_CURSOR}'")
def validation_failures(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return asof.visible(events, ntz(EVENT_CURSOR), "ts").where(k.isin(7, 42)).select("event_id", "user_id", k.alias("k"))


@query(f"""SELECT e.event_id, e.user_id, p.event_id AS parent_id, e.event_type FROM (SELECT DISTINCT * FROM events WHERE ts <= TIMESTAMP '{EVENT_CURSOR}') e
    LEFT JOIN (SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '{EVENT_CURSOR}') p ON p.event_id = e.event_id - 1 AND p.user_id = e.user_id""")
def evidence_gather(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    seen = asof.visible(events, ntz(EVENT_CURSOR), "ts")
    parents = seen.select(F.col("event_id").alias("parent_id"), F.col("user_id").alias("_user"))
    rows = seen.distinct()
    return rows.join(parents, (F.col("parent_id") == F.col("event_id") - 1) & (F.col("_user") == F.col("user_id")), "left").select("event_id", "user_id", "parent_id", "event_type")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS place FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE place = 1 OR event_type IS DISTINCT FROM before""")
def change_detection(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return asof.changes(events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query(f"""WITH states AS (SELECT event_id, user_id, ts, {STATE_SQL} AS disposition FROM events),
    marked AS (SELECT *, lag(disposition) OVER w AS was FROM states WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    edges AS (SELECT *, coalesce((disposition <> 'CLOSED' AND was = 'CLOSED') OR (was = 'PENDING' AND disposition = 'EXCEPTION'), false) AS fell FROM marked),
    islands AS (SELECT *, sum(CASE WHEN fell OR disposition = 'CLOSED' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM edges)
    SELECT event_id, user_id, disposition, max(CASE WHEN fell THEN was END) OVER g AS reopened_from, max(CASE WHEN fell THEN event_id END) OVER g AS reopened_at
    FROM islands WINDOW g AS (PARTITION BY user_id, island)""")
def reopened_carry(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    states = events.select("event_id", "user_id", "ts", state_of().alias("disposition"))
    return asof.carry_reopened(states, ["user_id"], ["ts", "event_id"], "disposition", "event_id").select("event_id", "user_id", "disposition", "reopened_from", "reopened_at")


@query(f"""SELECT event_id, user_id, CAST(sum({cents_sql('value')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 124000000 AS BIGINT) AS running_cents FROM events""")
def running_balance(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", "ts", cents("value").alias("c"))
    return asof.running_total(rows, ["user_id"], ["ts", "event_id"], "c", 124_000_000).select("event_id", "user_id", "running_cents")


@query(f"""SELECT o_custkey AS who, 'order' AS kind, o_orderkey AS id, o_orderdate AS "at", {cents_sql('o_totalprice')} AS amount_cents, o_orderstatus AS fact FROM orders
    UNION ALL SELECT o_custkey, 'line', l_orderkey, l_shipdate, {cents_sql('l_extendedprice')}, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT user_id, 'event', event_id, ts, {cents_sql('value')}, event_type FROM events""")
def timeline_union(spark, sf_dir):
    """Three shapes of rows as the timeline of everyone."""
    orders, lines, events = tables(spark, sf_dir, "orders", "lineitem", "events")
    shipped = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def shape(rows, who, kind, id, at, amount, fact):
        return rows.select(F.col(who).alias("who"), F.lit(kind).alias("kind"), F.col(id).alias("id"), F.col(at).alias("at"), cents(amount).alias("amount_cents"), F.col(fact).alias("fact"))

    return reads.timeline(
        shape(orders, "o_custkey", "order", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"),
        shape(shipped, "o_custkey", "line", "l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag"),
        shape(events, "user_id", "event", "event_id", "ts", "value", "event_type"),
    )


@query("""SELECT l_orderkey, l_partkey, l_suppkey, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lineage_trace(spark, sf_dir):
    lines, orders, customer, nation, region = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_partkey", "l_suppkey", "c_name", "n_name", "r_name")


@query("""WITH q AS (SELECT o_orderkey, o_orderstatus FROM orders) SELECT
    CAST((SELECT count(*) FROM (SELECT o_orderkey FROM q WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM q WHERE o_orderstatus <> 'F')) AS BIGINT) AS shared,
    (SELECT count(*) FROM q WHERE o_orderstatus IN ('F', 'O', 'P')) AS queued, (SELECT count(*) FROM q) AS total""")
def partition_check(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return reads.partition_check(orders, "o_orderkey", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS ordinal FROM conversations""")
def evidence_ordinals(spark, sf_dir):
    (talk,) = tables(spark, sf_dir, "conversations")
    return reads.ordinals(talk.select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS number FROM events")
def dense_id_minting(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return asof.dense_ids(events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "number")


@query("""SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def table_sizes(spark, sf_dir):
    return reads.sizes({n: t for n, t in zip(("customer", "orders", "lineitem", "events"), tables(spark, sf_dir, "customer", "orders", "lineitem", "events"))})


@query("""WITH scored AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS best
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, coalesce(greatest(value, before) - best <= 1.0, false) AS stalled FROM scored""")
def stall_detection(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return asof.stalled(events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "event_id", "stalled")
