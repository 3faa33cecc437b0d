"""Queries of the desk: queues, cash, money, facts, bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import desk
from tallyloom.plans.registry import EVENT_CURSOR, STATE_SQL, cents, cents_sql, ntz, query, state_of, tables

_CURRENT = f"""current AS (SELECT user_id, ts, {STATE_SQL} AS disposition, {cents_sql('value')} AS c FROM events WHERE ts <= TIMESTAMP '{EVENT_CURSOR}'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _verdicts(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select("user_id", "ts", "event_id", state_of().alias("disposition"), cents("value").alias("c"))


@query(f"WITH {_CURRENT} SELECT user_id, ts, disposition FROM current WHERE disposition = 'EXCEPTION'")
def queue_of_disposition(spark, sf_dir):
    return desk.queue(_verdicts(spark, sf_dir), ["user_id"], ["ts", "event_id"], "EXCEPTION", ntz(EVENT_CURSOR)).select("user_id", "ts", "disposition")


@query(f"WITH {_CURRENT} SELECT user_id, ts, disposition FROM current WHERE disposition = 'PENDING' AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def queue_of_ids(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    asked = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return desk.queue(_verdicts(spark, sf_dir), ["user_id"], ["ts", "event_id"], "PENDING", ntz(EVENT_CURSOR), asked).select("user_id", "ts", "disposition")


@query(f"SELECT event_id, ts AS received_at FROM events WHERE ts <= TIMESTAMP '{EVENT_CURSOR}' AND (event_type = 'error' OR value < 1)")
def quarantine_as_of(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return desk.quarantined(events.where("event_type = 'error' OR value < 1").select("event_id", F.col("ts").alias("received_at")), ntz(EVENT_CURSOR))


@query(f"""SELECT l_orderkey, CASE l_linenumber % 5 WHEN 3 THEN 'WEAK_INFERENCE' WHEN 4 THEN 'UNATTRIBUTED' ELSE 'EXACT_REFERENCE' END AS strength, count(*) AS allocations,
    CAST(sum({cents_sql('l_extendedprice')}) AS BIGINT) AS cents FROM lineitem GROUP BY ALL""")
def cash_match_strength(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    basis = F.element_at(F.array(*map(F.lit, ("TRN02", "ACH_TRACE", "ALLOCATION_CODE", "AMOUNT_DATE", "RESIDUAL"))), F.col("l_linenumber") % 5 + 1)
    return desk.cash_match(lines.select("l_orderkey", basis.alias("basis"), cents("l_extendedprice").alias("allocated_cents")), "l_orderkey")


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R'))
    SELECT o_orderkey, (SELECT count(*) FROM o) AS total FROM o ORDER BY o_orderdate, o_orderkey LIMIT 10""")
def unallocated_deposits(spark, sf_dir):
    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    free = orders.join(lines.where("l_returnflag <> 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")
    return desk.unallocated_sample(free, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "total")


def _usd_sql(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


@query(f"""WITH {_CURRENT}, v AS (SELECT user_id, 5000 - c AS a, c - 2500 AS b FROM current)
    SELECT user_id, CAST(a + b AS BIGINT) AS total_variance_cents, CAST(abs(a) + abs(b) AS BIGINT) AS absolute_variance_cents, {_usd_sql('(a)')} AS variance_usd, {_usd_sql('(b)')} AS variance_rebate_usd,
        {_usd_sql('(abs(a) + abs(b))')} AS absolute_variance_usd FROM v""")
def reconciled_money(spark, sf_dir):
    from tallyloom.operators.asof import latest

    now = latest(_verdicts(spark, sf_dir), ["user_id"], ["ts", "event_id"], ntz(EVENT_CURSOR))
    money = now.select("user_id", (F.lit(5000) - F.col("c")).alias("variance_cents"), (F.col("c") - 2500).alias("variance_rebate_cents"))
    return desk.reconciliation(money).select("user_id", "total_variance_cents", "absolute_variance_cents", "variance_usd", "variance_rebate_usd", "absolute_variance_usd")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{{' || CASE WHEN o_orderkey % 3 <> 0 THEN '"trace":"T' || o_orderkey || '",' ELSE '' END || '"amount_cents":"' || {cents_sql('o_totalprice')} || '","event_date":"'
    || strftime(o_orderdate, '%Y-%m-%d') || '"}}' ELSE '{{"amount_cents":"' || {cents_sql('o_totalprice')} || '","event_date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}}' END AS facts FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN '{{"rx":"T' || o_orderkey || '"}}' ELSE '{{}}' END FROM orders WHERE o_orderstatus = 'P'""")
def record_facts(spark, sf_dir):
    """Orders as three kinds of records, each with the facts of its kind; what is absent is left out."""
    (orders,) = tables(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "REMITTANCE").when(F.col("o_orderstatus") == "P", "PHARMACY_REVERSAL").otherwise("BANK_TRANSACTION")
    own = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("T"), F.col("o_orderkey").cast("string")))
    rows = orders.select("o_orderkey", kind.alias("record_kind"), F.when(F.col("o_orderstatus") == "F", own).alias("trace"), own.alias("rx"), cents("o_totalprice").alias("amount_cents"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"))
    return desk.projected(rows).select("o_orderkey", F.to_json("facts").alias("facts"))


@query("""SELECT 'events' AS "table", count(*) AS rows, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM events
    UNION ALL SELECT 'orders', count(*), strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders""")
def data_bounds(spark, sf_dir):
    events, orders = tables(spark, sf_dir, "events", "orders")
    return desk.bounds({"events": (events, "ts"), "orders": (orders, "o_orderdate")}).withColumns({c: F.substring(c, 1, 10) for c in ("first", "last")})


@query("""SELECT o_orderkey, CAST(i AS INTEGER) - 1 AS ordinal, parts[i] AS reason FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS parts, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) AS i FROM orders)""")
def reason_ordinals(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return desk.ordinals(orders.select("o_orderkey", F.split("o_orderpriority", "-").alias("reasons")), "reasons", "reason")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_rounds(spark, sf_dir):
    return desk.best_round(tables(spark, sf_dir, "events")[0], ["user_id"], "event_id", "value")


@query("SELECT user_id AS id FROM events WHERE event_type = 'error' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def graded_by_both(spark, sf_dir):
    events, orders = tables(spark, sf_dir, "events", "orders")
    return desk.graded_by_both(events.where("event_type = 'error'").select(F.col("user_id").alias("id")), orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), ["id"])


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS arrival FROM events")
def arrival_order(spark, sf_dir):
    return desk.arrival_order(tables(spark, sf_dir, "events")[0], ["user_id"], "ts", "event_id").select("event_id", "arrival")


@query("""WITH up AS (SELECT user_id, event_type, coalesce(value > lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id), true) AS rises FROM events)
    SELECT user_id, event_type, bool_and(rises) AND count(*) > 1 AS rising FROM up GROUP BY ALL""")
def rising_scores(spark, sf_dir):
    from tallyloom.operators.asof import always_rising

    return always_rising(tables(spark, sf_dir, "events")[0], ["user_id", "event_type"], "event_id", "value", "user_id")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 24 AS chunk FROM orders")
def claim_chunks(spark, sf_dir):
    from tallyloom.operators.matching import allocation_chunks

    return allocation_chunks(tables(spark, sf_dir, "orders")[0], ["o_custkey"], ["o_orderkey"], 24).select("o_orderkey", "chunk")


@query(f"""WITH s AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * {cents_sql('l_extendedprice')}) AS BIGINT) AS sum_cents FROM lineitem GROUP BY l_orderkey),
    d AS (SELECT o_orderkey AS document_id, sum_cents + CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 ELSE 0 END AS declared_cents, sum_cents FROM orders JOIN s ON l_orderkey = o_orderkey)
    SELECT document_id, CAST(declared_cents AS BIGINT) AS declared_cents, sum_cents FROM d WHERE declared_cents <> sum_cents""")
def document_identity(spark, sf_dir):
    """Orders that declare what their lines less their returns come to, but for some that are a cent or two off."""
    from tallyloom.operators.allocation import identity_breaks

    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "PLB").otherwise("LINE")
    children = lines.select(F.col("l_orderkey").alias("document_id"), kind.alias("kind"), cents("l_extendedprice").alias("amount_cents"))
    sums = children.groupBy("document_id").agg(F.sum(F.when(F.col("kind") == "PLB", -F.col("amount_cents")).otherwise(F.col("amount_cents"))).alias("s"))
    off = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 3).otherwise(F.lit(0))
    documents = orders.join(sums, F.col("o_orderkey") == F.col("document_id")).select("document_id", (F.col("s") + off).alias("declared_cents"))
    return identity_breaks(documents, children)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [] WHEN {cents_sql('o_totalprice')} = o_custkey THEN [] ELSE [CAST({cents_sql('o_totalprice')} AS VARCHAR)] END AS unsourced FROM orders")
def unsourced_amounts(spark, sf_dir):
    """Numbers of a sentence that no tool has given."""
    from tallyloom.functions.text import unsourced_numbers

    (orders,) = tables(spark, sf_dir, "orders")
    amount, customer = cents("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    said = F.concat(F.lit("Customer "), customer, F.lit(" owes "), amount, F.lit(" cents."))
    known = F.when(F.col("o_orderkey") % 3 == 0, F.array(customer, amount)).otherwise(F.array(customer))
    return orders.select("o_orderkey", unsourced_numbers(said, known).alias("unsourced"))


@query("""WITH a AS (SELECT user_id, value AS outcome FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    b AS (SELECT user_id, value AS state FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, outcome, state FROM a FULL OUTER JOIN b ON a.user_id = b.user_id""")
def merged_decisions(spark, sf_dir):
    """The last outcome and the last state of everyone who has one."""
    from tallyloom.operators.folds import merged_decisions as merged

    (events,) = tables(spark, sf_dir, "events")
    outcomes = events.where("event_type = 'click' AND user_id % 3 <> 0").withColumnRenamed("value", "outcome")
    states = events.where("event_type = 'purchase' AND user_id % 5 <> 0").withColumnRenamed("value", "state")
    return merged(outcomes, states, "user_id", ["ts", "event_id"], (["outcome"], ["state"]))
