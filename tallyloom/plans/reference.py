"""Queries on files, reference data, counters and the pool of waiting records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.plans.casework import event_keys, event_levels_sql
from tallyloom.plans.registry import query, tables
from tallyloom.sources import constraints as C
from tallyloom.sources import files
from tallyloom.sources.counters import Counters, by_reason, id_bounds
from tallyloom.sources.landing import shared_folder, stored


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/engine-{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS own, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'ODD' WHEN o_orderkey % 11 <> 0 THEN 'DETAIL' END AS kind,
    'Line ' || o_orderpriority || ', "' || o_custkey || '"' AS note FROM orders""")
def delimited_by_header(spark, sf_dir):
    """All orders as delimited files with their columns in two orders, empty cells, empty types and quoted cells, read by each file's header."""
    (orders,) = tables(spark, sf_dir, "orders")
    at = _folder(spark, "delimited")
    key, status = F.col("o_orderkey").cast("string").alias("own"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status")
    kind = F.when(F.col("o_orderkey") % 7 == 0, "ODD").when(F.col("o_orderkey") % 11 != 0, "DETAIL").alias("record_type")
    note = F.concat(F.lit("Line "), F.col("o_orderpriority"), F.lit(', "'), F.col("o_custkey").cast("string"), F.lit('"')).alias("note")
    for half, columns in ((0, [key, status, kind, note]), (1, [note, kind, key, status])):
        orders.where(F.col("o_custkey") % 2 == half).select(*columns).write.csv(f"{at}/{half}", header=True, quote='"', escape='"', emptyValue="", nullValue="")
    rows = files.read_delimited(spark, [f"{at}/0/*.csv", f"{at}/1/*.csv"])
    cell = lambda n: F.get_json_object("payload", f"$.{n}")
    return rows.select(cell("own").alias("own"), cell("status").alias("status"), F.nullif("record_type", F.lit("")).alias("kind"), cell("note").alias("note"))


@query("SELECT count(*) AS lines, 0 AS unnumbered, count(*) AS raw_ids FROM events")
def numbered_lines(spark, sf_dir):
    """All events as files of lines: every file's lines are numbered from 1 without a gap, over all splits, and raw ids are unique."""
    (events,) = tables(spark, sf_dir, "events")
    at = _folder(spark, "lines")
    events.select(F.to_json(F.struct(*events.columns))).write.text(at)
    rows = stored(files.read_lines(spark, [f"{at}/*.txt"]), "numbered")
    by_file = rows.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.count_distinct("line_no").alias("apart"))
    gaps = by_file.agg(F.sum("n").alias("lines"), F.count_if((F.col("n") != F.col("last")) | (F.col("n") != F.col("apart"))).cast("int").alias("unnumbered"))
    return gaps.crossJoin(rows.select("file_sha256", "line_no").distinct().agg(F.count("*").alias("raw_ids")))


_SEEDED = [
    C.Key("line", ("l_orderkey", "l_linenumber")), C.Reference("order", ("o_custkey",), "customer", ("c_custkey",)), C.Reference("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    C.Check("order", "status", "o_orderstatus IN ('F', 'O')"), C.Check("order", "price", "o_totalprice > 1000"), C.Exclusive("order", ("o_custkey",), "since", "until"), C.Rows("customer", "buildings", "c_mktsegment = 'BUILDING'", 0, 1),
]


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS since,
        CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS until FROM orders),
    spans AS (SELECT o_custkey, since, until, count(*) OVER w AS n, max(until) OVER w AS most, bool_or(until IS NULL) OVER w AS open FROM o
        WINDOW w AS (PARTITION BY o_custkey ORDER BY since NULLS FIRST, until NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT 'line' AS "table", 'KEY l_orderkey,l_linenumber' AS rule, l_orderkey || '|' || l_linenumber AS row FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'order', 'REFERENCE o_custkey TO customer', CAST(k AS VARCHAR) FROM (SELECT DISTINCT o_custkey AS k FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 'customer', 'REFERENCE c_nationkey TO nation', CAST(k AS VARCHAR) FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))
    UNION ALL SELECT 'order', 'CHECK status', CAST(o_orderkey AS VARCHAR) FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'order', 'CHECK price', CAST(o_orderkey AS VARCHAR) FROM o WHERE NOT o_totalprice > 1000
    UNION ALL SELECT 'order', 'EXCLUSIVE since..until BY o_custkey', o_custkey || '|' || since FROM spans WHERE (n > 0 AND (coalesce(open, false) OR most > since)) OR coalesce(until <= since, false)
    UNION ALL SELECT 'customer', 'ROWS buildings', CAST(n AS VARCHAR) FROM (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING') WHERE n > 1""")
def integrity_breaches(spark, sf_dir):
    """Seeded breaches of keys, references, checks, exclusive spans and counts, over whole tables."""
    lines, orders, customer, nation = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    day = F.col("o_orderdate").cast("date")
    spans = orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", "o_totalprice", day.alias("since"),
        F.when(F.col("o_orderkey") % 50 != 0, F.date_add(day, (F.col("o_orderkey") % 90).cast("int"))).alias("until"),
    )
    return C.breaches({"line": lines, "order": spans, "customer": customer, "nation": nation}, _SEEDED, {"order": ("o_orderkey",)})


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand AS brand, CASE WHEN (l_partkey % 3) = 0 THEN 1 ELSE 2 END AS published FROM lineitem LEFT JOIN (SELECT p_partkey + 1 AS k, p_brand FROM part) ON k = l_partkey""")
def dimension_lookup(spark, sf_dir):
    """A part dimension that is one key off, and keys that are published for known codes alone."""
    lines, part = tables(spark, sf_dir, "lineitem", "part")
    dim = part.select((F.col("p_partkey") + 1).alias("l_partkey"), F.col("p_brand").alias("brand"))
    found = C.with_dimension(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), dim, "l_partkey", ["brand"])
    codes = part.select((F.col("p_partkey") % 3).alias("c")).where("c > 0").distinct()
    keys = F.array(*[F.struct(F.lit(t).alias("key_type"), F.col("l_partkey").cast("string").alias("key_value")) for t in ("HCPCS_MEDICAL", "OTHER")])
    known = C.known_codes_only(found.withColumn("keys", keys).withColumn("code", F.col("l_partkey") % 3), "keys", "HCPCS_MEDICAL", "code", codes, "c")
    return known.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "brand", F.size("keys").alias("published"))


@query("""WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS_KEY_MATCH' WHEN o_orderstatus = 'F' THEN 'NO_KEY_MATCH' END AS reason FROM orders)
    SELECT 'raw_records' AS counter, count(*) AS n FROM r UNION ALL SELECT 'keys_published', CAST(sum(o_orderkey % 3) AS BIGINT) FROM r UNION ALL SELECT 'parked_no_keys_present', 0
    UNION ALL SELECT 'parked_no_key_match', count(*) FILTER (WHERE reason = 'NO_KEY_MATCH') FROM r UNION ALL SELECT 'parked_ambiguous_key_match', count(*) FILTER (WHERE reason = 'AMBIGUOUS_KEY_MATCH') FROM r
    UNION ALL SELECT 'parked_covered_entity_mismatch', 0 UNION ALL SELECT 'allocations_written', count(*) FROM lineitem""")
def ingest_counters(spark, sf_dir):
    """Counters of two tables that are written, taken while they are written."""
    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    rows = orders.withColumn("reason", F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS_KEY_MATCH").when(F.col("o_orderstatus") == "F", "NO_KEY_MATCH"))
    counters = Counters()
    stored(counters.watch(rows, raw_records=F.count(F.lit(1)), keys_published=F.sum(F.col("o_orderkey") % 3), **by_reason()), "counted")
    stored(counters.watch(lines, allocations_written=F.count(F.lit(1))), "counted")
    return spark.createDataFrame(sorted(counters.totals().items()), "counter string, n long")


@query("SELECT min(event_id) AS least, max(event_id) AS most FROM events")
def raw_id_bounds(spark, sf_dir):
    return id_bounds(tables(spark, sf_dir, "events")[0], "event_id")


@query("""SELECT o_orderkey, CASE WHEN k % 10 = 0 THEN [CAST(h * 1000 AS BIGINT), CAST(h * 100 AS BIGINT)] ELSE [CAST(h * 1000 + t * 10 + k % 10 AS BIGINT), CAST(h * 100 AS BIGINT)] END AS numbers
    FROM (SELECT o_orderkey, o_orderkey % 19 + 1 AS h, o_orderkey // 19 % 8 + 2 AS t, o_orderkey // 152 AS k FROM orders)""")
def numbers_said(spark, sf_dir):
    """Numbers in words of a sentence, and not the small ones beside them."""
    (orders,) = tables(spark, sf_dir, "orders")
    words = lambda w, i: F.element_at(F.array(*map(F.lit, w)), i.cast("int") + 1)
    key = F.col("o_orderkey")
    h, t, k = key % 19 + 1, F.floor(key / 19) % 8, F.floor(key / 152)
    small = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit(" and "), words(T.TENS, t), F.lit("-"), words(T.UNITS, k % 10)))
    said = F.concat(F.lit("We counted "), words(T.UNITS, h), F.lit(" Thousand"), small, F.lit(", then "), words(T.UNITS, h), F.lit(" hundred in eight boxes"))
    return orders.select("o_orderkey", T.numbers_in_words(said).alias("numbers"))


@query(f"""{event_levels_sql()}
    SELECT event_id AS record_id, CASE WHEN who = event_id THEN CASE WHEN target <> most THEN 'AMBIGUOUS_KEY_MATCH' ELSE 'COVERED_ENTITY_MISMATCH' END ELSE 'NO_KEY_MATCH' END AS reason,
        CASE WHEN target = most AND NOT clash THEN target END AS episode_id, CASE WHEN target = most AND NOT clash THEN who END AS resolved_by
    FROM events LEFT JOIN judged USING (event_id) WHERE event_type <> 'signup' AND (who IS DISTINCT FROM event_id OR target <> most OR clash)""")
def parks_and_resolutions(spark, sf_dir):
    """Events in three batches of ten days: what parked when it came, why, and what resolved it later."""
    from tallyloom.streaming.pool import Pool

    lookups, anchors, publishes = event_keys(spark, sf_dir)
    pool = Pool(spark, _folder(spark, "pool"))
    lookups, anchors = stored(lookups, "lookups"), stored(anchors, "anchors")
    ends = ["2024-01-11", "2024-01-21", "9999"]
    for step, (since, until) in enumerate(zip(["", *ends], ends)):
        here = lookups.where((F.col("at") >= since) & (F.col("at") < until))
        came = anchors.where((F.col("first_seen_at") >= since) & (F.col("first_seen_at") < until))
        pool.advance(here, came, publishes.join(here.select("record_id").distinct(), "record_id", "left_semi"), step=step)
    both = pool.parks().join(pool.resolutions(), "record_id", "left")
    return both.select(F.col("record_id").cast("long").alias("record_id"), "reason", F.col("episode_id").cast("long").alias("episode_id"), F.col("resolved_by").cast("long").alias("resolved_by"))
