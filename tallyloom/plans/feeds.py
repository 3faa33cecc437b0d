"""Queries on raw rows: contracts, authority, control totals, JSON, redaction, quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.keys import canonical_json
from tallyloom.functions.redaction import redaction
from tallyloom.operators import quotes
from tallyloom.operators.matching import contradicts
from tallyloom.plans.registry import cents, cents_sql, query, tables
from tallyloom.sources.contracts import Field, authority_breaches, violations
from tallyloom.sources.controls import reconciled


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS canonical FROM events")
def json_canonical_extract(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), canonical_json("user_id", "event_id", "event_type").alias("canonical"))


@query("""SELECT event_id, '{"event_id": ' || event_id || ', "paid": 12.50, "claim": {"bin": "[REDACTED:PHI]", "lines": [{"cardholder_id": "[REDACTED:PHI]", "kind": "' || event_type
    || '"}], "note": "pcn=[REDACTED:PHI], cabin=3"}}' AS payload, ['bin', 'cardholder_id', 'pcn'] AS removed FROM events""")
def phi_redaction(spark, sf_dir):
    """Payloads with private values in an object of objects, in a list and in a sentence; all else stays byte by byte."""
    (events,) = tables(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    line = F.concat(F.lit('{"cardholder_id": {"no": '), user, F.lit('}, "kind": "'), F.col("event_type"), F.lit('"}'))
    note = F.concat(F.lit('"pcn='), user, F.lit(', cabin=3"'))
    claim = F.concat(F.lit('{"bin": "610'), user, F.lit('", "lines": ['), line, F.lit('], "note": '), note, F.lit("}"))
    payload = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "paid": 12.50, "claim": '), claim, F.lit("}"))
    return events.select("event_id", redaction(payload).alias("r")).select("event_id", "r.payload", "r.removed")


@query("""SELECT event_id, list_filter([CASE WHEN NOT regexp_matches(CAST(value AS VARCHAR), '^[0-9]{1,2}\\.[0-9]+$') THEN 'value: KIND' END,
    CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type: CODE' END], lambda x: x IS NOT NULL) AS violations FROM events
    WHERE NOT regexp_matches(CAST(value AS VARCHAR), '^[0-9]{1,2}\\.[0-9]+$') OR event_type NOT IN ('click', 'view', 'purchase')""")
def schema_contract_violations(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select("event_id", F.col("value").cast("string").alias("value"), "event_type")
    contract = [Field("value", "PATTERN", pattern=r"^[0-9]{1,2}\.[0-9]+$", says="KIND"), Field("event_type", "CODE", codes=("click", "view", "purchase"), says="CODE")]
    return rows.select("event_id", violations(contract).alias("violations")).where(F.size("violations") > 0)


@query("""SELECT event_id, event_type FROM events WHERE (event_type, user_id % 3) NOT IN (('click', 0), ('click', 1), ('view', 0), ('view', 1), ('view', 2), ('purchase', 2))""")
def authority_breach(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select("event_id", "event_type", (F.col("user_id") % 3).cast("string").alias("source"))
    allowed = [("click", "0"), ("click", "1"), ("view", "0"), ("view", "1"), ("view", "2"), ("purchase", "2")]
    return authority_breaches(rows, "event_type", "source", allowed).select("event_id", "event_type")


@query("""WITH observed AS (SELECT source, count(*) AS observed_count FROM documents GROUP BY source), declared AS (SELECT source, max(doc_id) % 40 + 10 AS declared_count FROM documents GROUP BY source)
    SELECT source, declared_count, observed_count, declared_count IS NOT DISTINCT FROM observed_count AS agrees FROM observed JOIN declared USING (source)""")
def control_totals(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    declared = docs.groupBy("source").agg((F.max("doc_id") % 40 + 10).alias("declared_count"))
    return reconciled(docs.groupBy("source").agg(F.count("*").alias("observed_count")), declared, "source")


_FLAT = "lower(trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query(f"""WITH d AS MATERIALIZED (SELECT doc_id, {_FLAT.format("text")} AS flat FROM documents), b AS MATERIALIZED (SELECT item_id, {_FLAT.format("text")} AS quote FROM benchmark)
    SELECT doc_id, item_id FROM d JOIN b ON contains(flat, quote)""")
def quoted_span_verified(spark, sf_dir):
    """Every benchmark text, whole, against all documents."""
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return quotes.quoted_in(docs.select("doc_id", "text"), benchmark.select("item_id", F.col("text").alias("quote")), "doc_id", "item_id")


@query(f"""SELECT o_orderkey, CASE WHEN {cents_sql('o_totalprice')} = o_orderkey * 100 THEN [CAST(o_orderkey AS VARCHAR) || '.00', CAST(o_orderkey AS VARCHAR)]
    ELSE [({cents_sql('o_totalprice')} // 100) || '.' || lpad(CAST({cents_sql('o_totalprice')} % 100 AS VARCHAR), 2, '0'), CAST(o_orderkey AS VARCHAR)] END AS numbers FROM orders""")
def numbers_present(spark, sf_dir):
    """Amounts in a sentence: separators go, a date and an identifier with letters are none."""
    (orders,) = tables(spark, sf_dir, "orders")
    amount = F.format_number((cents("o_totalprice") / 100).cast("decimal(20,2)"), 2)
    key = F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("Deposit of $"), amount, F.lit(" on 2024-05-01 for ORD-"), key, F.lit(" in "), key, F.lit(" parts."))
    return orders.select("o_orderkey", T.numbers_in(said).alias("numbers"))


@query("""SELECT coalesce(a.name, b.name) AS name FROM (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS h FROM documents) a
    FULL OUTER JOIN (SELECT doc_id || CASE WHEN doc_id % 7 = 0 THEN 'b' ELSE '' END AS name, sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END) AS h FROM documents) b
    ON a.name = b.name WHERE a.h IS DISTINCT FROM b.h""")
def manifest_diff(spark, sf_dir):
    """All documents against all of them after some were renamed and some changed."""
    from tallyloom.sources.landing import changed_files

    (docs,) = tables(spark, sf_dir, "documents")
    name, text = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("sha256")
    renamed = F.concat(name, F.when(F.col("doc_id") % 7 == 0, "b").otherwise(""))
    left = docs.select(name.alias("name"), sha(text))
    right = docs.select(renamed.alias("name"), sha(F.concat(text, F.when(F.col("doc_id") % 10 == 0, "!").otherwise(""))))
    return changed_files(left, right).select("name")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality <> toxic")
def both_present_and_different(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.join(labels, "doc_id").where(contradicts(F.col("quality"), F.col("toxic"))).select("doc_id")
