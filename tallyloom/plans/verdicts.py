"""Queries on rules: configurations, verdicts, flags, dispositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import reads, rules
from tallyloom.plans.leaves import DOMAINS, depth, violations
from tallyloom.plans.registry import cents, cents_sql, query, tables

_COLUMNS = ", ".join(rules.DIMENSIONS)


#: A line's number, from which every dimension's value is chosen.
_NUMBER = "l_partkey * 31 + l_suppkey * 17 + l_orderkey * 7 + l_linenumber"
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _leaf_ctes() -> str:
    parts, before = [], f"(SELECT {_LINE}, {_NUMBER} AS n FROM lineitem)"
    for k, (name, choices) in enumerate(DOMAINS.items()):
        cases = " ".join(f"WHEN {c} THEN list_extract([{', '.join(repr(v) for v in values)}], 1 + ((n // {k + 2} + n * {k + 1}) % {len(values)}))" for c, values in choices)
        parts.append(f"s{k} AS (SELECT *, CASE {cases} END AS {name} FROM {before})")
        before = f"s{k}"
    return "WITH " + ",\n ".join(parts) + f",\n leaves AS (SELECT {_LINE}, {_COLUMNS} FROM {before})"


def line_configurations(spark, sf_dir):
    """A configuration for every line of every order: each variable that is asked has one of its values, by the line's number."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    out = lines.selectExpr(*_LINE.split(", "), f"{_NUMBER} AS n")
    for k, (name, choices) in enumerate(DOMAINS.items()):
        value = None
        for condition, values in choices:
            one = F.element_at(F.array(*map(F.lit, values)), F.expr(f"CAST(1 + (n div {k + 2} + n * {k + 1}) % {len(values)} AS INT)"))
            value = F.when(F.expr(condition), one) if value is None else value.when(F.expr(condition), one)
        out = out.withColumn(name, value)
    return out.drop("n")


# The rules again, written as SQL from the specification and not from the tables of the rules module.
_PHARMACY_SQL = """CASE WHEN ph_adjudication = 'REJECTED' THEN 'A-01' WHEN ph_post_event = 'REVERSAL_PRE_PAY' THEN 'A-16'
    WHEN ph_post_event = 'REVERSAL_POST_PAY' THEN CASE WHEN cash_reimb_out = 'MATCHED' THEN 'A-10' ELSE 'A-11' END
    WHEN ph_post_event = 'RECOUPMENT' THEN CASE WHEN cash_reimb_out = 'MATCHED' THEN 'A-12' ELSE 'A-13' END
    WHEN ph_payment = 'NONE' THEN 'A-02' WHEN ph_payment = 'DUPLICATE' THEN 'A-17' WHEN ph_payment = 'OVER' THEN 'A-09'
    WHEN ph_post_event = 'ADJUSTMENT' THEN CASE WHEN cash_reimb_in = 'MATCHED' THEN 'A-14' ELSE 'A-15' END
    WHEN ph_payment = 'PARTIAL' THEN CASE WHEN cash_reimb_in = 'ABSENT' THEN 'A-08' ELSE 'A-07' END
    WHEN cash_reimb_in = 'ABSENT' THEN 'A-05' WHEN cash_reimb_in = 'PARTIAL' THEN 'A-07' WHEN ph_settlement = 'MISSING' THEN 'A-06' ELSE 'A-04' END"""
_MEDICAL_SQL = """CASE WHEN md_clearinghouse = 'REJECTED' THEN 'B-01' WHEN md_post_event = 'RECOUPMENT' THEN 'B-15' WHEN md_remittance = 'NONE' THEN 'B-02'
    WHEN md_remittance = 'DUPLICATE_835' THEN 'B-16'
    WHEN md_remittance = 'PAID_FULL' THEN CASE cash_reimb_in WHEN 'ABSENT' THEN 'B-05' WHEN 'PARTIAL' THEN 'B-06' ELSE 'B-04' END
    WHEN md_appeal = 'WON' AND cash_reimb_in = 'ABSENT' THEN 'B-14'
    WHEN md_remittance = 'PARTIAL' THEN CASE md_appeal WHEN 'NOT_FILED' THEN 'B-06' WHEN 'PENDING' THEN 'B-07' WHEN 'WON' THEN 'B-08' ELSE 'B-09' END
    ELSE CASE md_appeal WHEN 'NOT_FILED' THEN 'B-10' WHEN 'PENDING' THEN 'B-11' WHEN 'WON' THEN 'B-12' ELSE 'B-13' END END"""
_REBATE_SQL = """CASE WHEN r_present = 'ABSENT' THEN 'C-00' WHEN r_qualification = 'PENDING' THEN 'C-01' WHEN r_qualification = 'NOT_QUALIFIED' THEN 'C-02'
    WHEN r_request = 'NOT_SUBMITTED' THEN 'C-03' WHEN r_manufacturer = 'PENDING' THEN 'C-05' WHEN r_manufacturer = 'REJECTED' THEN 'C-07'
    WHEN r_payment = 'NONE' THEN 'C-11' WHEN r_payment = 'CLAWED_BACK' THEN 'C-13' WHEN r_payment = 'DUPLICATE' THEN 'C-14' WHEN r_payment = 'PARTIAL' THEN 'C-10'
    WHEN cash_rebate_in = 'ABSENT' THEN 'C-09' WHEN cash_rebate_in = 'PARTIAL' THEN 'C-10' ELSE 'C-08' END"""
_CODED = f"coded AS (SELECT *, CASE reimb_type WHEN 'PHARMACY' THEN {_PHARMACY_SQL} ELSE {_MEDICAL_SQL} END AS reimbursement_code, {_REBATE_SQL} AS rebate_code FROM leaves)"
_UNDISPENSED = "(reimb_type = 'PHARMACY' AND (ph_adjudication = 'REJECTED' OR coalesce(ph_post_event, '') IN ('REVERSAL_PRE_PAY', 'REVERSAL_POST_PAY')))"
_FAILED = """(coalesce(ph_adjudication, '') = 'REJECTED' OR coalesce(md_clearinghouse, '') = 'REJECTED' OR (coalesce(md_remittance, '') = 'DENIED' AND coalesce(md_appeal, '') IN ('NOT_FILED', 'LOST')))"""
_SETTLED = """(cash_reimb_in = 'MATCHED' AND ((ph_settlement = 'CONFIRMED' AND ph_post_event IN ('NONE', 'ADJUSTMENT')) OR (md_remittance = 'PAID_FULL' AND md_post_event = 'NONE')))"""
_FLAGGED = f"""flagged AS (SELECT *, list_filter([
    CASE WHEN {_FAILED} AND r_payment IN ('PARTIAL', 'FULL', 'DUPLICATE') THEN 'X-1' END,
    CASE WHEN {_UNDISPENSED} AND r_manufacturer = 'APPROVED' AND r_payment IS DISTINCT FROM 'CLAWED_BACK' THEN 'X-2' END,
    CASE WHEN ph_post_event = 'RECOUPMENT' AND r_qualification = 'QUALIFIED' THEN 'X-3' END,
    CASE WHEN {_SETTLED} AND r_manufacturer = 'REJECTED' THEN 'X-4' END,
    CASE WHEN cash_reimb_in = 'ABSENT' AND cash_rebate_in = 'ABSENT' THEN 'X-5' END,
    CASE WHEN {_FAILED} AND (r_manufacturer = 'REJECTED' OR r_qualification = 'NOT_QUALIFIED') THEN 'X-6' END,
    CASE WHEN md_appeal = 'WON' AND r_payment = 'CLAWED_BACK' THEN 'X-7' END], lambda x: x IS NOT NULL) AS flags,
    CASE WHEN {_UNDISPENSED} AND r_present <> 'ABSENT' AND r_qualification IS DISTINCT FROM 'NOT_QUALIFIED' AND r_payment IS DISTINCT FROM 'CLAWED_BACK' THEN 'ANOMALY' ELSE 'COHERENT' END AS coherence FROM coded)"""
_RANKS = "CASE code WHEN 'EXCEPTION' THEN 2 WHEN 'PENDING' THEN 1 WHEN 'CLOSED' THEN 0 END"
_CLOSED = "'A-01', 'A-04', 'A-10', 'A-12', 'A-14', 'A-16', 'B-04', 'B-08', 'B-12', 'C-02', 'C-07', 'C-08'"
_PENDING = "'A-02', 'B-02', 'B-07', 'B-11', 'C-01', 'C-03', 'C-05', 'C-11'"


def _rank(code: str) -> str:
    return f"CASE WHEN {code} = 'C-00' THEN -1 WHEN {code} IN ({_CLOSED}) THEN 0 WHEN {code} IN ({_PENDING}) THEN 1 ELSE 2 END"


_HEAD = _leaf_ctes()


@query(f"{_HEAD} SELECT {_COLUMNS}, count(*) AS lines FROM leaves GROUP BY ALL")
def leaf_enumeration(spark, sf_dir):
    """The configurations that lines have."""
    return line_configurations(spark, sf_dir).groupBy(*rules.DIMENSIONS).agg(F.count("*").alias("lines"))


@query(f"""{_HEAD} SELECT {_LINE} FROM leaves WHERE l_orderkey % 13 = 0 OR (l_orderkey % 13 = 1 AND ph_adjudication IS NULL) OR (l_orderkey % 13 = 2 AND r_present = 'PRESENT')""")
def leaf_validation(spark, sf_dir):
    """Some lines get a value that no domain has, one that was not asked for, or none where one was: those and no others are found."""
    rows, kind = line_configurations(spark, sf_dir), F.col("l_orderkey") % 13
    broken = rows.withColumns({
        "cash_reimb_in": F.when(kind == 0, F.lit("SOON")).otherwise(F.col("cash_reimb_in")), "ph_payment": F.when((kind == 1) & F.col("ph_adjudication").isNull(), F.lit("FULL")).otherwise(F.col("ph_payment")),
        "r_qualification": F.when(kind != 2, F.col("r_qualification")),
    })
    return violations(broken).select(*_LINE.split(", "))


@query(f"{_HEAD}, {_CODED} SELECT reimbursement_code, rebate_code, count(*) AS lines FROM coded GROUP BY ALL")
def verdict_pair_counts(spark, sf_dir):
    return rules.classified(line_configurations(spark, sf_dir)).groupBy("reimbursement_code", "rebate_code").agg(F.count("*").alias("lines"))


@query(f"{_HEAD}, {_CODED}, {_FLAGGED} SELECT {_LINE}, reimbursement_code, rebate_code, flags, coherence FROM flagged")
def verdict_classify(spark, sf_dir):
    return rules.classified(line_configurations(spark, sf_dir)).select(*_LINE.split(", "), "reimbursement_code", "rebate_code", "flags", "coherence")


@query(f"{_HEAD}, {_CODED}, {_FLAGGED} SELECT flag, count(*) AS lines FROM (SELECT unnest(flags) AS flag FROM flagged) GROUP BY flag")
def cross_track_flags(spark, sf_dir):
    return rules.classified(line_configurations(spark, sf_dir)).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("lines"))


_RANKED = f"""ranked AS (SELECT *, greatest({_rank('reimbursement_code')}, {_rank('rebate_code')}, CASE WHEN len(list_filter(flags, lambda x: x <> 'X-4')) > 0 THEN 2 ELSE -1 END) AS r FROM flagged)"""


@query(f"""{_HEAD}, {_CODED}, {_FLAGGED}, {_RANKED}
    SELECT reimbursement_code, rebate_code, flags, CASE r WHEN 2 THEN 'EXCEPTION' WHEN 1 THEN 'PENDING' WHEN 0 THEN 'CLOSED' END AS disposition, count(*) AS lines FROM ranked GROUP BY ALL""")
def disposition_rollup(spark, sf_dir):
    rows = rules.composed(rules.classified(line_configurations(spark, sf_dir)))
    return rows.groupBy("reimbursement_code", "rebate_code", "flags", "disposition").agg(F.count("*").alias("lines"))


# Why, by code and by flag, written from the specification.
_WHY = """CASE code WHEN 'A-01' THEN ['REJECTED_AT_POS'] WHEN 'A-02' THEN ['AWAITING_REMITTANCE'] WHEN 'A-05' THEN ['NO_CASH'] WHEN 'A-06' THEN ['SETTLEMENT_MISSING']
    WHEN 'A-07' THEN ['UNDERPAID'] WHEN 'A-08' THEN ['UNDERPAID', 'NO_CASH'] ELSE [] END"""


@query(f"""{_HEAD}, {_CODED} SELECT {_LINE}, len(reasons) AS reasons, reasons[1] AS first_reason FROM (SELECT *, {_WHY.replace('code', 'reimbursement_code')} AS reasons FROM coded
    WHERE reimbursement_code IN ('A-01', 'A-02', 'A-04', 'A-05', 'A-06', 'A-07', 'A-08') AND rebate_code = 'C-00') WHERE list_contains(['A-01', 'A-02', 'A-04', 'A-05', 'A-06', 'A-07', 'A-08'], reimbursement_code)""")
def reasons_of_lines(spark, sf_dir):
    """Reasons of lines without a rebate track that no flag can hold for."""
    rows = rules.composed(rules.classified(line_configurations(spark, sf_dir))).where("rebate_code = 'C-00' AND reimbursement_code IN ('A-01', 'A-02', 'A-04', 'A-05', 'A-06', 'A-07', 'A-08')")
    return rows.select(*_LINE.split(", "), F.size("reasons").cast("long").alias("reasons"), F.get("reasons", F.lit(0)).alias("first_reason"))


@query(f"""{_HEAD}, depths AS (SELECT reimb_type, {' + '.join(f'CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END' for n in rules.DIMENSIONS)} AS d FROM leaves)
    SELECT reimb_type, CAST(min(d) AS BIGINT) AS least, CAST(max(d) AS BIGINT) AS most, CAST(sum(d) AS BIGINT) AS total FROM depths GROUP BY reimb_type""")
def leaf_depths(spark, sf_dir):
    rows = line_configurations(spark, sf_dir).withColumn("d", depth())
    return rows.groupBy("reimb_type").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.sum("d").alias("total"))


def _pairs(rows):
    """Every code of one track with every code of the other that lines have: 31 and 12 codes at most, and no data, are combined."""
    return rows.select("reimbursement_code").distinct().crossJoin(rows.select("rebate_code").distinct())


_PAIRS = "pairs AS (SELECT a.reimbursement_code, c.rebate_code FROM (SELECT DISTINCT reimbursement_code FROM coded) a, (SELECT DISTINCT rebate_code FROM coded) c)"


@query(f"{_HEAD}, {_CODED}, {_PAIRS} SELECT * FROM pairs")
def reachable_pairs(spark, sf_dir):
    return _pairs(rules.classified(line_configurations(spark, sf_dir)))


@query(f"{_HEAD}, {_CODED}, {_PAIRS} SELECT * FROM pairs EXCEPT SELECT reimbursement_code, rebate_code FROM coded WHERE reimbursement_code <> 'A-05'")
def missing_pairs(spark, sf_dir):
    """Pairs that could be but are not among those of the lines, from which one code was taken out."""
    rows = rules.classified(line_configurations(spark, sf_dir)).select("reimbursement_code", "rebate_code")
    return _pairs(rows).exceptAll(rows.where("reimbursement_code <> 'A-05'").distinct())


_PAYMENT = """CASE WHEN n = 0 THEN 'NONE' WHEN n > 1 AND amounts = 1 THEN 'DUPLICATE' WHEN paid > expected THEN 'OVER' WHEN paid = expected THEN 'FULL' WHEN paid > 0 THEN 'PARTIAL' ELSE 'NONE' END"""


@query(f"""WITH p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS amounts, CAST(sum({cents_sql('l_extendedprice')}) AS BIGINT) AS paid FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, {_PAYMENT.replace('expected', cents_sql('o_totalprice')).replace('n = 0', 'n IS NULL')} AS payment FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def payment_dimension(spark, sf_dir):
    from tallyloom.operators.dimensions import payment_state
    from tallyloom.operators.folds import one_amount

    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    paid = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), one_amount("l_quantity").alias("is_duplicate"), F.sum(cents("l_extendedprice")).alias("paid"))
    rows = orders.join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", payment_state(F.col("lines"), F.col("is_duplicate"), F.col("paid"), cents("o_totalprice")).alias("payment"))


@query(f"""WITH p AS (SELECT l_orderkey, CAST(sum({cents_sql('l_extendedprice')}) AS BIGINT) AS received FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN {cents_sql('o_totalprice')} = 0 THEN NULL WHEN coalesce(received, 0) = 0 THEN 'ABSENT' WHEN received >= {cents_sql('o_totalprice')} THEN 'MATCHED' ELSE 'PARTIAL' END AS cash_in
    FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def cash_dimension(spark, sf_dir):
    from tallyloom.operators.dimensions import cash_in

    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    received = lines.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("received"))
    rows = orders.join(received, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", cash_in(cents("o_totalprice"), F.coalesce("received", F.lit(0))).alias("cash_in"))


@query("""SELECT o_orderstatus AS state, count(DISTINCT o_custkey) AS episodes FROM orders GROUP BY o_orderstatus""")
def archetype_counts(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return reads.overview(orders.withColumn("state", F.col("o_orderstatus")), "state", ["F", "O", "P"], {"episodes": F.count_distinct("o_custkey")})
