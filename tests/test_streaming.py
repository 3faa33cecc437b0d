import json

from pyspark.sql import functions as F
from scenario import claim, deposit, raw_rows, remittance

from tallyloom.operators.normalize import normalized
from tallyloom.sources.feeds import Source, read
from tallyloom.streaming.incremental import ingest, touched


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    sent = [claim(1), remittance(1, [(1, 120.0, 90.0)], 90.0), deposit(1, 90.0), dict(claim(1), received_at="2025-07-09T10:00:00Z"), "{broken"]
    raw = raw_rows(spark, sent)
    folder = f"{tmp_path}/in"
    raw.limit(3).write.mode("append").parquet(folder)
    out = [f"{tmp_path}/{n}" for n in ("records", "quarantine", "checkpoint")]
    ingest(spark, folder, *out).awaitTermination()
    raw.where("raw_id >= 'raw0003'").write.mode("append").parquet(folder)
    for _ in range(2):
        ingest(spark, folder, *out).awaitTermination()
    records, refused = normalized(raw)
    ids = lambda df, c: sorted(r[c] for r in df.select(c).collect())
    stored = spark.read.parquet(out[0])
    assert ids(stored, "record_id") == ids(records, "record_id")
    assert ids(spark.read.parquet(out[1]), "raw_id") == ids(refused, "raw_id") == ["raw0004"]
    attachments = stored.select("record_id", F.lit("e").alias("episode_id"))
    assert touched(stored.limit(1), attachments).count() == 1


def test_a_later_copy_of_a_parent_drops_its_children(spark, tmp_path):
    """Copies days apart, in other batches; an unreadable first delivery takes no id."""
    first = remittance(1, [(1, 120.0, 90.0)], 90.0)
    copy = dict(remittance(1, [(1, 120.0, 90.0), (2, 50.0, 40.0)], 130.0), received_at="2025-09-01T10:00:00Z")
    broken = dict(claim(9), transaction_code="??")
    out = [f"{tmp_path}/{n}" for n in ("records", "quarantine", "checkpoint")]
    raw = raw_rows(spark, [first, broken, copy, dict(claim(9), received_at="2025-08-01T10:00:00Z"), first])
    for ids in (("raw0000", "raw0001"), ("raw0002", "raw0003"), ("raw0004",)):
        raw.where(F.col("raw_id").isin(*ids)).write.mode("append").parquet(f"{tmp_path}/in")
        ingest(spark, f"{tmp_path}/in", *out).awaitTermination()
    stored = spark.read.parquet(out[0])
    assert {r["raw_id"] for r in stored.collect()} == {"raw0000", "raw0003"}
    assert stored.where("raw_id = 'raw0000'").count() == 2 and [r["raw_id"] for r in spark.read.parquet(out[1]).collect()] == ["raw0001"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [claim(1), claim(2)])) + "\n\n")
    (tmp_path / "bank.csv").write_text(
        "posting_date,description,ach_trace_number,trn02,company_name,company_id,company_entry_description,amount,type,running_balance,received_at\n2025-07-11,ACH,1,,ACME,1,X,90.00,CREDIT,1.00,2025-07-11T10:00:00Z\n"
    )
    (tmp_path / "v.csv").write_text("record_type,Rx,stamp\nDETAIL,7,\nODD,8,2025-07-02T00:00:00Z\nTRAILER,,\n")
    sources = [
        Source("a", "PBM_ADJUDICATION", "JSONL", (f"{tmp_path}/a.jsonl",)), Source("b", "BANK", "BANK_CSV", (f"{tmp_path}/bank.csv",)),
        Source("v", "TPA_VERITY", "VENDOR_CSV", (f"{tmp_path}/v.csv",), "stamp", renames={"Rx": "rx_number"}), Source("off", "BANK", "JSONL", ("nowhere",), enabled=False),
    ]
    rows = read(spark, sources, "2025-07-31T00:00:00Z").collect()
    assert sorted(r["source_id"] for r in rows) == ["a", "a", "b", "v", "v"]
    bank = next(r for r in rows if r["source_id"] == "b")
    assert "trn02" not in json.loads(bank["payload"]) and bank["received_at"] == "2025-07-11T10:00:00Z"
    vendor = sorted((json.loads(r["payload"])["rx_number"], r["received_at"]) for r in rows if r["source_id"] == "v")
    assert vendor == [("7", "2025-07-31T00:00:00Z"), ("8", "2025-07-02T00:00:00Z")]
    assert read(spark, sources, "x", exclude=("TPA_VERITY",)).count() == 3
