"""Files as rows: numbers of lines, headers in any order, rows of unknown type, hashes, and what is refused."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import controls, feeds, files
from tallyloom.sources.feeds import Source

BANK = feeds.BANK_COLUMNS


def bank_file(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *[",".join(r.get(c, "") for c in columns) for r in rows]]) + "\n")


def test_bank_columns_go_by_each_files_own_header(spark, tmp_path):
    one = {"posting_date": "2025-07-11", "description": "ACH", "ach_trace_number": "T1", "amount": "90.00", "type": "CREDIT", "received_at": "2025-07-11T10:00:00Z"}
    two = dict(one, ach_trace_number="T2", amount="-5.10", trn02="X")
    bank_file(tmp_path / "a.csv", BANK, [one])
    bank_file(tmp_path / "b.csv", BANK[::-1], [two])
    rows = feeds.read_bank_csv(spark, Source("b", "BANK", "BANK_CSV", (str(tmp_path),)), "2025-08-01T00:00:00Z").collect()
    assert {r["source_record_id"]: json.loads(r["payload"]) for r in rows} == {"T1": one, "T2": two}
    assert {r["line_no"] for r in rows} == {2} and len({r["raw_id"] for r in rows}) == 2


@pytest.mark.parametrize("columns", [BANK[:-1], [*BANK, "extra"], [*BANK[:-1], BANK[0]], ["amount", "posting_date", "description"]])
def test_an_unknown_bank_header_is_refused(spark, tmp_path, columns):
    bank_file(tmp_path / "a.csv", columns, [{"amount": "1.00"}])
    with pytest.raises(Exception, match="UnreadableFile"):
        feeds.read_bank_csv(spark, Source("b", "BANK", "BANK_CSV", (str(tmp_path),)), "x").collect()


def test_vendor_rows_of_every_type_land(spark, tmp_path):
    (tmp_path / "a.csv").write_text('record_type,Rx,stamp,note\nDETAIL,7,,"two\nlines"\n,8,,\nODD,9,2025-07-02T00:00:00Z,"a ""b"""\n\nTRAILER,,,\n')
    (tmp_path / "b.csv").write_text("﻿stamp,Rx,record_type,declared_record_count\n,r9,DETAIL,\n,r10,DETAIL,,spare\n,,TRAILER,2\n".replace("﻿", "﻿"))
    (tmp_path / "c.csv").write_text("Rx,stamp\n1,\n")
    (tmp_path / "d.csv").write_text("")
    source = Source("v", "TPA_VERITY", "VENDOR_CSV", (str(tmp_path),), "stamp", renames={"Rx": "rx_number"})
    raw, marks = feeds.read_vendor_csv(spark, source, "2025-07-31T00:00:00Z")
    got = sorted((r["file"][-5:], r["line_no"], r["received_at"], json.loads(r["payload"])) for r in raw.collect())
    late = "2025-07-31T00:00:00Z"
    assert got == [
        ("a.csv", 2, late, {"record_type": "DETAIL", "rx_number": "7", "note": "two\nlines"}), ("a.csv", 3, late, {"rx_number": "8"}),
        ("a.csv", 4, "2025-07-02T00:00:00Z", {"record_type": "ODD", "rx_number": "9", "stamp": "2025-07-02T00:00:00Z", "note": 'a "b"'}),
        ("b.csv", 2, late, {"record_type": "DETAIL", "rx_number": "r9"}), ("b.csv", 3, late, {"record_type": "DETAIL", "rx_number": "r10", "_more": ["spare"]}), ("c.csv", 2, late, {"rx_number": "1"}),
    ]
    totals = {r["file"][-5:]: (r["has_trailer"], r["declared_count"]) for r in controls.declared(marks, "file").collect()}
    assert totals == {"a.csv": (True, None), "b.csv": (True, 2), "c.csv": (None, None)}


@pytest.mark.parametrize("text", [b"a,a\n1,2\n", b"a,,c\n1,2,3\n", b'a,b\n1,"2\n', b"a,b\n1,\xff\n"])
def test_unreadable_files_are_refused_whole(spark, tmp_path, text):
    (tmp_path / "x.csv").write_bytes(text)
    with pytest.raises(Exception, match="UnreadableFile"):
        files.read_delimited(spark, [str(tmp_path)]).collect()


def test_lines_count_from_one_over_all_splits_of_a_file(spark, tmp_path):
    lines = ["" if i % 7 == 3 else json.dumps({"record_id": str(i), "pad": "x" * (i % 90)}) for i in range(1, 4001)]
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines[: 4000 if name[0] == "a" else 100]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = files.read_lines(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 100)):
        assert sorted((r["line_no"], r["payload"]) for r in rows if r["file"].endswith(name)) == [(i + 1, x) for i, x in enumerate(lines[:n]) if x]
        sha = hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
        assert {r["file_sha256"] for r in rows if r["file"].endswith(name)} == {sha}


def test_same_named_files_share_no_raw_id_and_equal_files_land_once(spark, tmp_path):
    for folder, text in (("1", '{"a": 1}\n{"a": 2}\n'), ("2", '{"a": 1}\n{"a": 3}\n'), ("3", '{"a": 1}\n{"a": 2}\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "c.jsonl").write_text(text)
    source = Source("s", "PBM_ADJUDICATION", "JSONL", tuple(str(tmp_path / f) for f in "123"))
    raw = feeds.read_jsonl(spark, source, "2025-01-01T00:00:00Z")
    assert raw.count() == raw.select("raw_id").distinct().count() == 4
    seen = files.file_hashes(spark, "s", [str(tmp_path / "1")])
    fresh = feeds.new_files(files.file_hashes(spark, "s", [str(tmp_path / "2"), str(tmp_path / "3")]), seen)
    assert [r["name"][-9:] for r in fresh.collect()] == ["2/c.jsonl"]


def test_a_delivery_without_a_stamp_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Rx\n1\n")
    source = Source("craneware_claims_report", "TPA_CRANEWARE", "VENDOR_CSV", (str(tmp_path),), None)
    for epoch in ("1970-01-01T00:00:00Z", "1970-01-01T00:00:00+00:00", "1970-01-01", "1969-12-31T19:00:00-05:00", "1970-01-01 00:00:00"):
        with pytest.raises(feeds.MissingDeliveryStamp):
            feeds.read_vendor_csv(spark, source, epoch)
    for fine in ("2025-07-01T00:00:00Z", "1970-01-01T00:00:01Z", "delivery 7"):
        raw, _ = feeds.read_vendor_csv(spark, source, fine)
        assert [r["received_at"] for r in raw.select("received_at").collect()] == [fine]
    stamped = Source("v", "TPA_VERITY", "VENDOR_CSV", (str(tmp_path),), "stamp")
    assert feeds.read_vendor_csv(spark, stamped, "1970-01-01T00:00:00Z")[0].count() == 1


def test_no_file_is_an_empty_table(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "e.jsonl").write_text("\n\n")
    assert files.read_delimited(spark, [str(tmp_path / "e.csv")]).count() == 0
    assert files.read_lines(spark, [str(tmp_path / "e.jsonl")]).where(F.col("line_no") > 0).count() == 0
