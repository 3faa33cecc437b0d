"""Redaction: private values go, every other byte stays, and what cannot be judged is refused."""

import json
import random

from pyspark.sql import functions as F

from tallyloom.functions import redaction as R

M = R.REDACTED


def test_json_keeps_every_other_byte():
    assert R.redacted_text('{"bin" : {"a": ["x"]},\n "lines":[{"pcn": 7, "qty": 2}], "name": "bin"}') == (f'{{"bin" : "{M}",\n "lines":[{{"pcn": "{M}", "qty": 2}}], "name": "bin"}}', ["bin", "pcn"])
    for number in ("1200.50", "12345678901234567.89", "1e400", "-0.0", "1E+2"):
        assert R.redacted_text(f'{{"paid":{number},"bin":{number}}}') == (f'{{"paid":{number},"bin":"{M}"}}', ["bin"])
    assert R.redacted_text('[{"group_id": null}]') == (f'[{{"group_id": "{M}"}}]', ["group_id"])
    assert R.redacted_text('{"\\u0062in": "1\\"23", "x": "\\u00e9"}') == (f'{{"\\u0062in": "{M}", "x": "\\u00e9"}}', ["bin"])
    assert R.redacted_text('{"bin": [1, {"a": "]}"}], "bin": "2"}') == (f'{{"bin": "{M}", "bin": "{M}"}}', ["bin"])


def test_strings_inside_strings():
    assert R.redacted_text('{"note": "cardholder_id=77"}') == (f'{{"note": "cardholder_id={M}"}}', ["cardholder_id"])
    inner = json.dumps({"pcn": "5", "deep": json.dumps({"bin": "9", "n": 1.50})})
    text, removed = R.redacted_text(json.dumps({"payload": inner}))
    found = json.loads(json.loads(text)["payload"])
    assert removed == ["bin", "pcn"] and found["pcn"] == M and json.loads(found["deep"]) == {"bin": M, "n": 1.5}
    assert R.redacted_text('{"note": "the cardholder_id is 77"}') == (None, None)
    assert R.redacted_text('["say \'bin=5\' now"]') == (f"[\"say 'bin={M}' now\"]", ["bin"])


def test_plain_texts():
    assert R.redacted_text("prescriber_npi='12 34' and cardholder_id: 77, rest") == (f"prescriber_npi={M} and cardholder_id: {M}, rest", ["cardholder_id", "prescriber_npi"])
    assert R.redacted_text("bin=610001; the cardholder_id is 77") == (None, None)
    assert R.redacted_text("the cardholder_id is 77") == (None, None)
    for fine in ("cabin=3", "a robin sang", "binary: 5", "nothing here", "", "12", "prescriber_id_2=4", "don't", '"'):
        assert R.redacted_text(fine) == (fine, [])
    assert R.redacted_text('x={"bin": "4", "y": 5} pcn=[1, 2] z') == (f'x={{"bin": {M}, "y": 5}} pcn={M} z', ["bin", "pcn"])
    assert R.redacted_text("bin:") == (f"bin:{M}", ["bin"]) and R.redacted_text("bin = 5 bin=6|7") == (f"bin = {M} bin={M}|7", ["bin"])


def test_too_deep_a_payload_is_refused_or_done():
    deep = "[" * 5000 + '{"bin": 1}' + "]" * 5000
    text, _ = R.redacted_text(deep)
    assert text is None or '"bin": 1' not in text


def test_random_documents_lose_private_values_only():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {rng.choice([*R.PRIVATE_KEYS, "qty", "cabin", "bin2", "note"]): value(depth - 1) for _ in range(rng.randrange(4))}
        return [rng.randrange(99), None, "secret" + str(rng.randrange(9)), 1.25][kind]

    def clean(v):
        if isinstance(v, list):
            return [clean(x) for x in v]
        return {k: M if k in R.PRIVATE_KEYS else clean(x) for k, x in v.items()} if isinstance(v, dict) else v

    for _ in range(300):
        doc = {"top": value(4), "rest": [value(3)]}
        text, _ = R.redacted_text(json.dumps(doc))
        assert json.loads(text) == clean(doc)


def test_columns(spark):
    df = spark.createDataFrame([('{"a": {"person_code":7, "cardholder_id": "X\\"1"}}',), (None,), ("the bin",)], "p string")
    got = [tuple(r) for r in df.select(R.redact_json(F.col("p")), R.removed_keys(F.col("p"))).collect()]
    assert got == [(f'{{"a": {{"person_code":"{M}", "cardholder_id": "{M}"}}}}', ["cardholder_id", "person_code"]), (None, None), (None, None)]
