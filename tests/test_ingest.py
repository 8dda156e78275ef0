import json

import pytest

from txrisk.operators import ingest
from txrisk.schemas import RAW_MESSAGE, TRANSACTION

BASE = dict(user_id="u", transaction_id="t", timestamp=1.7e9, amount=1.5, merchant_id="m", country="US",
            card_present=True, merchant_category="retail")


def text(drop=(), **own):
    return json.dumps({k: v for k, v in {**BASE, **own}.items() if k not in drop}).encode()


def parse(spark, values):
    rows = [(b"user_1", v, "transactions.raw", 2, i, None) for i, v in enumerate(values)]
    return ingest.parse_messages(spark.createDataFrame(rows, RAW_MESSAGE))


CASES = [
    (text(), None, None),
    (b"\xffA", "deserialize", "payload is not UTF-8"),
    (b'{"a":', "deserialize", "payload is not JSON"),
    (None, "deserialize", "no payload"),
    (b"", "deserialize", "payload is not JSON"),
    (b'{"a":NaN}', "deserialize", "payload is not JSON"),
    (text() + b" x", "deserialize", "payload is not JSON"),
    (text() + text(), "deserialize", "payload is not JSON"),
    (text() + b"," + text(), "deserialize", "payload is not JSON"),
    (b"[1]", "transform", "message is not an object"),
    (b"5", "transform", "message is not an object"),
    (b"null", "transform", "message is not an object"),
    (b"[" + text() + b"]", "transform", "message is not an object"),
    (b"{}", "transform", "'user_id'"),
    (text(drop=("card_present",)), "transform", "'card_present'"),
    (text(drop=("amount", "country")), "transform", "'amount'"),
    (text(country=None), "transform", "'country'"),
    (text(amount="12"), "transform", "amount has the wrong type"),
    (text(amount=True), "transform", "amount has the wrong type"),
    (text(amount=-1), "transform", "amount is out of range"),
    (text(timestamp=1e15), "transform", "timestamp is out of range"),
    (text(user_id=5), "transform", "user_id has the wrong type"),
    (text(merchant_id={"a": 1}), "transform", "merchant_id has the wrong type"),
    (text(card_present="yes"), "transform", "card_present has the wrong type"),
    (text(_is_fraud="x"), "transform", "_is_fraud is not a whole number"),
    (text(user_id="5"), None, None),
    (text(user_id="true"), None, None),
    (text(merchant_id="{x}"), None, None),
    (text(transaction_id=7), None, None),
    (text(extra={"amount": "z"}), None, None),
    (b"  " + text() + b"\n", None, None),
]


def test_every_message_has_one_outcome(spark):
    got = [(r.stage, r.error) for r in parse(spark, [c[0] for c in CASES]).orderBy("offset").collect()]
    assert got == [(stage, error) for _, stage, error in CASES]


def test_good_and_bad_rows_add_up(spark):
    parsed = parse(spark, [c[0] for c in CASES])
    good, bad = ingest.good_transactions(parsed), ingest.dead_letters(parsed)
    assert good.count() + bad.count() == len(CASES)
    assert good.columns[:len(TRANSACTION.names)] == TRANSACTION.names
    counts = {r.stage: r.messages for r in ingest.stage_counts(parsed).collect()}
    assert sum(counts.values()) == len(CASES) and counts["deserialize"] == 8


def test_fields_of_a_good_row(spark):
    values = [text(_is_fraud=1, amount=0.30000000000000004), text(_is_fraud="1", transaction_id=7), text(_is_fraud=True), text(_is_fraud=None)]
    rows = ingest.good_transactions(parse(spark, values)).orderBy("offset").collect()
    assert [r.label for r in rows] == [1, 1, 1, None]
    first = rows[0]
    assert (first.amount, first.currency, first.ts_us, first.user_id) == (0.30000000000000004, "USD", 1_700_000_000_000_000, "u")
    assert rows[1].transaction_id == "7"


def test_dead_letter_message_contains_context(spark):
    letters = ingest.dead_letter_messages(ingest.dead_letters(parse(spark, [b"{", b"\xffA"])))
    rows = {json.loads(r.value)["offset"]: (r.key, json.loads(r.value)) for r in letters.collect()}
    key, first = rows[0]
    assert key == "user_1"
    assert list(first)[:8] == ingest.DEAD_LETTER_FIELDS
    assert first["stage"] == "deserialize" and first["source_topic"] == "transactions.raw"
    assert first["original_payload"] == "{" and first["partition"] == 2 and first["message_key"] == "user_1"
    assert first["ts_utc"].endswith("+00:00")
    assert rows[1][1]["original_payload"] is None and rows[1][1]["original_payload_base64"] == "/0E="


def test_feature_messages_round_trip(spark, make_tx):
    from txrisk.operators import features
    vectors = features.feature_vector(make_tx([(0, {}), (5, {"label": None})]))
    messages = ingest.feature_messages(vectors)
    assert {r.key for r in messages.collect()} == {"u1"}
    back = ingest.parse_feature_events(messages).filter("not is_corrupt").drop("is_corrupt")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vectors.collect()))


@pytest.mark.parametrize("value", [b"{", b"nonsense", None])
def test_corrupt_feature_events_are_flagged(spark, value):
    raw = spark.createDataFrame([(value,)], "value binary")
    assert ingest.parse_feature_events(raw).first().is_corrupt


def test_defaults(spark):
    from pyspark.sql import functions as F
    tx = spark.createDataFrame([(None, None)], "currency string, timestamp double")
    assert ingest.with_defaults(tx).first().timestamp is None
    filled = ingest.with_defaults(tx, F.lit("1970-01-01 00:00:10").cast("timestamp")).first()
    assert (filled.currency, filled.timestamp) == ("USD", 10.0)
