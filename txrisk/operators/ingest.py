"""From raw messages to typed transactions, with failures routed to dead letters."""

from pyspark.sql import Column, DataFrame, functions as F

from txrisk.functions import scalar as S
from txrisk.schemas import FEATURE_VECTOR, REQUIRED_FIELDS, TRANSACTION

MESSAGE_COLS = ["key", "value", "topic", "partition", "offset"]

# The first and the last second that a calendar date can show.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def parse_messages(raw: DataFrame) -> DataFrame:
    """Message columns, `stage` and `error` (both NULL for a good row) and the transaction columns.

    A payload that is not UTF-8 or not JSON fails in stage `deserialize`; a missing or ill-typed
    field fails in stage `transform`, with the first failing field as the error. A failed row takes
    no part in any user's history.
    """
    checked = [*REQUIRED_FIELDS, "_is_fraud"]
    record = [("_is_fraud" if f.name == "label" else f.name, f.dataType.simpleString())
              for f in TRANSACTION.fields if f.name != "ts_us"]
    text = F.col("value").cast("string")
    quick = F.from_json(
        F.when(F.is_valid_utf8(text), text), ", ".join(f"{n} {t}" for n, t in [*record, ("_corrupt", "string")]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
         "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    tidy = F.trim(text)
    # one object that closes with its first brace has nothing after it
    whole = tidy.startswith("{") & (F.instr(tidy, "}") == F.length(tidy))
    # a user id must have come as text: a number, literal or nested value would follow its name without a quote
    plain = ~text.rlike(r'"user_id"\s*:\s*[^"\s]') & ~F.col("quick.user_id").rlike(r"^([{\[]|true$|false$)")
    for name in ("transaction_id", "merchant_id", "country", "merchant_category"):
        plain = plain & ~F.col(f"quick.{name}").rlike(r"^([{\[]|true$|false$)")
    sure = whole & plain & F.col("quick._corrupt").isNull()
    for name in REQUIRED_FIELDS:
        sure = sure & F.col(f"quick.{name}").isNotNull()
    rows = raw.select(*MESSAGE_COLS, quick.alias("quick"))
    rows = rows.withColumn("sure", F.coalesce(sure, F.lit(False)))
    # only records the typed parse cannot vouch for are parsed again with their own types
    # (as the only element of an array, so that anything after the record makes it invalid)
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    rows = rows.withColumn("list", F.when(~F.col("sure") & F.is_valid_utf8(text), alone))
    rows = rows.withColumn("doc", F.when(
        F.try_variant_get("list", "$[1]", "variant").isNull(), F.try_variant_get("list", "$[0]", "variant")))
    rows = rows.withColumns({
        "types": F.schema_of_variant(F.to_variant_object(F.try_variant_get(
            "doc", "$", "struct<" + ", ".join(f"{n}: variant" for n in checked) + ">"))),
        "tx": F.when(F.col("sure"), F.struct(*[F.col(f"quick.{n}").alias(n) for n, _ in record])).otherwise(
            F.try_variant_get("doc", "$", "struct<" + ", ".join(f"{n}: {t}" for n, t in record) + ">")),
    })
    good = (F.col("sure") | F.coalesce(F.col("types").rlike(_good_types()), F.lit(False))) & F.coalesce(_in_range(), F.lit(False))
    bad_json = ~F.col("sure") & F.col("doc").isNull()
    outcome = F.struct(
        F.when(bad_json, "deserialize").when(~good, "transform").alias("stage"),
        F.when(good, S.epoch_micros(F.col("tx.timestamp"))).alias("ts_us"),
        "types", "tx",
    )
    # the generator keeps a filter on `stage` above the parse, so that a record is read once
    return rows.select(*MESSAGE_COLS, F.inline(F.array(outcome))).select(
        *MESSAGE_COLS, "stage",
        F.when(F.col("stage").isNotNull(), _error_text()).alias("error"),
        *[{"ts_us": F.col("ts_us"),
           "label": F.col("tx._is_fraud").alias("label"),
           "currency": F.coalesce("tx.currency", F.lit("USD")).alias("currency")}.get(c, F.col(f"tx.{c}").alias(c))
          for c in TRANSACTION.names],
    )


# Fixed patterns: the type names a field may have in a schema text.
NUMBER = r"(BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT)"
SCALAR = rf"(STRING|{NUMBER})"
FIELD_TYPES = {
    "user_id": "STRING", "transaction_id": SCALAR, "timestamp": NUMBER, "amount": NUMBER,
    "merchant_id": SCALAR, "country": SCALAR, "card_present": "BOOLEAN", "merchant_category": SCALAR,
}


def _good_types() -> str:
    """Pattern of the schema text of a record whose required fields are all there and well-typed."""
    types = FIELD_TYPES | {"_is_fraud": f"(VOID|STRING|BOOLEAN|{NUMBER})"}
    return "^OBJECT<" + ", ".join(f"{n}: {types[n]}" for n in sorted(types)) + ">$"


def _in_range() -> Column:
    no_flag = F.col("sure") | F.col("types").contains("_is_fraud: VOID")
    return (
        F.col("tx.timestamp").between(FIRST_SECOND, LAST_SECOND)
        & (F.col("tx.amount") > -1) & (F.col("tx.amount") < float("inf"))
        & (no_flag | F.col("tx._is_fraud").isNotNull())
    )


def _error_text() -> Column:
    """Why a row failed: the first failing field in the order in which fields are read."""
    text, types = F.col("value").cast("string"), F.col("types")
    error = (
        F.when(F.col("value").isNull(), "no payload")
        .when(~F.is_valid_utf8(text), "payload is not UTF-8")
        .when(F.col("stage") == "deserialize", "payload is not JSON")
        .when((F.col("tx.amount") <= -1) | (F.col("tx.amount") == float("inf")), "amount is out of range")
        .when(~F.col("tx.timestamp").between(FIRST_SECOND, LAST_SECOND), "timestamp is out of range")
        .when(types.isNull(), "message is not an object")
    )
    for name in REQUIRED_FIELDS:
        error = error.when(types.contains(f" {name}: VOID") | types.contains(f"<{name}: VOID"), f"'{name}'")
    for name in REQUIRED_FIELDS:
        error = error.when(~types.rlike(f"[< ]{name}: {FIELD_TYPES[name]}[,>]"), f"{name} has the wrong type")
    return error.otherwise("_is_fraud is not a whole number")


def good_transactions(parsed: DataFrame) -> DataFrame:
    """Typed transactions of the good rows, with the position of their message."""
    return parsed.filter("stage is null").select(*TRANSACTION.names, "partition", "offset")


def dead_letters(parsed: DataFrame, at: Column | None = None) -> DataFrame:
    """One record per failed row; an undecodable payload is kept as base64."""
    now = F.current_timestamp() if at is None else at
    text = F.col("value").cast("string")
    key = F.col("key").cast("string")
    return parsed.filter("stage is not null").select(
        "error",
        F.try_validate_utf8(key).alias("message_key"),
        "offset",
        F.when(F.is_valid_utf8(text), text).alias("original_payload"),
        "partition",
        F.col("topic").alias("source_topic"),
        "stage",
        F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ts_utc"),
        F.when(~F.is_valid_utf8(text), F.base64("value")).alias("original_payload_base64"),
    )


# The fields of a dead-letter record, in order.
DEAD_LETTER_FIELDS = ["error", "message_key", "offset", "original_payload",
                      "partition", "source_topic", "stage", "ts_utc"]


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as topic messages: the original key and a JSON value."""
    body = F.struct(*DEAD_LETTER_FIELDS, "original_payload_base64")
    return letters.select(
        F.col("message_key").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )


def feature_messages(features: DataFrame) -> DataFrame:
    """Feature events as topic messages, keyed by user so that a user's events stay in order."""
    value = F.to_json(F.struct(*FEATURE_VECTOR.names), {"ignoreNullFields": "false"})
    # the generator keeps later filters above it, so they do not take the features' expressions with them
    return features.select(F.inline(F.array(F.struct(F.col("user_id").alias("key"), value.alias("value")))))


def parse_feature_events(raw: DataFrame) -> DataFrame:
    """Feature columns of each message plus `is_corrupt`; the monitor counts and drops corrupt ones."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEATURE_VECTOR.fields)
    text = F.col("value").cast("string")
    event = F.from_json(text, f"{schema}, _corrupt string",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    missing = F.trim(F.coalesce(text, F.lit(""))) == ""
    parsed = raw.select(missing.alias("missing"), F.inline(F.array(event)))
    corrupt = F.col("missing") | F.col("_corrupt").isNotNull()
    return parsed.select(*FEATURE_VECTOR.names, corrupt.alias("is_corrupt"))


def stage_counts(parsed: DataFrame) -> DataFrame:
    """Messages by outcome: processed, or the stage in which they failed."""
    return parsed.groupBy(F.coalesce("stage", F.lit("processed")).alias("stage")).agg(
        F.count("*").alias("messages"))


def with_defaults(tx: DataFrame, now: Column | None = None) -> DataFrame:
    """The declared defaults of optional fields; `timestamp` is only filled when `now` is given."""
    filled = tx.withColumn("currency", F.coalesce("currency", F.lit("USD")))
    if now is not None:
        filled = filled.withColumn("timestamp", F.coalesce("timestamp", F.unix_micros(now) / 1e6))
    return filled
