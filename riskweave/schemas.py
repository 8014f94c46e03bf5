"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(19, 4)
SCORE = T.DecimalType(5, 2)

TRANSACTION_COLUMNS = (
    "id", "amount", "currency", "from_account", "to_account", "description", "occurred_at",
)
DECISION_COLUMNS = ("decision", "risk_score", "reasoning", "evaluated_at")

TRANSACTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("amount", AMOUNT),
    T.StructField("currency", T.StringType()),
    T.StructField("from_account", T.StringType()),
    T.StructField("to_account", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
])

ACCOUNT_FEATURES = T.StructType([
    *TRANSACTIONS.fields,
    T.StructField("velocity", T.LongType()),
    T.StructField("history_count", T.LongType()),
    T.StructField("history_sum", T.DecimalType(29, 4)),
])

DECISIONS = T.StructType([
    T.StructField("decision", T.StringType()),
    T.StructField("risk_score", SCORE),
    T.StructField("reasoning", T.StringType()),
    T.StructField("evaluated_at", T.TimestampType()),
])

DECIDED = T.StructType(TRANSACTIONS.fields + DECISIONS.fields)

REJECTS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("reject_reason", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("amount", AMOUNT),
    T.StructField("currency", T.StringType()),
    T.StructField("from_account", T.StringType()),
    T.StructField("to_account", T.StringType()),
    T.StructField("description", T.StringType()),
])

OUTBOX = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("aggregate_type", T.StringType()),
    T.StructField("aggregate_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("text", T.StringType()),
])

# A vector with few numbers other than zero.
SPARSE = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType()))])

# In the store a vector keeps the time of its transaction.
STORED_EMBEDDINGS = T.StructType([*EMBEDDINGS.fields, T.StructField("occurred_at", T.TimestampType())])

USAGE = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
])

HEADERS = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.BinaryType()),
]))

# One record of an event stream, as the Kafka source with headers delivers it.
FRAMES = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("headers", HEADERS),
    T.StructField("timestamp", T.TimestampType()),
])

# JSON payloads, camelCase on the wire. Numbers are read wider than they are
# kept, so that bounds are checked on what was sent; times are text.
_WIRE_NUMBER = T.DecimalType(38, 18)
_WIRE_TRANSACTION = [
    T.StructField("id", T.StringType()),
    T.StructField("amount", _WIRE_NUMBER),
    T.StructField("currency", T.StringType()),
    T.StructField("fromAccount", T.StringType()),
    T.StructField("toAccount", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("occurredAt", T.StringType()),
]
RECEIVED_PAYLOAD = T.StructType(_WIRE_TRANSACTION)
EVALUATED_PAYLOAD = T.StructType(_WIRE_TRANSACTION + [
    T.StructField("decision", T.StringType()),
    T.StructField("riskScore", _WIRE_NUMBER),
    T.StructField("reasoning", T.StringType()),
    T.StructField("evaluatedAt", T.StringType()),
])
