"""The given test tables seen as the data this package works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import fixed_values as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _account(country: str, number: str) -> str:
    return f"concat('{country}', lpad(cast({number} as string), 10, '0'))"


def _event_uuid(number: str) -> str:
    return f"concat('00000000-0000-0000-0000-', lpad(cast({number} as string), 12, '0'))"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with every kind of description the gate and redaction know, and pairs of accounts that moved nothing before."""
    pair = "event_id % 200 in (198, 199)"
    return table(spark, sf_dir, "events").selectExpr(
        f"{_event_uuid('event_id')} as id",
        f"""cast(case when {pair} then (event_id % 2) * 20000 else cast(value as decimal(19,4)) * 100 end
                as decimal(19,4)) as amount""",
        "case event_id % 3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end as currency",
        f"if({pair}, {_account('ZM', 'event_id div 200')}, {_account('US', 'user_id')}) as from_account",
        f"if({pair}, {_account('ZN', 'event_id div 200')}, {_account('US', '(event_id * 31) % 150')}) as to_account",
        """case when event_id % 101 = 0 then 'Suspected Money  Launder ring'
                when event_id % 103 = 0 then 'Possible sanction violation'
                when event_id % 107 = 0 then 'Gift to a TERRORIST group'
                when event_id % 109 = 0 then 'Illicit funds after a sanctions violation'
                when event_id % 11 = 0 then 'Mail anna.k+x@mail.example.org, SSN 987-65-4321, dial 212-555-0199'
                when event_id % 13 = 0 then 'Desk phone (646) 555-0142'
                else 'Groceries and fuel' end as description""",
        "cast(ts as timestamp) as occurred_at",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(f"{_event_uuid('vec_id')} as id", "embedding")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frames of both types, some with every fault that a frame can have."""
    def field(name: str, value: str) -> str:
        return f"""'"{name}":', coalesce({value}, 'null')"""

    def text(value: str) -> str:
        return f"""concat('"', {value}, '"')"""

    fields = ", ',', ".join((
        field("id", text(f"if(event_id % 61 = 0, 'no-uuid', {_event_uuid('event_id')})")),
        field("amount", """case when event_id % 67 = 0 then null when event_id % 71 = 0 then '10000000000000000.5'
            else cast(cast(if(event_id % 47 = 0, -75.25D, value) as decimal(19,4)) as string) end"""),
        field("currency", text("if(event_id % 53 = 0, 'QQQ', if(event_id % 2 = 0, 'USD', 'DEM'))")),
        field("fromAccount", text(f"if(event_id % 59 = 0, 'US12', {_account('US', 'user_id')})")),
        field("toAccount", text("'FR0000000777'")),
        field("description", "if(event_id % 73 = 0, null, '\"Library fees\"')"),
        field("occurredAt", text("date_format(ts, if(event_id % 79 = 0, 'yyyy-MM-dd', \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))")),
    ))
    decision = ", ',', ".join((
        field("decision", text("if(event_id % 83 = 0, 'MAYBE', 'FLAG')")),
        field("riskScore", "if(event_id % 89 = 0, '100.5', cast(event_id % 100 as string))"),
        field("reasoning", text("'checked by hand'")),
        field("evaluatedAt", text("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")),
    ))
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """case when event_id % 37 = 0 then null when event_id % 41 = 0 then 'TransactionMoved'
                when event_id % 5 = 0 then 'TransactionEvaluated' else 'TransactionReceived' end as event_type""",
        f"""if(event_id % 43 = 0, 'no json', concat('{{', {fields},
             if(event_id % 5 = 0, concat(',', {decision}), ''), '}}')) as value""",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-shaped rows of which some lack a field or carry a bad one."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """cast(case when event_id % 29 = 0 then null when event_id % 31 = 0 then -50.0D else value end
                as decimal(19,4)) as amount""",
        "case when event_id % 37 = 0 then '\t' when event_id % 41 = 0 then 'QQQ' else 'USD' end as currency",
        f"""case when event_id % 43 = 0 then null when event_id % 47 = 0 then 'US12'
                 else {_account('US', 'user_id')} end as from_account""",
        "if(event_id % 53 = 0, '', 'FR0000000777') as to_account",
        "if(event_id % 59 = 0, null, 'Library fees') as description",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one per conversation turn, characters standing for tokens."""
    models = ("gpt-4o", "gpt-4o-mini-2024-07-18", "gpt-4-0613", "all-MiniLM-L6-v2", None, "gpt-3.5-turbo")
    model = F.lit("gpt-4-turbo-preview")
    for i, name in reversed(list(enumerate(models))):
        model = F.when(F.col("conv_id") % 7 == i, F.lit(name)).otherwise(model)
    answer = F.col("role") == "assistant"
    size = F.length("text").cast("bigint")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", model.alias("model"),
        F.when(answer, 0).otherwise(size).alias("input_tokens"),
        F.when(answer, size).otherwise(0).alias("output_tokens"),
    )


def dated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls spread over sixty days."""
    return usage(spark, sf_dir).withColumn("day", F.expr("date_add(date'2024-01-01', cast(conv_id % 60 as int))"))


def prices(spark: SparkSession) -> DataFrame:
    """The listed prices as a table: twice as high before February; one model priced late, one price withdrawn."""
    rows = [(name, price_in, price_out) for name, price_in, price_out in V.MODEL_PRICES]
    listed = spark.createDataFrame(rows, "name string, price_in string, price_out string").selectExpr(
        "name", "cast(price_in as decimal(18,9)) price_in", "cast(price_out as decimal(18,9)) price_out")
    bounds = "cast({} as date) valid_from", "cast({} as date) valid_to"
    before = listed.selectExpr("name", "cast(price_in * 2 as decimal(18,9)) price_in", "cast(price_out * 2 as decimal(18,9)) price_out",
                               bounds[0].format("null"), bounds[1].format("'2024-02-01'"))
    after = listed.selectExpr("*", bounds[0].format("'2024-02-01'"), bounds[1].format("if(name = 'gpt-3.5-turbo', '2024-02-20', null)"))
    late = listed.filter("name = 'gpt-4o'").selectExpr("'all-MiniLM' name", "price_in", "price_out", bounds[0].format("'2024-02-10'"), bounds[1].format("null"))
    return before.unionByName(after).unionByName(late)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as they arrive: every seventh arrives again later, one unit larger."""
    first = transactions(spark, sf_dir).withColumn("number", F.substring("id", 25, 12).cast("bigint"))
    times = F.when(F.col("number") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        first.withColumn("again", F.explode(times))
        .withColumn("amount", (F.col("amount") + F.col("again")).cast("decimal(19,4)"))
        .withColumn("ingest_seq", F.col("number") + F.col("again").cast("bigint") * 1_000_000_000)
        .drop("number", "again")
    )


def wanted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction ids to look up; part of them do not exist."""
    return table(spark, sf_dir, "documents").selectExpr(f"{_event_uuid('doc_id * 17')} as id")
