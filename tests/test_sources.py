"""Stored tables read with their schemas."""

import pytest
from pyspark.sql import functions as F

from riskweave.schemas import EMBEDDINGS, OUTBOX, TRANSACTIONS, USAGE
from riskweave.sources import tables


@pytest.mark.parametrize("read, schema", [
    (tables.read_transactions, TRANSACTIONS), (tables.read_embeddings, EMBEDDINGS),
    (tables.read_outbox, OUTBOX), (tables.read_usage, USAGE),
])
@pytest.mark.parametrize("format", ["parquet", "json"])
def test_tables_have_their_schema(spark, tmp_path, read, schema, format):
    row = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]]
    spark.range(2).select(F.lit("x").alias(schema.names[0]), *row, F.lit(1).alias("other")).write.format(format).option(
        "ignoreNullFields", "false").save(f"{tmp_path}/t")
    found = read(spark, f"{tmp_path}/t", format=format)
    assert found.schema.names == schema.names and [f.dataType for f in found.schema] == [f.dataType for f in schema]
    assert found.count() == 2 and found.first()[0] == "x"
