import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from riskweave.schemas import TRANSACTIONS  # noqa: E402
from riskweave.session import configure  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Transactions from short rows: (id, from, to, microseconds, amount[, description])."""
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def build(rows):
        return spark.createDataFrame([
            (
                f"00000000-0000-0000-0000-{n:012d}", Decimal(str(amount)), "USD", f"US{a:010d}", f"US{b:010d}",
                rest[0] if rest else "Monthly rent payment", start + timedelta(microseconds=us),
            )
            for n, a, b, us, amount, *rest in rows
        ], TRANSACTIONS)

    return build
