from __future__ import annotations

import sys
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from centsible.schemas import NORMALISED_SCHEMA  # noqa: E402
from centsible.session import build_session  # noqa: E402
from centsible.sources.categories import load_categories  # noqa: E402

AS_OF = datetime(2024, 3, 15, 12, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def categories(spark):
    return load_categories(spark)


@pytest.fixture
def make(spark):
    """make(source_id="a", amount="5.00", ...) -> canonical rows with arrival columns."""

    def rows(*records: dict):
        schema = "arrival_seq long, ingested_at timestamp, " + ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in NORMALISED_SCHEMA
        )
        filled = []
        for number, record in enumerate(records):
            row = {
                "arrival_seq": number,
                "ingested_at": AS_OF,
                "source_id": f"id-{number}",
                "source_type": "BANK_FEED",
                "account_id": "ACC-1",
                "amount": "10.00",
                "currency": "ZAR",
                "merchant_name": "Some Merchant",
                "merchant_mcc": None,
                "transacted_at": AS_OF - timedelta(hours=1),
                "status": "SETTLED",
                "raw_payload": "{}",
                **record,
            }
            if row["amount"] is not None:
                row["amount"] = Decimal(row["amount"])
            filled.append(row)
        names = [part.strip().split(" ")[0] for part in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in filled], schema)

    return rows
