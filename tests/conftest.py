import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_tx(spark):
    """Transactions from dicts; every field not given is a plain valid value."""
    from txrisk.schemas import HISTORY_COLUMNS

    plain = dict.fromkeys(HISTORY_COLUMNS, "") | {
        "from_address": "0xa", "to_address": "0xb", "value": "1000000000000000000",
        "time_stamp": "1700000000", "gas": "21000", "gas_price": "1000000000",
        "gas_used": "21000", "is_error": "0", "block_number": "100",
        "transaction_index": "0", "confirmations": "10", "input": "0x",
    }

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            r = {**plain, "hash": f"0xh{i:04d}", **row}
            full.append((i, *[r[c] for c in HISTORY_COLUMNS]))
        schema = "pos bigint, " + ", ".join(f"`{c}` string" for c in HISTORY_COLUMNS)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def listed(spark):
    def make(*addresses):
        return spark.createDataFrame([(a,) for a in addresses], "address string")

    return make
