"""Schemas and fixed names shared by every module.

Column names are snake_case inside the library.  The names found in files are
kept as column metadata (``original``) and in the dictionaries below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names that must equal those in the input files and in saved
# models.  The order of the static features is the model's input order.
# ---------------------------------------------------------------------------

STATIC_FEATURES: dict[str, str] = {
    "Avg min between sent tnx": "avg_min_between_sent",
    "Avg min between received tnx": "avg_min_between_received",
    "Time Diff between first and last (Mins)": "time_diff_first_last_mins",
    "Sent tnx": "sent_count",
    "Received Tnx": "received_count",
    "Number of Created Contracts": "created_contracts",
    "Unique Received From Addresses": "unique_received_from",
    "Unique Sent To Addresses": "unique_sent_to",
    "min value received": "min_received",
    "max value received ": "max_received",
    "avg val received": "avg_received",
    "min val sent": "min_sent",
    "max val sent": "max_sent",
    "avg val sent": "avg_sent",
    "min value sent to contract": "min_sent_contract",
    "max val sent to contract": "max_sent_contract",
    "avg value sent to contract": "avg_sent_contract",
    "total transactions (including tnx to create contract": "total_transactions",
    "total Ether sent": "total_sent",
    "total ether received": "total_received",
    "total ether sent contracts": "total_sent_contracts",
    "total ether balance": "total_balance",
    "Total ERC20 tnxs": "erc20_transactions",
    "ERC20 total Ether received": "erc20_total_received",
    "ERC20 total ether sent": "erc20_total_sent",
    "ERC20 total Ether sent contract": "erc20_total_sent_contract",
    "ERC20 uniq sent addr": "erc20_unique_sent_addr",
    "ERC20 uniq rec addr": "erc20_unique_rec_addr",
    "ERC20 uniq sent addr.1": "erc20_unique_sent_addr_1",
    "ERC20 uniq rec contract addr": "erc20_unique_rec_contract_addr",
    "ERC20 avg time between sent tnx": "erc20_avg_time_between_sent",
    "ERC20 avg time between rec tnx": "erc20_avg_time_between_rec",
    "ERC20 avg time between rec 2 tnx": "erc20_avg_time_between_rec_2",
    "ERC20 avg time between contract tnx": "erc20_avg_time_between_contract",
    "ERC20 min val rec": "erc20_min_rec",
    "ERC20 max val rec": "erc20_max_rec",
    "ERC20 avg val rec": "erc20_avg_rec",
    "ERC20 min val sent": "erc20_min_sent",
    "ERC20 max val sent": "erc20_max_sent",
    "ERC20 avg val sent": "erc20_avg_sent",
    "ERC20 min val sent contract": "erc20_min_sent_contract",
    "ERC20 max val sent contract": "erc20_max_sent_contract",
    "ERC20 avg val sent contract": "erc20_avg_sent_contract",
    "ERC20 uniq sent token name": "erc20_unique_sent_token_name",
    "ERC20 uniq rec token name": "erc20_unique_rec_token_name",
}

# Columns of a bulk transaction table that carry no signal for the model.
IRRELEVANT_TX_COLUMNS: list[str] = [
    "r", "s", "nonce", "type", "v", "max_priority_fee_per_gas",
    "max_fee_per_gas", "transaction_index", "method_id", "function_name",
]

# Explorer record: field in the response -> column name here (all strings).
EXPLORER_FIELDS: dict[str, str] = {
    "blockNumber": "block_number",
    "blockHash": "block_hash",
    "timeStamp": "time_stamp",
    "hash": "hash",
    "nonce": "nonce",
    "transactionIndex": "transaction_index",
    "from": "from_address",
    "to": "to_address",
    "value": "value",
    "gas": "gas",
    "gasPrice": "gas_price",
    "input": "input",
    "methodId": "method_id",
    "functionName": "function_name",
    "contractAddress": "contract_address",
    "cumulativeGasUsed": "cumulative_gas_used",
    "txreceipt_status": "txreceipt_status",
    "gasUsed": "gas_used",
    "confirmations": "confirmations",
    "isError": "is_error",
}

# The same for internal transfers: fixed names of the explorer's responses.
INTERNAL_FIELDS: dict[str, str] = {
    "blockNumber": "block_number",
    "timeStamp": "time_stamp",
    "hash": "hash",
    "from": "from_address",
    "to": "to_address",
    "value": "value",
    "contractAddress": "contract_address",
    "input": "input",
    "type": "call_type",
    "gas": "gas",
    "gasUsed": "gas_used",
    "traceId": "trace_id",
    "isError": "is_error",
    "errCode": "error_code",
}

# The same for token transfers: fixed names of the explorer's responses.
TOKEN_FIELDS: dict[str, str] = {
    "blockNumber": "block_number",
    "timeStamp": "time_stamp",
    "hash": "hash",
    "nonce": "nonce",
    "blockHash": "block_hash",
    "from": "from_address",
    "contractAddress": "contract_address",
    "to": "to_address",
    "value": "value",
    "tokenName": "token_name",
    "tokenSymbol": "token_symbol",
    "tokenDecimal": "token_decimal",
    "transactionIndex": "transaction_index",
    "gas": "gas",
    "gasPrice": "gas_price",
    "gasUsed": "gas_used",
    "cumulativeGasUsed": "cumulative_gas_used",
    "input": "input",
    "confirmations": "confirmations",
}

# What a response of each kind holds.
KIND_FIELDS: dict[str, dict[str, str]] = {
    "txlist": EXPLORER_FIELDS,
    "txlistinternal": INTERNAL_FIELDS,
    "tokentx": TOKEN_FIELDS,
}

# The ten positions of a serving sequence row, in model order.
SEQUENCE_FIELDS: list[str] = [
    "timestamp", "value", "gas", "gas_price", "gas_used", "is_error",
    "tx_type", "block_number", "transaction_index", "confirmations",
]

# Model configuration values.
SEQUENCE_LENGTH = 50
SEQUENCE_WIDTH = 10
HIDDEN_LAYERS = [256, 128]
MAJORITY_SAMPLE = 2179

# ---------------------------------------------------------------------------
# Derived names and schemas
# ---------------------------------------------------------------------------

FEATURES: list[str] = list(STATIC_FEATURES.values())
COMPUTED_FEATURES: list[str] = FEATURES[:22]

ADDRESS_SCHEMA = T.StructType(
    [
        T.StructField("Index", T.IntegerType()),
        T.StructField("Address", T.StringType()),
        T.StructField("FLAG", T.IntegerType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in STATIC_FEATURES]
)


def record_of(kind: str) -> T.StructType:
    """A transaction in a response of a kind; every field is text."""
    return T.StructType([T.StructField(name, T.StringType()) for name in KIND_FIELDS[kind]])


# ``result`` stays text: it is an array on success and a message on errors.  A landed
# response may say which page it is and when it landed, in seconds.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("landed_at", T.LongType()),
    ]
)

EXPLANATION = T.ArrayType(
    T.StructType(
        [
            T.StructField("title", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("examples", T.ArrayType(T.StringType())),
        ]
    )
)

# The fields of a transaction, in the order of the explorer's records.
HISTORY_COLUMNS: list[str] = list(EXPLORER_FIELDS.values())


def snake_case(df: DataFrame) -> DataFrame:
    """Rename a labelled address table to the names used here.

    The match is exact (case and trailing blanks count), and the name found in
    the file is kept as column metadata.
    """
    names = {"Index": "index", "Address": "address", "FLAG": "flag", **STATIC_FEATURES}
    return df.select(
        *[
            F.col(f"`{c}`").alias(names[c], metadata={"original": c})
            if c in names
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
