"""The registered queries once more, as plain SQL over the same tables.

Written for the checking engine (DuckDB) from the definitions, not from the
Spark plans: rankings rank whole groups, medians use the built-in, and so on.
"""

from __future__ import annotations

from txrisk.proxy import HUGE
from txrisk.schemas import COMPUTED_FEATURES, FEATURES, HISTORY_COLUMNS, SEQUENCE_FIELDS

# -- shared views -----------------------------------------------------------------

_ADDR = "concat('0x', lpad(cast({} as varchar), 40, '0'))"

_TO = (
    "case when event_type = 'signup' then '' else "
    + _ADDR.format("regexp_extract(props, '([0-9]+)', 1)")
    + " end"
)

TX = f"""tx as (
  select event_id as pos,
    concat('0x', right(md5(cast(event_id as varchar)), 32)) as hash,
    {_ADDR.format("user_id")} as from_address,
    {_TO} as to_address,
    case when event_id % 103 = 0 then '' when event_id % 107 = 0 then 'n/a'
      else concat(cast(cast(round(value * 100, 0) as bigint) as varchar), '0000000000000000') end as value,
    case when event_id % 101 = 0 then '' else cast(cast(floor(epoch(ts)) as bigint) as varchar) end as time_stamp,
    case when event_id % 97 = 0 then 'bad' else cast(21000 + event_id % 79000 as varchar) end as gas,
    concat(cast(1 + event_id % 50 as varchar), '000000000') as gas_price,
    cast(20000 + event_id % 7000 as varchar) as gas_used,
    case when event_type = 'error' then '1' else '0' end as is_error,
    cast(19000000 + cast(floor(event_id / 10) as bigint) as varchar) as block_number,
    cast(event_id % 10 as varchar) as transaction_index,
    case when event_id % 89 = 0 then '' else cast(10000000 - event_id as varchar) end as confirmations,
    case event_type when 'purchase' then '0xa9059cbb00000000000000000000000000000001'
      when 'click' then 'deprecated' when 'view' then '0x00' else '0x' end as input,
    concat('0x', md5(cast(cast(floor(event_id / 10) as bigint) as varchar))) as block_hash,
    cast(event_id % 1000 as varchar) as nonce,
    case event_type when 'purchase' then '0xa9059cbb' else '0x' end as method_id,
    case event_type when 'purchase' then 'transfer(address,uint256)' else '' end as function_name,
    case event_type when 'signup' then {_ADDR.format("event_id + 1000000")} else '' end as contract_address,
    cast(30000 + event_id % 9000 as varchar) as cumulative_gas_used,
    case event_type when 'error' then '0' else '1' end as txreceipt_status
  from events)"""

# The same with amounts of 40 digits.
TX_HUGE = TX.replace(
    "then 'n/a'", f"then 'n/a' when event_id % 109 = 0 then '{HUGE}'"
)

BULK = f"""bulk as (
  select event_id as pos,
    {_ADDR.format("user_id")} as from_address,
    {_TO} as to_address,
    {_ADDR.format("event_id % 150")} as source_address,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as created_at,
    value,
    21000 + event_id % 79000 as gas,
    20000 + event_id % 7000 as gas_used,
    19000000 + cast(floor(event_id / 10) as bigint) as block_number
  from events)"""

ACC = f"""acc as (
  select {_ADDR.format("c_custkey")} as address,
    case when c_acctbal < 0 then 1 else 0 end as flag, c_custkey as key
  from customer)"""

ROWS = """rows_ as (
  select from_address as address, t.* from tx t where from_address <> ''
  union all
  select to_address as address, t.* from tx t where to_address <> '' and to_address <> from_address),
allhist as (
  select *, from_address = address as sent, to_address = address as received,
    coalesce(try_cast(time_stamp as bigint), 0) as ts,
    coalesce(try_cast(value as decimal(38,0)), 0) as wei,
    case when try_cast(value as decimal(38,0)) is null then try_cast(value as double) end as beyond
  from rows_)"""

HIST = f"""{TX}, {ACC}, {ROWS}, hist as (
  select h.* from allhist h where address in (select address from acc))"""

_NEWEST = (
    "ts desc, cast(block_number as bigint) desc, cast(transaction_index as bigint) desc, hash, pos"
)
_OLDEST = "ts, cast(block_number as bigint), cast(transaction_index as bigint), hash, pos"

RECENT = f"""ranked as (
  select *, row_number() over (partition by address order by {_NEWEST}) as rank from hist),
recent as (select * from ranked where rank <= 100)"""


def _feature_sql(source: str, sign: str) -> str:
    contract = (
        "sent and to_address <> '' and regexp_full_match(input, '(0[xX])?[0-9a-fA-F]*[1-9a-fA-F][0-9a-fA-F]*')"
    )
    def money(kind: str, cond: str) -> str:
        if kind == "sum":
            return f"coalesce({total(cond)}, 0.0)"
        each = "coalesce(beyond / 1e18, cast(wei as double) / 1e18)"
        return f"coalesce({kind}({each}) filter (where {cond}), 0.0)"

    def total(cond: str) -> str:
        return (
            f"(cast(sum(wei) filter (where {cond}) as double) / 1e18"
            f" + coalesce(sum(beyond) filter (where {cond}), 0.0) / 1e18)"
        )

    def mean(cond: str) -> str:
        return f"coalesce({total(cond)} / count(*) filter (where {cond}), 0.0)"

    def gap(cond: str) -> str:
        n = f"count(*) filter (where {cond} and ts > 0)"
        span = f"max(ts) filter (where {cond} and ts > 0) - min(ts) filter (where {cond} and ts > 0)"
        return (
            f"case when {n} > 1 and count(*) filter (where ts > 0) > 1"
            f" then {sign}(({span}) / 60) / ({n} - 1) else 0.0 end"
        )

    e = {
        "avg_min_between_sent": gap("sent"),
        "avg_min_between_received": gap("received"),
        "time_diff_first_last_mins": "case when count(*) filter (where ts > 0) > 1 then "
        "(max(ts) filter (where ts > 0) - min(ts) filter (where ts > 0)) / 60 else 0.0 end",
        "sent_count": "count(*) filter (where sent)",
        "received_count": "count(*) filter (where received)",
        "created_contracts": "count(*) filter (where sent and to_address = '')",
        "unique_received_from": "count(distinct from_address) filter (where received)",
        "unique_sent_to": "count(distinct to_address) filter (where sent and to_address <> '')",
        "min_received": money("min", "received"),
        "max_received": money("max", "received"),
        "avg_received": mean("received"),
        "min_sent": money("min", "sent"),
        "max_sent": money("max", "sent"),
        "avg_sent": mean("sent"),
        "min_sent_contract": money("min", contract),
        "max_sent_contract": money("max", contract),
        "avg_sent_contract": mean(contract),
        "total_transactions": "count(*)",
        "total_sent": money("sum", "sent"),
        "total_received": money("sum", "received"),
        "total_sent_contracts": money("sum", contract),
        "total_balance": money("sum", "received") + " - " + money("sum", "sent"),
    }
    columns = ",\n    ".join(f"{e[c]} as {c}" for c in COMPUTED_FEATURES)
    return f"select address,\n    {columns}\n  from {source} group by address"


FEATS = f"""{HIST}, {RECENT}, found as ({_feature_sql("recent", "-")}),
feats as (
  select a.address, a.flag, a.key, {", ".join(f"coalesce(f.{c}, 0) as {c}" for c in COMPUTED_FEATURES)}
  from acc a left join found f using (address))"""

_PRICE = "regexp_full_match(gas_price, '\\s*[+-]?[0-9]+\\s*')"
WELL_FORMED = " and ".join(
    [f"(gas_price = '' or {_PRICE})", "(value = '' or try_cast(value as double) is not null)"]
    + [
        f"({c} = '' or try_cast({c} as bigint) is not null)"
        for c in (
            "time_stamp", "gas", "gas_used", "is_error", "block_number",
            "transaction_index", "confirmations",
        )
    ]
)


def _int(c: str) -> str:
    return f"coalesce(try_cast({c} as bigint), 0)"


_VALUES = {
    "timestamp": "cast(ts % 1000000 as double)",
    "value": "coalesce(beyond / 1e18, cast(wei as double) / 1e18)",
    "gas": f"{_int('gas')} / 1e6",
    "gas_price": "cast(coalesce(try_cast(gas_price as decimal(38,0)), 0) as double) / 1e9",
    "gas_used": f"{_int('gas_used')} / 1e6",
    "is_error": f"cast({_int('is_error')} as double)",
    "tx_type": "cast(0 as double)",
    "block_number": f"cast({_int('block_number')} % 1000000 as double)",
    "transaction_index": f"cast({_int('transaction_index')} as double)",
    "confirmations": f"{_int('confirmations')} / 100",
}
STEP_VALUES = ", ".join(f"{_VALUES[f]} as {f}" for f in SEQUENCE_FIELDS)


def _latest(source: str, n: int, tie: str) -> str:
    return f"""(select address, step, {STEP_VALUES} from (
      select *, row_number() over (partition by address order by ts desc, {tie}) - 1 as step
      from {source} where {WELL_FORMED}) where step < {n})"""


# All 50 steps of every account, zeros where there is no transaction.
PROFILE = f"""{HIST}, {RECENT}, steps as {_latest("recent", 50, "rank")},
profile as (
  select a.address, cast(g.step as bigint) as step,
    {", ".join(f"coalesce(s.{f}, 0.0) as {f}" for f in SEQUENCE_FIELDS)}
  from acc a cross join (select unnest(range(50)) as step) g
  left join steps s on s.address = a.address and s.step = g.step)"""

PAIRS = f"""{BULK}, {ACC}, parties as (
  select from_address as address, pos from bulk
  union select to_address, pos from bulk
  union select source_address, pos from bulk)"""

SPLIT = f"""{ACC}, sizes as (select flag, count(*) as n from acc group by flag),
total as (select sum(n) as n from sizes),
t1 as (select s.flag, s.n, (t.n - ceil(0.3 * t.n)) as want, (t.n - ceil(0.3 * t.n)) * s.n / t.n as exact
  from sizes s, total t),
t2 as (select *, row_number() over (order by exact - floor(exact) desc, flag) as r,
  want - sum(floor(exact)) over () as missing from t1),
t3 as (select flag, n, floor(exact) + case when r <= missing then 1 else 0 end as train from t2),
h0 as (select sum(n - train) as n from t3),
h1 as (select s.flag, s.n, s.train, (h.n - ceil(0.5 * h.n)) as want,
  (h.n - ceil(0.5 * h.n)) * (s.n - s.train) / h.n as exact from t3 s, h0 h),
h2 as (select *, row_number() over (order by exact - floor(exact) desc, flag) as r,
  want - sum(floor(exact)) over () as missing from h1),
quota as (select flag, train, floor(exact) + case when r <= missing then 1 else 0 end as val from h2),
placed as (select address, flag,
  row_number() over (partition by flag order by md5(concat('42:', address)), address) as r from acc),
split as (select p.address, p.flag, case when r <= train then 'train' when r <= train + val then 'val'
  else 'test' end as split from placed p join quota q using (flag))"""

SCORED = f"""{FEATS}, logits as (
  select *, round(received_count / 100, 4) as z0,
    round(created_contracts / 10 + unique_sent_to / 50 - sent_count / 200, 4) as z1 from feats),
scored as (
  select *, round(exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 6) as p0,
    round(exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 6) as p1,
    case when z1 > z0 then 1 else 0 end as predicted from logits)"""

def _newton_sql(steps: int = 8) -> str:
    """Newton's steps for two scaled features; every step solves three equations by determinants."""
    parts = ["weights0 as (select 0.0::double as w0, 0.0::double as w1, 0.0::double as w2)"]
    det = "({0}*({4}*{8}-{5}*{7}) - {1}*({3}*{8}-{5}*{6}) + {2}*({3}*{7}-{4}*{6}))"
    m = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]
    for k in range(steps):
        parts.append(f"""sums{k} as (select any_value(w0) as w0, any_value(w1) as w1, any_value(w2) as w2,
            sum(y - p) as g0, sum((y - p) * x1) as g1, sum((y - p) * x2) as g2,
            sum(p * (1 - p)) as h00, sum(p * (1 - p) * x1) as h01, sum(p * (1 - p) * x2) as h02,
            sum(p * (1 - p) * x1 * x1) as h11, sum(p * (1 - p) * x1 * x2) as h12, sum(p * (1 - p) * x2 * x2) as h22
          from (select *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) as p from train, weights{k}))""")
        whole = det.format(*m)
        moved = []
        for i in range(3):
            other = [f"g{j // 3}" if j % 3 == i else c for j, c in enumerate(m)]
            moved.append(f"w{i} + {det.format(*other)} / {whole} as w{i}")
        parts.append(f"weights{k + 1} as (select {', '.join(moved)} from sums{k})")
    return ", ".join(parts)


_TWO = f"""{FEATS}, {SPLIT.replace(ACC + ", ", "")}, moments as (
  select avg(sent_count) as m1, stddev_pop(sent_count) as s1,
    avg(unique_sent_to) as m2, stddev_pop(unique_sent_to) as s2
  from feats join split using (address) where split = 'train'),
points as (select split, cast(feats.flag as double) as y, (sent_count - m1) / s1 as x1, (unique_sent_to - m2) / s2 as x2
  from feats join split using (address), moments),
train as (select * from points where split = 'train'), {_newton_sql()}"""

_CANDIDATES = f"""{TX}, candidates as (
  select to_address as candidate from tx
  union all select {_ADDR.format("c_custkey")} from customer
  union all select upper({_ADDR.format("c_custkey")}) from customer
  union all select c_name from customer
  union all select concat({_ADDR.format("c_custkey")}, chr(10)) from customer),
states as (select candidate, case when trim(candidate) = '' then 'empty'
  when regexp_full_match(candidate, '0x[a-fA-F0-9]{{40}}') then 'ok' else 'invalid' end as state
  from candidates)"""

_GAPPY = """gappy as (
  select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice end as price,
    case when o_orderpriority <> '1-URGENT' then cast(o_custkey as double) end as customer,
    cast(null as double) as nothing,
    case when o_orderstatus = 'O' then cast(o_orderkey as varchar) else o_orderpriority end as text
  from orders)"""

_SCALER = """scaled as (
  select avg(o_totalprice) as m1, stddev_pop(o_totalprice) as s1,
    avg(o_custkey) as m2, stddev_pop(o_custkey) as s2 from orders)"""

_LOSS = "(greatest({z}, 0) - {z} * {y} + ln(1 + exp(-abs({z}))))"

_JSON = "concat('{', " + ", ',', ".join(
    f"""'"{c}":"', {c}, '"'""" for c in HISTORY_COLUMNS
) + ", '}')"


def _cells(source: str, label: str, prediction: str) -> str:
    return f"""select cast(a.v as integer) as actual, cast(p.v as integer) as predicted, (
      select count(*) from {source} where {label} = a.v and {prediction} = p.v) as records
    from (select unnest([0, 1]) as v) a cross join (select unnest([0, 1]) as v) p"""


# -- one statement per query ----------------------------------------------------------------


def statements() -> dict[str, str]:
    from txrisk.plans.explain import EVIDENCE, INSTRUCTION, TASK

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    feature_list = ", ".join(COMPUTED_FEATURES)
    pooled = []
    for kind in ("avg({})", "max({})", "max({}) filter (where step = 0)", "stddev_pop({})"):
        name = {"a": "mean", "s": "std"}.get(kind[0]) or ("first" if "filter" in kind else "max")
        digits = 6 if name == "std" else 9
        pooled += [f"round({kind.format(f)}, {digits}) as {name}_{f}" for f in SEQUENCE_FIELDS]

    return {
        "account_features": f"with {FEATS} select address, {feature_list} from feats",
        "account_features_full": f"with {TX_HUGE}, {ROWS}, ok as (select * from allhist where is_error = '0') "
        + _feature_sql("ok", ""),
        **{
            name: f"with {TX_HUGE}, {ROWS}, ok as (select * from allhist where is_error = '0') "
            + _feature_sql("ok", "")
            for name in ("rolled_features", "rolled_features_coarse")
        },
        **{
            name: f"""with {TX}, hub as (
              select {_ADDR.format("pos % 3")} as address, *, {_int("time_stamp")} as ts from tx),
              r as (select *, row_number() over (partition by address order by {order}) as rank from hub)
              select address, cast(rank as integer) as rank, hash, block_number from r
              where rank between 2991 and 3000"""
            for name, order in (("deep_page", _NEWEST), ("deep_page_oldest", _OLDEST))
        },
        "align_features": f"with {FEATS} select address, "
        + ", ".join(
            f"cast({c if c in COMPUTED_FEATURES else 0} as double) as {c}" for c in FEATURES
        )
        + " from feats",
        "touching_transactions": f"""with {BULK}, {ACC}, f as (select address from acc where flag = 1)
            select pos, from_address, to_address, source_address, value from bulk
            where from_address in (select address from f) or to_address in (select address from f)
              or source_address in (select address from f)""",
        "incidence_counts": f"""with {PAIRS} select address, count(*) as transactions,
            min(pos) as first_pos, max(pos) as last_pos from parties
            where address in (select address from acc where flag = 1) group by address""",
        "history_roles": f"""with {HIST} select address, pos, sent, received,
            sent and to_address = '' as created_contract,
            sent and to_address <> '' and input = '0xa9059cbb00000000000000000000000000000001' as contract_call
            from hist""",
        "distinct_accounts": f"with {TX}, {ROWS} select distinct address from allhist",
        "filter_label": f"with {ACC} select address, flag from acc where flag = 1",
        "numeric_projection": f"with {BULK} select pos, value, gas, gas_used, block_number from bulk",
        "select_existing": f"with {FEATS} select address, flag, min_sent, max_sent from feats",
        "recent_k": f"with {HIST}, {RECENT} select address, cast(rank as integer) as rank, hash, time_stamp from recent",
        "page_history": f"""with {HIST}, r as (select *, row_number() over (partition by address order by {_OLDEST}) as rank
            from hist) select address, cast(rank as integer) as rank, hash, block_number from r where rank between 26 and 50""",
        "tx_gaps": f"""with {HIST}, roles as (
            select address, 'sent' as role, pos, ts from hist where sent and ts > 0
            union all select address, 'received' as role, pos, ts from hist where received and ts > 0)
            select address, role, pos, ts,
              (ts - lag(ts) over (partition by address, role order by ts, pos)) / 60 as gap_mins from roles""",
        "batch_index": f"with {ACC} select address, flag, row_number() over (order by key) - 1 as batch_index from acc",
        "first_n_sequence": f"""with {PAIRS}, r as (
            select p.address, b.*, row_number() over (partition by p.address order by b.pos) - 1 as step
            from parties p join bulk b using (pos) where p.address in (select address from acc where flag = 1))
            select address, cast(step as integer) as step,
              cast(strftime(cast(created_at as timestamp), '%Y%m%d') as bigint) as created_at,
              value, gas, gas_used, block_number from r where step < 50""",
        "latest_sequence": f"with {HIST.replace(TX, TX_HUGE)} select * from {_latest('hist', 50, 'pos')}",
        "padded_length": f"""with {HIST}, s as {_latest("hist", 200, "pos")}
            select address, 200 as length, cast(count(*) as integer) as real_rows,
              cast(200 - count(*) as integer) as padding from s group by address""",
        "profile_sequence": f"with {PROFILE} select * from profile",
        "pooled_sequence": f"with {PROFILE} select address, {', '.join(pooled)} from profile group by address",
        "nest_transactions": f"""with {HIST}, {RECENT} select a.address, cast(rank as integer) as rank,
            {", ".join(f"r.{c}" for c in HISTORY_COLUMNS)} from acc a left join recent r using (address)""",
        "validate_address": f"with {_CANDIDATES} select candidate, count(*) as times, state from states group by candidate, state",
        "failed_requests": f"""with {_CANDIDATES} select case state when 'ok' then 'analysed' else state end as reason,
            count(*) as requests from states group by 1""",
        "short_address": f"""with {ACC} select address, concat(left(address, 6), '...', right(address, 4)) as short,
            address as key from acc""",
        "date_int": f"""with {BULK} select pos, created_at,
            cast(replace(left(created_at, 10), '-', '') as bigint) as day from bulk""",
        "hex_nonzero": f"""with {TX} select pos, input = '0xa9059cbb00000000000000000000000000000001' as input_set,
            regexp_matches(substr(hash, 3), '[1-9a-f]') as hash_set, true as gas_set from tx""",
        "safe_numbers": f"""with {TX_HUGE} select pos, case when try_cast(value as decimal(38,0)) is null
              then coalesce(try_cast(value as double), 0.0) / 1e18
              else cast(try_cast(value as decimal(38,0)) as double) / 1e18 end as ether,
            {_int("time_stamp")} as ts, nullif({_int("time_stamp")}, 0) as valid_ts, {_int("gas")} as gas,
            coalesce(try_cast(gas as double), 0.0) as gas_double, {WELL_FORMED} as well_formed from tx""",
        "undersample": f"""with {ACC}, r as (select *, row_number() over (order by md5(concat('42:', address)), address) as r
            from acc where flag = 0)
            select address, flag from r where r <= 100 union all select address, flag from acc where flag = 1""",
        "stratified_split": f"with {SPLIT} select address, flag, split from split",
        "split_counts": f"with {SPLIT} select split, flag, count(*) as records from split group by split, flag",
        "impute_median": f"""with {_GAPPY}, m as (select median(price) as p, median(customer) as c from gappy)
            select o_orderkey, coalesce(price, m.p) as price, coalesce(customer, m.c) as customer,
              0.0::double as nothing, coalesce(try_cast(text as double), 0.0) as text from gappy, m""",
        "fit_scaler": f"""with {_SCALER}
            select 0 as position, 'o_totalprice' as feature, round(m1, 6) as mean, round(s1, 6) as std from scaled
            union all select 1, 'o_custkey', round(m2, 6), round(s2, 6) from scaled
            union all select 2, 'constant', 7.3, 0.0""",
        "scale_features": f"""with {_SCALER} select o_orderkey, round((o_totalprice - m1) / s1, 6) as o_totalprice,
            round((o_custkey - m2) / s2, 6) as o_custkey, 0.0::double as constant from orders, scaled""",
        "assemble_training": f"""with {PAIRS}, r as (
            select p.address, b.value, row_number() over (partition by p.address order by b.pos) as r
            from parties p join bulk b using (pos)),
            s as (select address, count(*) as n, sum(value) as total from r where r <= 50 group by address)
            select address, flag, 50 as length, cast(coalesce(n, 0) as integer) as real_rows,
              round(coalesce(total, 0.0), 6) as value_total from acc left join s using (address)""",
        "one_hot_labels": f"with {ACC} select address, cast(1 - flag as double) as y0, cast(flag as double) as y1 from acc",
        "softmax_verdict": f"""with {SCORED} select address, p0, p1, predicted,
            case predicted when 1 then 'Fraud' else 'Normal' end as verdict, greatest(p0, p1) as confidence from scored""",
        "risk_band": f"""with {SCORED} select address,
            case when p1 * 100 <= 30 then 'low' when p1 * 100 <= 60 then 'medium' when p1 * 100 <= 80 then 'high'
              else 'very_high' end as band,
            concat(cast(cast(trunc(p1 * 100) as bigint) as varchar), '%') as label,
            case predicted when 1 then 'fraud' else 'normal' end as status,
            case predicted when 1 then 'FRAUD' else 'NORMAL' end as badge from scored""",
        "accuracy": "select round(avg(case when quality = toxic then 1.0 else 0.0 end), 6) as accuracy from labels",
        "bce_loss": f"""with {SCORED} select round(avg(({_LOSS.format(z="z0", y="(1 - flag)")}
            + {_LOSS.format(z="z1", y="flag")}) / 2), 6) as loss from scored""",
        "confusion_matrix": _cells("labels", "toxic", "quality"),
        "predicted_confusion": f"with {SCORED} " + _cells("scored", "flag", "predicted"),
        "analysis_row": f"""with {SCORED} select case predicted when 1 then 'Fraud' else 'Normal' end as prediction,
            predicted = 1 as is_fraud, address, cast(total_transactions as integer) as total_transactions,
            '2024-02-01T00:00:00' as analysis_timestamp, greatest(p0, p1) as confidence,
            cast(p1 as varchar) as fraud_probability from scored""",
        "explanation_prompts": f"""with {SCORED}, lists as (
            select address, concat('[', string_agg({_JSON}, ',' order by rank), ']') as used from recent group by address)
            select s.address, concat({text(INSTRUCTION)}, s.address, {text(EVIDENCE)}, coalesce(used, '[]'), {text(TASK)}) as prompt
            from scored s left join lists using (address) where predicted = 1""",
        "parse_explanations": """select concat('part-', cast(p_partkey as varchar)) as address, p_name as title,
              p_type as description, p_brand as examples from part
            union all select concat('turn-', cast(conv_id as varchar), '-', cast(turn as varchar)), null, null, ''
            from conversations""",
        "visible_explanations": f"""with {SCORED} select address, predicted = 1 as is_fraud,
            cast(flag as integer) as reasons, case when predicted = 1 and flag = 1 then address end as shown_title
            from scored""",
        "explorer_records": f"""with {HIST}, {RECENT} select address, rank - 1 as pos, hash, from_address, to_address,
            value, time_stamp from recent""",
        # The other branch of each join and ranking has the same rows.
        "touching_long_list": f"""with {BULK}, {ACC}, f as (
              select address from acc where flag = 1 union all select '')
            select pos, from_address, to_address, source_address, value from bulk
            where from_address in (select address from f) or to_address in (select address from f)
              or source_address in (select address from f)""",
        "touching_blank": f"""with {BULK}, {ACC}, f as (
              select address from acc where flag = 1 union all select '')
            select pos, from_address, to_address, source_address, value from bulk
            where from_address in (select address from f) or to_address in (select address from f)
              or source_address in (select address from f)""",
        "incidence_long_list": f"""with {PAIRS} select address, count(*) as transactions,
            min(pos) as first_pos, max(pos) as last_pos from parties
            where address in (select address from acc where flag = 1) group by address""",
        "history_long_list": f"with {HIST} select address, pos, sent, received from hist",
        "recent_k_hubs": f"with {HIST}, {RECENT} select address, cast(rank as integer) as rank, hash from recent",
        "page_history_hubs": f"""with {HIST}, r as (select *, row_number() over (partition by address order by {_OLDEST}) as rank
            from hist) select address, cast(rank as integer) as rank, hash from r where rank between 26 and 50""",
        "latest_sequence_hubs": f"with {HIST} select * from {_latest('hist', 50, 'pos')}",
        "tx_gaps_hubs": f"""with {HIST}, roles as (
            select address, 'sent' as role, pos, ts from hist where sent and ts > 0
            union all select address, 'received' as role, pos, ts from hist where received and ts > 0)
            select address, role, pos, ts,
              (ts - lag(ts) over (partition by address, role order by ts, pos)) / 60 as gap_mins from roles""",
        "kept_history_scan": f"with {FEATS} select address, {feature_list} from feats where flag = 1",
        # Models: what does not depend on the weights.
        "train_and_score": f"""with {ACC} select address, flag, {len(COMPUTED_FEATURES)} as features_used,
            50 as sequence_length, true as sums_to_one, true as agrees from acc""",
        **{
            name: f"""with {SPLIT} select split, count(*) as records, true as in_range, true as finite,
              true as same_accuracy, true as same_loss from split group by split"""
            for name in ("model_quality", "bulk_model")
        },
        "trained_weights": f"""with {_TWO} select cast(i as integer) as "position",
            case i when 0 then 'intercept' when 1 then 'sent_count' else 'unique_sent_to' end as name,
            round(case i when 0 then w0 when 1 then w1 else w2 end, 6) as newton,
            round(case i when 0 then w0 when 1 then w1 else w2 end, 3) as trained
            from weights8, (select unnest([0, 1, 2]) as i)""",
        "model_evaluation": f"""with {_TWO}, z as (select *, w0 + w1 * x1 + w2 * x2 as z from points, weights8)
            select split, count(*) as records, round(avg(case when (z > 0) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy,
              round(avg({_LOSS.format(z="z", y="y")}), 4) as loss from z group by split""",
        "model_predictions": f"""with {ACC} select flag as actual, count(*) as records, true as same_cells
            from acc group by flag""",
        "newest_stream": f"""with {HIST}, {RECENT} select a.address, cast(rank as integer) as rank,
            {", ".join(f"r.{c}" for c in HISTORY_COLUMNS)} from acc a left join recent r using (address)""",
        "quality_counters": f"""with {_CANDIDATES.replace(TX, TX_HUGE)}, c as (select count(*) as transactions,
              count(*) filter (where pos % 113 = 0) as null_from, count(*) filter (where pos % 127 = 0) as null_to,
              count(*) filter (where value <> '' and try_cast(value as double) is null) as unreadable_value,
              count(*) filter (where {_int("time_stamp")} <= 0) as untimed,
              count(*) filter (where not ({WELL_FORMED})) as malformed from tx),
            r as (select count(*) as requests, count(*) filter (where state <> 'ok') as failed_requests from states)
            select counter, records from (unpivot c on columns(*) into name counter value records)
            union all select counter, records from (unpivot r on columns(*) into name counter value records)""",
        "model_agreement": f"with {ACC} select address, flag as actual, true as is_class, true as agrees from acc",
        "score_static_only": f"with {ACC} select address, true as sums_to_one, true as agrees from acc",
        "batch_scan": f"""with {HIST} select key as batch_index, address,
            cast(case when n is null then 0 else least(n, 1000) end as integer) as total_transactions,
            cast(case when n is null then 0 else least(n, 1000) end as integer) as used, {len(COMPUTED_FEATURES)} as features_used,
            50 as sequence_length, true as sums_to_one, true as agrees
            from acc left join (select address, count(*) as n from hist group by address) using (address)""",
        "scan_stream": f"""with {HIST} select address, cast(case when n is null then 0 else least(n, 1000) end as integer) as total_transactions,
            cast(case when n is null then 0 else least(n, 1000) end as integer) as used, true as sums_to_one, true as agrees
            from acc left join (select address, count(*) as n from hist group by address) using (address)""",
        "stream_failures": f"""select c_name as address, 'invalid' as reason from customer
            union all select concat({_ADDR.format("c_custkey")}, chr(10)), 'invalid' from customer""",
        "batch_failures": """select row_number() over (order by c_custkey) - 1 as batch_index,
            case when c_custkey % 3 = 0 then null else c_name end as address,
            case when c_custkey % 3 = 0 then 'missing' else 'invalid' end as reason from customer""",
        "model_info": f"""select 'LogisticRegressionModel' as model_type, {len(COMPUTED_FEATURES)} as num_features,
            {len(COMPUTED_FEATURES)} as listed""",
        "feature_catalog": "select * from (values "
        + ", ".join(
            [f"('{c}', {i}, 'static')" for i, c in enumerate(COMPUTED_FEATURES)]
            + [
                f"('{n}', {i}, 'sequence')"
                for i, n in enumerate(f"{k}_{f}" for k in ("mean", "max", "first", "std") for f in SEQUENCE_FIELDS)
            ]
        )
        + ') t(name, "position", "group")',
        "saved_model": f"with {ACC} select address, true as same from acc",
        # Files: what was written comes back.
        "read_addresses": f"""select c_custkey as "index", {_ADDR.format("c_custkey")} as address,
            case when c_acctbal < 0 then 1 else 0 end as flag, c_acctbal as avg_sent from customer""",
        "read_transactions": f"with {BULK} select pos, from_address, to_address, value, gas, block_number from bulk",
        "explorer_internal": f"""with {HIST}, {RECENT}, internal as (select *,
              row_number() over (partition by address order by rank) - 1 as place from recent
              where contract_address <> '' or method_id <> '0x')
            select address, place as pos, hash, value, contract_address,
              case when contract_address <> '' then 'create' else 'call' end as call_type,
              concat(transaction_index, '_1') as trace_id,
              case when is_error = '1' then 'out of gas' else '' end as error_code from internal""",
        "explorer_tokens": f"""with {HIST}, {RECENT}, tokens as (select *, cast(nonce as bigint) % 7 as number,
              row_number() over (partition by address order by rank) - 1 as place from recent
              where starts_with(function_name, 'transfer('))
            select address, place as pos, hash, concat('Token ', cast(number as varchar)) as token_name,
              concat('T', cast(number as varchar)) as token_symbol, cast(number * 3 as varchar) as token_decimal,
              coalesce(try_cast(value as double), 0.0) / pow(10.0, number * 3) as amount from tokens""",
        "explorer_strict": f"""with {HIST}, {RECENT}
            select address, rank - 1 as pos, hash, value, cast(null as varchar) as problem from recent
            union all select address, null, null, null, concat('explorer response without a list for ', address)
            from acc where address not in (select address from recent)""",
        "explorer_landed_again": f"""with {HIST}, {RECENT} select address, rank - 1 as pos, hash, from_address,
            to_address, value, time_stamp from recent""",
        "feature_table": f"with {FEATS} select address, flag, {feature_list} from feats",
        "written_results": f"""with {SCORED} select address, predicted = 1 as is_fraud,
            cast(total_transactions as integer) as total_transactions, true as stamped from scored""",
    }
