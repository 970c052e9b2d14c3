"""Features and sequences of one account in plain Python, row by row.

Made from the definitions of the features: every row updates the tallies of the
roles the account plays in it.
"""

from __future__ import annotations

import dataclasses
import re


def parse(text, kind):
    """Blank is 0; unreadable text is None."""
    if not text:
        return kind(0)
    try:
        return kind(text)
    except ValueError:
        return None


@dataclasses.dataclass
class Tally:
    rows: int = 0
    low: float = float("inf")
    high: float = 0.0
    total: float = 0.0
    partners: set = dataclasses.field(default_factory=set)
    times: int = 0
    gaps: float = 0.0
    latest: int | None = None
    span: tuple = (float("inf"), 0)

    def add(self, ether, time, partner):
        self.rows += 1
        self.low, self.high = min(self.low, ether), max(self.high, ether)
        self.total += ether
        self.partners.add(partner)
        if time > 0:
            if self.latest is not None:
                self.gaps += (time - self.latest) / 60
            self.times, self.latest = self.times + 1, time
            self.span = (min(self.span[0], time), max(self.span[1], time))

    def money(self):
        if self.rows == 0:
            return 0.0, 0.0, 0.0
        return self.low, self.high, self.total / self.rows

    def gap(self):
        return self.gaps / (self.times - 1) if self.times > 1 else 0.0


def parties(row):
    return row["from_address"].lower(), row["to_address"].lower()


def touches(rows, address):
    return [r for r in rows if address in parties(r)]


def newest(rows, k):
    keys = ("time_stamp", "block_number", "transaction_index")
    by_hash = sorted(rows, key=lambda r: r["hash"])
    return sorted(by_hash, key=lambda r: [parse(r[c], int) or 0 for c in keys], reverse=True)[:k]


def features(address, rows):
    everything, out, into, calls = Tally(), Tally(), Tally(), Tally()
    creations = 0
    for row in rows:
        source, target = parties(row)
        ether = (parse(row["value"], float) or 0.0) / 1e18
        time = parse(row["time_stamp"], int) or 0
        everything.add(ether, time, None)
        if target == address:
            into.add(ether, time, source)
        if source == address:
            out.add(ether, time, target)
            creations += target == ""
            if target and re.fullmatch("(0x)?[0-9a-f]*[1-9a-f][0-9a-f]*", row["input"].lower()):
                calls.add(ether, time, target)
    result = {
        "avg_min_between_sent": out.gap(),
        "avg_min_between_received": into.gap(),
        "time_diff_first_last_mins": 0.0,
        "sent_count": out.rows,
        "received_count": into.rows,
        "created_contracts": creations,
        "unique_received_from": len(into.partners),
        "unique_sent_to": len(out.partners - {""}),
        "total_transactions": everything.rows,
        "total_sent": out.total,
        "total_received": into.total,
        "total_sent_contracts": calls.total,
        "total_balance": into.total - out.total,
    }
    if everything.times > 1:
        result["time_diff_first_last_mins"] = (everything.span[1] - everything.span[0]) / 60
    for name, tally in (("sent", out), ("received", into), ("sent_contract", calls)):
        for kind, value in zip(("min", "max", "avg"), tally.money()):
            result[f"{kind}_{name}"] = value
    return result


# Field, type and scaling of the ten positions.
POSITIONS = [
    ("time_stamp", int, lambda v: v % 10**6),
    ("value", float, lambda v: v / 1e18),
    ("gas", int, lambda v: v / 1e6),
    ("gas_price", int, lambda v: v / 1e9),
    ("gas_used", int, lambda v: v / 1e6),
    ("is_error", int, float),
    (None, int, float),
    ("block_number", int, lambda v: v % 10**6),
    ("transaction_index", int, float),
    ("confirmations", int, lambda v: v / 100),
]


def sequence(rows, length):
    kept = []
    for row in rows:
        raw = [parse(row[field] if field else "", kind) for field, kind, _ in POSITIONS]
        if None not in raw:
            kept.append((raw[0], [scale(v) for v, (_, _, scale) in zip(raw, POSITIONS)]))
    ordered = [values for _, values in sorted(kept, key=lambda s: s[0], reverse=True)]
    return (ordered + [[0.0] * 10] * length)[:length]
