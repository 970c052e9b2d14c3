"""The interval join of op6 against a comparison of all pairs of a text."""

import random

import pytest
from conftest import SMALL

from txrisk.llm import secretlinks as links

ORDER = {k: i for i, k in enumerate(links.KINDS)}


def plain(text, reach):
    """Base spans, and the weak candidates that have their complements in reach."""
    sure = links.base_spans(text)
    weak = links.weak_spans(text, sure)
    parts = [*sure, *weak]

    def near(span, kinds):
        return any(
            k in kinds and (a, b) != span[1:] and a - span[2] <= reach and span[1] - b <= reach
            for k, a, b in parts
        )

    found = []
    for span in weak:
        if span[0] == "weak_id":
            taken = near(span, links.SECRETS)
        elif span[0] == "weak_secret":
            taken = near(span, links.IDS)
        else:
            taken = near(span, links.IDS) and near(span, links.SECRETS)
        if taken:
            found.append(span)
    spans = sorted({*sure, *found}, key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(df, reach):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.spans) for r in links.find(df, reach).collect()), key=repr)
    assert got == sorted(((d, plain(t, reach)) for d, t in rows), key=repr)
    return got


def test_given_documents(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"), links.REACH)


@pytest.mark.parametrize("reach", [1, 30, 200])
def test_parts_at_any_distance(spark, reach):
    """Parts strewn over texts, at the edges of the scope and across its bins, more of some than others."""
    random.seed(reach)
    token = lambda n: "".join(random.choices("ABCDEFGHJKabcdefghjk0123456789", k=n))
    makers = [
        lambda: f"DB_USER={token(8)}", lambda: f"client_id: {token(12)}", lambda: token(32), lambda: token(40),
        lambda: f"https://api.{token(5).lower()}.com/v1", lambda: f"host={token(6).lower()}.example.net",
        lambda: f"password = {token(10)}", lambda: "AKIA" + token(16).upper(), lambda: f"{random.getrandbits(128):032x}",
    ]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(random.randrange(1, 7)):
            text += random.choice(makers)() + " " + "x" * random.choice([0, 1, reach - 1, reach, reach + 1, 3 * reach]) + " "
        rows.append((i % 140, text))
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), reach)
    assert reach == 1 or any("weak_id" in s for _, s in got) and any("endpoint" in s for _, s in got)
