"""Personal data: labelers vote, their reliability is estimated, a classifier decides.

Base spans (email, ip, card, phone by fixed patterns) are always reported. Candidates
of the same kinds and of ``ssn`` come from looser patterns. Each
candidate is judged by labelers of three sorts, which vote for, against, or
abstain: patterns (shape, checksum), gazetteers (known prefixes, endings and
reserved numbers) and context (words before the candidate).

1. All documents give counts per vote pattern and feature set; both come from fixed
   lists, so the table of counts does not grow with the text.
2. Expectation-maximisation over the counts estimates, per kind, the share of
   personal data and how reliable each labeler is; the base patterns' spans anchor it.
3. The probabilities are the targets of a logistic span classifier over
   features that include what no labeler looks at (shape around the span, length).
4. A second pass reports base spans and the candidates the classifier accepts that
   do not overlap a base span or an accepted one before it.

Null texts count as empty, texts have any length. Positions are code points, ends exclusive. Kinds
are ordered email, ip, card, phone, ssn; of candidates that overlap, the first by place and then the shorter
one is taken. Repeated rows are counted and judged one by one. An empty table gives an empty
result and a model that takes nothing; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm import spans as base
from txrisk.llm.common import texts

KINDS = ("email", "ip", "card", "phone", "ssn")
BASE = {"email": base.emails, "ip": base.ips, "card": base.cards, "phone": base.phones}

# Looser shapes than the base patterns, all linear in the text. Names and hosts are of any
# length; the other numbers are those of the formats.
_LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++"
        r"(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{2,}+)++"
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(
        r"(?<![0-9+])(?:00[1-9][0-9 ().-]{7,18}[0-9]|\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
    ),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: A text without these cannot hold a loose candidate of the kind.
_HINT = {
    "email": re.compile(r"[(\[ ]at[)\] ]"),
    "ip": re.compile(r":[0-9A-Fa-f]{1,4}:"),
    "card": re.compile(r"[0-9]{4}"),
    "phone": re.compile(r"[0-9]{3}"),
    "ssn": re.compile(r"[0-9]-[0-9]{2}-[0-9]"),
}

# Words that announce personal data, and words that announce other numbers.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "from", "login", "client"),
    "card": ("card", "visa", "credit", "debit", "mastercard", "payment", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "whatsapp"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = (
    "version", "order", "invoice", "isbn", "section", "page", "figure", "chapter", "id", "sku", "serial",
    "ref", "reference", "ticket", "build", "release", "article", "no", "number",
)
# Common endings of hosts, and first digits of issued cards.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "co")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")

_WORD = re.compile(r"[^\W_]+")
LABELERS = ("shape", "check", "gazetteer", "context", "counter_context")


def candidates(text: str):
    """``(kind, start, end, from base)`` of one text, base spans first within a kind."""
    out = []
    for kind in KINDS:
        sure = BASE[kind](text) if kind in BASE else []
        out += [(kind, a, b, True) for a, b in sure]
        if _HINT[kind].search(text):
            known = iter(sure)
            a, b = next(known, (None, None))
            for m in _LOOSE[kind].finditer(text):
                while a is not None and b <= m.start():
                    a, b = next(known, (None, None))
                if a is None or m.end() <= a:
                    out.append((kind, *m.span(), False))
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One of 1 (personal), -1 (not), 0 (abstains) per labeler."""
    span = text[start:end]
    digits = base.digits_of(span)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-4:]]
    shape = check = gazetteer = 0
    if kind == "email":
        host = re.split(r"@|\(at\)|\[at\]| at ", span)[-1]
        last = re.split(r"\.|\(dot\)|\[dot\]| dot ", host)[-1].strip().lower()
        shape = 1 if "@" in span or "(" in span or "[" in span else -1
        check = 1 if last.isalpha() and len(last) >= 2 else -1
        gazetteer = 1 if last in ENDINGS else 0
    elif kind == "ip":
        parts = span.split(".") if "." in span else span.split(":")
        shape = 1 if len(parts) in (4, 8) else -1
        check = 1 if "." in span else (0 if any(c.isalpha() for c in span) else -1)
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == "card":
        shape = 1 if len(digits) in (15, 16) else -1
        check = 1 if base.luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_STARTS) else -1
    elif kind == "phone":
        shape = 1 if span[0] in "+(" or span.startswith("00") else 0
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = -1 if len(set(digits)) <= 2 else 0
    else:
        shape = 1 if len(digits) == 9 else -1
        # Never issued: area 000, 666 and from 900 on, group 00, serial 0000.
        issued = not (digits[:3] in ("000", "666") or digits[0] == "9" or "00" == digits[3:5] or digits[5:] == "0000")
        check = 1 if issued else -1
        gazetteer = -1 if len(set(digits)) == 1 else 0
    context = 1 if any(w in CONTEXT[kind] for w in before) else 0
    counter = -1 if any(w in AGAINST for w in before[-2:]) else 0
    return shape, check, gazetteer, context, counter


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees besides the kind; small numbers from fixed ranges."""
    span = text[start:end]
    digits = base.digits_of(span)
    before, after = text[start - 1 : start], text[end : end + 1]
    marks = {c for c in span if not c.isalnum()}
    return (
        min(len(digits), 20), min(len(span) // 4, 10), min(len(marks), 4),
        int(not before or before.isspace()), int(before.isalnum()),
        int(not after or after.isspace()), int(after.isalnum()),
    )


_WIDTHS = (21, 11, 5, 2, 2, 2, 2)


def _vector(kind: str, vote: tuple, feature: tuple) -> np.ndarray:
    """One-hot kind, features and votes."""
    parts = [np.eye(len(KINDS))[KINDS.index(kind)]]
    parts += [np.eye(w)[f] for w, f in zip(_WIDTHS, feature)]
    parts += [np.eye(3)[v + 1] for v in vote]
    return np.concatenate(parts)


@dataclass
class SpanModel:
    """``accept`` holds the decision for each pattern the corpus has; others are scored."""

    weights: np.ndarray
    cut: float = 0.5
    accept: dict = field(default_factory=dict)
    reliability: dict = field(default_factory=dict)

    def probability(self, key: tuple) -> float:
        return float(1 / (1 + np.exp(-np.clip(_vector(*key) @ self.weights, -40, 40))))

    def takes(self, key: tuple) -> bool:
        if key not in self.accept:
            self.accept[key] = self.probability(key) >= self.cut
        return self.accept[key]


def pattern_counts(docs: DataFrame) -> DataFrame:
    """``kind, votes, features, sure, n`` over all candidates of all documents."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                for kind, a, b, sure in candidates(text):
                    found[kind, votes(text, kind, a, b), features(text, kind, a, b), sure] += 1
        rows = list(found)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([r[0] for r in rows], pa.string()),
            "votes": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            "features": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            "sure": pa.array([r[3] for r in rows], pa.bool_()),
            "n": pa.array([found[r] for r in rows], pa.int64()),
        })

    counts = texts(docs).select("text").mapInArrow(
        run, "kind string, votes array<int>, features array<int>, sure boolean, n long"
    )
    return counts.groupBy("kind", "votes", "features", "sure").agg(F.sum("n").alias("n"))


def reliabilities(vote: np.ndarray, sure: np.ndarray, n: np.ndarray, rounds: int = 50):
    """``(posterior, share, rates)`` by expectation-maximisation.

    ``rates[l, c, v]``: how often labeler ``l`` votes ``v`` (against, abstains, for) on a
    candidate of class ``c``. Base spans count as certain; a weak prior says that labelers
    are better than chance.
    """
    onehot = (vote[:, :, None] == np.array([-1, 0, 1])).astype(float)
    prior = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])
    posterior = np.where(sure, 1.0, 1 / (1 + np.exp(-vote.sum(axis=1))))
    share, rates = 0.5, None
    for _ in range(rounds):
        mass = np.stack([n * (1 - posterior), n * posterior])
        rates = np.einsum("cr,rlv->lcv", mass, onehot) + prior
        rates /= rates.sum(axis=2, keepdims=True)
        free = ~sure
        share = ((n * posterior)[free].sum() + 1) / (n[free].sum() + 2)
        log = np.einsum("rlv,lcv->rc", onehot, np.log(rates)) + np.log([1 - share, share])
        posterior = np.where(sure, 1.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40))))
    return posterior, share, rates


def fit(docs: DataFrame) -> SpanModel:
    """Estimate the labelers and train the classifier on counts over all documents."""
    rows = pattern_counts(docs).orderBy("kind", "votes", "features", "sure").collect()
    size = len(KINDS) + sum(_WIDTHS) + 3 * len(LABELERS)
    if not rows:
        return SpanModel(np.zeros(size), cut=2.0)
    target = np.zeros(len(rows))
    n = np.array([r["n"] for r in rows], float)
    sure = np.array([r["sure"] for r in rows])
    reliability = {}
    for kind in KINDS:
        own = np.array([i for i, r in enumerate(rows) if r["kind"] == kind], int)
        if len(own):
            vote = np.array([rows[i]["votes"] for i in own])
            target[own], share, rates = reliabilities(vote, sure[own], n[own])
            reliability[kind] = {"share": share, "rates": rates}
    x = np.stack([_vector(r["kind"], tuple(r["votes"]), tuple(r["features"])) for r in rows])
    w, weight = np.zeros(size), n / n.sum()
    # Newton steps on the ridge-regularised log loss; the matrix has some 65 columns.
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(size)
        w = w - np.linalg.solve(curve, gradient)
    return SpanModel(w, reliability=reliability)


def spans_of(text: str, model: SpanModel) -> tuple[list, list]:
    """``(base spans, all spans)``, both by kind and then position."""
    found = candidates(text)
    sure = [(k, a, b) for k, a, b, s in found if s]
    # Base spans as intervals apart from each other, to look overlaps up in.
    lows, highs = [], []
    for _, a, b in sorted(sure, key=lambda x: x[1]):
        if highs and a < highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)
    extra, free = [], 0
    for kind, a, b, s in sorted(found, key=lambda c: (c[1], c[2])):
        i = bisect_left(lows, b)
        if s or a < free or (i and highs[i - 1] > a):
            continue
        if model.takes((kind, votes(text, kind, a, b), features(text, kind, a, b))):
            extra.append((kind, a, b))
            free = b
    order = {k: i for i, k in enumerate(KINDS)}
    return sure, sorted(sure + extra, key=lambda x: (order[x[0]], x[1], x[2]))


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Per document: ``doc_id``, counts and digest of the base spans, ``spans`` of all."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            counts = {k: [] for k in BASE}
            digests, every = [], []
            for text in batch.column("text"):
                sure, spans = spans_of(text.as_py(), model)
                for k, out in counts.items():
                    out.append(sum(s[0] == k for s in sure))
                digests.append(base.digest(sure))
                every.append(base.joined(spans))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")}
                | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
                | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(every, pa.string())}
            )

    return texts(docs).mapInArrow(
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs``, all columns, with every span replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text):
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in sorted(spans_of(text, shared.value)[1], key=lambda s: (s[1], -s[2])):
            if b > at:
                out += [text[at : max(a, at)], f"[{kind}]"]
                at = b
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(clean)

    return docs.withColumn("text", run(F.col("text").cast("string")))
