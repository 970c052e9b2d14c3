"""Secrets in texts, and credentials whose parts stand apart.

Base spans (assign, access, hex by fixed patterns) are always reported. Weak
candidates are not evidence by themselves: identifiers of accounts, tokens that look
random, and endpoints. An interval join links them inside a scope, ``reach`` code
points around a part in the same document, and a candidate is
reported only with its complements:

    weak_id       with a secret (assign, hex or a random token)
    weak_secret   with an identifier (access or weak_id)
    endpoint      with an identifier and a secret

Parts meet by document and by bins of the scope's width, and a semi join keeps the
candidates, so no pairs are written and a bin holds no more parts than fit into it.

Null texts count as empty. Positions are code points, ends exclusive. Equal rows get
equal results; rows that share only the doc_id are scanned one by one. Texts and parts have any length; of
candidates that overlap, the first by place is taken. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import stored, texts
from txrisk.llm.spans import digest

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
REACH = 200


def _either(word: str) -> str:
    """Both cases of ASCII letters, and nothing that only folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ID_NAMES = "|".join(
    [f"{_either(a)}_?{_either('id')}" for a in ("client", "key")]
    + [f"{_either('user')}(?:{_either('name')})?", _either("login"), _either("account")]
)
_SCHEMES = "|".join([f"{_either('http')}[sS]?", *map(_either, ("ftp", "s3", "postgres", "mysql", "redis", "mongodb", "amqp"))])
_END_NAMES = "|".join(map(_either, ("endpoint", "host", "server")))
# Runs have no upper bound; they are possessive, so each character is read once.
_WEAK_ID = re.compile(
    rf"""(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{{6,}}+|(?:{_ID_NAMES})"""
    r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]{3,}+)(?![A-Za-z0-9])"""
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(
    rf"""(?<![A-Za-z0-9])(?:(?:{_SCHEMES})://[^\s"'<>]{{3,}}+"""
    rf"""|(?:{_END_NAMES})["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9.:-]{{3,}}+)"""
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _random_looking(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
    return digits >= 3 and upper and lower and len(set(token)) >= 10


def weak_spans(text: str, sure: list) -> list[tuple[str, int, int]]:
    """Weak candidates that do not overlap a base span; kinds may overlap each other."""
    out = [("weak_id", *m.span()) for m in _WEAK_ID.finditer(text)]
    out += [("weak_secret", *m.span()) for m in _TOKEN.finditer(text) if _random_looking(m.group())]
    out += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    out.sort(key=lambda s: (s[1], s[2]))
    ahead = sorted((a, b) for _, a, b in sure)
    starts, reached = [a for a, _ in ahead], list(accumulate((b for _, b in ahead), max))
    kept = []
    for kind, a, b in out:
        # Base spans that begin before the candidate ends.
        n = bisect_left(starts, b)
        if n == 0 or reached[n - 1] <= a:
            kept.append((kind, a, b))
    return kept


def _scan(batches):
    import pyarrow as pa

    part = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        counts = {k: [] for k in KINDS[:3]}
        digests, bases, weaks = [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            sure = base_spans(text)
            for k, out in counts.items():
                out.append(sum(s[0] == k for s in sure))
            digests.append(digest(sure))
            for out, spans in ((bases, sure), (weaks, weak_spans(text, sure))):
                out.append([{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in spans])
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "h": batch.column("h")}
            | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
            | {"base_sha256": pa.array(digests, pa.string())}
            | {"sure": pa.array(bases, part), "weak": pa.array(weaks, part)}
        )


_PART = "array<struct<kind: int, start: long, `end`: long>>"
_SCANNED = (
    "doc_id long, h long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    f"sure {_PART}, weak {_PART}"
)


def linked(weak: DataFrame, parts: DataFrame, kinds: tuple[str, ...], reach: int) -> DataFrame:
    """The rows of ``weak`` with a part of one of ``kinds`` in reach.

    Both: ``id, h, kind, start, end``. The distance is the gap between the spans.
    """
    wanted = [KINDS.index(k) for k in kinds]
    bins = F.sequence(
        F.floor(F.col("start") / reach) - 1, F.floor((F.col("end") + reach) / reach)
    )
    # A long span lies in all bins it touches, so a partner is found from any side.
    spread = parts.where(F.col("kind").isin(wanted)).select(
        F.col("id").alias("p_id"), F.col("h").alias("p_h"), F.col("start").alias("p_start"),
        F.col("end").alias("p_end"), F.col("kind").alias("p_kind"),
        F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("p_bin"),
    )
    near = (
        (F.col("id") == F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("bin") == F.col("p_bin"))
        & (F.col("p_start") - F.col("end") <= reach) & (F.col("start") - F.col("p_end") <= reach)
        & ~((F.col("p_start") == F.col("start")) & (F.col("p_end") == F.col("end")))
    )
    return (
        weak.withColumn("bin", F.explode(bins)).join(spread, near, "left_semi")
        .select("id", "h", "kind", "start", "end").distinct()
    )


IDS, SECRETS = ("access", "weak_id"), ("assign", "hex", "weak_secret")


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document: ``doc_id``, counts and digest of the base spans, ``spans`` of all."""
    scanned = stored(
        texts(docs).withColumn("h", F.xxhash64("text")).mapInArrow(_scan, _SCANNED), "secrets"
    ).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    # Only documents with weak candidates have anything to link.
    some = scanned.where(F.size("weak") > 0)
    weak = some.select("id", "h", F.inline("weak"))
    parts = some.select("id", "h", F.inline(F.concat("sure", "weak")))
    kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    found = linked(weak.where(kind["weak_id"]), parts, SECRETS, reach).union(
        linked(weak.where(kind["weak_secret"]), parts, IDS, reach)
    )
    with_id = linked(weak.where(kind["endpoint"]), parts, IDS, reach)
    found = found.union(linked(with_id, parts, SECRETS, reach))
    extra = found.groupBy("id", "h").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("extra")
    )
    none = F.array().cast(_PART)
    spans = F.array_sort(
        F.transform(
            F.concat("sure", F.coalesce("extra", none)),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
        )
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return scanned.join(stored(extra, "links"), ["id", "h"], "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(shown, ",").alias("spans")
    )
