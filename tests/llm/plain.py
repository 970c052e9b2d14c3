"""The operators once more, in plain Python over small tables."""

import collections
import re
import zlib

import numpy as np

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = {k: k + 32 for k in range(65, 91)}

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def bag(text, k=5):
    w = words(text)
    if len(w) < k:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_classes(texts, least=0.8):
    """doc -> smallest doc of its class; ``texts``: doc -> text."""
    bags = {i: bag(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, b in bags.items():
        for x in b:
            holders[x].append(i)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = {(min(x, y), max(x, y)) for h in holders.values() for x in h for y in h if x != y}
    for x, y in pairs:
        both = sum((bags[x] & bags[y]).values())
        if both >= least * (sum(bags[x].values()) + sum(bags[y].values()) - both):
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def without_repeats(texts, least=20, documents=3):
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\v\f\r").translate(ASCII_LOWER)
            if len(key) >= least:
                holders[key].add(i)
    out = {}
    for i, t in texts.items():
        kept = []
        for line in (t or "").split("\n"):
            h = holders.get(line.strip(" \t\n\v\f\r").translate(ASCII_LOWER), ())
            if len(h) < documents or i == max(h):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def contaminated(texts, items, span=13):
    wins = set()
    for t in items:
        w = words(t)
        n = min(span, len(w))
        wins.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    sizes = {len(w) for w in wins}
    out = set()
    for i, t in texts.items():
        w = words(t)
        hit = set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [
            m.span() for m in CARD.finditer(text)
            if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))
        ],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15],
    }


def secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def check_packing(rows, ids, window=2048):
    """Every id in one piece, sequences gapless and in order; returns the padding."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start))
    assert set(pieces) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    for doc, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    order, padding = [], 0
    for number in sorted(sequences):
        at = 0
        for offset, length, doc, start in sorted(sequences[number]):
            assert offset == at
            at += length
            order.append((doc, start))
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    assert order == sorted(order)
    return padding
