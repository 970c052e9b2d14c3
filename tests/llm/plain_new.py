"""Plain Python versions of spelling forms, order sketches and conversation repair."""

import collections
import hashlib
import re
import string
import zlib

import xxhash

# -- spelling ---------------------------------------------------------------------

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted_words(rows, least_length=7, least=2):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def forms(counts, factor=10):
    """``(word, form, root, n, n_near, form_n)`` by comparing words that share a deletion."""
    groups = collections.defaultdict(set)
    for w in counts:
        groups[w].add(w)
        for i in range(len(w)):
            groups[w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for g in groups.values():
        for a in g:
            near[a].update(b for b in g if one_edit(a, b))
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= factor * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


# -- order sketches -----------------------------------------------------------------

MASK = (1 << 64) - 1


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(raw, seed=42):
    return xxhash.xxh64(raw, seed=seed & MASK).intdigest()


def _long(x, seed=42):
    return _hash((x & MASK).to_bytes(8, "little"), seed)


def text_hash(text):
    return _signed(_hash(text.encode()))


def sketch(text, k=3, size=2, bins=64):
    """Every component by a sort of all numbered k-mers from its own start of the range on."""
    space = " \t\n\x0b\f\r"
    tokens = re.findall(f"[{space}]*[^{space}]{{1,8}}|[{space}]+", text)
    hashed = [_hash(t.encode()) for t in tokens]
    seen, every = collections.Counter(), []
    for i in range(len(hashed)):
        h = 42
        for x in hashed[i : i + k]:
            h = _long(x, h)
        times = seen[h]
        seen[h] += 1
        if times:
            every.append((_signed(_hash(times.to_bytes(4, "little"), _long(h))), i))
        else:
            every.append((_signed(h), i))
    if not every:
        return [-1] * bins
    out = []
    for j in range(bins):
        start = -(1 << 63) + j * (1 << 64) // bins
        chosen = sorted(every, key=lambda e: ((e[0] - start) & MASK, e[1]))[:size]
        h = 42
        for value, _ in sorted(chosen, key=lambda e: e[1]):
            h = _long(value, h)
        out.append(h & 0x7FFFFFFF)
    return out


def fingerprints(rows):
    """Rows of the query, for ``(doc_id, text)``."""
    rows = sorted(
        ((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))
    )
    sketches = [sketch(t) for _, t in rows]
    written = lambda s: "".join(f"{v & 0xFFFFFFFF:08x}" for v in s)
    alike = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = sketch(edited)
        out.append((
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(sketches[i]),
            written(changed), alike(sketches[i], changed), alike(sketches[i], sketches[(i + 1) % len(rows)]),
        ))
    return out


# -- conversations --------------------------------------------------------------------

NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    """``{conv_id: [(turn, role, text)]}`` and all conv_ids, of ``(conv_id, turn, role, text)``."""
    out, ids = collections.defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out, ids


def repaired(rows):
    """``gaps, blank, duplicate, truncated, illegal, cost, audit, sha256`` of damaged rows.

    Every state carries its cheapest and then least audit with all it wrote, from front to back.
    """
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    rows = sorted(rows, key=order)
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        if not marks:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    states = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        moves = [(2, "D", None, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            moves += [(extra, "K", role[:1], role), (1 + extra, "R", "u", "user"), (1 + extra, "R", "a", "assistant")]
        new = {}
        for state, (cost, audit, wrote) in states.items():
            for _ in range(4):
                for price, edit, initial, name in moves:
                    if initial is not None and initial not in NEXT[state]:
                        continue
                    end = state if initial is None else NEXT[state][initial]
                    added = () if initial is None else ((name, text),)
                    now = (cost + price, audit + edit, wrote + added)
                    if end not in new or now[:2] < new[end][:2]:
                        new[end] = now
                letter = "a" if state == 2 else "u"
                cost, audit, wrote = cost + 5, audit + "I", (*wrote, (NAMES[letter], ""))
                state = NEXT[state][letter]
        states = new
    ends = []
    for state, (cost, audit, wrote) in states.items():
        for letter in ("", "ua", "a", "")[state]:
            cost, audit, wrote = cost + 5, audit + "I", (*wrote, (NAMES[letter], ""))
        ends.append((cost, audit, wrote))
    cost, audit, wrote = min(ends, key=lambda e: e[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in wrote).encode()).hexdigest()
    count = collections.Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest
