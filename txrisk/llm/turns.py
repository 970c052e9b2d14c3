"""Repair of conversations by Hirschberg's divide and conquer.

A repaired conversation has roles whose initials read ``(s?(ua)+)?``. Rows are kept (0),
get the role user or assistant (1) or are deleted (2); rows of role user or assistant
without text are inserted (5). Blank rows and rows whose role and text were seen before
must go, and a row that ends in the middle of a sentence costs 5 unless it goes. Of the
cheapest repairs the one is taken whose edits, as initials in order (the audit), are
least in ASCII.

1. Without their texts, rows are sorted over all partitions by conversation and turn, and
   each one is given a letter for its role and fault. ``BLOCK`` rows at most of a
   conversation make a block: one short string.
2. There are four states: nothing yet, after system, after user, after assistant. A block
   is a table of costs from state to state, with the order of the audits among those from
   the same state. Audits of two states after the same rows are never one the
   beginning of the other, so this order is all that has to be known of them.
3. Between the blocks of a conversation, and then between the rows of a block, the
   states are found by halving: costs from the front and costs from the back meet in the
   middle, the cheapest crossing is taken, of several the one with the least audit, and
   both halves go on by themselves. Only vectors of four costs are kept.
4. Texts travel once, to meet their edits in the order of the conversation.

A conversation of any length is sorted and repaired in many tasks. Only its digest, and
its text written out in order, come from one task, a batch of rows at a time, because a
SHA-256 has no parts.

Nulls in role and text are one space; rows without a turn come first. Rows of a turn are
ordered by role, then by the MD5 of the text; equal rows are duplicates of each other. A
null conv_id is a conversation of its own. A role counts by its first letter, and any
other than s, u and a (or none) never fits. Empty tables give empty results; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import stored
from txrisk.llm.sqlparts import CRC_TABLE, crc32

#: Rows of a block, as a power of two.
BLOCK_BITS = 12
#: What does not make a text: code points 32 and 9 to 13.
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults in the order in which they count.
FAULTS = ("none", "truncated", "blank", "duplicate")
INITIALS = "suax"
# States by number: nothing yet, after system, after user, after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What it takes to end in a state: the roles to insert.
TAIL = ("", "ua", "a", "")
NEVER = 1 << 40


# -- rows -----------------------------------------------------------------------


def _filled(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults that the crc32 of ``conv_id:turn`` picks, by
    its remainder of 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats
    it, 4 makes the role user. Nulls are one space."""
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    kind = F.col("kind")
    rows = _filled(conversations).withColumn("kind", F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20)))
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.where(kind != 0).withColumn("copy", F.explode(copies)).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, h``; equal rows have equal keys."""
    return _filled(rows).withColumn("h", F.unhex(F.md5("text")))


def marked(rows: DataFrame) -> DataFrame:
    """``at, conv_id, turn, role, h, initial, fault``: rows without their texts, numbered in order.

    ``at`` ascends by conversation, turn, role and text, and has no gaps inside a
    partition of the sorted rows.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    first = F.left("role", F.lit(1))
    light = _keyed(rows).select(
        "conv_id", "turn", "role", "h",
        F.when(first.isin(*INITIALS[:3]), first).otherwise(F.lit(INITIALS[3])).alias("initial"),
        F.when(bare == "", F.lit(2)).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit(1))
        .otherwise(0).alias("fault"),
        # Spreads equal rows over partitions; their order among themselves does not matter.
        F.monotonically_increasing_id().alias("spread"),
    )
    order = ["conv_id", "turn", "role", "h"]
    light = light.repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    light = stored(light.drop("spread").withColumn("at", F.monotonically_increasing_id()), "turns")
    seen = (
        light.where("fault <> 2").groupBy("conv_id", "role", "h")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")).where("rows > 1")
    )
    seen = seen.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "h")], "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (
        F.col("h") == F.col("_h")
    )
    duplicate = (F.col("fault") != 2) & (F.col("at") != F.col("first"))
    return light.join(seen, same, "left").select(
        "at", *order, "initial", F.when(duplicate, F.lit(3)).otherwise(F.col("fault")).alias("fault")
    )


# -- costs ----------------------------------------------------------------------


def _moves(initial: str, fault: int) -> list[tuple[int, str, str]]:
    """``(cost, edit, role initial)`` that a row allows."""
    out = [(DELETE, "D", "")]
    if FAULTS[fault] in ("none", "truncated"):
        extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
        out.append((KEEP + extra, "K", initial))
        out += [(REROLE + extra, "R", role) for role in "ua"]
    return out


def _step(letter: str) -> tuple[list, list]:
    """Table of a row: ``[from][to]`` costs, and tokens such as ``IuK`` or ``Ra``."""
    number = ord(letter) - 65
    moves = _moves(INITIALS[number // 4], number % 4)
    costs = [[NEVER] * 4 for _ in range(4)]
    tokens = [[""] * 4 for _ in range(4)]
    audits = [[""] * 4 for _ in range(4)]
    for begin in range(4):
        state, paid, inserted = begin, 0, ""
        # Two insertions lead to every state that insertions reach.
        for _ in range(3):
            for cost, edit, role in moves:
                if role and role not in NEXT[state]:
                    continue
                end = NEXT[state][role] if role else state
                audit = "I" * (len(inserted) // 2) + edit
                if (paid + cost, audit) < (costs[begin][end], audits[begin][end]):
                    costs[begin][end], audits[begin][end] = paid + cost, audit
                    tokens[begin][end] = inserted + edit + (role if edit == "R" else "")
            # One role can follow by insertion; after nothing or system it is user.
            role = "a" if state == 2 else "u"
            inserted += "I" + role
            paid, state = paid + INSERT, NEXT[state][role]
    ranks = [[sorted(audits[b]).index(audits[b][e]) for e in range(4)] for b in range(4)]
    return (costs, ranks), tokens


STEPS, TOKENS = {}, {}
for _letter in map(chr, range(65, 81)):
    STEPS[_letter], TOKENS[_letter] = _step(_letter)


def _forward(steps, begin: int) -> tuple[list[int], list[int]]:
    """Cheapest costs from ``begin`` to every state, and the order of their audits."""
    costs = [NEVER] * 4
    costs[begin] = 0
    ranks = [0] * 4
    for table, order in steps:
        best = []
        for end in range(4):
            cost, rank, begin = min((costs[b] + table[b][end], ranks[b], b) for b in range(4))
            best.append((cost, (rank, order[begin][end])))
        costs = [min(c, NEVER) for c, _ in best]
        places = sorted({r for _, r in best})
        ranks = [places.index(r) for _, r in best]
    return costs, ranks


def _backward(steps, end: int) -> list[int]:
    """Cheapest costs from every state to ``end``."""
    costs = [NEVER] * 4
    costs[end] = 0
    for table, _ in reversed(steps):
        costs = [min(NEVER, min(table[b][e] + costs[e] for e in range(4))) for b in range(4)]
    return costs


def crossings(steps, begin: int, end: int) -> list[int]:
    """States before the first, between all and after the last of ``steps``."""
    states = [begin] * len(steps) + [end]
    todo = [(0, len(steps))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        costs, ranks = _forward(steps[low:middle], states[low])
        rest = _backward(steps[middle:high], states[high])
        states[middle] = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
        todo += [(low, middle), (middle, high)]
    return states


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


@lru_cache(100_000)
def summary(letters: str) -> tuple[int, ...]:
    """A block in 35 numbers: costs, order, illegal pairs, first and last initial."""
    steps = [STEPS[c] for c in letters]
    tables = [_forward(steps, begin) for begin in range(4)]
    initials = "".join(INITIALS[(ord(c) - 65) // 4] for c in letters)
    out = [c for costs, _ in tables for c in costs] + [r for _, ranks in tables for r in ranks]
    return *out, _illegal(initials), INITIALS.index(initials[0]), INITIALS.index(initials[-1])


@lru_cache(100_000)
def bridged(numbers: tuple[int, ...]) -> tuple[int, ...]:
    """Cost, illegal pairs and the states around all blocks, from their summaries in order."""
    blocks = [numbers[i : i + 35] for i in range(0, len(numbers), 35)]
    steps = [
        ([b[4 * q : 4 * q + 4] for q in range(4)], [b[16 + 4 * q : 20 + 4 * q] for q in range(4)])
        for b in blocks
    ]
    costs, ranks = _forward(steps, 0)
    paid = [c + INSERT * len(TAIL[s]) for s, c in enumerate(costs)]
    end = min(range(4), key=lambda s: (paid[s], ranks[s]))
    edges = "".join(INITIALS[b[33]] + INITIALS[b[34]] for b in blocks)[1:-1]
    between = sum(_illegal(edges[i : i + 2]) for i in range(0, len(edges), 2))
    return paid[end], sum(b[32] for b in blocks) + between, *crossings(steps, 0, end)


@lru_cache(100_000)
def walked(letters: str, begin: int, end: int) -> tuple[str, ...]:
    """The token of every row of a block."""
    states = crossings([STEPS[c] for c in letters], begin, end)
    return tuple(TOKENS[c][a][b] for c, a, b in zip(letters, states, states[1:]))


# -- blocks and conversations ------------------------------------------------------


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """``conv_id, first, letters, numbers``: the blocks of marked rows."""
    @F.pandas_udf("array<long>")
    def numbers(letters: pd.Series) -> pd.Series:
        return letters.map(lambda s: list(summary(s)))

    of = F.instr(F.lit(INITIALS), F.col("initial")) - 1
    letter = F.char(F.lit(65) + of * 4 + F.col("fault"))
    inside = F.sort_array(F.collect_list(F.struct("at", letter.alias("letter"))))
    blocks = rows.groupBy("conv_id", F.shiftright("at", bits).alias("block")).agg(
        F.min("at").alias("first"), F.array_join(F.transform(inside, lambda r: r["letter"]), "").alias("letters")
    )
    return stored(blocks.select("conv_id", "first", "letters", numbers("letters").alias("numbers")), "blocks")


def _states(blocks: DataFrame) -> DataFrame:
    """``conv_id, firsts, found``; ``found``: cost, illegal pairs and states."""
    @F.pandas_udf("array<long>")
    def found(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda n: list(bridged(tuple(n.tolist()))))

    gathered = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "numbers"))).alias("blocks")
    )
    flat = F.flatten(F.transform("blocks", lambda b: b["numbers"]))
    return stored(
        gathered.select("conv_id", F.col("blocks.first").alias("firsts"), found(flat).alias("found")), "states"
    )


def _tokens(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """``at, token``: the edit of every row; the last one of a conversation has those after it."""
    @F.pandas_udf("array<string>")
    def walk(letters: pd.Series, begin: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for s, b, e, closes in zip(letters, begin, end, last):
            row = list(walked(s, b, e))
            if closes:
                row[-1] += "".join("I" + role for role in TAIL[e])
            out.append(row)
        return pd.Series(out)

    n = F.size("firsts")
    every = F.transform(
        "firsts", lambda f, i: F.struct(
            f.alias("first"), F.get("found", i + 2).alias("begin"), F.get("found", i + 3).alias("end"),
            (i == n - 1).alias("last"),
        ),
    )
    ends = states.select(F.explode(every).alias("e")).select("e.*")
    walks = blocks.select("first", "letters").join(ends, "first")
    walks = walks.select("first", F.posexplode(walk("letters", "begin", "end", "last")).alias("i", "token"))
    return walks.select((F.col("first") + F.col("i")).alias("at"), "token")


def _edited(batches: Iterator) -> Iterator[tuple]:
    """``(conv_id, edits)`` of each batch's rows in order; ``edits``: ``(edit, role, text)``."""
    begun = key = text = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "text", "token")]
        for conv, turn, role, h, said, token in zip(*columns):
            if token is None:
                # Equal rows share a text, which comes before their tokens.
                if key != (conv, turn, role, h):
                    key, text = (conv, turn, role, h), said
                continue
            edits, at = [], 0
            while at < len(token):
                edit = token[at]
                named = {"u": "user", "a": "assistant"}.get(token[at + 1 : at + 2])
                at += 2 if edit in "IR" else 1
                if edit == "I":
                    edits.append((edit, named, ""))
                else:
                    edits.append((edit, named if edit == "R" else role, text))
            begun = conv
            yield begun, edits


def _met(rows: DataFrame, tokens: DataFrame, light: DataFrame) -> DataFrame:
    """Texts and edits of a conversation in one task, in order, texts before their edits."""
    columns = ["conv_id", "turn", "role", "h"]
    edits = light.select("at", *columns).join(tokens, "at").select(
        *columns, F.lit(1).alias("kind"), "at", F.lit(None).cast("string").alias("text"), "token"
    )
    texts = _keyed(rows).select(
        *columns, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "text",
        F.lit(None).cast("string").alias("token"),
    )
    both = texts.unionByName(edits).repartition("conv_id").sortWithinPartitions(*columns, "kind", "at")
    return both.select(*columns, "text", "token")


def _digests(batches: Iterator) -> Iterator:
    import hashlib
    import io

    import pyarrow as pa

    names = ["conv_id", "audit", "repaired_sha256"]
    types = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    done: list[tuple] = []
    conv, audit, digest, rows = None, None, None, 0

    def out():
        made = pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], types)
        done.clear()
        return made

    for now, edits in _edited(batches):
        if audit is None or now != conv:
            if audit is not None:
                done.append((conv, audit.getvalue(), digest.hexdigest()))
            conv, audit, digest, rows = now, io.StringIO(), hashlib.sha256(), 0
        for edit, role, text in edits:
            audit.write(edit)
            if edit != "D":
                digest.update(f"{chr(10) if rows else ''}{role}:{text}".encode())
                rows += 1
        if len(done) >= 5_000:
            yield out()
    if audit is not None:
        done.append((conv, audit.getvalue(), digest.hexdigest()))
    yield out()


def _written(batches: Iterator) -> Iterator:
    import pyarrow as pa

    types = pa.schema([
        ("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
        ("edit", pa.string()),
    ])
    conv, place, begun, held, size = None, 0, False, [], 0
    for now, edits in _edited(batches):
        if not begun or now != conv:
            conv, place, begun = now, 0, True
        for edit, role, text in edits:
            if edit != "D":
                held.append({"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit})
                place, size = place + 1, size + len(text)
        if len(held) >= 5_000 or size > 1 << 24:
            yield pa.RecordBatch.from_pylist(held, types)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, types)


class Repair:
    """The repair of a table ``conv_id, turn, role, text``; steps are made once and shared."""

    def __init__(self, rows: DataFrame, block_bits: int = BLOCK_BITS):
        self.rows = rows
        self.light = stored(marked(rows), "marked")
        self.blocks = _blocks(self.light, block_bits)
        self.states = _states(self.blocks)
        self.tokens = _tokens(self.blocks, self.states)

    def conversations(self) -> DataFrame:
        """``conv_id, audit, repaired_sha256``: the digest of repaired ``role:text`` lines."""
        return _met(self.rows, self.tokens, self.light).mapInArrow(
            _digests, "conv_id long, audit string, repaired_sha256 string"
        )

    def repaired(self) -> DataFrame:
        """``conv_id, place, role, text, edit``: the rows of repaired conversations."""
        return _met(self.rows, self.tokens, self.light).mapInArrow(
            _written, "conv_id long, place long, role string, text string, edit string"
        )

    def counts(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated``."""

        def fault(name: str) -> Column:
            return F.count_if(F.col("fault") == FAULTS.index(name)).alias(name)

        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        return self.light.groupBy("conv_id").agg(
            F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"),
            fault("blank"), fault("duplicate"), fault("truncated"),
        )


def report(conversations: DataFrame, rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conv_id of ``conversations``: what is wrong with its ``rows`` and the repair.

    A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    repair = Repair(rows, block_bits)
    costs = repair.states.select(
        "conv_id", F.get("found", F.lit(1)).alias("illegal"), F.get("found", F.lit(0)).alias("cost")
    )
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (repair.counts(), costs, repair.conversations()):
        part = part.withColumnRenamed("conv_id", "_conv_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def sql() -> str:
    """The query in SQL: each state carries its cheapest and then least audit and all it wrote, one
    row at a time."""
    far = 1_000_000
    kept = f"case when fault = 0 then 0 when fault = 1 then {TRUNCATED} else {far} end"

    def moved(i: int, cost: str | int, audit: str, *said: str) -> str:
        text = f"s{i}.t"
        for line in said:
            text = f"({text} || case when {text} = '' then '' else chr(10) end || {line})"
        return f"{{'c': s{i}.c + {cost}, 'a': s{i}.a || '{audit}', 't': {text}}}"

    def keep(i: int, letter: str) -> str:
        return moved(i, f"case when initial = '{letter}' then {kept} else {far} end", "K", "role || ':' || text")

    def rerole(i: int, name: str) -> str:
        return moved(i, f"{REROLE} + {kept}", "R", f"'{name}:' || text")

    def insert(i: int, *names: str) -> str:
        return moved(i, INSERT * len(names), "I" * len(names), *[f"'{name}:'" for name in names])

    never = f"{{'c': {far}, 'a': '', 't': ''}}"
    users = ", ".join(x for b in (0, 1, 3) for x in (keep(b, "u"), rerole(b, "user")))
    return f"""
with recursive {CRC_TABLE},
given as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') key from conversations),
kinds as (select *, {crc32("key")} % 20 kind from given, crc_table),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) copy
  from kinds where kind <> 0),
placed as (
  select conv_id, turn, role, text,
    row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') bare, left(role, 1) initial
  from damaged),
marked as (
  select *, case when bare = '' then 2
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 3
      when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end fault,
    lag(initial) over (partition by conv_id order by i) || initial pair
  from placed),
states as (
  select conv_id, 0::bigint i, {{'c': 0, 'a': '', 't': ''}} s0, {never} s1, {never} s2, {never} s3
  from (select distinct conv_id from marked)
  union all
  select conv_id, i, {moved(0, DELETE, "D")}, least({moved(1, DELETE, "D")}, {keep(0, "s")}),
    least({moved(2, DELETE, "D")}, {users}),
    least({moved(3, DELETE, "D")}, {keep(2, "a")}, {rerole(2, "assistant")})
  from (
    select s.conv_id, r.i, r.role, r.text, r.initial, r.fault, s0, s1,
      least(s2, {", ".join(insert(b, "user") for b in (0, 1, 3))}) s2, least(s3, {insert(2, "assistant")}) s3
    from states s join marked r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1)),
lengths as (select conv_id, max(i) i from marked group by conv_id),
ends as (
  select s.conv_id, least(s0, {insert(1, "user", "assistant")}, {insert(2, "assistant")}, s3) e
  from states s join lengths l on l.conv_id is not distinct from s.conv_id and l.i = s.i),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
    count(*) filter (where fault = 2) blank, count(*) filter (where fault = 3) duplicate,
    count(*) filter (where fault = 1) truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) illegal
  from marked group by conv_id)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cast(e.c as bigint), 0) as cost,
  coalesce(e.a, '') audit, sha256(coalesce(e.t, '')) repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join ends on ends.conv_id is not distinct from o.conv_id
"""
