"""Conversation structure repair: the cheapest edits that make a conversation's roles well formed.

Well formed role initials are `(s?(ua)+)?`. Each row of a conversation may be kept (0), given the role user or assistant (1)
or deleted (2); an empty user or assistant row may be inserted anywhere (5); an undeleted truncated row adds 5; blank and duplicate rows must
be deleted. Of the cheapest edits the one whose initials (K, R, D, I) in order are ASCII-least is taken.

The edits are paths in a lattice: a node is a number of rows that are done and the state of the output (nothing, s, u, a). Two Dijkstra
searches meet in it, one from the start, one backward from the accepted ends. They go on until the sum of their heaps' least costs exceeds the
best path, so that all equal-cost crossings are finished; of every crossing edge and node the
joined audit, forward part, edge, backward part, is compared and the least one wins. Nodes of equal cost are settled in order of
their rows, then of their audits; two audits of one node and one cost are never the beginning of each other (the letters fix the cost), so the least part
stays least whatever follows. Rows that must go next to each other are one step.

Rows are counted by content, sorted by range partitions and streamed. A conversation that a task holds whole in up to `CHUNK` rows is repaired
there. A longer one, or one that goes on in the next partition, is cut into chunks: the search gives, for each pair of states before and after a
chunk, the cost, the audit and the audit's rank among the chunk's. Chunks are composed by these small numbers only, from the last one
back, and the repaired text is hashed by a stream over the chunks in order. So no task holds a conversation's texts; what grows
with the longest conversation is its audit, which is a cell of the result, and some 100 bytes for each `CHUNK` rows.

Defined edge results: nulls count as one space in any column, but a null turn comes first and takes no part in gaps; rows of one
turn are in order of role and text; a null conv_id is a conversation of its own; equal rows are damaged alike; role initials other than s, u
and a are never kept; a conversation without rows after the damage has zeros, an empty audit and the hash of the empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.runtime import stored
from strandline.llm.manifest import CRC32_SQL

CHUNK = 512
#: States of the output: nothing yet, or the initial of its last row.
NOTHING, S, U, A = range(4)
STATES = (NOTHING, S, U, A)
ACCEPTED = (NOTHING, A)
#: (state before, state after) of each kind of row that the output can take next.
NEXT = {"s": ((NOTHING, S),), "u": ((NOTHING, U), (S, U), (A, U)), "a": ((U, A),)}
EITHER = NEXT["u"] + NEXT["a"]
LEGAL_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Costs and audits of inserting what is missing after the last row, by state, and the audits' ranks.
CLOSING_COSTS, CLOSING_RANKS = (0, 10, 5, 0), (0, 2, 1, 0)
CLOSING_AUDITS = ("", "II", "I", "")
SPACE = re.compile(r"[^\x20\x09-\x0D]")

#: A step of the lattice: how many rows that must go, or (0, role initial, truncated) for a row that may stay.
Step = tuple[int, str, bool]


def _ways(step: Step) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters) of every way through a step."""
    forced, initial, truncated = step
    if forced:
        return [(x, x, DELETE * forced, "D" * forced) for x in STATES]
    extra = TRUNCATED * truncated
    ways = [(x, x, DELETE, "D") for x in STATES]
    ways += [(x, y, extra, "K") for x, y in NEXT.get(initial, ())]
    return ways + [(x, y, REROLE + extra, "R") for x, y in EITHER]


def cheapest(steps: list[Step], start: int = NOTHING, ends: tuple[int, ...] = ACCEPTED, closing: bool = True) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest paths from `start` to one of `ends`; None if there is none. `closing`: inserts may follow the last row."""
    n = len(steps)
    ahead: dict[tuple[int, int], list] = {}
    back: dict[tuple[int, int], list] = {}

    def edges(node: tuple[int, int], forward: bool) -> list[tuple[tuple[int, int], int, str]]:
        known = ahead if forward else back
        if node not in known:
            at, state = node
            step = at if forward else at - 1
            found = []
            if 0 <= step < n:
                for x, y, cost, letters in _ways(steps[step]):
                    if (x if forward else y) == state:
                        found.append(((at + 1, y) if forward else (at - 1, x), cost, letters))
            if at < n or closing:
                found += [((at, y if forward else x), INSERT, "I") for x, y in EITHER if (x if forward else y) == state]
            known[node] = found
        return known[node]

    # Heap entries: cost, rows done in this direction, audit so far, node. Rows come before audits, as edges without a cost lead to later rows.
    heaps = [[(0, 0, "", (0, start))], [(0, 0, "", (n, x)) for x in ends]]
    settled: list[dict[tuple[int, int], tuple[int, str]]] = [{}, {}]
    best = float("inf")
    while heaps[0] or heaps[1]:
        least = [h[0][0] if h else 0 for h in heaps]
        if sum(least) > best:
            break
        side = 0 if heaps[0] and (not heaps[1] or least[0] <= least[1]) else 1
        cost, _, audit, node = heapq.heappop(heaps[side])
        own, other = settled[side], settled[1 - side]
        if node in own:
            continue
        own[node] = cost, audit
        if node in other:
            best = min(best, cost + other[node][0])
        for to, more, letters in edges(node, side == 0):
            if to in other:
                best = min(best, cost + more + other[to][0])
            if to not in own:
                done = to[0] if side == 0 else n - to[0]
                heapq.heappush(heaps[side], (cost + more, done, audit + letters if side == 0 else letters + audit, to))
    forward, backward = settled
    found = [a + backward[node][1] for node, (c, a) in forward.items() if node in backward and c + backward[node][0] == best]
    for node, (cost, audit) in forward.items():
        for to, more, letters in edges(node, True):
            if to in backward and cost + more + backward[to][0] == best:
                found.append(audit + letters + backward[to][1])
    return (int(best), min(found)) if found else None


def fault_of(text: str, first: bool) -> str | None:
    """A row's first fault; `first`: no earlier row has its role and text."""
    seen = SPACE.findall(text)
    if not seen:
        return "blank"
    if not first:
        return "duplicate"
    return None if seen[-1] in ".!?" else "truncated"


#: A row of a conversation: turn as text or None, role, text, how often it follows itself, whether it is the first of its role and text.
Row = tuple[str | None, str, str, int, bool]


class Part:
    """Consecutive rows of one conversation: their steps in the lattice, and counts that add up over parts."""

    def __init__(self, rows: list[Row]):
        self.rows = [r for r in rows if r[3]]
        self.steps: list[Step] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first = self.last = self.low = self.high = None
        turn = None
        for number, role, text, copies, first in self.rows:
            fault, initial = fault_of(text, first), role[:1]
            forced = copies if fault in ("blank", "duplicate") else copies - 1
            if fault == "blank":
                self.counts["blank"] += copies
            else:
                self.counts["duplicate"] += forced
                self.counts["truncated"] += fault == "truncated"
            if copies > forced:
                self.steps.append((0, initial, fault == "truncated"))
            if forced and self.steps and self.steps[-1][0]:
                self.steps[-1] = (self.steps[-1][0] + forced, "", False)
            elif forced:
                self.steps.append((forced, "", False))
            if self.last is not None:
                self.counts["illegal"] += self.last + initial not in LEGAL_PAIRS
            self.counts["illegal"] += copies - 1
            self.first = initial if self.first is None else self.first
            self.last = initial
            if number is not None and number != turn:
                turn = number
                self.counts["turns"] += 1
                self.low = int(number) if self.low is None else self.low
                self.high = int(number)

    def repaired(self, audit: str, state: int = NOTHING) -> list[str]:
        """The `role:text` rows that the edits leave, from a state on."""
        letters, out = iter(audit), []

        def put(role: str, text: str, initial: str) -> None:
            nonlocal state
            out.append(f"{role}:{text}")
            state = "-sua".index(initial)

        def new(text: str) -> None:
            name = "assistant" if state == U else "user"
            put(name, text, name[0])

        for _, role, text, copies, _ in self.rows:
            left = copies
            while left:
                letter = next(letters)
                if letter == "I":
                    new("")
                    continue
                left -= 1
                if letter == "K":
                    put(role, text, role[:1])
                elif letter == "R":
                    new(text)
        for _ in letters:
            new("")
        return out


def pair_table(steps: list[Step]) -> tuple[list[int], list[int], list[str]]:
    """Costs (-1: no path), ranks and audits for each (state before, state after) of a chunk after which nothing is inserted."""
    found = [cheapest(steps, x, (y,), False) for x, y in product(STATES, STATES)]
    audits = [f[1] if f else "" for f in found]
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    return [f[0] if f else -1 for f in found], [order[a] for a in audits], audits


def choose(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """The cost of a conversation and the pair (16 of them, as in `pair_table`) that each of its chunks takes."""
    cost, rank, choices = list(CLOSING_COSTS), list(CLOSING_RANKS), []
    for own_costs, own_ranks in zip(reversed(costs), reversed(ranks)):
        best = []
        for x in STATES:
            ways = [(own_costs[4 * x + y] + cost[y], own_ranks[4 * x + y], rank[y], y) for y in STATES if own_costs[4 * x + y] >= 0]
            best.append(min(ways))
        order = {k: i for i, k in enumerate(sorted({b[1:3] for b in best}))}
        cost, rank = [b[0] for b in best], [order[b[1:3]] for b in best]
        choices.append([b[3] for b in best])
    state, taken = NOTHING, []
    for choice in reversed(choices):
        taken.append(4 * state + choice[state])
        state = choice[state]
    return cost[NOTHING], taken


COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = (
    "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
OPEN = (
    "part int, chunk int, first string, last string, low string, high string, turns bigint, costs array<bigint>, ranks array<int>, audits array<string>, "
    "rows array<struct<role: string, text: string, copies: bigint>>"
)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _whole(conv: str, rows: list[Row]) -> dict:
    part = Part(rows)
    cost, audit = cheapest(part.steps)
    text = "\n".join(part.repaired(audit)).encode("utf-8", "surrogatepass")
    own = {k: part.counts[k] for k in COUNTS} | {"gaps": _gaps(part.low, part.high, part.counts["turns"])}
    return own | {"conv": conv, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text).hexdigest()}


def _chunk(conv: str, rows: list[Row], part_id: int, number: int) -> dict:
    part = Part(rows)
    costs, ranks, audits = pair_table(part.steps)
    low, high = (None if x is None else str(x) for x in (part.low, part.high))
    texts = [{"role": r[1], "text": r[2], "copies": r[3]} for r in part.rows]
    own = {"conv": conv, "part": part_id, "chunk": number, "first": part.first, "last": part.last, "low": low, "high": high}
    return own | {"turns": part.counts["turns"], "costs": costs, "ranks": ranks, "audits": audits, "rows": texts} | {k: part.counts[k] for k in COUNTS}


def _repair(chunk: int):
    columns = [c.split()[0] for c in RESULT.split(", ")]
    opened = ["part", "chunk", "first", "last", "low", "high", "turns", "costs", "ranks", "audits", "rows"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_id, conv, held, number, is_first = TaskContext.get().partitionId(), None, [], 0, True
        out: list[dict] = []

        def close(last: bool) -> None:
            # The first and the last conversation of a partition may go on in the one before or after it.
            if is_first or last or number:
                out.append(_chunk(conv, held, part_id, number))
            else:
                out.append(_whole(conv, held))

        def frame() -> pd.DataFrame:
            found = {c: pd.Series([r.get(c) for r in out], dtype=object) for c in [*columns, *opened]}
            out.clear()
            return pd.DataFrame(found)

        for batch in batches:
            for own, *row in zip(*[batch[c] for c in ("conv", "turn", "role", "text", "copies", "first")]):
                if own != conv:
                    if conv is not None:
                        close(False)
                        is_first = False
                    conv, held, number = own, [], 0
                elif len(held) == chunk:
                    out.append(_chunk(conv, held, part_id, number))
                    held, number = [], number + 1
                held.append(tuple(row))
            if out:
                yield frame()
        if conv is not None:
            close(True)
            yield frame()

    return work


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order become one row for each conversation; a chunk's texts are dropped as soon as they are hashed."""
    conv, digest, audits, any_row, about = None, None, [], False, None

    def row() -> pd.DataFrame:
        audit = "".join(audits) + CLOSING_AUDITS[state]
        for k, letter in enumerate(CLOSING_AUDITS[state]):
            name = "assistant" if state == U or k else "user"
            put(f"{name}:")
        named = {"conv": conv, "audit": audit, "repaired_sha256": digest.hexdigest()}
        return pd.DataFrame([named | about])

    def put(line: str) -> None:
        nonlocal any_row
        digest.update((("\n" if any_row else "") + line).encode("utf-8", "surrogatepass"))
        any_row = True

    state = NOTHING
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.conv != conv:
                if conv is not None:
                    yield row()
                conv, digest, audits, any_row, state = r.conv, hashlib.sha256(), [], False, NOTHING
                about = {k: getattr(r, k) for k in (*COUNTS, "gaps", "cost")}
            part = Part([(None, x["role"], x["text"], x["copies"], True) for x in r.rows])
            for line in part.repaired(r.audit, state):
                put(line)
            audits.append(r.audit)
            state = int(r.pick) % 4
    if conv is not None:
        yield row()


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one conversation, by their numbers: which pair each takes, and the conversation's counts."""
    pdf = pdf.sort_values(["part", "chunk"])
    cost, taken = choose([list(c) for c in pdf["costs"]], [list(r) for r in pdf["ranks"]])
    totals = {k: int(pdf[k].sum()) for k in COUNTS}
    turns, low, high, last = 0, None, None, None
    for r in pdf.itertuples(index=False):
        if r.first is not None:
            totals["illegal"] += last is not None and last + r.first not in LEGAL_PAIRS
            last = r.last
        if r.low is not None:
            turns += int(r.turns) - (r.low == high)
            low, high = low if low is not None else r.low, r.high
    gaps = _gaps(None if low is None else int(low), None if high is None else int(high), turns)
    return pdf[["conv", "part", "chunk"]].assign(pick=taken, cost=cost, gaps=gaps, **totals)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text, copies): its faults, the cheapest edits and the repaired text's hash.

    `copies` says how often a row stands there, next to itself; a conversation all of whose rows have no copy is empty.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("number")).alias("at")
    space = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    counted = rows.select(conv, turn, *space, F.col("copies").cast("long").alias("copies"))
    counted = stored(counted.groupBy("conv", "at", "role", "text").agg(F.sum("copies").alias("copies")), "conversation-rows")
    named = counted.withColumn("text_hash", F.md5("text"))
    firsts = named.where("copies > 0").groupBy("conv", "role", "text_hash").agg(F.min("at").alias("first_at"))
    firsts = stored(firsts, "first-rows")
    first = F.coalesce(F.col("at") == F.col("first_at"), F.lit(False)).alias("first")
    marked = stored(named.join(firsts, ["conv", "role", "text_hash"], "left").select("conv", "at", "role", "text", "copies", first), "marked-rows")
    keys = ["conv", "at", "role", "text"]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.select("conv", F.col("at.number").cast("string").alias("turn"), "role", "text", "copies", "first")
    found = stored(dealt.mapInPandas(_repair(chunk), f"{RESULT}, {OPEN}"), "repaired")
    result = [c.split()[0] for c in RESULT.split(", ")]
    opened = found.where("part is not null")
    numbers = opened.select("conv", "part", "chunk", "first", "last", "low", "high", "turns", "costs", "ranks", *COUNTS)
    picked = numbers.groupBy("conv").applyInPandas(
        _composed, "conv string, part int, chunk int, pick int, cost bigint, gaps bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    )
    audit = F.col("audits")[F.col("pick")].alias("audit")
    texts = opened.select("conv", "part", "chunk", "audits", "rows").join(stored(picked, "picked"), ["conv", "part", "chunk"])
    texts = texts.select("conv", "part", "chunk", "rows", audit, "pick", "cost", "gaps", *COUNTS)
    joined = texts.repartition("conv").sortWithinPartitions("conv", "part", "chunk").mapInPandas(_joined, RESULT)
    whole = found.where("part is null").select(*result).union(joined.select(*result))
    return whole.select(F.expr("try_cast(conv as bigint)").alias("conv_id"), *result[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of `conv_id:turn` names: 0 drops a row, 1 empties its text, 2 removes
    `[.!?]`, 3 repeats it, 4 makes its role user. Nulls are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    code: Column = F.crc32(name) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every conversation, damaged, with its faults, the cheapest repair and the repaired text's hash."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _option(cost: str, letter: str, then: str) -> str:
    """A way to go on as a struct (c, a); null if `cost` is null."""
    return f"CASE WHEN {cost} IS NOT NULL THEN {{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a}} END"


def _kept(initial: str, state: int) -> str:
    return _option(f"(CASE WHEN NOT r.forced AND r.initial = '{initial}' THEN r.extra END)", "K", f"p.f{state}")


def _bare(state: int) -> str:
    """The least way from a state through the next row, without insertions before it."""
    rerole = "(CASE WHEN NOT r.forced THEN 1 + r.extra END)"
    on = [_kept("a", 3), _option(rerole, "R", "p.f3")] if state == 2 else [_kept("u", 2), _option(rerole, "R", "p.f2")]
    return _least(_option("2", "D", f"p.f{state}"), *on, *([_kept("s", 1)] if state == 0 else []))


_IN = {k: _option("5", "I", f"b{k}") for k in (2, 3)}
_IN2 = _option("10", "II", "b3")
#: The least suffix of every (row, state), from the last row back; repaired rows follow from the letters of the audit.
OP12_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32_SQL.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM raw WHERE code <> 0 UNION ALL SELECT * FROM raw WHERE code = 3)
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    regexp_replace(text, '[ \t-\r]+', '', 'g') AS seen FROM hurt
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM sorted
), marked AS (
  SELECT *, seen = '' AS blank, seen <> '' AND again AS duplicate,
    seen <> '' AND NOT again AND NOT regexp_matches(seen, '[.!?]$') AS truncated FROM numbered
), ready AS (
  SELECT *, blank OR duplicate AS forced, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM marked
), sizes AS (
  SELECT conv_id, max(i) AS n FROM sorted GROUP BY conv_id
), paths AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': ''}} AS f0, {{'c': 10, 'a': 'II'}} AS f1, {{'c': 5, 'a': 'I'}} AS f2, {{'c': 0, 'a': ''}} AS f3 FROM sizes
  UNION ALL
  SELECT conv_id, i, {_least("b0", _IN[2], _IN2)}, {_least("b1", _IN[2], _IN2)}, {_least("b2", _IN[3])}, {_least("b3", _IN[2])}
  FROM (
    SELECT p.conv_id, r.i, {", ".join(f"{_bare(k)} AS b{k}" for k in range(4))}
    FROM paths p JOIN ready r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1
  )
), best AS (
  SELECT conv_id, f0.c AS cost, f0.a AS audit FROM paths WHERE i = 1
), letters AS (
  SELECT conv_id, k, audit[k] AS letter, sum(CASE WHEN audit[k] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i,
    sum(CASE WHEN audit[k] = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS o
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), output AS (
  SELECT l.conv_id, l.o, l.letter, r.role, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN l.o = 1 AND l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS has_s
  FROM letters l LEFT JOIN ready r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o
  ) AS repaired FROM output GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ready GROUP BY conv_id
)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
  coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
