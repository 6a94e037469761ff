"""Conversation structure repair by generalised LR parsing with edits.

Roles of a conversation are parsed by an LR automaton for ``(s?(ua)+)?``. Each turn may be kept,
given the role user or assistant, or deleted, and empty turns may be inserted, each at a cost. All
parses are followed at once on a graph-structured stack: stacks share their lower parts, and
stacks with equal tops are merged into the one of least (cost, audit), the audit being the
edits' initials. In this grammar what may follow depends on the top alone.

A parse that costs more than ``SPREAD`` over the cheapest cannot win (two insertions and a deletion
bring the cheapest parse to any top at that price) and is dropped. The edits on which all parses
left agree are settled on the way, and their turns are handed out, so texts wait only until
the parses agree.

On Spark, conversations are dealt by id and sorted by turn within partitions, and each task reads
its rows as a stream. A conversation is one sequence, so one task reads it, one turn after another:
besides the texts not yet settled it holds 16 bytes (and their set entry) for each distinct turn,
to know repeats, and one letter of the audit. No other conversation shares its fate.

Definitions: a null conv_id, role or text is one space, a null turn sorts first. Rows of the same
turn are taken by role, then text. A role that is empty or whose initial is none of s, u, a cannot
be kept. Rows that are equal are repeats. Texts of any length are hashed and handed on, never
parsed. A null conv_id is a conversation. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
USER, ASSISTANT = "user", "assistant"
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
SPREAD = 2 * INSERT + DELETE
SETTLE = 64

# The LR(0) automaton of the role grammar.
#   Dialog -> nothing | Turns | s Turns     Turns -> Pair | Turns Pair     Pair -> u a
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 4, (5, "u"): 4, (4, "a"): 7}
GOTO = {(0, "Turns"): 2, (1, "Turns"): 5, (0, "Pair"): 3, (1, "Pair"): 3, (2, "Pair"): 6, (5, "Pair"): 6}
REDUCE = {7: ("Pair", 2), 3: ("Turns", 1), 6: ("Turns", 2)}
COMPLETE = {0, 2, 5}

# A stack is (state, stack below); the bottom is (0, None). Stacks share what lies below.
BOTTOM = (0, None)


@lru_cache(None)
def shifted(stack: tuple, role: str) -> tuple | None:
    """The stack after a turn with that role initial, all reductions done."""
    state = SHIFT.get((stack[0], role))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        symbol, size = REDUCE[stack[0]]
        for _ in range(size):
            stack = stack[1]
        stack = (GOTO[stack[0], symbol], stack)
    return stack


@lru_cache(None)
def opened(stack: tuple) -> tuple:
    """The stack and those after insertions: (stack, cost, edits, roles put in)."""
    out = [(stack, 0, "", ())]
    for at, cost, edits, roles in out:
        if len(edits) < 2:
            for role in (USER, ASSISTANT):
                after = shifted(at, role[0])
                if after:
                    out.append((after, cost + INSERT, edits + "I", (*roles, role)))
    return tuple(out)


@lru_cache(None)
def moves(stack: tuple, initial: str, keepable: bool) -> tuple:
    """What one turn may do: (stack after it, cost, edits, inserted roles, its own role).

    The own role is None for a deleted turn and "" for one that keeps its role.
    """
    out = []
    for at, cost, edits, roles in opened(stack):
        out.append((at, cost + DELETE, edits + "D", roles, None))
        if keepable:
            for edit, role, price in (("K", "", 0), ("R", USER, RENAME), ("R", ASSISTANT, RENAME)):
                after = shifted(at, role[:1] or initial)
                if after:
                    out.append((after, cost + price, edits + edit, roles, role))
    return tuple(out)


class Repair:
    """One conversation, fed turn by turn; settled turns come back as (role, text)."""

    def __init__(self):
        # By audit: stack, cost, and the edits as a chain of [edits before, edits, turns].
        root = [None, "", ()]
        self.tops = [(BOTTOM, 0, root)]
        self.root, self.audit, self.unsettled = root, [], 0

    def feed(self, role: str, text: str, keepable: bool, cut: bool) -> list[tuple[str, str]]:
        best: dict[int, tuple] = {}
        for rank, (stack, cost, _) in enumerate(self.tops):
            for move in moves(stack, role[:1], keepable):
                price = cost + move[1] + (CUT if cut and move[4] is not None else 0)
                found = (price, rank, move[2], move)
                top = move[0][0]
                if top not in best or found[:3] < best[top][:3]:
                    best[top] = found
        limit = min(b[0] for b in best.values()) + SPREAD
        tops = []
        for price, rank, edits, (stack, _, _, roles, own) in sorted(best.values(), key=lambda b: b[1:3]):
            if price <= limit:
                turns = [(r, "") for r in roles] + ([] if own is None else [(own or role, text)])
                tops.append((stack, price, [self.tops[rank][2], edits, turns]))
        self.tops = tops
        self.unsettled += 1
        return self.settle() if self.unsettled >= SETTLE else []

    def settle(self) -> list[tuple[str, str]]:
        """Hand out the turns of the edits that all parses share."""
        chains = []
        for _, _, node in self.tops:
            chain = []
            while node is not self.root:
                chain.append(node)
                node = node[0]
            chains.append(chain[::-1])
        done = []
        for level in zip(*chains, strict=False):
            if any(node is not level[0] for node in level):
                break
            self.root = level[0]
            self.audit.append(self.root[1])
            done += self.root[2]
        self.root[0] = None
        self.unsettled = 0
        return done

    def finish(self) -> tuple[int, str, list[tuple[str, str]]]:
        """Cost, audit and the turns not handed out yet."""
        ends = []
        for rank, (stack, cost, node) in enumerate(self.tops):
            for at, price, edits, roles in opened(stack):
                if at[0] in COMPLETE:
                    ends.append((cost + price, rank, edits, node, roles))
        cost, _, edits, node, roles = min(ends, key=lambda e: e[:3])
        self.tops = [(BOTTOM, cost, [node, edits, [(r, "") for r in roles]])]
        turns = self.settle()
        return cost, "".join(self.audit), turns


def or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of ``conv_id:turn``.

    A row that is dropped leaves a row without role and text, so that no conversation is lost.
    """
    key = F.concat(or_blank(F.col("conv_id")), F.lit(":"), or_blank(F.col("turn")))
    rows = conversations.select(
        "conv_id", "turn", or_blank(F.col("role")).alias("role"), or_blank(F.col("text")).alias("text"),
        (F.crc32(key) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = (
        F.when(fault == 0, None)
        .when(fault == 1, "")
        .when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(fault == 0, None).when(fault == 4, USER).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")
    ).drop("_")


def in_order(rows: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, sorted by turn."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class Walk:
    """What is known of one conversation while its rows pass: faults, gaps, repaired turns."""

    def __init__(self):
        self.repair = Repair()
        self.seen: set[bytes] = set()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before: str | None = None
        self.low = self.high = None
        self.turns = 0

    def feed(self, turn, role: str, text: str) -> list[tuple[str, str]]:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.before is not None:
            self.counts["illegal"] += self.before[:1] + role[:1] not in ("su", "ua", "au")
        self.before = role
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        said = text.rstrip(BLANKS)
        fault = None
        if not said:
            fault = "blank"
        elif mark in self.seen:
            fault = "duplicate"
        elif said[-1] not in ".!?":
            fault = "truncated"
        self.seen.add(mark)
        if fault:
            self.counts[fault] += 1
        return self.repair.feed(role, text, fault in (None, "truncated"), fault == "truncated")

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, walk, turns handed out, None) and, at a conversation's end, its (cost, audit)."""
    walk, at = None, None
    for b in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if walk is None or conv != at:
                if walk:
                    cost, audit, turns = walk.repair.finish()
                    yield at, walk, turns, (cost, audit)
                walk, at = Walk(), conv
            if text is not None:
                turns = walk.feed(turn, role, text)
                if turns:
                    yield at, walk, turns, None
    if walk:
        cost, audit, turns = walk.repair.finish()
        yield at, walk, turns, (cost, audit)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns of every conversation after its cheapest repair."""
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = in_order(
        rows.select("conv_id", "turn", or_blank(F.col("role")).alias("role"), or_blank(F.col("text")).alias("text"))
    )
    conv = ordered.schema["conv_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for at, _, turns, end in walked(batches):
            n = len(turns)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at] * n, to_arrow_type(conv)), pa.array(range(place, place + n), pa.int64()),
                    pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()),
                ],
                names=["conv_id", "place", "role", "text"],
            )
            place = 0 if end else place + n

    return ordered.mapInArrow(work, f"conv_id {conv.simpleString()}, place long, role string, text string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summarised(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and audit of the repair, digest of its turns."""
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = in_order(rows)
    conv = ordered.schema["conv_id"].dataType
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [to_arrow_type(conv)] + [pa.int64()] * len(COUNTS) + [pa.string()] * 2
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, first = [], hashlib.sha256(), True
        for at, walk, turns, end in walked(batches):
            for role, text in turns:
                line = f"{role}:{text}" if first else f"\n{role}:{text}"
                digest.update(line.encode("utf-8", "surrogatepass"))
                first = False
            if end:
                out.append((at, walk.gaps, *walk.counts.values(), *end, digest.hexdigest()))
                digest, first = hashlib.sha256(), True
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    longs = ", ".join(f"{c} long" for c in COUNTS)
    return ordered.mapInArrow(work, f"conv_id {conv.simpleString()}, {longs}, audit string, repaired_sha256 string")


def op12_conversation_repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the table after damage and repair."""
    return summarised(damaged(conversations))


def plus(best: str, cost: str, edits: str) -> str:
    """SQL: the struct (c, a) of a parse after more edits."""
    return f"struct_pack(c := {best}.c + {cost}, a := {best}.a || '{edits}')"


def least(*parses: str) -> str:
    """SQL: the least of parses that may be null."""
    return f"list_min(list_filter([{', '.join(parses)}], lambda x: x.c IS NOT NULL))"


def given(condition: str, parse: str) -> str:
    return f"CASE WHEN {condition} THEN {parse} END"


# One parse per place in the grammar: n before anything, s after s, u after u, a after a pair.
_CUT = f"CASE WHEN truncated THEN {CUT} ELSE 0 END"
_TO_U = [
    p for x in ("n", "s", "xa")
    for p in (given("ok AND r = 'u'", plus(x, _CUT, "K")), given("ok", plus(x, f"{RENAME} + {_CUT}", "R")))
]
OP12_SQL = rf"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                        lambda c: ord(c)::UBIGINT) AS bytes
  FROM conversations
), f AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295::UBIGINT, list_reduce(bytes, lambda c, b: list_reduce(range(8)::UBIGINT[],
             lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b)), 4294967295::UBIGINT)) % 20 AS fault
  FROM b
), g AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g
), t AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, role[1] AS r, blank,
         NOT blank AND again AS duplicate,
         NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS truncated,
         NOT blank AND NOT again AS ok,
         coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o)
), w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '') AS n,
         struct_pack(c := NULL::BIGINT, a := '') AS s, struct_pack(c := NULL::BIGINT, a := '') AS u,
         struct_pack(c := NULL::BIGINT, a := '') AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, i, {plus("n", str(DELETE), "D")},
         {least(plus("s", str(DELETE), "D"), given("ok AND r = 's'", plus("n", _CUT, "K")))},
         {least(plus("xu", str(DELETE), "D"), *_TO_U)},
         {least(plus("xa", str(DELETE), "D"), given("ok AND r = 'a'", plus("xu", _CUT, "K")),
                given("ok", plus("xu", f"{RENAME} + {_CUT}", "R")))}
  FROM (
    SELECT t.*, w.n, w.s,
           {least("w.u", *(plus(x, str(INSERT), "I") for x in ("w.n", "w.s", "w.a")))} AS xu,
           {least("w.a", plus("w.u", str(INSERT), "I"), *(plus(x, str(2 * INSERT), "II") for x in ("w.n", "w.s")))} AS xa
    FROM w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1)
), e AS MATERIALIZED (
  SELECT conv_id, best.c AS cost, best.a AS audit FROM (
    SELECT conv_id, {least("n", "a", plus("u", str(INSERT), "I"), plus("s", str(2 * INSERT), "II"))} AS best
    FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
), l AS (
  SELECT conv_id, k, edit,
         count(*) FILTER (WHERE edit <> 'I') OVER p AS i, count(*) FILTER (WHERE edit <> 'D') OVER p AS j
  FROM (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS k, unnest(string_split(audit, '')) AS edit FROM e WHERE audit <> '')
  WINDOW p AS (PARTITION BY conv_id ORDER BY k)
), m AS (
  SELECT l.conv_id, l.k, l.edit, l.j, t.role, t.text,
         max(CASE WHEN l.j = 1 AND l.edit = 'K' AND t.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM l LEFT JOIN t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.i = t.i AND l.edit <> 'I'
  WHERE l.edit <> 'D'
), z AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said
  FROM m GROUP BY conv_id
), q AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM t GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM e LEFT JOIN q ON e.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON e.conv_id IS NOT DISTINCT FROM z.conv_id
"""
