"""Repair of conversation structure over a suffix-shared automaton.

A row of a conversation is one symbol: its role's initial (system, user, assistant, other) and whether it is cut short, or that
it must go (blank, or said before). The symbols of all conversations, read from the end, form one acyclic automaton
whose nodes are the distinct suffixes: a node is the digest of its symbol and of the node after it, so equal suffixes of
any two conversations are one node wherever they were met, and no dictionary has to be shared.

Legal conversations have the role initials ``(s?(ua)+)?``: four grammar states. Edits are Keep 0, Rerole 2, Delete 3,
Insert 2, and 1 for every cut row that stays. The cost-to-go of a node is a vector over the states, worked out once per
node: each symbol is a 4 x 4 matrix of least costs, and chains of matrices are multiplied (minimum of sums) by doubling,
so a conversation of n rows takes log n joins of narrow rows. The best audit suffix of (node, state) is its best edits for
this row and the (node, state) that they lead to, which share all that follows. In any state the four edits differ in
their initial, so of equal costs the least initial gives the least audit. Each conversation then walks its nodes forwards.

Both passes over rows stream through sorted partitions and hold one row, never a conversation; a conversation is walked by
one task, since one digest covers all of its text in order. Joins by node meet a unique side, and adaptive execution splits
the other where a suffix is frequent.

Results by case: null role, text, id or turn are damaged as one space, and the null id is a conversation of its own; rows that
share a turn follow one another by role, text and copy; other roles can be reroled or deleted, not kept; a conversation
without rows after damage has zeros, an empty audit and the digest of an empty string; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripmill.llm.common import saved
from tripmill.llm.linedup import STRIPPED

# The costs, the damage kinds and the roles of the contract.
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
KINDS = 20
USER, ASSISTANT = "user", "assistant"
START, SYSTEM, ASKED, ANSWERED = range(4)  # grammar states: nothing yet; after s; after u; after a
TURN_OF = {START: USER, SYSTEM: USER, ASKED: ASSISTANT, ANSWERED: USER}
AFTER = {START: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
AT_END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "II", "I", "")
NEVER = 1 << 40
MUST_GO = "x"

ROW = "conv_id bigint, pos bigint, turn bigint, role string, text string, symbol string, fault int"
PLAN = "node binary, cost bigint, edits array<string>, leads array<int>"
REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) with the faults of the contract planted by a checksum of the row's place."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % KINDS
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def faulted(rows: DataFrame) -> DataFrame:
    """The rows of ``ROW``: place, symbol and first fault (1 blank, 2 duplicate, 3 truncated, 0 none). One shuffle, by conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "role", "t1", "t2").orderBy("pos")
    body = F.btrim("text", F.lit(STRIPPED))
    placed = rows.repartition("conv_id").withColumn("pos", F.row_number().over(order).cast("bigint"))
    placed = placed.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("t"), "text")})
    placed = placed.withColumn("nth", F.row_number().over(same))
    fault = F.when(body == "", 1).when(F.col("nth") > 1, 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    first = F.left(F.col("role"), F.lit(1))
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    symbol = F.when(fault.isin(1, 2), MUST_GO).when(fault == 3, F.upper(letter)).otherwise(letter)
    return placed.select("conv_id", "pos", "turn", "role", "text", symbol.alias("symbol"), fault.alias("fault"))


def with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations, last one first: the node of each row and the node after it."""
    owner, after = object(), None
    for batch in batches:
        nodes, nexts = [], []
        for conv, symbol in zip(batch.column("conv_id").to_pylist(), batch.column("symbol").to_pylist(), strict=True):
            if conv != owner:
                owner, after = conv, None
            nexts.append(after)
            after = hashlib.blake2b(symbol.encode() + (after or b""), digest_size=16).digest()
            nodes.append(after)
        made = [pa.array(nodes, pa.binary()), pa.array(nexts, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "node", "next"])


def moves(symbol: str, state: int) -> dict[str, tuple[int, int]]:
    """Edit initial to (cost, next state) of the edits that take the row in."""
    found = {"D": (DELETE, state)}
    if symbol != MUST_GO:
        cut = CUT if symbol.isupper() else 0
        found["R"] = (REROLE + cut, AFTER[state])
        if symbol.lower() == TURN_OF[state][0]:
            found["K"] = (cut, AFTER[state])
        elif symbol.lower() == "s" and state == START:
            found["K"] = (cut, SYSTEM)
    return found


@lru_cache(None)
def matrix(symbol: str) -> tuple[int, ...]:
    """Least cost from each state to each by taking the row in, insertions before it included; row by row."""
    rows = []
    for state in range(4):
        best, at, paid = [NEVER] * 4, state, 0
        for _ in range(3):  # more than two insertions come back to a state at a cost
            for cost, to in moves(symbol, at).values():
                best[to] = min(best[to], paid + cost)
            at, paid = AFTER[at], paid + INSERT
        rows += best
    return tuple(rows)


@lru_cache(1 << 14)
def best_edits(symbol: str, costs: tuple[int, ...]) -> tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...]]:
    """Per state the edits up to and with the one that takes the row in, the state after it and the cost-to-go, where
    ``costs`` are those of the next node."""
    own = [min((paid + costs[to], edit, to) for edit, (paid, to) in moves(symbol, state).items()) for state in range(4)]
    total = [cost for cost, _, _ in own]
    for _ in range(2):
        total = [min(total[state], INSERT + total[AFTER[state]]) for state in range(4)]
    edits, leads = [], []
    for state in range(4):
        at, said = state, ""
        while min((own[at][0], own[at][1]), (INSERT + total[AFTER[at]], "I")) != own[at][:2]:
            at, said = AFTER[at], said + "I"
        edits.append(said + own[at][1])
        leads.append(own[at][2])
    return tuple(edits), tuple(leads), tuple(total)


def product(left: str, right: str) -> Column:
    """Minimum of sums of two 4 x 4 matrices."""
    cells = [F.least(*(F.col(left)[4 * i + k] + F.col(right)[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]
    return F.array(*cells)


def costs_to_go(nodes: DataFrame) -> DataFrame:
    """(node, costs) of (node, symbol, next): per node its least costs to the end, by state."""
    letters = [MUST_GO, *"suaoSUAO"]
    of_symbol = F.create_map(*(x for letter in letters for x in (F.lit(letter), F.array(*(F.lit(v).cast("bigint") for v in matrix(letter))))))
    state = saved(nodes.select("node", F.col("next").alias("jump"), of_symbol[F.col("symbol")].alias("way")), "ways")
    ended = [state.filter("jump is null")]
    waiting = state.filter("jump is not null")
    while not waiting.isEmpty():
        on = state.select(F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("way").alias("on"))
        longer = waiting.join(on, "jump").select("node", F.col("further").alias("jump"), product("way", "on").alias("way"))
        longer = saved(longer, "ways")
        ended.append(longer.filter("jump is null"))
        waiting = longer.filter("jump is not null")
        state = waiting
        for done in ended:
            state = state.unionByName(done)
    whole = ended[0]
    for done in ended[1:]:
        whole = whole.unionByName(done)
    to_end = [F.least(*(F.col("way")[4 * i + j] + AT_END[j] for j in range(4))) for i in range(4)]
    return whole.select("node", F.array(*to_end).alias("costs"))


def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the costs of the next one: the best edits of every state."""
    for batch in batches:
        found = [
            best_edits(symbol, tuple(costs) if costs else AT_END)
            for symbol, costs in zip(batch.column("symbol").to_pylist(), batch.column("costs").to_pylist(), strict=True)
        ]
        columns = [
            batch.column("node"),
            pa.array([total[START] for _, _, total in found], pa.int64()),
            pa.array([list(edits) for edits, _, _ in found], pa.list_(pa.string())),
            pa.array([list(leads) for _, leads, _ in found], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "cost", "edits", "leads"])


class Walk:
    """One conversation on its way: counts, state and running digest."""

    def __init__(self, conv, cost: int):
        self.conv, self.cost, self.state, self.audit = conv, cost, START, []
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0
        self.digest, self.said = hashlib.sha256(), False

    def say(self, role: str, text: str = "") -> None:
        if self.said:
            self.digest.update(b"\n")
        self.said = True
        self.digest.update(f"{role}:{text}".encode())

    def insert(self) -> None:
        self.say(TURN_OF[self.state])
        self.state = AFTER[self.state]

    def step(self, turn, role: str, text: str, fault: int, edits: list[str], leads: list[int]) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        chosen, to = edits[self.state], leads[self.state]
        self.audit.append(chosen)
        for _ in chosen[:-1]:
            self.insert()
        if chosen[-1] == "K":
            self.say(role, text)
        elif chosen[-1] == "R":
            self.say(TURN_OF[self.state], text)
        self.state = to

    def report(self) -> tuple:
        self.audit.append(END_EDITS[self.state])
        for _ in END_EDITS[self.state]:
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order, with their node's plan: one report per conversation."""
    walk, names = None, [field.split()[0] for field in REPORT.split(", ")]
    for batch in batches:
        done = []
        columns = (batch.column(name) for name in ("conv_id", "cost", "turn", "role", "text", "fault", "edits", "leads"))
        for conv, cost, *row in zip(*columns, strict=True):
            conv, cost = conv.as_py(), cost.as_py()
            if walk is None or walk.conv != conv:
                if walk is not None:
                    done.append(walk.report())
                walk = Walk(conv, cost)
            walk.step(*(value.as_py() for value in row))
        if done:
            yield reports(done, names)
    if walk is not None:
        yield reports([walk.report()], names)


def reports(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if name in ("audit", "repaired_sha256") else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repaired(rows: DataFrame) -> DataFrame:
    """The report of every conversation of (conv_id, turn, role, text, copy) that has rows."""
    told = faulted(rows)
    backwards = told.sortWithinPartitions("conv_id", F.col("pos").desc())  # dealt by conversation already
    told = saved(backwards.mapInArrow(with_nodes, f"{ROW}, node binary, next binary"), "suffixes")
    nodes = saved(told.groupBy("node").agg(F.first("symbol").alias("symbol"), F.first("next").alias("next")), "automaton")
    costs = saved(costs_to_go(nodes), "costs-to-go")
    on = nodes.join(costs.withColumnRenamed("node", "next"), "next", "left").select("node", "symbol", "costs")
    plans = saved(on.mapInArrow(planned, PLAN), "plans")
    edits = told.select("conv_id", "pos", "node").join(plans, "node")
    edits = edits.select(F.col("conv_id").alias("e_conv"), F.col("pos").alias("e_pos"), "cost", "edits", "leads")
    met = told.select("conv_id", "pos", "turn", "role", "text", "fault").join(edits, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("pos") == F.col("e_pos")))
    ordered = met.drop("e_conv", "e_pos").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(walked, REPORT)


def repair_query(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    found = repaired(damaged(conversations.select("conv_id", "turn", "role", "text")))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv")).distinct()
    joined = every.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit, digest = F.coalesce("audit", F.lit("")), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    return joined.select(F.col("conv").alias("conv_id"), *counts, audit.alias("audit"), digest.alias("repaired_sha256"))


# Fixed values in the SQL: the polynomial of the checksum, and the costs above.
ORACLE_SQL = r"""
with recursive filled as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as place
  from conversations
), summed as (
  select *, xor(list_reduce(
    list_transform(range(0, 8 * length(place)), lambda k: (ascii(place[k // 8 + 1]) >> (k % 8)) & 1),
    lambda crc, bit: xor(crc >> 1, case when (xor(crc, bit) & 1) = 1 then 3988292384 else 0 end),
    cast(4294967295 as bigint)), 4294967295) % 20 as kind
  from filled
), hurt as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case kind when 3 then [0, 1] else [0] end) as copy
  from summed where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from hurt
), told as (
  select *, case when body = '' then 1
      when row_number() over (partition by conv_id, role, text order by pos) > 1 then 2
      when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
    lag(left(role, 1)) over (partition by conv_id order by pos) as before
  from placed
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (pos > 1 and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal,
    count(*) as n, list({'fault': fault, 'role': role, 'text': text} order by pos) as turns
  from told group by conv_id
), steps as (
  select conv_id, n as i, turns,
    {'c': 0, 'e': '', 't': cast([] as varchar[])} as v0, {'c': 4, 'e': 'II', 't': ['user:', 'assistant:']} as v1,
    {'c': 2, 'e': 'I', 't': ['assistant:']} as v2, {'c': 0, 'e': '', 't': cast([] as varchar[])} as v3
  from counted
  union all
  select conv_id, i - 1, turns,
    list_sort([b0, {'c': 2 + q2.c, 'e': 'I' || q2.e, 't': list_prepend('user:', q2.t)}])[1],
    list_sort([b1, {'c': 2 + q2.c, 'e': 'I' || q2.e, 't': list_prepend('user:', q2.t)}])[1], q2, q3
  from (
    select *, list_sort([b2, {'c': 2 + b3.c, 'e': 'I' || b3.e, 't': list_prepend('assistant:', b3.t)}])[1] as q2,
      list_sort([b3, {'c': 2 + b2.c, 'e': 'I' || b2.e, 't': list_prepend('user:', b2.t)}])[1] as q3
    from (
      select conv_id, i, turns,
        list_sort([{'c': 3 + v0.c, 'e': 'D' || v0.e, 't': v0.t},
          {'c': go + 2 + cut + v2.c, 'e': 'R' || v2.e, 't': list_prepend('user:' || text, v2.t)},
          {'c': go + case initial when 's' then 0 else 1000000 end + cut + v1.c, 'e': 'K' || v1.e, 't': list_prepend(role || ':' || text, v1.t)},
          {'c': go + case initial when 'u' then 0 else 1000000 end + cut + v2.c, 'e': 'K' || v2.e, 't': list_prepend(role || ':' || text, v2.t)}])[1] as b0,
        list_sort([{'c': 3 + v1.c, 'e': 'D' || v1.e, 't': v1.t},
          {'c': go + 2 + cut + v2.c, 'e': 'R' || v2.e, 't': list_prepend('user:' || text, v2.t)},
          {'c': go + case initial when 'u' then 0 else 1000000 end + cut + v2.c, 'e': 'K' || v2.e, 't': list_prepend(role || ':' || text, v2.t)}])[1] as b1,
        list_sort([{'c': 3 + v2.c, 'e': 'D' || v2.e, 't': v2.t},
          {'c': go + 2 + cut + v3.c, 'e': 'R' || v3.e, 't': list_prepend('assistant:' || text, v3.t)},
          {'c': go + case initial when 'a' then 0 else 1000000 end + cut + v3.c, 'e': 'K' || v3.e, 't': list_prepend(role || ':' || text, v3.t)}])[1] as b2,
        list_sort([{'c': 3 + v3.c, 'e': 'D' || v3.e, 't': v3.t},
          {'c': go + 2 + cut + v2.c, 'e': 'R' || v2.e, 't': list_prepend('user:' || text, v2.t)},
          {'c': go + case initial when 'u' then 0 else 1000000 end + cut + v2.c, 'e': 'K' || v2.e, 't': list_prepend(role || ':' || text, v2.t)}])[1] as b3
      from (
        select *, turns[i].role as role, turns[i].text as text, left(turns[i].role, 1) as initial,
          case when turns[i].fault in (1, 2) then 1000000 else 0 end as go, case turns[i].fault when 3 then 1 else 0 end as cut
        from steps where i > 0
      )
    )
  )
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(v0.c, 0) as bigint) as cost,
  coalesce(v0.e, '') as audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on o.conv_id is not distinct from c.conv_id
left join (select conv_id, v0 from steps where i = 0) s on o.conv_id is not distinct from s.conv_id
"""
