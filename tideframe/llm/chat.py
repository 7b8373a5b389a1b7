"""Chat formatting by minimum-cost role repair.

A legal conversation is what a small automaton accepts: an optional system turn, then user and assistant turns in
alternation, ending with an assistant turn. Dynamic programming over the automaton's states finds the cheapest way to
read any sequence of turns: keep a turn, relabel it, merge it into the turn before, or insert empty turns before it or
at the end. The repaired sequence is rendered turn by turn.

What a run of turns does to the states is a min-plus matrix, and matrices of consecutive runs multiply. So conversations
are not gathered: rows are range-partitioned in order, each partition sums up the runs of its first and last
conversation, the driver chains these (two small matrices a partition) and fixes the state at every border, and each
partition then repairs its own runs. A conversation with a third of all rows is spread over many partitions.

Of several cheapest repairs the one with the smallest sequence of states is taken, whatever the partitioning.

Defined results: a null or unknown role can take any role at UNKNOWN; null text is empty; turns are ordered by turn
(null last), then by a hash of role and text; repeated rows are turns of their own; rows with a null conversation form
one conversation; an empty table gives an empty result; only the four named columns are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import common

ROLES = ("system", "user", "assistant")
#: States: nothing emitted yet, then the role of the last turn emitted. NEXT holds the roles that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT, UNKNOWN = 1, 2, 2, 1
FAR = 1 << 60
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _chains(state: int) -> list[tuple[int, ...]]:
    """Insertions of empty turns that lead on from a state, without a state twice."""
    out, todo = [], [()]
    while todo:
        chain = todo.pop(0)
        out.append(chain)
        last = chain[-1] if chain else state
        todo += [(*chain, s) for s in NEXT[last] if s not in chain and s != state]
    return out


def _moves(role: int | None) -> dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]:
    """(state, next state) -> the cheapest (cost, insertions, merged) that reads a turn of role (None: unknown)."""
    best: dict = {}
    for q in range(4):
        for chain in _chains(q):
            at = chain[-1] if chain else q
            ways = [(s, False) for s in NEXT[at]] + ([(q, True)] if q != START and not chain else [])
            for s, merged in ways:
                cost = INSERT * len(chain) + MERGE * merged + (0 if s == role else UNKNOWN if role is None else RELABEL)
                if (q, s) not in best or (cost, len(chain)) < (best[q, s][0], len(best[q, s][1])):
                    best[q, s] = (cost, chain, merged)
    return best


MOVES = {role: _moves(role) for role in (None, SYSTEM, USER, ASSISTANT)}
#: state -> (cost, insertions) that end a conversation legally; one without turns is left as it is.
ENDS = {q: min(((INSERT * len(c), c) for c in _chains(q) if (c[-1] if c else q) == ASSISTANT), default=(FAR, ())) for q in range(4)}


def role_code(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


class Run:
    """Reads consecutive turns from one state: for each state at the end the cost, and the rank of its path among the ends'."""

    def __init__(self, start: int):
        self.cost = [FAR] * 4
        self.cost[start] = 0
        self.rank = [0] * 4
        self.back: list[tuple] = []

    def read(self, role: int | None) -> None:
        best: list = [None] * 4
        for (q, s), (cost, _, _) in MOVES[role].items():
            if self.cost[q] < FAR:
                way = (self.cost[q] + cost, self.rank[q], q)
                if best[s] is None or way < best[s]:
                    best[s] = way
        self.cost = [FAR if b is None else b[0] for b in best]
        order = sorted((b[1], s) for s, b in enumerate(best) if b is not None)
        for place, (_, s) in enumerate(order):
            self.rank[s] = place
        self.back.append(tuple(None if b is None else b[2] for b in best))

    def states(self, end: int) -> list[int]:
        """The states before the first turn and after each, of the path that ends at end."""
        out = [end]
        for step in reversed(self.back):
            out.append(step[out[-1]])
        return out[::-1]

    def best_end(self) -> int:
        return min(range(4), key=lambda q: (self.cost[q] + (ENDS[q][0] if self.back or q != START else 0), self.rank[q], q))


def chain_borders(segments: list[dict]) -> list[tuple[int, int]]:
    """(start, end) state of each segment of one conversation, from the segments' cost and rank matrices."""
    rest = [ENDS[q][0] for q in range(4)]
    rests = [rest]
    for seg in reversed(segments):
        rest = [min(min(c + r, FAR) for c, r in zip(seg["cost"][q], rest, strict=True)) for q in range(4)]
        rests.append(rest)
    rests.reverse()
    out, at = [], START
    for k, seg in enumerate(segments):
        end = min(range(4), key=lambda q: (min(seg["cost"][at][q] + rests[k + 1][q], FAR), seg["rank"][at][q], q))
        out.append((at, end))
        at = end
    return out


def repaired(turns: list[tuple], start: int, end: int | None, first: int, last: bool) -> list[tuple]:
    """Rows (turn, seq, sub, role, action, cost, text, rendered) of consecutive turns (turn, role, text).

    start and end are the states around them (end None: the cheapest), first their place in the conversation; last says
    whether the conversation ends here.
    """
    run = Run(start)
    codes = [role_code(r) for _, r, _ in turns]
    for code in codes:
        run.read(code)
    states = run.states(run.best_end() if end is None else end)
    out, opened = [], start != START

    def emit(turn, seq, sub, state, action, cost, text, merged):
        nonlocal opened
        shown = "\n" + text if merged else (CLOSE if opened else "") + OPEN.format(ROLES[state - 1]) + text
        opened = True
        out.append([turn, seq, sub, ROLES[state - 1], action, cost, text, shown])

    for k, ((turn, _, text), code) in enumerate(zip(turns, codes, strict=True)):
        cost, chain, merged = MOVES[code][states[k], states[k + 1]]
        for sub, s in enumerate(chain):
            emit(None, first + k, sub, s, "insert", INSERT, "", False)
        changed = states[k + 1] != code
        action = "relabel+merge" if changed and merged else "relabel" if changed else "merge" if merged else "keep"
        emit(turn, first + k, len(chain), states[k + 1], action, cost - INSERT * len(chain), text or "", merged)
    if last:
        for sub, s in enumerate(ENDS[states[-1]][1]):
            emit(None, first + len(turns), sub, s, "insert", INSERT, "", False)
        out[-1][-1] += CLOSE
    return [tuple(r) for r in out]


def _runs(batches, key, wanted):
    """(key, rows) of consecutive rows with one key; rows are tuples of the wanted columns."""
    now, held = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (key, *wanted)]
        for k, *row in zip(*cols, strict=True):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for every turn read or inserted: conv, turn, seq, sub, role, action, cost, text, rendered.

    seq is the place in the conversation, sub the place among the rows of one seq; the rendered pieces of a conversation,
    put together in the order of (seq, sub), are its rendering. seq, sub and all else do not depend on the partitioning.
    """
    spark = turns.sparkSession
    common.with_workers(spark)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (conv, turn)}
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("deal"), F.col("serial")]
    own = own.withColumn("deal", F.xxhash64("role", "text")).withColumn("serial", F.monotonically_increasing_id())
    own = common.checkpointed(own.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text"))

    def summarise(batches):
        part, first, final, n = TaskContext.get().partitionId(), None, None, 0
        for k, rows in _runs(batches, "conv", ("role",)):
            final = (k, rows)
            first = first or final
            n += 1
        for end, seg in (("only", first),) if n == 1 else (("first", first), ("last", final)):
            if seg:
                each = [Run(q) for q in range(4)]
                for (r,) in seg[1]:
                    for run in each:
                        run.read(role_code(r))
                yield pa.RecordBatch.from_pydict({"part": [part], "place": [end], "conv": pa.array([seg[0]], conv_type), "n": [len(seg[1])], "cost": [[run.cost for run in each]], "rank": [[run.rank for run in each]]})

    conv_type = _arrow_type(turns, conv)
    found = own.select("conv", "role").mapInArrow(summarise, f"part long, place string, conv {kinds[conv]}, n long, cost array<array<long>>, rank array<array<long>>").collect()
    order = {"only": 0, "first": 0, "last": 1}
    segments = [r.asDict() for r in sorted(found, key=lambda r: (r.part, order[r.place]))]
    borders, k = {}, 0
    while k < len(segments):  # segments of one conversation follow each other
        chain = [segments[k]]
        while segments[k]["place"] != "first" and k + 1 < len(segments) and segments[k + 1]["conv"] == chain[0]["conv"]:
            k += 1
            chain.append(segments[k])
            if segments[k]["place"] == "first":
                break
        k += 1
        seen = 0
        for seg, (start, end) in zip(chain, chain_borders(chain), strict=True):
            borders[seg["part"], seg["place"]] = (start, end, seen, seg is chain[-1])
            seen += seg["n"]
    sent = spark.sparkContext.broadcast(borders)  # two entries a partition at most

    def mend(batches):
        part, before, held = TaskContext.get().partitionId(), None, 0

        def rows_of(k, rows, at):
            start, end, first, last = sent.value.get((part, at), (START, None, 0, True))
            mended = repaired([(t, r, x) for t, r, x in rows], start, end, first, last)
            cols = list(zip(*mended, strict=True))
            kinds_ = [turn_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["turn", "seq", "sub", "role", "action", "cost", "text", "rendered"]
            return pa.RecordBatch.from_arrays([pa.array([k] * len(mended), conv_type), *[pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)]], names=["conv", *names])

        for item in _runs(batches, "conv", ("turn", "role", "text")):
            if before:
                yield rows_of(*before, "first" if held == 1 else "inner")
            before, held = item, held + 1
        if before:
            yield rows_of(*before, "only" if held == 1 else "last")

    turn_type = _arrow_type(turns, turn)
    out = own.mapInArrow(mend, f"conv {kinds[conv]}, turn {kinds[turn]}, seq long, sub long, role string, action string, cost long, text string, rendered string")
    return out.withColumnRenamed("conv", conv)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def render(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, rendered) with a conversation's whole rendering in one value; for conversations that fit in a row."""
    own = pieces.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("seq", "sub", "rendered"))).alias("p"))
    return own.select(conv, F.array_join(F.transform("p", lambda p: p["rendered"]), "").alias("rendered"))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(common.table(spark, sf_dir, "conversations"))
