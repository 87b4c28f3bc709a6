"""Conversation structure repair: the cheapest edits that make a conversation alternate, by divide and conquer.

A repaired conversation is empty or an optional system turn and then pairs of a user's and an assistant's turn. Four
states tell what may follow (nothing yet, after system, after user, after assistant). Over a range of rows, the forward
vector holds the cost of reaching each state from a given one, and the backward vector that of reaching the end from
it. The two meet in the middle; the crossing with the least sum is kept, ties by the least audit (the forward vector
carries the order of its four audits, so no audit is stored), and both halves recurse. Memory is that of the rows.

A range of rows acts on the states like one row: by a 4 x 4 table of costs and orders. So the rows, sorted by range
partitioning, are cut into chunks of fixed size, whatever conversations lie in them. Conversations inside a chunk are
solved there; the at most two that reach over its ends pass on one table each, which chunks of chunks treat as rows.
Crossings go down the same levels. No conversation, however long, is gathered.

Defined results: a null role or text counts as one space, a null turn sorts first. Rows of one turn come in an order
fixed by their role and a hash of their text. Rows without ``conv_id`` form a conversation. Repeated rows are
duplicates. An empty table has no edits. Other columns play no part. Texts of any length are hashed where they
lie; only the texts that stay are shuffled, once for ``edits`` and once more, in order, for ``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ionloom.llm.common import narrow_batches, staged

STATES = range(4)  # nothing yet, after system, after user, after assistant
NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
WANTED = ["user", "user", "assistant", "user"]
ENDINGS = [0, 2, 1, 0]  # turns to insert so that a conversation may end in a state
CLOSING = [INSERT * n for n in ENDINGS]
INITIALS = "sua"
SPACE = "\x20\t\n\x0b\x0c\r"
OWN = 9  # place of a row's own edit among the inserts before and after it
# A chunk is a run of 2^13 row numbers. A row number is 2^33 x partition + place, so the next levels join the chunks
# of a partition, 2^10 partitions, and all.
LEVELS = (13, 33, 43, 63)

Moves = list[tuple[int, int, int, int]]  # (state before, state after, cost, order of the audit among those of the state before)


def after(state: int, inserts: int) -> int:
    for _ in range(inserts):
        state = 3 if state == 2 else 2
    return state


def row_moves(initial: str, gone: bool, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest way of a row from state to state, with its audit: inserts, then what becomes of the row."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for state in STATES:
        for inserts in range(3):
            at = after(state, inserts)
            ways = [(at, DELETE, "D")]
            if not gone:
                extra = TRUNCATED * truncated
                ways.append((after(at, 1), REROLE + extra, "R"))
                if (initial, at) in STEPS:
                    ways.append((STEPS[initial, at], KEEP + extra, "K"))
            for target, cost, letter in ways:
                way = (INSERT * inserts + cost, "I" * inserts + letter)
                found[state, target] = min(found.get((state, target), way), way)
    return found


# a row's kind: 0 must go; else 1 + 2 x (system, user, assistant, other) + truncated
ROWS = [row_moves("", True, False)] + [row_moves(initial, False, bool(cut)) for initial in (*INITIALS, "") for cut in range(2)]


def ordered(moves: dict[tuple[int, int], tuple[int, str]]) -> Moves:
    places = {s: sorted(audit for (a, _), (_, audit) in moves.items() if a == s) for s in STATES}
    return [(s, t, cost, places[s].index(audit)) for (s, t), (cost, audit) in moves.items()]


KINDS = [ordered(moves) for moves in ROWS]


def forward(elements: list[Moves], start: int) -> list[tuple[int, int]]:
    """Cost of reaching each state from ``start``, and the order of the four audits."""
    vector = [(NEVER, 0)] * 4
    vector[start] = (0, 0)
    for moves in elements:
        best = [(NEVER, 0, 0)] * 4
        for s, t, cost, place in moves:
            so_far, order = vector[s]
            if so_far < NEVER:
                way = (so_far + cost, order, place)
                if way < best[t]:
                    best[t] = way
        orders = sorted(way[1:] for way in best)
        vector = [(way[0], orders.index(way[1:])) for way in best]
    return vector


def backward(elements: list[Moves], tail: list[int]) -> list[int]:
    """Cost of reaching the end from each state."""
    for moves in reversed(elements):
        vector = [NEVER] * 4
        for s, t, cost, _ in moves:
            if cost + tail[t] < vector[s]:
                vector[s] = cost + tail[t]
        tail = vector
    return tail


def crossings(elements: list[Moves], start: int, tail: list[int]) -> list[int]:
    """The state after each element on the cheapest way, ties by the least audit."""
    states = [0] * len(elements)
    work = [(0, len(elements), start, tail)]
    while work:
        low, high, s, tail = work.pop()
        if high - low == 1:
            states[low] = min((cost + tail[t], place, t) for a, t, cost, place in elements[low] if a == s)[2]
            continue
        middle = (low + high) // 2
        ahead, behind = forward(elements[low:middle], s), backward(elements[middle:high], tail)
        t = min(STATES, key=lambda q: (ahead[q][0] + behind[q], ahead[q][1]))
        only = [NEVER] * 4
        only[t] = 0
        work += [(low, middle, s, only), (middle, high, t, tail)]
    return states


def table_of(elements: list[Moves]) -> Moves:
    """Many elements as one."""
    out = []
    for s in STATES:
        out += [(s, t, cost, order) for t, (cost, order) in enumerate(forward(elements, s)) if cost < NEVER]
    return out


def runs(conversations: list) -> list[tuple[int, int]]:
    """Bounds of the runs of equal conversations."""
    cuts = [0] + [i for i in range(1, len(conversations)) if conversations[i] != conversations[i - 1]] + [len(conversations)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def elements_of(table: pa.Table, level: int) -> list[Moves]:
    if level == 0:
        return [KINDS[k] for k in table["kind"].to_pylist()]
    return [list(zip(*[iter(flat)] * 4, strict=True)) for flat in table["moves"].to_pylist()]


def open_ends(table: pa.Table, level: int) -> pa.Table:
    """Of a chunk, its first and its last conversation, each as one element of the next level."""
    table = table.sort_by("row")
    elements = elements_of(table, level)
    bounds = runs(table["conv_id"].to_pylist())
    ends = bounds if len(bounds) < 2 else [bounds[0], bounds[-1]]
    flat = [[x for move in table_of(elements[a:b]) for x in move] for a, b in ends]
    first = table.take(pa.array([a for a, _ in ends], pa.int64())).select(["conv_id", "row"])
    return first.append_column("moves", pa.array(flat, pa.list_(pa.int64())))


def cross_chunk(table: pa.Table, given: pa.Table | None, level: int) -> pa.Table:
    """The states before and after each element of a chunk. ``given`` has those of the conversations at its ends."""
    table = table.sort_by("row")
    elements, rows = elements_of(table, level), table["row"].to_pylist()
    known = {} if given is None else {r["row"]: r for r in given.to_pylist()}
    before, behind, last = [0] * len(rows), [0] * len(rows), [False] * len(rows)
    for a, b in runs(table["conv_id"].to_pylist()):
        start, tail, ends = 0, CLOSING, True
        if rows[a] in known:
            end = known[rows[a]]
            start, ends = end["before"], end["last"]
            tail = [0 if t == end["behind"] else NEVER for t in STATES]
        behind[a:b] = crossings(elements[a:b], start, tail)
        before[a:b] = [start, *behind[a : b - 1]]
        last[b - 1] = ends
    keep = table.drop_columns(["moves"]) if level else table
    return keep.append_column("before", pa.array(before, pa.int32())).append_column("behind", pa.array(behind, pa.int32())).append_column("last", pa.array(last))


def open_ends_of(level: int):
    return lambda table: open_ends(table, level)


def closed_chunk(level: int):
    return lambda table: cross_chunk(table, None, level)


def open_chunk(level: int):
    return lambda table, given: cross_chunk(table, given, level)


def conversation_rows(turns: DataFrame) -> DataFrame:
    """Nulls of role and text as one space, with two hashes of conversation, role and text."""
    shown = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    content = [F.col("conv_id").isNull(), "conv_id", "role", "text"]
    return shown.withColumns({"h1": F.xxhash64(*content), "h2": F.xxhash64(F.lit(1), *content)})


def located(rows: DataFrame) -> DataFrame:
    """The rows without their texts, in order: conv_id, turn, row, initial, fault, kind and the hashes."""
    bare = F.rtrim("text", F.lit(SPACE))
    kept = rows.select(
        "conv_id",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        "role",
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        "h1",
        "h2",
        F.monotonically_increasing_id().alias("tie"),  # lets range partitioning split rows that are alike in all else
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h1", "h2", "tie"]
    kept = kept.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "tie")
    kept = staged(kept.withColumn("row", F.monotonically_increasing_id()), "turns")
    repeated = kept.groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = kept.join(repeated, ["h1", "h2"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("row") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    marked = marked.withColumn("fault", fault)
    place = F.instr(F.lit(INITIALS), F.col("initial"))
    group = F.when((F.col("initial") != "") & (place > 0), place - 1).otherwise(len(INITIALS))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * group + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))
    return staged(marked.select("conv_id", "turn", "row", "initial", "fault", kind.alias("kind"), "h1", "h2"), "turn-kinds")


def crossed(rows: DataFrame) -> DataFrame:
    """``rows`` with the states before and after each on the cheapest way of its conversation."""

    def chunk(level: int) -> Column:
        return F.shiftright("row", LEVELS[level]) if LEVELS[level] < 63 else F.lit(0).cast("long")

    named = rows.schema["conv_id"]
    up = StructType([named, StructField("row", rows.schema["row"].dataType), *StructType.fromDDL("moves array<long>").fields])
    levels = [rows]
    while LEVELS[len(levels) - 1] < 63:
        level = len(levels) - 1
        least, most = levels[-1].agg(F.min(chunk(level)), F.max(chunk(level))).first()
        if least == most:
            break
        ends = levels[-1].select("conv_id", "row", "kind" if level == 0 else "moves").groupBy(chunk(level).alias("chunk"))
        levels.append(staged(ends.applyInArrow(open_ends_of(level), up), "turn-ends"))
    found = None
    for level in reversed(range(len(levels))):
        own = levels[level]
        fields = [f for f in own.schema.fields if f.name != "moves"]
        out = StructType([*fields, *StructType.fromDDL("before int, behind int, last boolean").fields])
        grouped = own.groupBy(chunk(level).alias("chunk"))
        if found is None:
            found = grouped.applyInArrow(closed_chunk(level), out)
        else:
            above = found.select("row", "before", "behind", "last").groupBy(chunk(level).alias("chunk"))
            found = grouped.cogroup(above).applyInArrow(open_chunk(level), out)
        found = staged(found, "turn-states")
    return found


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, in order of ``row`` and ``part``.

    ``edit`` is K(eep), R(erole), D(elete) or I(nsert); ``role`` and ``text`` are those of the repaired turn, null if it is
    deleted. ``turn``, ``initial`` (of the role) and ``fault`` tell of the row edited and are null for inserts.
    """
    spark = turns.sparkSession
    narrow_batches(spark, 1 << 14)
    rows = conversation_rows(turns)
    states = crossed(located(rows))
    # every pair of states of a kind has one way; a table of at most 9 x 16 rows
    ways = [(k, s, t, audit.count("I"), audit[-1], cost) for k, moves in enumerate(ROWS) for (s, t), (cost, audit) in moves.items()]
    ways = F.broadcast(spark.createDataFrame(ways, "kind int, before int, behind int, inserts int, edit string, price int"))
    chosen = states.join(ways, ["kind", "before", "behind"])

    def inserted(number: Column, state: Column, first: int) -> Column:
        """Inserts take turns, beginning with the one wanted."""
        steps = F.sequence(F.lit(0), number - 1)
        role = lambda i: F.when(((state == 2).cast("int") + i) % 2 == 1, "assistant").otherwise("user")
        made = F.transform(steps, lambda i: F.struct((i + first).alias("part"), F.lit("I").alias("edit"), role(i).alias("role")))
        return F.when(number > 0, made).otherwise(F.array().cast("array<struct<part:int,edit:string,role:string>>"))

    at = F.when(F.col("inserts") == 0, F.col("before")).otherwise(F.when((F.col("before") == 2) == (F.col("inserts") == 1), 3).otherwise(2))
    own = F.struct(F.lit(OWN).alias("part"), F.col("edit").alias("edit"), F.when(F.col("edit") == "R", F.when(at == 2, "assistant").otherwise("user")).alias("role"))
    missing = F.when(F.col("last"), F.array(*map(F.lit, ENDINGS))[F.col("behind")]).otherwise(0)
    script = F.concat(inserted(F.col("inserts"), F.col("before"), 0), F.array(own), inserted(missing, F.col("behind"), OWN + 1))
    told = chosen.select(
        "conv_id", "row", "turn", "initial", "fault", "h1", "h2", F.explode(script).alias("e"), (F.col("price") - INSERT * F.col("inserts")).alias("price")
    )
    mine = F.col("e.part") == OWN

    def only(name: str) -> Column:
        return F.when(mine, F.col(name)).alias(name)

    told = told.select(
        "conv_id", "row", "e.part", "e.edit", "e.role", only("turn"), only("initial"), only("fault"), F.when(mine, F.col("price")).otherwise(INSERT).alias("price"), only("h1"), only("h2")
    )
    stays = F.col("edit").isin("K", "R")
    texts = rows.groupBy("h1", "h2").agg(F.first(F.struct("role", "text")).alias("said"))
    kept = told.where(stays).join(texts, ["h1", "h2"]).withColumn("role", F.coalesce("role", "said.role")).withColumn("text", F.col("said.text"))
    rest = told.where(~stays).withColumn("text", F.when(F.col("edit") == "I", ""))
    columns = ["conv_id", "row", "part", "edit", "role", "text", "turn", "initial", "fault", "price"]
    return kept.select(columns).unionByName(rest.select(columns))


class Digest:
    """What a conversation's edits add up to, taken in order."""

    COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    LEGAL = {"su", "ua", "au"}

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.hash, self.some, self.initial = conv_id, [], hashlib.sha256(), False, None
        self.low = self.high = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, part, edit, role, text, turn, initial, fault, price) -> None:
        self.audit.append(edit)
        self.cost += price
        if edit != "D":
            self.hash.update((("\n" if self.some else "") + role + ":" + text).encode())
            self.some = True
        if part != OWN:
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += self.initial is not None and self.initial + initial not in self.LEGAL
        self.initial = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def digests(turns: DataFrame, original: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``original``: counts, cost, audit and the hash of the repaired conversation.

    A conversation's edits pass through one task in order, a batch at a time, since a hash has no parts that could be
    joined; only its audit is held.
    """
    names = ["part", "edit", "role", "text", "turn", "initial", "fault", "price"]
    made = edits(turns)
    every = original.select("conv_id").distinct().withColumn("row", F.lit(-1).cast("long"))
    made = made.unionByName(every, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def batch() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = zip(*done, strict=True) if done else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=out)

        kind = None
        for part in batches:
            kind = part.schema.field("conv_id").type
            for conv_id, row, *values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = Digest(conv_id)
                if row >= 0:
                    current.add(*values)
            if done:
                yield batch()
                done = []
        if current is not None:
            done.append(current.row())
            yield batch()

    out = ["conv_id", *Digest.COLUMNS, "audit", "repaired_sha256"]
    schema = StructType([made.schema["conv_id"], *StructType.fromDDL(", ".join(f"{c} long" for c in Digest.COLUMNS) + ", audit string, repaired_sha256 string").fields])
    sorted_edits = made.select("conv_id", "row", *names).repartition("conv_id").sortWithinPartitions("conv_id", "row", "part")
    return sorted_edits.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with known faults, told by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space there."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fault.alias("fault"),
    ).where("fault <> 0")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).drop("fault", "copy")
