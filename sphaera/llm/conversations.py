"""Repair of the structure of conversations.

A row has at most one fault: it is blank, or repeats an earlier role and text of its conversation, or breaks off without a
closing mark.  The roles and faults of a conversation are written as a string, a character a row; every distinct string is
solved once by memoised recursion for its cheapest edits; audits are joined back and replayed over the texts.

The roles of a repaired conversation match (s?(ua)+)?, by their initials.  Edits: Keep (0), Rerole to user or assistant (3),
Delete (4, required for blank and repeated rows), Insert an empty row of user or assistant (3); a row that breaks off and is
not deleted adds 3.  Of the cheapest lists of edits the least one in ASCII order is taken.  Its letters fix every role: from
each state of the pattern, a kept row, a new role and an inserted row lead to one state each.

A long conversation is cut into blocks of at most BLOCK rows.  The cost of getting through a block is a 4 x 4 table (state
before, state after); only these tables, and for every block the four states it leads to, meet in one task: 10^9 rows of one
conversation are some 120,000 small rows there.  Texts are shuffled once, by conversation, and streamed in order.

Null text and role are one space; a null conversation id is a conversation, a null turn comes first.  Rows of one turn are
taken by role, then by the SHA-256 of role and text; equal rows are interchangeable.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import materialise

DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
BLOCK = 1 << 13
NEVER = 1 << 30
#: States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or new role leads to, and which role that is.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The pattern may end before its first row, or after an assistant.
END = (0, NEVER, NEVER, 0)
#: Solved signatures are dealt to so many places, so that a common one meets its conversations in many tasks.
SALTS = 16
_WHITE = " \t\n\x0b\x0c\r"


def kept_state(state: int, symbol: str) -> int | None:
    """The state after a kept row, None where its role does not fit."""
    s = symbol.lower()
    if s == "s":
        return SYSTEM if state == START else None
    if s == "u":
        return USER if state != USER else None
    return ASSISTANT if s == "a" and state == USER else None


def steps(state: int, symbol: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that take in a row, in ASCII order of their letters."""
    yield "D", DELETE, state
    if symbol != "x":
        late = CUT_OFF if symbol.isupper() else 0
        to = kept_state(state, symbol)
        if to is not None:
            yield "K", late, to
        yield "R", REROLE + late, TURN[state]


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):  # two inserts at most are ever of use in one place
        costs = [min(c, INSERT + costs[TURN[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def remaining(signature: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For every place of a signature the least cost from each state to its end, where each state has the cost `end`."""
    known = {len(signature): _with_inserts(list(end))}

    def rest(i: int) -> tuple[int, ...]:
        if i not in known:
            after = rest(i + 1)
            known[i] = _with_inserts([min(cost + after[to] for _, cost, to in steps(s, signature[i])) for s in range(4)])
        return known[i]

    for i in range(len(signature), -1, -200):  # the recursion stays shallow
        rest(i)
    return [rest(i) for i in range(len(signature) + 1)]


def cheapest(signature: str, end: tuple[int, ...] = END, state: int = START) -> tuple[list[str], int, int]:
    """(letters for every row, state after, cost): the least of the cheapest lists of edits.

    A row's letters are the inserts before it and its own edit; the last row's also the inserts at the end.
    """
    rest = remaining(signature, end)
    out, total, letters = [], rest[0][state], ""
    for i, symbol in enumerate(signature):
        while True:
            left = rest[i][state]
            moves = [*steps(state, symbol), ("I", INSERT, TURN[state])]
            letter, to = min((x, t) for x, c, t in moves if c + rest[i if x == "I" else i + 1][t] == left)
            letters, state = letters + letter, to
            if letter != "I":
                break
        out.append(letters)
        letters = ""
    while end[state] != rest[len(signature)][state]:
        out[-1] += "I"
        state = TURN[state]
    return out, state, total


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32(`conv_id:turn`) % 20; a dropped row has no copies."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def whole(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of rows as they are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, initial, fault, pos and symbol, without texts; pos is the place in the order of rows."""
    bare = F.rtrim("text", F.lit(_WHITE))
    closed = F.substring(bare, -1, 1).isin(".", "!", "?")
    slim = rows.where("copies > 0").select("conv_id", "turn", "role", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), F.when(bare == "", "blank").when(~closed, "truncated").alias("state"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")
    keys = ("conv_id", "turn", "role", "digest")
    placed = materialise(slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()), "turns")
    first = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("state") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.coalesce("state", F.lit("")))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return placed.join(first, "pos", "left").withColumn("fault", fault).withColumn("symbol", symbol)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, through: the least cost from each state before to each state after, 16 numbers."""
    for b in batches:
        out = []
        for sig in b.column(0).to_pylist():
            columns = [remaining(sig, tuple(0 if t == s else NEVER for s in range(4)))[0] for t in range(4)]
            out.append([min(columns[t][s], NEVER) for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["sig", "through"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, end, letters (for each state before, those of every row), exits (for each state before)."""
    for b in batches:
        letters, exits = [], []
        for sig, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            four = [cheapest(sig, tuple(end), s) for s in range(4)]
            letters.append([x[0] for x in four])
            exits.append([x[1] for x in four])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(letters, pa.list_(pa.list_(pa.string()))), pa.array(exits, pa.list_(pa.int64()))], names=["sig", "end", "letters", "exits"])


def _ends(g: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation the cost from each state after it to the end, less the least one."""
    g = g.sort_values("block")
    end, out = list(END), []
    for through in reversed(g["through"].tolist()):
        low = min(end)
        end = [min(x - low, NEVER) for x in end]
        out.append(end)
        end = [min(through[4 * s + t] + end[t] for t in range(4)) for s in range(4)]
    return g[["conv_id", "block", "sig"]].assign(end=out[::-1])


def _states(g: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of a conversation."""
    g = g.sort_values("block")
    state, out = START, []
    for exits in g["exits"].tolist():
        out.append(state)
        state = int(exits[state])
    return g[["conv_id", "block"]].assign(before=out)


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, pos, initial, fault, letters for rows (conv_id, turn, role, text, copies).

    letters: a row's own edit, with the inserts before it, and after it at a conversation's end.
    """
    row = F.struct("pos", "turn", "role", "digest", "initial", "fault", "symbol")
    held = _symbols(rows).groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = materialise(held.withColumn("sig", F.array_join(F.transform("rows", lambda r: r["symbol"]), "")), "turn-blocks")
    several = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    cut = blocks.select("conv_id", "block", "sig").join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    kind = dict(rows.dtypes)["conv_id"]
    tables = cut.select("sig").distinct().mapInArrow(_tables, "sig string, through array<long>")
    ends = cut.join(tables, "sig").groupBy("conv_id").applyInPandas(_ends, f"conv_id {kind}, block long, sig string, end array<long>")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "end")
    asked = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").select("conv_id", "block", "rows", "sig", F.coalesce("end", F.array(*(F.lit(x).cast("long") for x in END))).alias("end"), F.col("c").isNotNull() | F.col("b").isNotNull())
    asked = asked.toDF("conv_id", "block", "rows", "sig", "end", "one_of_many").withColumn("salt", F.pmod(F.xxhash64("conv_id", "block"), F.lit(SALTS)))
    solved = asked.select("sig", "end").distinct().mapInArrow(_solved, "sig string, end array<long>, letters array<array<string>>, exits array<long>")
    solved = materialise(solved, "turn-signatures").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = asked.join(solved, ["sig", "end", "salt"])
    chained = found.where("one_of_many").select("conv_id", "block", "exits").groupBy("conv_id").applyInPandas(_states, f"conv_id {kind}, block long, before long")
    chained = chained.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before")
    chosen = found.join(chained, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").select("conv_id", "rows", F.element_at("letters", (F.coalesce("before", F.lit(0)) + 1).cast("int")).alias("letters"))
    return chosen.select("conv_id", F.explode(F.arrays_zip("rows", "letters")).alias("e")).select("conv_id", *(f"e.rows.{c}" for c in ("turn", "role", "digest", "pos", "initial", "fault")), "e.letters")


def _streamed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Texts and edits of every conversation in one partition, in order, a text before the edits that may take it up."""
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.lit(-1).cast("long").alias("pos"), "text", none("string").alias("initial"), none("string").alias("fault"), none("string").alias("letters"))
    acts = changes.select("conv_id", "turn", "role", "digest", "pos", none("string").alias("text"), "initial", "fault", "letters")
    return texts.unionByName(acts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "pos")


class _Tally:
    """What one conversation adds up to, row by row in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.low = self.high = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before = None
        self.audit: list[str] = []
        self.state, self.text = START, ""

    def take(self, turn: int | None, role: str, initial: str, fault: str, letters: str) -> Iterator[tuple[str, str, str]]:
        """Counts one row and gives the rows of the repaired conversation that come of it: (letter, role, text)."""
        if turn is not None:
            self.low, self.high = (turn if self.low is None else self.low), turn
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.audit.append(letters)
        for letter in letters:
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[letter] + (CUT_OFF if fault == "truncated" and letter in "KR" else 0)
            if letter == "K":
                self.state = kept_state(self.state, initial)
                yield letter, role, self.text
            elif letter != "D":
                self.state = TURN[self.state]
                yield letter, ROLE[self.state], self.text if letter == "R" else ""


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Tally, tuple[str, str, str] | None]]:
    """(tally, repaired row) for all rows, and (tally, None) at the end of every conversation."""
    now = None
    for b in batches:
        for conv_id, turn, role, _, pos, text, initial, fault, letters in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now, None
                now = _Tally(conv_id)
            if pos < 0:
                now.text = text
            else:
                for row in now.take(turn, role, initial, fault, letters):
                    yield now, row
    if now is not None:
        yield now, None


def repaired(rows: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """conv_id, ordinal, role, text, edit: the rows of every repaired conversation, in order."""
    kind = rows.select("conv_id").schema
    out = pa.schema([pa.field("conv_id", _arrow(kind)), ("ordinal", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ordinal = [], 0, 0
        for tally, row in _walk(batches):
            if row is None:
                ordinal = 0
                continue
            letter, role, text = row
            held.append((tally.conv_id, ordinal, role, text, letter))
            ordinal += 1
            size += len(text)
            if size > 1 << 22 or len(held) >= 5000:
                yield _batch(held, out)
                held, size = [], 0
        if held:
            yield _batch(held, out)

    return _streamed(rows, edits(rows) if changes is None else changes).mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, ordinal long, role string, text string, edit string")


def _arrow(schema) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema.fields[0].dataType)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    out = pa.schema([pa.field("conv_id", _arrow(rows.select("conv_id").schema)), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, any_row = [], hashlib.sha256(), False
        for tally, row in _walk(batches):
            if row is not None:
                sha.update((("\n" if any_row else "") + f"{row[1]}:{row[2]}").encode())
                any_row = True
                continue
            gaps = 0 if tally.low is None else tally.high - tally.low + 1 - tally.turns
            held.append((tally.conv_id, gaps, *tally.faults.values(), tally.illegal, tally.cost, "".join(tally.audit), sha.hexdigest()))
            sha, any_row = hashlib.sha256(), False
            if len(held) >= 5000:
                yield _batch(held, out)
                held = []
        if held:
            yield _batch(held, out)

    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _streamed(rows, edits(rows) if changes is None else changes).mapInArrow(run, ddl)
