"""Conversation structure repair by a lazily determinised weighted automaton.

A repaired conversation's roles spell ``(s?(ua)+)?`` by their initials. The automaton's
four places are where such a word may stand; edits cost, and for every row the costs to
finish from each place form a vector. Vectors less their minimum are few: they become
states, and the step from a state by a row's kind is computed once and kept in a table.
One scan from the last row to the first by table look-ups gives the costs; the trace runs
back against the scan, from the first row on, and takes of the arcs that keep the cost
(tight arcs) the one whose letter is least. Given its letters, a path is determined, so
these are the least letters of all cheapest edits.

Rows are numbered over the whole table and cut into chunks of a fixed number of rows,
whatever conversation they belong to. Of a conversation that crosses chunks, each chunk
gives the cheapest ways from any place to any other; these matrices are folded over the
chunks, and so are the places in which the trace leaves them. So no task holds more
than a chunk, of kinds and not texts, however long a conversation is. The two values that the contract
wants of a whole conversation, its letters and the hash of its repaired text, are made of a
byte for each row and by streaming sorted rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast
from terrace.plans.indexing import row_index

CHUNK = 16_384
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Parts into which rows of a text that repeats in a conversation are dealt where repeated texts are too many to broadcast.
PARTS = 16

_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
# Places: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where each initial leads from each; -1: nowhere.
_PLACES = range(4)
_STEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
_NEXT = ("u", "u", "a", "u")  # the initial that an insert or a new role must have
_END = (0, _FAR, _FAR, 0)
# Kinds of rows: 0 must go, else 1 + 2 * class + truncated, where class is a place in this list, 3 for any other initial.
_CLASSES = "sua"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class Automaton:
    """The table of states and steps, filled as rows ask for them."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, str, int]] = {}

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """Number of a vector of costs, and the minimum taken off it."""
        low = min(vector)
        key = tuple(v - low if v < _FAR else _FAR for v in vector)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], low

    @staticmethod
    def inserted(vector: tuple[int, ...]) -> tuple[int, ...]:
        """Costs where inserts may come first; more than three never pay."""
        for _ in range(3):
            vector = tuple(min(v, INSERT + vector[_STEP[_NEXT[q]][q]]) for q, v in zip(_PLACES, vector))
        return vector

    @staticmethod
    def moves(kind: int, q: int) -> list[tuple[str, str, int, int]]:
        """Letter, initial, cost and place after, of the edits that take a row at ``q``, least letter first."""
        out = [("D", "", DELETE, q)]
        if kind:
            of, worse = divmod(kind - 1, 2)
            if of < 3 and _STEP[_CLASSES[of]][q] >= 0:
                out.append(("K", "-", worse * TRUNCATED, _STEP[_CLASSES[of]][q]))
            out.append(("R", _NEXT[q], REROLE + worse * TRUNCATED, _STEP[_NEXT[q]][q]))
        return out

    def step(self, after: int, kind: int) -> tuple[int, int]:
        """State before a row of ``kind`` that leads to state ``after``, and the cost that its minimum adds."""
        key = after, kind
        if key not in self.steps:
            ahead = self.vectors[after]
            self.steps[key] = self.state(self.inserted(tuple(min(cost + ahead[to] for _, _, cost, to in self.moves(kind, q)) for q in _PLACES)))
        return self.steps[key]

    def scan(self, kinds: list[int], end: tuple[int, ...]) -> tuple[list[int], int]:
        """States before each row and after the last, and what must be added to the first one's vector."""
        steps = self.steps
        now, total = self.state(end)
        states = [now]
        for kind in reversed(kinds):
            found = steps.get((now, kind)) or self.step(now, kind)
            now = found[0]
            total += found[1]
            states.append(now)
        states.reverse()
        return states, total

    def arc(self, after: int, kind: int, q: int) -> tuple[str, str, int]:
        """Letters and initials of the least tight edits at ``q`` up to and with the row, and the place after it."""
        key = after, kind, q
        if key not in self.arcs:
            before, low = self.step(after, kind)
            here, ahead = self.vectors[before], self.vectors[after]
            letters = initials = ""
            while True:
                tight = [m for m in self.moves(kind, q) if m[2] + ahead[m[3]] - low == here[q]]
                on = _STEP[_NEXT[q]][q]
                # D is before I, and I before K and R.
                if here[q] == INSERT + here[on] and not (tight and tight[0][0] == "D"):
                    letters, initials, q = letters + "I", initials + _NEXT[q], on
                    continue
                letter, initial, _, q = tight[0]
                self.arcs[key] = letters + letter, initials + initial, q
                break
        return self.arcs[key]

    def trace(self, states: list[int], kinds: list[int], q: int) -> tuple[list[tuple[str, str, int]], int]:
        """The arc of each row from place ``q`` on, and the last place."""
        arcs, out = self.arcs, []
        for after, kind in zip(states[1:], kinds):
            found = arcs.get((after, kind, q)) or self.arc(after, kind, q)
            out.append(found)
            q = found[2]
        return out, q

    def closing(self, q: int) -> str:
        """Initials of the inserts after the last row."""
        out = ""
        while _END[q]:
            out, q = out + _NEXT[q], _STEP[_NEXT[q]][q]
        return out


@cache
def _automaton() -> Automaton:
    return Automaton()


_LAST = Automaton.inserted(_END)


def _pieces(table: pa.Table) -> list[tuple[int, int]]:
    """First and last row (excluded) of each conversation in a chunk's sorted rows."""
    convs = table.column("conv").to_pylist()
    starts = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1]]
    return list(zip(starts, [*starts[1:], len(convs)]))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("k").combine_chunks()


def _matrices(table: pa.Table) -> pa.Table:
    """For a chunk's first and last conversation the least cost from every place to every other."""
    table, machine = _sorted(table), _automaton()
    spans = _pieces(table)
    out = []
    for start, stop in dict.fromkeys((spans[0], spans[-1])):
        part = table.slice(start, stop - start)
        kinds = part.column("kind").to_pylist()
        costs = []
        for to in _PLACES:
            states, low = machine.scan(kinds, tuple(0 if q == to else _FAR for q in _PLACES))
            costs.append([min(v + low, _FAR) for v in machine.vectors[states[0]]])
        out.append((part.column("chunk")[0].as_py(), part.column("conv")[0].as_py(), [costs[to][q] for q in _PLACES for to in _PLACES]))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), table.schema.field("conv").type, pa.list_(pa.int64())))], ["chunk", "conv", "m"])


def _ends(table: pa.Table) -> pa.Table:
    """Costs to finish after each piece of a conversation, folded from the last piece back."""
    table = table.sort_by("chunk")
    end, out = list(_LAST), []
    for m in reversed(table.column("m").to_pylist()):
        out.append(end)
        end = [min(min(m[4 * q + to] + end[to] for to in _PLACES), _FAR) for q in _PLACES]
    return pa.table([table.column("chunk"), table.column("conv"), pa.array(out[::-1], pa.list_(pa.int64())), pa.array([i == len(out) - 1 for i in range(len(out))])], ["chunk", "conv", "end", "last"])


def _exits(table: pa.Table, ends: pa.Table) -> pa.Table:
    """For the pieces named by ``ends`` the place where the trace leaves them, by the place where it comes in."""
    table, machine = _sorted(table), _automaton()
    known = {e["conv"]: e for e in ends.to_pylist()}
    out = []
    for start, stop in _pieces(table):
        conv = table.column("conv")[start].as_py()
        if conv in known:
            kinds = table.column("kind").slice(start, stop - start).to_pylist()
            states, _ = machine.scan(kinds, tuple(known[conv]["end"]))
            out.append(known[conv] | {"exits": [machine.trace(states, kinds, q)[1] for q in _PLACES]})
    conv_type = table.schema.field("conv").type
    return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("conv", conv_type), ("end", pa.list_(pa.int64())), ("last", pa.bool_()), ("exits", pa.list_(pa.int64()))]))


def _entries(table: pa.Table) -> pa.Table:
    """The place where the trace comes into each piece, folded from the first piece on."""
    table = table.sort_by("chunk")
    q, out = 0, []
    for exits in table.column("exits").to_pylist():
        out.append(q)
        q = exits[q]
    return table.select(["chunk", "conv", "end", "last"]).append_column("start", pa.array(out, pa.int64()))


def _edits(table: pa.Table, entries: pa.Table) -> pa.Table:
    """A row for each row of the chunk, with its letters and initials, and one for each piece, with all its letters."""
    table, machine = _sorted(table), _automaton()
    known = {e["conv"]: e for e in entries.to_pylist()}
    conv_type = table.schema.field("conv").type
    names = ["conv", "k", "letters", "initials", "chunk", "cost", "illegal", "first", "last"]
    types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    per_row: list[tuple] = []
    per_piece: list[tuple] = []
    all_kinds, all_classes, ks = (table.column(c).to_pylist() for c in ("kind", "class", "k"))
    for start, stop in _pieces(table):
        conv = table.column("conv")[start].as_py()
        piece = known.get(conv, {"end": _LAST, "start": 0, "last": True})
        kinds, classes = all_kinds[start:stop], all_classes[start:stop]
        states, _ = machine.scan(kinds, tuple(piece["end"]))
        arcs, q = machine.trace(states, kinds, piece["start"])
        closing = machine.closing(q) if piece["last"] else ""
        arcs[-1] = arcs[-1][0] + "I" * len(closing), arcs[-1][1] + closing, q
        letters = "".join(a[0] for a in arcs)
        cost = letters.count("I") * INSERT + letters.count("D") * DELETE + letters.count("R") * REROLE
        cost += sum(TRUNCATED for kind, a in zip(kinds, arcs) if kind and kind % 2 == 0 and "D" not in a[0])
        illegal = sum(pair not in _LEGAL for pair in zip(classes, classes[1:]))
        per_row += [(conv, k, a[0], a[1]) for k, a in zip(ks[start:stop], arcs)]
        per_piece.append((conv, letters, table.column("chunk")[0].as_py(), cost, illegal, classes[0], classes[-1]))
    rows = [*((*r, None, None, None, None, None) for r in per_row), *((p[0], None, p[1], None, *p[2:]) for p in per_piece)]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def faults(rows: DataFrame) -> DataFrame:
    """Numbered rows (``k, conv, role, text``) as ``k, conv, class, fault``: blank, duplicate, truncated or null, the first that holds.

    A text seen before is found by the least number of each repeated role and text, which
    are counted before they are dealt, and by a join in ``PARTS`` parts.
    """
    end = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    of = F.lit(3)
    for i, c in enumerate(_CLASSES):
        of = F.when(initial == c, i).otherwise(of)
    spelled = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = durable(
        rows.select("k", "conv", of.cast("int").alias("class"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), F.when(end != "", spelled).alias("said"))
    )
    repeated = marked.where("not blank").groupBy("conv", "said").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = durable(repeated.select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), "first", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")) & (F.col("k") % PARTS == F.col("_part"))
    joined = marked.join(maybe_broadcast(repeated, 120), same, "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("k") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return joined.select("k", "conv", "class", fault.alias("fault"))


def numbered(rows: DataFrame) -> DataFrame:
    """``k, conv, turn, role, text``: rows in the order of conversation, turn (nulls first), role and text; nulls of role and text are a space."""
    space = F.lit(" ")
    plain = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return row_index(plain, ["conv", "turn", "role", "text"])


class Repair:
    """A table of conversations judged and repaired; its rows, their faults and their edits are written once.

    Defined cases: rows are taken by conversation, turn (nulls first), role and text; rows
    with a null ``conv_id`` are one conversation; a null role or text is a space; a role that is
    empty or starts with none of s, u, a cannot be kept; repeated rows are duplicates; texts of any length are read whole;
    an empty table gives empty results. Other columns are not read.
    """

    def __init__(self, rows: DataFrame, chunk: int = CHUNK) -> None:
        self.rows = numbered(rows)
        self.marked = durable(faults(self.rows))
        kind = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * F.col("class") + F.when(F.col("fault") == "truncated", 1).otherwise(0))
        cells = durable(self.marked.select("k", "conv", "class", kind.alias("kind"), F.expr(f"k div {chunk}").alias("chunk")).repartition("chunk"))
        of = cells.schema["conv"].dataType.simpleString()
        by_chunk = cells.groupBy("chunk")
        ways = by_chunk.applyInArrow(_matrices, f"chunk long, conv {of}, m array<long>")
        ends = durable(ways.groupBy("conv").applyInArrow(_ends, f"chunk long, conv {of}, end array<long>, last boolean"))
        exits = by_chunk.cogroup(ends.groupBy("chunk")).applyInArrow(_exits, f"chunk long, conv {of}, end array<long>, last boolean, exits array<long>")
        starts = durable(exits.groupBy("conv").applyInArrow(_entries, f"chunk long, conv {of}, end array<long>, last boolean, start long"))
        names = f"conv {of}, k long, letters string, initials string, chunk long, cost long, illegal long, first long, last long"
        made = durable(by_chunk.cogroup(starts.groupBy("chunk")).applyInArrow(_edits, names))
        self.edits = made.where("k is not null").select("conv", "k", "letters", "initials")
        self.pieces = made.where("k is null").select("conv", "chunk", "letters", "cost", "illegal", "first", "last")

    def repaired(self) -> DataFrame:
        """``conv_id, k, at, role, text``: the rows that stay, with their new roles, and those inserted, in the order of ``k, at``."""
        every = self.rows.join(self.edits.drop("conv"), "k")
        # Initials has no place for a deleted row, so letters without D go with it.
        letters = F.split(F.translate("letters", "D", ""), "")
        stays = every.where("initials != ''").select("conv", "k", "role", "text", "initials", F.posexplode(letters).alias("at", "letter")).where("letter != ''")
        new = F.when(F.substring("initials", F.col("at") + 1, F.lit(1)) == "u", "user").otherwise("assistant")
        role = F.when(F.col("letter") == "K", F.col("role")).otherwise(new)
        text = F.when(F.col("letter") == "I", "").otherwise(F.col("text"))
        return stays.select(F.col("conv").alias("conv_id"), "k", "at", role.alias("role"), text.alias("text"))

    def report(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows."""
        turns = self.rows.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("n"))
        counts = self.marked.groupBy("conv").agg(*(F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")))
        before = F.lag("last").over(Window.partitionBy("conv").orderBy("chunk"))
        legal = F.coalesce(before * 10 + F.col("first"), F.lit(1)).isin(*(a * 10 + b for a, b in _LEGAL))
        # A conversation has one piece for each chunk of rows that it touches.
        joined = self.pieces.withColumn("illegal", F.col("illegal") + (~legal).cast("long"))
        letters = F.array_sort(F.collect_list(F.struct("chunk", "letters")))
        audits = joined.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(letters, lambda p: p["letters"]), "").alias("audit"))
        out = audits
        for i, other in enumerate((turns, counts)):
            out = out.join(other.withColumnRenamed("conv", f"_{i}"), F.col("conv").eqNullSafe(F.col(f"_{i}")))
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long")
        return out.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def texts_sha256(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the ``role:text`` lines of ``Repair.repaired``; rows are sorted and streamed, never held."""
    of = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "k", "at", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches):
        now, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
            kind = batch.schema.field(0).type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "k", "at").mapInArrow(run, f"conv_id {of}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by crc32 of ``conv_id:turn`` modulo 20 (nulls: a space).

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question
    marks, 3 repeats the row, 4 makes its role user.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(named) % 20
    dealt = rows.select("conv_id", "turn", fate.alias("fate"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(0), times))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired text for every ``conv_id`` of ``original``, of the ``rows`` left of it.

    Conversations without rows have zeros, an empty audit and the hash of the empty text.
    """
    made = Repair(rows)
    hashes = texts_sha256(made.repaired()).withColumnRenamed("conv_id", "_h")
    report = made.report().withColumnRenamed("conv_id", "_r")
    every = original.select("conv_id").distinct()
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("_r")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
