"""Conversation structure repair: the cheapest edits to (system)? (user assistant)+ by survivor-coalescence Viterbi.

Rows of a conversation are read in order of turn (nulls first, then role and text). Four states
say what was emitted last: nothing, the system row, a user row, an assistant row. Each state keeps
its cheapest path as a leaf of a tree of backpointers. A node counts the nodes that refer to it;
leaves that no state takes over, or that another state undercuts whatever follows, are dropped
together with ancestors whose count falls to zero.
While the root has a single successor, all survivors share it: its edits are final, are handed out
and forgotten. So memory holds the unresolved suffixes alone, whatever the conversation's length.

Equal costs go to the path whose edit initials are least in ASCII order. Of one row the steps
``D``, ``IK``, ``IR``, ``K`` and ``R`` are no prefixes of each other, so whole suffixes are compared
from the first row on which they differ; the order of the survivors' suffixes is carried from row
to row as ranks. An insertion directly before a deletion is never least and not tried. Rows that must go prolong all survivors alike and are only counted in their leaves.

Spark deals rows out by conversation once, finds repeated rows by a window and sorts; Python reads
the sorted rows as a stream and never holds a conversation. A conversation's audit and digest are
one row made in order, so one task reads it, however long it is.

Cases: null conv_id, role and text are read as one blank in hashes, roles and texts; rows of null
conv_id are one conversation, returned with null. Null turns come first. Empty texts are blank
rows. Repeated rows are duplicates but for the first. A role's initial is its first character; an
empty role has none and cannot be kept. A conversation without rows has zeros, an empty audit and
the digest of an empty text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwork.llm.linking import release_memory

WHITE = " \t\n\x0b\f\r"
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs; keeping costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)  # what was emitted last
NAMES = {USER: "user", ASSISTANT: "assistant"}
# What it costs at most to go on from the first state as from the second: one insertion turns a user
# row's state into an assistant row's and back; a system row that only the start could keep is deleted.
SWITCH = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 0,
    (SYSTEM, START): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
}
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """Known damage by crc32 of ``conv_id:turn``: (conv_id, turn, role, text, dropped), dropped rows without texts."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    named = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    dropped = F.col("kind") == 0
    broken = F.when(dropped, F.lit(None)).when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    roles = F.when(dropped, F.lit(None)).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    made = named.select("conv_id", "turn", roles.alias("role"), broken.alias("text"), dropped.alias("dropped"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return made.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``, the first of blank, duplicate and truncated or null; rows of one conversation lie together in order.

    ``rows`` has conv_id, turn, role, text and, where wanted, ``dropped`` (rows that only name their conversation).
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    gone = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *blank, gone.alias("dropped")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))

    def first(end: Column) -> Column:
        truncated = ~F.substring(end, -1, 1).isin(".", "!", "?")
        return F.when(end == "", "blank").when(F.col("copy") > 1, "duplicate").when(truncated, "truncated")

    found = dealt.withColumn("copy", F.row_number().over(same)).withColumn("fault", F.when(~F.col("dropped"), first(stripped)))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return found.select("conv_id", "turn", "role", "text", "fault", "dropped").sortWithinPartitions(*order)


class Node:
    """One row's edits on a path: a step, and ``run`` deletions of rows that had to go behind it."""

    __slots__ = ("parent", "heirs", "refs", "step", "state", "row", "run")

    def __init__(self, parent: Node | None, step: str, state: int, row: tuple[str, str] | None):
        self.parent, self.step, self.state, self.row = parent, step, state, row
        self.heirs: set[Node] = set()
        self.refs = 0  # nodes that name this one as their parent, and the state that it survives in
        self.run = 0
        if parent is not None:
            parent.heirs.add(self)
            parent.refs += 1


class Repair:
    """Survivors of one conversation; final edits go to ``sink(step, state, row)`` in order.

    ``step`` is K, R, D, IK or IR, or I at the end; ``state`` is the last role emitted, ``row`` the
    (role, text) that the step read, none for an insertion at the end and for rows that had to go.
    """

    def __init__(self, sink: Callable[[str, int, tuple[str, str] | None], None]):
        self.sink = sink
        self.root = Node(None, "", START, None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}  # state -> cost, rank of the path, leaf

    def forced(self) -> None:
        """A row that must be deleted."""
        if self.alive.keys() == {self.root.state} and self.alive[self.root.state][2] is self.root:  # nothing open
            cost, rank, leaf = self.alive[self.root.state]
            self.alive = {self.root.state: (cost + DELETE, rank, leaf)}
            self.sink("D", self.root.state, None)
            return
        self.alive = {s: (cost + DELETE, rank, leaf) for s, (cost, rank, leaf) in self.alive.items()}
        for _, _, leaf in self.alive.values():
            leaf.run += 1

    def row(self, role: str, text: str, truncated: bool) -> None:
        """A row that may stay."""
        initial, late = role[:1], TRUNCATED if truncated else 0
        user = ("K", late) if initial == "u" else ("R", late + RE_ROLE)
        assistant = ("K", late) if initial == "a" else ("R", late + RE_ROLE)
        best: dict[int, tuple[int, int, str, Node]] = {}
        for state, (cost, rank, leaf) in self.alive.items():
            ways = [(state, DELETE, "D")]
            if state == START and initial == "s":
                ways.append((SYSTEM, late, "K"))
            if state == USER:
                ways.append((ASSISTANT, assistant[1], assistant[0]))
                ways.append((USER, INSERT + user[1], f"I{user[0]}"))
            else:
                ways.append((USER, user[1], user[0]))
                ways.append((ASSISTANT, INSERT + assistant[1], f"I{assistant[0]}"))
            for to, more, step in ways:
                way = (cost + more, rank, step)
                if to not in best or way < best[to][:3]:
                    best[to] = (*way, leaf)
        for state in [s for s, way in best.items() if any(way[0] > best[t][0] + SWITCH[t, s] for t in best if t != s)]:
            del best[state]  # another one can do whatever this one does for less
        order = {way: k for k, way in enumerate(sorted(way[1:3] for way in best.values()))}
        before, made = self.alive, (role, text)
        self.alive = {to: (cost, order[rank, step], Node(leaf, step, to, made)) for to, (cost, rank, step, leaf) in best.items()}
        for _, _, leaf in self.alive.values():
            leaf.refs += 1
        for _, _, leaf in before.values():
            self._release(leaf)
        self._hand_out()

    def _release(self, node: Node) -> None:
        """One reference less; without any, the node and its lonely ancestors go."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            above = node.parent
            above.heirs.discard(node)
            above.refs -= 1
            node.parent, node = None, above

    def _hand_out(self) -> None:
        """Edits that all survivors share."""
        while self.root.refs == 1 and self.root.heirs:
            (heir,) = self.root.heirs
            heir.parent, self.root = None, heir
            self._tell(heir)

    def _tell(self, node: Node) -> None:
        self.sink(node.step, node.state, node.row)
        for _ in range(node.run):
            self.sink("D", node.state, None)
        node.run = 0

    def close(self) -> int:
        """Hand the cheapest path out; its cost."""
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        # Behind equal paths up to here nothing follows or insertions do: never both at one cost.
        cost, _, state, leaf = min((cost + INSERT * len(ends[s]), rank, s, leaf) for s, (cost, rank, leaf) in self.alive.items())
        path, node = [], leaf
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._tell(node)
        for _ in ends[state]:
            state = USER if state == SYSTEM else ASSISTANT
            self.sink("I", state, None)
        self.alive, self.root = {}, leaf
        return cost


def emitted(step: str, state: int, row: tuple[str, str] | None) -> list[tuple[str, str, str]]:
    """(initial, role, text) of the edits of one step; a deleted row has no role."""
    if step == "D":
        return [("D", "", "")]
    out = []
    if step[0] == "I":
        inserted = state if len(step) == 1 else USER if state == ASSISTANT else ASSISTANT
        out.append(("I", NAMES[inserted], ""))
    if step[-1] == "K":
        out.append(("K", *row))
    elif step[-1] == "R":
        out.append(("R", NAMES[state], row[1]))
    return out


class Summary:
    """The row of one conversation; texts are digested as they are handed out."""

    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first, self.last, self.initial = 0, 0, None, None, None
        self.audit, self.hash, self.empty = bytearray(), hashlib.sha256(), True
        self.repair = Repair(self._sink)

    def _sink(self, step: str, state: int, row: tuple[str, str] | None) -> None:
        for initial, role, text in emitted(step, state, row):
            self.audit += initial.encode()
            if initial != "D":
                self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
                self.empty = False

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if fault in ("blank", "duplicate"):
            self.repair.forced()
        else:
            self.repair.row(role, text, fault == "truncated")

    def close(self) -> tuple:
        cost = self.repair.close()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.counts.values(), self.illegal, cost, self.audit.decode(), self.hash.hexdigest()


class Edits:
    """The edits of one conversation as rows (place, edit, role, text), as soon as they are final."""

    def __init__(self):
        self.place, self.ready = 0, []
        self.repair = Repair(self._sink)

    def _sink(self, step: str, state: int, row: tuple[str, str] | None) -> None:
        for initial, role, text in emitted(step, state, row):
            self.ready.append((self.place, initial, role or None, text if role else None))
            self.place += 1

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault in ("blank", "duplicate"):
            self.repair.forced()
        else:
            self.repair.row(role, text, fault == "truncated")

    def taken(self) -> list[tuple]:
        ready, self.ready = self.ready, []
        return ready

    def close(self) -> None:
        self.repair.close()


def _stream(found: DataFrame, kind: type, results: str) -> DataFrame:
    """Run ``kind`` over the conversations of ``faults()``; rows leave as soon as they are known."""
    schema = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), *T._parse_datatype_string(results).fields])
    whole = kind is Summary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, current, arrow = None, None, None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=schema.names)

        for batch in batches:
            if arrow is None:
                from pyspark.sql.pandas.types import to_arrow_type

                arrow = [batch.schema.types[0], *[to_arrow_type(f.dataType) for f in schema.fields[1:]]]
            out: list[tuple] = []
            for conv, turn, role, text, fault, dropped in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or conv != open_id:
                    if current is not None:
                        last = current.close()
                        out += [(open_id, *last)] if whole else [(open_id, *r) for r in current.taken()]
                    open_id, current = conv, kind()
                if not dropped:
                    current.add(turn, role, text, fault)
            if not whole and current is not None:
                out += [(open_id, *r) for r in current.taken()]
            yield table(out)
        if current is not None:
            last = current.close()
            yield table([(open_id, *last)] if whole else [(open_id, *r) for r in current.taken()])
        release_memory()

    return found.mapInArrow(run, schema)


def summaries(found: DataFrame) -> DataFrame:
    """One row a conversation: gaps of turns, faults, illegal neighbours, cost, edit initials and the repaired text's digest."""
    return _stream(found, Summary, SUMMARY)


def repaired(found: DataFrame) -> DataFrame:
    """The edits of every conversation in order: (conv_id, place, edit, role, text); deletions have neither role nor text."""
    return _stream(found, Edits, "place long, edit string, role string, text string")
