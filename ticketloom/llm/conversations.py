"""Repair of the turn structure of conversations by depth-first branch and bound.

Turns are sorted once over range partitions and numbered there; a block is a run of numbers. Each block is
searched in one piece of a task, conversation by conversation: an explicit stack of prefixes, lower bounds for the suffix,
an incumbent (cost, audit), and per node (turns read, last role) a table of the best prefix, which
eliminates every worse one. A conversation that goes on in another block is solved there for each role it may
start from, and the blocks are chained by the same dominance. Texts stay behind: decisions find them by number.
"""
from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import arrow_map, picked, stored

# What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Turns that are searched together; in a longer conversation, pieces of so many are chained by dominance.
WINDOW = 32
# Numbers of a block are equal but for so many bits.
BLOCK_BITS = 10
# Last role so far: none, system, user, assistant. The costs to go from any two of them differ by SPREAD at most:
# a missing role is inserted in front of what follows (twice behind a system turn), a further system turn is deleted.
NONE, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
STATES = (NONE, SYSTEM, USER, ASSISTANT)
SPREAD = 2 * INSERT
NAMES = {USER: "user", ASSISTANT: "assistant"}

Label = tuple[int, str]  # cost and audit of a prefix


def _follows(state: str) -> str:
    """The role that an inserted or renamed turn takes behind ``state``."""
    return ASSISTANT if state == USER else USER


def _moves(state: str, initial: str, forced: bool, cut: bool) -> list[tuple[int, str, str]]:
    """(cost, audit, state) of what can be done with the next turn, cheapest first."""
    moves = [(DELETE, "D", state)]
    if not forced:
        fee, other = TRUNCATED if cut else 0, _follows(state)
        if initial == other or (initial == SYSTEM and state == NONE):
            moves.append((fee, "K", initial))
        elif initial == _follows(other):
            moves.append((fee + INSERT, "IK", initial))
        moves += [(fee + REROLE, "R", other), (fee + INSERT + REROLE, "IR", _follows(other))]
    return sorted(moves)


def _bounds(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """For each suffix of ``rows`` (initial, forced, cut) a cost that no repair goes below.

    Every turn costs what its own fault asks for; every second one of two neighbours that cannot stand behind
    each other needs a further edit. Disjoint pairs of such neighbours add up.
    """
    legal = {"su", "ua", "au"}
    bound, at = [0] * (len(rows) + 1), [0] * (len(rows) + 1)
    last = None  # (index, own cost) of the next turn that may stay and is not in a pair yet
    extra = 0
    for i in range(len(rows) - 1, -1, -1):
        initial, forced, cut = rows[i]
        own = DELETE if forced else TRUNCATED if cut else 0
        if not forced and initial not in (SYSTEM, USER, ASSISTANT):
            own = min(own + REROLE, DELETE)
        at[i] = at[i + 1] + own
        if not forced:
            if last is not None and initial + rows[last[0]][0] not in legal and all(
                    x in (SYSTEM, USER, ASSISTANT) for x in (initial, rows[last[0]][0])):
                extra += min(INSERT, REROLE, DELETE - own, DELETE - last[1])
                last = None
            else:
                last = (i, own)
        bound[i] = at[i] + extra
    return bound


def search(rows: list[tuple[str, bool, bool]], starts: dict[str, Label], final: bool) -> dict[str, Label]:
    """The best (cost, audit) of each role at the end of ``rows``, from the labels in ``starts``.

    With ``final`` the conversation ends here: missing turns are added, and only the best of all is
    returned, under its last role. Prefixes wait on a stack, the cheapest step on top. A prefix is left when its
    node already has a better one, when it lies more than SPREAD above another role's prefix of the same
    length, or when its cost and the bound of the rest exceed what is already reached.
    """
    size, bound = len(rows), _bounds(rows)
    table: dict[tuple[int, str], Label] = {}
    lowest = [1 << 60] * (size + 1)
    stack = sorted(((cost, audit, state, 0) for state, (cost, audit) in starts.items()), reverse=True)
    incumbent: tuple[int, str, str] | None = None
    while stack:
        cost, audit, state, i = stack.pop()
        if cost > lowest[i] + SPREAD or ((i, state) in table and table[i, state] <= (cost, audit)):
            continue
        if final and incumbent is not None:
            least = cost + bound[i]
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][:len(audit)]):
                continue
        elif not final and cost + bound[i] > lowest[size] + SPREAD:
            continue
        table[i, state] = (cost, audit)
        lowest[i] = min(lowest[i], cost)
        if i < size:
            for fee, edits, then in reversed(_moves(state, *rows[i])):
                stack.append((cost + fee, audit + edits, then, i + 1))
        elif final:
            missing = {SYSTEM: 2, USER: 1}.get(state, 0)
            whole = (cost + INSERT * missing, audit + "I" * missing, state)
            incumbent = whole if incumbent is None else min(incumbent, whole)
    if final:
        return {incumbent[2]: incumbent[:2]}
    reached = {state: table[size, state] for state in STATES if (size, state) in table}
    return {state: label for state, label in reached.items() if label[0] <= lowest[size] + SPREAD}


def chained(rows: list[tuple[str, bool, bool]], start: str, final: bool) -> dict[str, Label]:
    """``search`` over windows of ``rows`` from one role on."""
    labels = {start: (0, "")}
    for at in range(0, max(len(rows), 1), WINDOW):
        labels = search(rows[at:at + WINDOW], labels, final and at + WINDOW >= len(rows))
    return labels


def _states(audit: str, entry: str, initials: str) -> str:
    """The role behind each edit, one letter each (a dot: none yet)."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit in "IR":
            state = _follows(state)
        elif edit == "K":
            state = initials[i]
        i += edit != "I"
        out.append(state or ".")
    return "".join(out)


def _steps(audit: str, entry: str, number: int, initials: str) -> list[dict]:
    """The turns that are left or added, from number ``number`` on: place, number (none: added), role (none: as it was)
    and edit. At most two are added in front of a turn, and places leave room for them."""
    out = []
    for edit, state in zip(audit, _states(audit, entry, initials)):
        if edit == "I":
            second = bool(out) and out[-1]["place"] == 3 * number
            out.append({"place": 3 * number + second, "number": None, "role": NAMES[state], "edit": edit})
            continue
        if edit != "D":
            out.append({"place": 3 * number + 2, "number": number, "role": NAMES[state] if edit == "R" else None, "edit": edit})
        number += 1
    return out


def _full(audit: str, copies: list[dict]) -> str:
    """The audit with the deletions of a turn's further copies behind it."""
    if not copies:
        return audit
    more, out, i = {c["at"]: c["more"] for c in copies}, [], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            out.append("D" * more.get(i, 0))
            i += 1
    return "".join(out)


FAULTS = ("blank", "duplicate", "truncated", "illegal")


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Fragment:
    """The turns of one conversation in one block."""

    def __init__(self, conv, block: int, number: int, opens: bool):
        self.conv, self.opens = conv, opens
        self.rows: list[tuple[str, bool, bool]] = []
        self.facts = {"block": block, "number": number, "first": None, "last": None, "different": 0, "copies": [], **dict.fromkeys(FAULTS, 0)}

    def add(self, turn: int | None, initial: str, fault: int, n: int) -> None:
        """A turn with its first fault (1 blank, 2 duplicate, 3 truncated, 0 none) and how often it is there."""
        facts = self.facts
        if turn is not None and turn != facts["last"]:
            facts["first"] = turn if facts["first"] is None else facts["first"]
            facts["last"], facts["different"] = turn, facts["different"] + 1
        facts["illegal"] += n - 1 + (bool(self.rows) and not _legal(self.rows[-1][0], initial))
        facts["blank"] += n if fault == 1 else 0
        facts["duplicate"] += 0 if fault == 1 else n - 1 + (fault == 2)
        facts["truncated"] += fault == 3
        if n > 1:
            facts["copies"].append({"at": len(self.rows), "more": n - 1})
        self.rows.append((initial, fault in (1, 2), fault == 3))

    def initials(self) -> str:
        return "".join(initial if initial in NAMES or initial == SYSTEM else "." for initial, _, _ in self.rows)

    def solved(self, closes: bool) -> dict:
        """Steps and report; or, when more of the conversation may stand in another block, labels to be chained."""
        facts, initials = self.facts, self.initials()
        fee = DELETE * sum(c["more"] for c in facts["copies"])
        if not self.opens and not closes:
            (cost, audit), = chained(self.rows, NONE, True).values()
            return {"steps": _steps(audit, NONE, facts["number"], initials),
                    "report": _report(facts, cost + fee, _full(audit, facts["copies"])), "open": None}
        labels = [{"entry": entry, "exit": state, "cost": cost + fee, "audit": audit}
                  for entry in (STATES if self.opens else (NONE,))
                  for state, (cost, audit) in chained(self.rows, entry, False).items()]
        ends = {"head": self.rows[0][0], "tail": self.rows[-1][0]}
        return {"steps": None, "report": None, "open": facts | ends | {"labels": labels, "initials": initials}}


def _report(facts: dict, cost: int, audit: str) -> dict:
    spread = 0 if facts["first"] is None else facts["last"] - facts["first"] + 1 - facts["different"]
    return {c: facts[c] for c in FAULTS} | {"gaps": spread, "cost": cost, "audit": audit}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_OPEN = ("block long, number long, first long, last long, different long, head string, tail string, initials string, blank long, "
         "duplicate long, truncated long, illegal long, copies array<struct<at: long, more: long>>, "
         "labels array<struct<entry: string, exit: string, cost: long, audit: string>>")
_STEPS = "array<struct<place: long, number: long, role: string, edit: string>>"


def _solver(arrow: pa.Schema):
    """Turns in order of their numbers -> a row per fragment."""
    def run(batches):
        current, block = None, None
        for batch in batches:
            out = []
            for conv, number, turn, initial, fault, n in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or number >> BLOCK_BITS != block or conv != current.conv:
                    if current is not None:
                        out.append({"conv_id": current.conv, **current.solved(number >> BLOCK_BITS != block)})
                    current = _Fragment(conv, number >> BLOCK_BITS, number, number >> BLOCK_BITS != block)
                    block = number >> BLOCK_BITS
                current.add(turn, initial, fault, n)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if current is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current.conv, **current.solved(True)}], arrow)
    return run


class _Chain:
    """Best prefixes of a conversation whose fragments arrive block by block."""

    def __init__(self, conv):
        self.conv, self.facts = conv, None
        # Per last role: cost, audit without ``settled``, and (what came before, fragment, entry, audit of the fragment).
        self.labels = {NONE: (0, "", None)}

    def add(self, part: dict) -> None:
        found: dict[str, tuple] = {}
        for label in part["labels"]:
            before = self.labels.get(label["entry"])
            if before is not None:
                new = (before[0] + label["cost"], before[1] + label["audit"], (before[2], part, label["entry"], label["audit"]))
                old = found.get(label["exit"])
                if old is None or new[:2] < old[:2]:
                    found[label["exit"]] = new
        lowest = min(cost for cost, *_ in found.values())
        found = {state: label for state, label in found.items() if label[0] <= lowest + SPREAD}
        agreed = len(os.path.commonprefix([audit for _, audit, _ in found.values()]))
        self.labels = {state: (cost, audit[agreed:], path) for state, (cost, audit, path) in found.items()}
        facts = self.facts
        if facts is None:
            self.facts = dict(part)
            return
        for name in FAULTS:
            facts[name] += part[name]
        facts["illegal"] += not _legal(facts["tail"], part["head"])
        facts["tail"] = part["tail"]
        if part["first"] is not None:
            facts["different"] += part["different"] - (facts["last"] == part["first"])
            facts["first"] = part["first"] if facts["first"] is None else facts["first"]
            facts["last"] = part["last"]

    def solved(self):
        """Rows (steps, report) of the conversation; the report comes with the last fragment."""
        ends = []
        for state, (cost, audit, path) in self.labels.items():
            missing = {SYSTEM: 2, USER: 1}.get(state, 0)
            ends.append((cost + INSERT * missing, audit + "I" * missing, missing, path))
        cost, _, missing, path = min(ends, key=lambda e: e[:2])
        parts = []
        while path is not None:
            path, part, entry, audit = path
            parts.append((part, entry, audit))
        parts.reverse()
        whole = "".join(_full(audit, part["copies"]) for part, _, audit in parts) + "I" * missing
        for k, (part, entry, audit) in enumerate(parts):
            last = k == len(parts) - 1
            yield {"conv_id": self.conv, "report": _report(self.facts, cost, whole) if last else None, "open": None,
                   "steps": _steps(audit + "I" * missing * last, entry, part["number"], part["initials"])}


def _chainer(arrow: pa.Schema):
    """Open fragments, by conversation and block -> a row per fragment with its steps."""
    def run(batches):
        current = None
        for batch in batches:
            for conv, part in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or conv != current.conv:
                    if current is not None:
                        yield pa.RecordBatch.from_pylist(list(current.solved()), arrow)
                    current = _Chain(conv)
                current.add(part)
        if current is not None:
            yield pa.RecordBatch.from_pylist(list(current.solved()), arrow)
    return run


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, number): different turns with their counts; numbers go up along a conversation.

    Equal turns are summed up before the shuffle. Range partitions cut long conversations; the first
    characters of a text are enough to cut by, and keep what the driver samples small.
    """
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    placed = counted.repartitionByRange(*keys, F.substring("text", 1, 100).asc()).sortWithinPartitions(*keys, F.col("text").asc())
    return stored(placed.withColumn("number", F.monotonically_increasing_id()), "turns")


def _faults(turns: DataFrame) -> DataFrame:
    """(conv_id, number, turn, initial, fault, n): 1 blank, 2 said before, 3 truncated, 0 none."""
    rows = turns.withColumns({"said": F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), "digest": F.sha2("text", 256)})
    first = rows.where("said <> ''").groupBy("conv_id", "role", "digest").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("times"))
    again = stored(first.where("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "again")
    told = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("said") == "", 1).when(F.col("first") < F.col("number"), 2).when(
        ~F.substring("said", -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return told.select("conv_id", "number", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"),
                       fault.alias("fault"), "n")


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation: a report per conversation, and the repaired turns.

    Report: conv_id; gaps (turn numbers missing between the first and the last), blank, duplicate and truncated turns (the
    first fault of each counts), illegal (neighbours that may not stand behind each other), cost and audit of
    the repair. Turns: conv_id, place (rising inside a conversation), role, text, edit (K, R or I).

    A turn is kept (K), renamed (R, 3), deleted (D, 4; a must for blank and repeated ones), and empty ones are
    inserted (I, 3) for the user or the assistant; a truncated turn that stays costs 3 more. The roles left are
    an optional system turn and then user and assistant in turns, or nothing. Of equally cheap repairs the one with the
    audit least by ASCII is taken.

    Turns are ordered by turn (NULL first), then role and text; NULL roles and texts count as empty, and a role
    without a first letter s, u or a cannot be kept. Equal rows are copies of one turn, all but the first
    repeated. A NULL conv_id is a conversation of its own; an empty table gives no rows. Other columns
    are not read. A conversation of any length is searched block by block in many tasks; only its labels, some
    bytes a turn, meet in one.
    """
    own = picked(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    own = own.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = _in_order(own)
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, steps {_STEPS}, report struct<{_REPORT}>, open struct<{_OPEN}>")
    arrow = to_arrow_schema(schema)
    facts = _faults(turns).repartition(F.shiftright("number", BLOCK_BITS)).sortWithinPartitions("number")
    solved = stored(arrow_map(facts, _solver(arrow), schema), "solved")
    parts = solved.where("open is not null").select("conv_id", "open").repartition("conv_id").sortWithinPartitions("conv_id", "open.block")
    done = stored(solved.where("open is null").unionByName(arrow_map(parts, _chainer(arrow), schema)).drop("open"), "repairs")
    report = done.where("report is not null").select("conv_id", "report.*")
    steps = done.select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.place", F.col("s.number").alias("at"), F.col("s.role").alias("new"), "s.edit")
    texts = turns.select("number", "role", "text")
    told = steps.join(texts, F.col("at") == F.col("number"), "left")
    return report, told.select("conv_id", "place", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, digest): SHA-256 of the ``role:text`` lines of repaired turns, read in order as a stream."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, digest string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for conv, line in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != current:
                    if state is not None:
                        out.append({"conv_id": current, "digest": state.hexdigest()})
                    current, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_pylist(out, arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "digest": state.hexdigest()}], arrow)

    lines = turns.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
    return arrow_map(lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line"), run, schema)
