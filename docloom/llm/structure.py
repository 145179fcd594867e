"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation's role initials are ``(s?(ua)+)?``: maybe a system turn, then
user and assistant by turns, or nothing at all. Edits of a turn: Keep costs 0,
Rerole (to user or assistant) 3, Delete 4, and 3 more if a truncated turn stays; an
empty turn of user or assistant may be Inserted anywhere for 3. Blank turns and repeats
of an earlier turn (role and text) must go. Of all cheapest edits, those whose initials,
in order, are least in ASCII are the audit.

Method: turns, in order, are cut into blocks of a bounded length. A block is aligned
(Wagner and Fischer, 1974) to each feasible length of the alternating string that can
stand there, in a band of diagonals around the main one (Ukkonen, 1985) that any
alignment as cheap as the incumbent must keep to; the first length's bound is doubled until it
holds. An alignment is traced back to the least audit, and equally cheap lengths are
compared by their audits. That gives a block's cheapest edits for each state before
it and after it (nothing yet, a system turn, user due, assistant due), 4 by 4.

Nearly all conversations are one block, and done there. The blocks of others are put together by
two scans over these small tables: costs from the end (smallest sums), then states
from the start, both within a partition's stretch of a conversation first and
over its stretches afterwards, of which there are at most as many as partitions. So no
task needs a whole conversation; only its digest reads it in one stream.

Rows: turns stand in order of turn (nulls first), then of a hash of role and text; null
roles and texts are one space; a null conv_id is one conversation. Rows that repeat are repeated
turns. Roles count by their first character; an empty role has none. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, pieces, small_or_none

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A block ends with so many turns, or so many characters of text.
BLOCK, BLOCK_CHARS = 64, 1 << 20
#: So many repeated texts are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
SPACE = " \t\n\x0b\x0c\r"
_INF = 1 << 60

# States between turns: nothing yet, after a system turn, user due (and all well), assistant due.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What must be inserted at the end, by state.
CLOSING = ["", "II", "", "I"]
_STATES = range(4)


def _off(x: int) -> int:
    """The least cost of standing x symbols ahead of the turns, or behind them."""
    return INSERT * x if x >= 0 else -DELETE * x


def _align(turns: str, target: str, limit: int) -> tuple[int, str] | None:
    """The least cost and audit of aligning turns to a target, no insertion after the last turn; None if it costs more than the limit.

    A turn is its initial (s, u, a, or x for others), in upper case if truncated, or d if it must go.
    """
    must, n = turns.count("d"), len(turns)
    delta = len(target) - (n - must)
    slack = limit - DELETE * must - _off(delta)
    if slack < 0:
        return None
    slack //= INSERT + DELETE
    low, high = min(0, delta) - slack, max(0, delta) + slack
    width, size = high - low + 1, len(target)
    # rows[i][j - kept before i - low]: the cost of turns from i on with symbols from j on
    row = [_INF] * (width + 1)
    row[delta - low] = 0
    rows, kept = [row], n - must
    for turn in reversed(turns):
        below, row = row, [_INF] * (width + 1)
        if turn == "d":
            for b in range(width - 1, -1, -1):
                row[b] = min(DELETE + below[b], INSERT + row[b + 1]) if 0 <= kept + low + b <= size else _INF
        else:
            kept -= 1
            initial, extra = turn.lower(), TRUNCATED if turn.isupper() else 0
            first, last = max(0, -kept - low), min(width - 1, size - kept - low)
            for b in range(last, first - 1, -1):
                cost = INSERT + row[b + 1]
                if b and DELETE + below[b - 1] < cost:
                    cost = DELETE + below[b - 1]
                j = kept + low + b
                if j < size:
                    stay = below[b] + extra
                    if target[j] != initial:
                        stay = stay + REROLE if target[j] != "s" else _INF
                    if stay < cost:
                        cost = stay
                row[b] = cost
        rows.append(row)
    rows.reverse()
    best = rows[0][-low]
    if best > limit:
        return None
    audit, i, kept, b = [], 0, 0, -low
    while i < n:
        cost, turn = rows[i][b], turns[i]
        step = 0 if turn == "d" else 1
        if b >= step and cost == DELETE + rows[i + 1][b - step]:
            audit.append("D")
            i, b, kept = i + 1, b - step, kept + step
        elif cost == INSERT + rows[i][b + 1]:
            audit.append("I")
            b += 1
        else:
            audit.append("K" if target[kept + low + b] == turn.lower() else "R")
            i, kept = i + 1, kept + 1
    return best, "".join(audit)


def _lengths(parity: int, near: int) -> Iterator[int]:
    """The positive lengths of a parity, nearest first."""
    step = 0
    while True:
        for x in dict.fromkeys((near - step, near + step)):
            if x > 0 and x % 2 == parity:
                yield x
        step += 1


def _best(turns: str, head: str, first: str, parity: int) -> tuple[int, str]:
    """The cheapest alignment, least in its audit, to a head and an alternating string of a parity that begins with first."""
    must = turns.count("d")
    near = len(turns) - must - len(head)
    other = "a" if first == "u" else "u"
    least = lambda size: DELETE * must + _off(size - near)
    best = None
    for size in _lengths(parity, near):
        if best and DELETE * must + INSERT * abs(size - near) > best[0]:  # and so all further ones
            break
        target = head + (first + other) * (size // 2) + (first if size % 2 else "")
        if best is None:
            limit = least(size) + 8
            while (best := _align(turns, target, limit)) is None:
                limit = min(2 * limit, _INF // 4)
            continue
        if least(size) <= best[0] and (found := _align(turns, target, best[0])):
            best = min(best, found)
    return best


def _whole(turns: str, target: str) -> tuple[int, str]:
    limit = DELETE * len(turns) + 8
    return _align(turns, target, limit) or (_INF, "")


def _table(turns: str, entries: tuple[int, ...]) -> list[list[tuple[int, str] | None]]:
    """By state before and state after, the cheapest edits of a block of turns."""
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in _STATES]
    gone = _whole(turns, "")
    user = [_best(turns, "", "u", p) for p in (0, 1)]
    for e in entries:
        row = out[e]
        if e == ASSISTANT:
            row[ASSISTANT] = min(gone, _best(turns, "", "a", 0))
            row[USER] = _best(turns, "", "a", 1)
            continue
        row[USER], row[ASSISTANT] = user
        row[e] = min(row[e], gone) if row[e] else gone
        if e == EMPTY and {"s", "S"} & set(turns):
            alone = _whole(turns, "s")
            row[SYSTEM] = alone if alone[0] < _INF else None
            if alone[0] < _INF:
                row[USER] = min(row[USER], _best(turns, "s", "u", 0))
                row[ASSISTANT] = min(row[ASSISTANT], _best(turns, "s", "u", 1))
    return out


def _ended(row: list[tuple[int, str] | None]) -> tuple[int, str, int]:
    """Cost, audit and last state of the cheapest edits of a conversation in one block."""
    cost, audit, state = min((x[0] + INSERT * len(CLOSING[s]), x[1], s) for s, x in enumerate(row) if x)
    return cost, audit + CLOSING[state], state


_short_table = lru_cache(100_000)(_table)
_short_end = lru_cache(100_000)(lambda turns: _ended(_table(turns, (EMPTY,))[EMPTY]))


def repaired(audit: str, turns: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The turns after the audit's edits, from a state on; turns: (role, text) of all, or any value for deleted ones."""
    out, k = [], 0
    for edit in audit:
        due = "assistant" if state == ASSISTANT else "user"
        if edit == "I":
            out.append((due, ""))
        else:
            k += 1
            if edit == "D":
                continue
            role, text = turns[k - 1]
            out.append((role if edit == "K" else due, text))
            if edit == "K" and role[:1] == "s":
                state = SYSTEM
                continue
        state = USER if state == ASSISTANT else ASSISTANT
    return out


def damage(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults, by crc32 of ``conv_id:turn`` modulo 20; copies: how often a row stands there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


_FAULTS = ["blank", "duplicate", "truncated"]
_STATS = "blank long, duplicate long, truncated long, illegal long, distinct_turns long, low_turn long, high_turn long, first_turn long, last_turn long, first_role string, last_role string"
_BLOCK = f"conv_id long, part int, seq long, whole boolean, {_STATS}, audit string, cost long, roles array<string>, texts array<string>, state int, costs array<long>, audits array<string>"
_BLOCK_TYPES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in (*_FAULTS, "illegal", "distinct_turns", "low_turn", "high_turn", "first_turn", "last_turn")],
    ("first_role", pa.string()), ("last_role", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("state", pa.int32()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])
_LEGAL = {"su", "ua", "au"}


class _Block:
    """Turns of one conversation that stand together."""

    def __init__(self, conv_id: int | None, first: bool):
        self.conv_id, self.first = conv_id, first
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0
        self.out = dict.fromkeys([*_FAULTS, "illegal", "distinct_turns"], 0) | dict.fromkeys(["low_turn", "high_turn", "first_turn", "last_turn", "first_role", "last_role"])

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        out, initial = self.out, role[:1]
        if fault:
            out[fault] += 1
        if not self.turns:
            out["first_role"], out["first_turn"] = initial, turn
        elif out["last_role"] + initial not in _LEGAL:
            out["illegal"] += 1
        if turn is not None:
            out["distinct_turns"] += out["last_turn"] != turn or out["low_turn"] is None
            out["low_turn"] = turn if out["low_turn"] is None else out["low_turn"]
            out["high_turn"] = turn  # they come in order
        out["last_role"], out["last_turn"] = initial, turn
        gone = fault in ("blank", "duplicate")
        known = initial if initial in ("s", "u", "a") else "x"
        self.turns.append("d" if gone else known.upper() if fault else known)
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.chars += len(self.texts[-1])

    def row(self, part: int, seq: int, whole: bool) -> dict:
        turns, out = "".join(self.turns), self.out | {"conv_id": self.conv_id, "part": part, "seq": seq, "whole": whole, "state": EMPTY}
        if whole:
            cost, audit, _ = _short_end(turns) if len(turns) <= 16 else _ended(_table(turns, (EMPTY,))[EMPTY])
            fixed = repaired(audit, list(zip(self.roles, self.texts, strict=True)), EMPTY)
            return out | {"cost": cost, "audit": audit, "roles": [r for r, _ in fixed], "texts": [t for _, t in fixed]}
        cells = [x for row in (_short_table if len(turns) <= 16 else _table)(turns, tuple(_STATES)) for x in row]
        return out | {"roles": self.roles, "texts": self.texts, "costs": [x[0] if x else _INF for x in cells], "audits": [x[1] if x else "" for x in cells]}


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows that stand in order; a conversation that is one block within a partition is whole and repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, block, held = TaskContext.get().partitionId(), 0, None, []
        first_run, key = True, None

        def close(whole: bool) -> None:
            nonlocal seq, block
            held.append(block.row(part, seq, whole))
            seq, block = seq + 1, None

        for batch in pieces(batches):
            for r in batch.to_pylist():
                if block and r["_c"] != key:
                    close(block.first and not first_run)  # what begins or ends with the partition may go on elsewhere
                    first_run = False
                begins, key = r["_c"] != key, r["_c"]
                for copy in range(r["n"]):
                    if block and (len(block.turns) >= BLOCK or block.chars >= BLOCK_CHARS):
                        close(False)
                        begins = False
                    block = block or _Block(r["conv_id"], begins)
                    fault = "blank" if r["blank"] else "duplicate" if copy or r["again"] else "truncated" if r["cut"] else None
                    block.add(r["turn"], r["role"], r["text"], fault)
                    if len(held) >= 256:
                        yield pa.RecordBatch.from_pylist(held, _BLOCK_TYPES)
                        held.clear()
        if block:
            close(False)
        if held:
            yield pa.RecordBatch.from_pylist(held, _BLOCK_TYPES)

    return rows.mapInArrow(run, _BLOCK)


def _later(costs: list[list[int]], end: list[int]) -> list[list[int]]:
    """For each 4 by 4 table in a row, the least costs after it by state, given those after the last."""
    out = [end]
    for m in reversed(costs[1:]):
        out.append([min(m[4 * e + x] + out[-1][x] for x in _STATES) for e in _STATES])
    return out[::-1]


def _product(costs: list[list[int]]) -> list[int]:
    """The least costs of several tables in a row, by state before and after."""
    whole = list(costs[0])
    for m in costs[1:]:
        whole = [min(min(whole[4 * e + y] + m[4 * y + x] for y in _STATES), _INF) for e in _STATES for x in _STATES]
    return [int(x) for x in whole]


def _choices(costs: list[int], audits: list[str], later: list[int]) -> list[int]:
    """For each state before a block, the state after it on the best way: least cost, then least audit."""
    return [min((costs[4 * e + x] + later[x], audits[4 * e + x], x) for x in _STATES if costs[4 * e + x] < _INF)[2] if min(costs[4 * e : 4 * e + 4]) < _INF else 0 for e in _STATES]


def _each(df: DataFrame, function: Callable[[dict], Iterator[dict]], schema: dict[str, pa.DataType]) -> DataFrame:
    """The rows that a function makes of each row."""
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    types = pa.schema(list(schema.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [x for r in batch.to_pylist() for x in function(r)]
            if out:
                yield pa.RecordBatch.from_pylist(out, types)

    return df.mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in schema.items()))


def _joined(parts: DataFrame) -> DataFrame:
    """(part, seq, entry, audit, cost) of the blocks (conv_id, part, seq, costs, audits) of conversations that aren't whole.

    A stretch is what one partition has of a conversation; a conversation has at most as many as there are partitions.
    """
    end = [INSERT * len(x) for x in CLOSING]
    cells = parts.select(F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("n")).alias("_c"), "part", "seq", "costs", "audits")
    stretches = materialize(cells.groupBy("_c", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "costs", "audits"))).alias("b")), "stretches")
    listed = lambda df, *columns: df.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias("s"))
    key = {"_c": pa.string(), "part": pa.int32()}

    def product(r: dict) -> Iterator[dict]:
        yield {"_c": r["_c"], "part": r["part"], "costs": _product([x["costs"] for x in r["b"]])}

    def later(r: dict) -> Iterator[dict]:
        for x, value in zip(r["s"], _later([x["costs"] for x in r["s"]], end), strict=True):
            yield {"_c": r["_c"], "part": x["part"], "later": value}

    def walk(r: dict, entries: list[int]) -> Iterator[tuple[int, list[dict]]]:
        """For each state before a stretch: the state after it and its blocks' choices."""
        values = _later([x["costs"] for x in r["b"]], r["later"])
        choices = [_choices(x["costs"], x["audits"], v) for x, v in zip(r["b"], values, strict=True)]
        for e in entries:
            state, rows = e, []
            for x, choice in zip(r["b"], choices, strict=True):
                to = choice[state]
                rows.append({"part": r["part"], "seq": x["seq"], "entry": state, "audit": x["audits"][4 * state + to], "cost": x["costs"][4 * state + to]})
                state = to
            yield state, rows

    def exits(r: dict) -> Iterator[dict]:
        yield {"_c": r["_c"], "part": r["part"], "exits": [state for state, _ in walk(r, list(_STATES))]}

    def entries(r: dict) -> Iterator[dict]:
        state = EMPTY
        for k, x in enumerate(r["s"]):
            yield {"_c": r["_c"], "part": x["part"], "begin": state, "last": k + 1 == len(r["s"])}
            state = x["exits"][state]

    def edits(r: dict) -> Iterator[dict]:
        state, rows = next(walk(r, [r["begin"]]))
        if r["last"]:
            rows[-1]["audit"] += CLOSING[state]
            rows[-1]["cost"] += end[state]
        yield from rows

    after = materialize(_each(listed(_each(stretches, product, key | {"costs": pa.list_(pa.int64())}), "costs"), later, key | {"later": pa.list_(pa.int64())}), "after")
    known = stretches.join(small_or_none(after, BROADCAST), ["_c", "part"])
    begins = materialize(_each(listed(_each(known, exits, key | {"exits": pa.list_(pa.int32())}), "exits"), entries, key | {"begin": pa.int32(), "last": pa.bool_()}), "begins")
    types = {"part": pa.int32(), "seq": pa.int64(), "entry": pa.int32(), "audit": pa.string(), "cost": pa.int64()}
    return _each(known.join(small_or_none(begins, BROADCAST), ["_c", "part"]), edits, types)


def _edited(blocks: DataFrame) -> DataFrame:
    """Apply each block's audit to its turns, from its state on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = batch.to_pylist()
            for r in rows:
                fixed = repaired(r["audit"], list(zip(r["roles"], r["texts"], strict=True)), r["state"])
                r["roles"], r["texts"] = [x for x, _ in fixed], [x for _, x in fixed]
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return blocks.mapInArrow(run, blocks.schema)


def _first_fault(text: str) -> tuple[Column, Column]:
    rest = F.rtrim(F.col(text), F.lit(SPACE))
    return rest == "", ~F.right(rest, F.lit(1)).isin(".", "!", "?")


def repair(turns: DataFrame) -> DataFrame:
    """Repaired blocks of turns (conv_id, turn, role, text, and copies if there is such a column).

    A block has conv_id, its place (part, seq), ``whole`` if it is all of its
    conversation, what was found before the repair (blank, duplicate, truncated,
    illegal neighbours, turns), audit, cost, and roles and texts of the repaired turns.
    """
    copies = F.sum("copies") if "copies" in turns.columns else F.count("*")
    clean = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *clean, *(["copies"] if "copies" in turns.columns else []))
    rows = given.groupBy("conv_id", "turn", "role", "text").agg(copies.cast("long").alias("n"))
    blank, cut = _first_fault("text")
    rows = rows.select("*", F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("n")).alias("_c"), F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("_h"), blank.alias("blank"), cut.alias("cut"))
    rows = materialize(rows, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.groupBy("_c", "_h").agg(F.count("*").alias("k"), F.min(when).alias("_first")).where("k > 1").select("_c", "_h", "_first")
    rows = rows.join(small_or_none(materialize(seen, "seen"), BROADCAST), ["_c", "_h"], "left")
    rows = rows.withColumn("again", F.coalesce(when > F.col("_first"), F.lit(False))).drop("_first")
    order = [F.col("_c"), F.col("turn").asc_nulls_first(), F.col("_h")]
    blocks = materialize(_blocks(materialize(rows, "marked").repartitionByRange(*order).sortWithinPartitions(*order).select("_c", "conv_id", "turn", "role", "text", "n", "blank", "cut", "again")), "blocks")

    whole, parts = blocks.where("whole"), blocks.where("NOT whole")
    edits = materialize(_joined(parts), "edits").withColumnsRenamed({"entry": "_entry", "audit": "_audit", "cost": "_cost"})
    found = parts.join(small_or_none(edits, BROADCAST), ["part", "seq"])
    found = found.withColumns({"state": F.col("_entry"), "audit": F.col("_audit"), "cost": F.col("_cost")})
    keep = [c for c in blocks.columns if c not in ("costs", "audits")]
    return whole.select(*keep).unionByName(_edited(found.select(*keep))).drop("state")


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(blocks: DataFrame) -> DataFrame:
    """One row for each conversation of repaired blocks: counts, cost, audit and the hash of its repaired ``role:text`` lines.

    A conversation in several blocks is read in one stream, block by block, since the hash is one over all of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None

        def close() -> None:
            span = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            out.append({k: now[k] for k in ("conv_id", *_FAULTS, "illegal", "cost")} | {"gaps": span, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()})

        for batch in pieces(batches):
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now:
                        close()
                    now = dict.fromkeys([*_FAULTS, "illegal", "cost", "turns"], 0) | {"conv_id": r["conv_id"], "audit": [], "hash": hashlib.sha256(), "any": False, "low": None, "last": None}
                elif now["last"] + r["first_role"] not in _LEGAL:
                    now["illegal"] += 1
                for k in (*_FAULTS, "illegal", "cost"):
                    now[k] += r[k]
                now["turns"] += r["distinct_turns"] - (r["distinct_turns"] > 0 and r["first_turn"] is not None and r["first_turn"] == now.get("turn"))
                if r["low_turn"] is not None:
                    now["low"] = r["low_turn"] if now["low"] is None else now["low"]
                    now["high"] = r["high_turn"]
                now["last"], now["turn"] = r["last_role"], r["last_turn"]
                now["audit"].append(r["audit"])
                if r["roles"]:
                    now["hash"].update((b"\n" if now["any"] else b"") + "\n".join(f"{x}:{t}" for x, t in zip(r["roles"], r["texts"], strict=True)).encode())
                    now["any"] = True
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, _DIGEST_TYPES)
                out.clear()
        if now:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGEST_TYPES)

    several = blocks.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return blocks.where("whole").mapInArrow(run, _DIGEST).unionByName(several.mapInArrow(run, _DIGEST))


_DIGEST_TYPES = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *_FAULTS, "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
