"""Conversation structure repair: the cheapest edits that give every conversation the form of one.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Its repair is a shortest path through a graph whose nodes
are (rows consumed, state of that pattern) and whose arcs are edits of small integer cost, so distances to the end come from a
bucket queue, and the audit (the edits' initials) from a walk along tight arcs that takes the least letter at each node.

Rows are sorted by ranges, so a conversation of any length is a chain of segments, each no longer than one task's rows. A segment
is known to the others by the 4 by 4 distances between its ends; these are chained backwards, and each segment walks its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hotkeys import left_join
from millrace.plans.materialize import free, materialize, shuffle_parts

#: Costs of the edits; a truncated row that isn't deleted adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system's, the user's, the assistant's turn. What follows by a user's or assistant's turn.
NEXT = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
#: KEEP[initial][state]: the state after a kept row; initials are 0 (any other), 1 (s), 2 (u), 3 (a). -1: not legal.
KEEP = ((-1, -1, -1, -1), (1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1))
KEPT_BEFORE = tuple(tuple(tuple(q for q in range(4) if to[q] == r) for r in range(4)) for to in KEEP)
ROLES = {2: "user", 3: "assistant"}
#: From each state, the distance to a legal end by insertions alone.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
#: Rows of a segment at most, and the ASCII spaces.
SEGMENT, SPACES = 1 << 16, " \t\n\x0b\x0c\r"
LEGAL = {(1, 2), (2, 3), (3, 2)}
COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20, nulls as one space: 0 drops the row, 1 empties the
    text, 2 removes its sentence ends, 3 repeats it with the same turn, 4 sets the role to user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    who = F.when(kind == 4, "user").otherwise(space(role))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(kind != 0).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), body.alias("text"), copies.alias("copy")).drop("copy")


# --- one segment ----------------------------------------------------------------------------------------------------------------


def distances(codes: bytes, after: list[int]) -> list[int]:
    """Dial's algorithm, backwards: for node 4 * i + q (i rows consumed, state q), the least cost to reach the segment's end and
    go on from there at the cost ``after[state]``.

    A row's code is its initial plus 4 if it is truncated, 8 if it must go. Arcs cost at most REROLE + TRUNCATED, so a ring of that
    many buckets, and room for unlike ``after``, holds every node that is open.
    """
    n = len(codes)
    found = [FAR] * (4 * n + 4)
    low = min(after)
    open_ = [x for x in after if x < FAR]
    ring = [[] for _ in range(max(REROLE + TRUNCATED, max(open_) - low) + 1)]
    for q, x in enumerate(after):
        if x < FAR:
            found[4 * n + q] = x
            ring[x % len(ring)].append((x, 4 * n + q))
    left, d = len(open_), low
    while left:
        bucket = ring[d % len(ring)]
        while bucket:  # arcs of no cost add to the bucket that is being emptied
            at, node = bucket.pop()
            left -= 1
            if found[node] != at:
                continue
            i, q = divmod(node, 4)
            arcs = [(4 * i + p, INSERT) for p in BEFORE[q]] if i < n else []
            if i:
                code, back = codes[i - 1], 4 * i - 4
                arcs.append((back + q, DELETE))
                if code < 8:
                    extra = TRUNCATED if code & 4 else 0
                    arcs += [(back + p, extra) for p in KEPT_BEFORE[code & 3][q]]
                    arcs += [(back + p, REROLE + extra) for p in BEFORE[q]]
            for to, cost in arcs:
                if at + cost < found[to]:
                    found[to] = at + cost
                    ring[(at + cost) % len(ring)].append((at + cost, to))
                    left += 1
        d += 1
    return found


def between_ends(codes: bytes) -> list[int]:
    """[4 * q + r]: the least cost from state q before the segment to state r after it."""
    columns = [distances(codes, [0 if q == r else FAR for q in range(4)])[:4] for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def walk(codes: bytes, found: list[int], state: int) -> tuple[str, int]:
    """The edits' initials from ``state`` to the segment's end along tight arcs, the least letter at each node, and the last state."""
    i, q, out = 0, state, []
    while i < len(codes):
        code, here = codes[i], found[4 * i + q]
        extra = TRUNCATED if code & 4 else 0
        kept = KEEP[code & 3][q] if code < 8 else -1
        if found[4 * i + 4 + q] + DELETE == here:
            letter, i = "D", i + 1
        elif found[4 * i + NEXT[q]] + INSERT == here:
            letter, q = "I", NEXT[q]
        elif kept >= 0 and found[4 * i + 4 + kept] + extra == here:
            letter, i, q = "K", i + 1, kept
        else:
            letter, i, q = "R", i + 1, NEXT[q]
        out.append(letter)
    return "".join(out), q


# --- segments of all conversations -----------------------------------------------------------------------------------------------


def _initial(role: str) -> int:
    return "sua".find(role[:1]) + 1 if role else 0


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, longest: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, role, text, n, kind) to the rows that may stay, numbered, and before them their segment's row."""
    part = TaskContext.get().partitionId()
    seq, out, size = 0, [], 0
    conv, seg, texts, codes = None, None, [], bytearray()

    def close() -> None:
        nonlocal seg, seq, texts, codes
        if seg is not None:
            out.append(seg | {"conv": conv, "part": part, "seq": seq, "at": -1, "codes": bytes(codes), "ends": between_ends(bytes(codes))})
            out.extend(texts)
            seq += 1
        seg, texts, codes = None, [], bytearray()

    def start() -> None:
        nonlocal seg
        seg = dict.fromkeys(COUNTS, 0) | {"first": None, "last": None, "low": None, "high": None}

    for batch in batches:
        for c, turn, role, text, n, kind in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if seg is None or c != conv or (c is None) != (conv is None):
                close()
                conv = c
                start()
            who = _initial(role)
            fresh = kind in ("fine", "truncated")
            while n:
                if len(codes) >= longest:
                    close()
                    start()
                if turn is not None and turn != seg["high"]:
                    seg |= {"low": turn if seg["low"] is None else seg["low"], "high": turn, "turns": seg["turns"] + 1}
                take = 1 if fresh else min(n, longest - len(codes))
                if fresh:
                    texts.append({"conv": conv, "part": part, "seq": seq, "at": len(codes), "role": role, "text": text})
                    size += len(text)
                    codes.append(who | (4 if kind == "truncated" else 0))
                else:
                    codes.extend(bytes([who | 8]) * take)
                if kind in COUNTS:
                    seg[kind] += take
                joins = take - 1 + (seg["last"] is not None)
                seg["illegal"] += (take - 1) + ((seg["last"], who) not in LEGAL) * (joins - take + 1)
                seg |= {"first": who if seg["first"] is None else seg["first"], "last": who, "n": seg["n"] + take}
                n -= take
                if fresh:
                    fresh, kind = False, "duplicate"
        if size > 1 << 22 or len(out) > 1 << 14:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    close()
    yield pa.RecordBatch.from_pylist(out, schema)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (conv, part, seq, ends), last ones first, to (part, seq, after): the cost to the conversation's end from each state."""
    conv, after = (), list(END)
    for batch in batches:
        conv_, part, seq, ends = (c.to_pylist() for c in batch.columns)
        out = []
        for c, e in zip(conv_, ends, strict=True):
            if (c,) != conv:
                conv, after = (c,), list(END)
            out.append(after)
            after = [min(e[4 * q + r] + after[r] for r in range(4)) for q in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["part", "seq", "after"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (part, seq, codes, after) to the edits and the last state from each state they may start with, and the costs."""
    for batch in batches:
        pieces, states, costs = [], [], []
        for codes, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = distances(codes, after)
            told = [walk(codes, found, q) for q in range(4)]
            pieces.append([p for p, _ in told])
            states.append([q for _, q in told])
            costs.append(found[0])
        arrays = [pa.array(pieces, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32())), pa.array(costs, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["part", "seq", "pieces", "states", "cost"])


def _laid(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, ids: DataFrame | None) -> DataFrame:
    """Segments with their walks, and the rows that may stay, each row of a segment after the segment's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).alias("n"))
    ids = rows.select(F.col(conv_id).alias("conv")) if ids is None else ids.select(F.col(conv_id).alias("conv"))
    none = ids.distinct().select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("n"))
    # equal rows of one turn are one row with a count, so their number makes no key hot
    rows = given.unionByName(none).groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    name = F.coalesce(F.concat(F.lit("v"), F.length(F.col("conv").cast("string")).cast("string"), F.lit(":"), F.col("conv").cast("string")), F.lit("n"))
    rows = materialize(rows.withColumn("h", F.sha2(F.concat(name, F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # an equal text of an earlier turn
    place = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("turn"))
    firsts = materialize(rows.where("n > 0").groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    seen = left_join(rows, firsts, ["h"], "c")
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    kind = F.when(end == "", "blank").when(F.col("first").isNotNull() & (F.col("first") != place), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("fine")
    seen = seen.select("conv", "turn", "role", "text", "n", kind.alias("kind"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    laid = seen.repartitionByRange(shuffle_parts(rows.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    type_ = rows.schema["conv"].dataType.simpleString()
    fields = f"conv {type_}, part int, seq int, at int, role string, text string, codes binary, ends array<bigint>, " + ", ".join(f"{c} long" for c in (*COUNTS, "low", "high")) + ", first int, last int"
    arrow, longest = _arrow(rows, fields), SEGMENT
    laid = materialize(laid.mapInArrow(lambda it: _segments(it, arrow, longest), fields))
    segments, count = laid.where("at = -1"), shuffle_parts(rows.sparkSession)
    chained = segments.select("conv", "part", "seq", "ends").repartition(count, "conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    after = chained.mapInArrow(_backwards, "part int, seq int, after array<bigint>")
    walks = segments.select("part", "seq", "codes").join(after, ["part", "seq"]).select("part", "seq", "codes", "after").mapInArrow(_walks, "part int, seq int, pieces array<string>, states array<int>, cost long")
    whole = segments.drop("codes", "ends").join(walks, ["part", "seq"])
    both = laid.where("at >= 0").drop("codes", "ends").unionByName(whole, allowMissingColumns=True)
    free(rows, firsts)
    return both.repartition(count, "conv").sortWithinPartitions("conv", "part", "seq", "at").select("conv", "at", "role", "text", "pieces", "states", "cost", *COUNTS, "low", "high", "first", "last")


def _arrow(rows: DataFrame, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of each conversation in order: ("turn", conversation, edit, role, text), and at last ("end", conversation, report)."""
    conv, report, audit, last = (), {}, [], None
    letters, at, piece, q = "", 0, 0, 0  # edits of the segment, rows consumed, edits read, state

    def until(row: int | None) -> Iterator[tuple]:
        """Edits before row ``row`` of the segment: rows that go, and insertions."""
        nonlocal at, piece, q
        while piece < len(letters) and (letters[piece] == "I" or row is None or at < row):
            if letters[piece] == "I":
                q = NEXT[q]
                yield "turn", conv[0], "I", ROLES[q], ""
            else:
                at += 1
            piece += 1

    def finish() -> Iterator[tuple]:
        nonlocal q
        yield from until(None)
        while END[q]:
            audit.append("I")
            q = NEXT[q]
            yield "turn", conv[0], "I", ROLES[q], ""
        yield "end", conv[0], report | {"audit": "".join(audit)}

    for batch in batches:
        for r in batch.to_pylist():
            if (r["conv"],) != conv:
                if conv:
                    yield from finish()
                conv, audit, letters, at, piece, q, last = (r["conv"],), [], "", 0, 0, 0, None
                report = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "cost": r["cost"]}
            if r["at"] == -1:
                yield from until(None)
                letters, at, piece = r["pieces"][q], 0, 0
                audit.append(letters)
                for c in COUNTS:
                    report[c] += r[c]
                report["illegal"] += last is not None and r["first"] is not None and (last, r["first"]) not in LEGAL
                report["turns"] -= r["low"] is not None and r["low"] == report["high"]
                report |= {"low": r["low"] if report["low"] is None else report["low"], "high": report["high"] if r["high"] is None else r["high"]}
                last = last if r["last"] is None else r["last"]
                continue
            yield from until(r["at"])
            letter = letters[piece]
            at, piece = at + 1, piece + 1
            if letter == "K":
                q = KEEP[_initial(r["role"])][q]
                yield "turn", conv[0], "K", r["role"], r["text"]
            elif letter == "R":
                q = NEXT[q]
                yield "turn", conv[0], "R", ROLES[q], r["text"]
    if conv:
        yield from finish()


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size, n = [], 0, 0
    for event in _read(batches):
        if event[0] == "end":
            n = 0
            continue
        out.append(dict(zip(schema.names, (event[1], n, *event[2:]), strict=True)))
        n, size = n + 1, size + len(event[4])
        if size > 1 << 22 or len(out) > 1 << 14:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def _reports(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size, digest, between = [], 0, hashlib.sha256(), b""
    for event in _read(batches):
        if event[0] == "turn":
            digest.update(between + f"{event[3]}:{event[4]}".encode("utf-8", "surrogatepass"))
            between = b"\n"
            continue
        r = event[2]
        gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
        out.append({schema.names[0]: event[1], "gaps": gaps, **{c: r[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")}, "repaired_sha256": digest.hexdigest()})
        digest, between, size = hashlib.sha256(), b"", size + len(r["audit"])
        if size > 1 << 22 or len(out) > 1 << 14:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def _apply(run, rows: DataFrame, columns: str, conv_id: str, turn: str, role: str, text: str, ids: DataFrame | None) -> DataFrame:
    type_ = rows.select(F.col(conv_id)).schema[0].dataType.simpleString()
    fields = f"`{conv_id}` {type_}, {columns}"
    arrow = _arrow(rows, fields)
    return _laid(rows, conv_id, turn, role, text, ids).mapInArrow(lambda it: run(it, arrow), fields)


def repaired_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, role, text), ``edit`` K (kept), R (role changed) or I (inserted).

    Rows of a conversation go by turn, nulls first, then role, then text; null roles and texts are one space, a null id is a
    conversation of its own. A row's first fault counts: blank (nothing but ASCII spaces), duplicate (role and text seen earlier),
    truncated (the last character that is no space isn't one of ``.!?``). Blank and duplicate rows must go (DELETE), other rows
    are kept (0), get another role (REROLE) or go; an empty turn may be inserted (INSERT) anywhere; a truncated row that stays
    adds TRUNCATED. Of the cheapest repairs, that with the least audit in ASCII is taken. Other columns of ``rows`` are not read.
    """
    return _apply(_turns, rows, "position int, edit string, role string, text string", conv_id, turn, role, text, None)


def repair_reports(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of ``rows`` and of ``ids`` (column ``conv_id``): what was wrong, and its repair (``repaired_turns``).

    ``gaps``: turns missing between the least and the largest (nulls ignored); ``blank``, ``duplicate``, ``truncated``: rows by first
    fault; ``illegal``: adjacent rows whose roles' initials aren't su, ua or au; ``cost`` and ``audit`` of the edits;
    ``repaired_sha256``: hash of the repaired ``role:text``, joined by newlines. A conversation without rows has zeros, an empty
    audit and the empty string's hash; empty tables give no rows.

    The hash takes a conversation's text in order, so the last step streams each conversation through one task; it holds one
    row at a time and the audit.
    """
    columns = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _apply(_reports, rows, columns, conv_id, turn, role, text, ids)
