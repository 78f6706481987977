import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import conversations as V
from millrace.llm.queries import op12_conversation_repair
from tests.llm.helpers import frame

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows, must, cut):
    """Least (cost, audit) by Dijkstra over whole audits, and the turns it gives."""
    legal = lambda s: re.fullmatch("(s?(u(au)*a?)?)", s) is not None
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        key = (i, roles[-1:])
        if key in done:
            continue
        done.add(key)
        if i == len(rows) and roles[-1:] in ("", "a"):
            return cost, audit, out
        add = lambda c, letter, j, r, turn: heapq.heappush(heap, (cost + c, audit + letter, j, roles[-2:] + r if r else roles, (*out, turn) if turn else out))  # noqa: E731,B023
        for r, name in (("u", "user"), ("a", "assistant")):
            if legal(roles[-1:] + r) and not (r == "a" and roles[-1:] != "u"):
                add(5, "I", i, r, (name, ""))
        if i < len(rows):
            role, text = rows[i]
            add(2, "D", i + 1, "", None)
            if not must[i]:
                c = 5 if cut[i] else 0
                first = role[:1]
                if first == "s" and not roles or first == "u" and roles[-1:] != "u" or first == "a" and roles[-1:] == "u":
                    add(c, "K", i + 1, first, (role, text))
                r, name = ("a", "assistant") if roles[-1:] == "u" else ("u", "user")
                add(c + 1, "R", i + 1, r, (name, text))
    raise AssertionError


def plain_reports(rows, ids):
    by = defaultdict(list, {i: [] for i in ids})
    for r in rows:
        by[r[0]].append(r[1:])
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, must, cut, faults = set(), [], [], [0, 0, 0]
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            must.append(fault < 2)
            cut.append(fault == 2)
            if fault < 3:
                faults[fault] += 1
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, turns = cheapest([r[1:] for r in mine], must, cut)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, *faults, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(frame_):
    return sorted(map(tuple, frame_.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(op12_conversation_repair(spark, sf)) == plain_reports(plain_damage(rows), {r[0] for r in rows})


def random_rows(rng, convs):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(0, 9)):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "ulf"])
                text = rng.choice(["Hi.", "Well!", "cut", " ", "", None, "What? ", "é. ", "Hi.", "a\x0b", "end.\n\n"])
                rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return [*rows, (None, 1, "user", "Hi."), (None, 1, "assistant", "x."), (None, None, "user", "Hi."), *[(-5, None, "user", "x")] * 3]


def test_random_conversations_and_segments_of_any_length(spark):
    rows = random_rows(random.Random(3), 150)
    table = frame(spark, rows, SCHEMA).withColumn("conv", F.lit(1)).withColumn("AT", F.lit("x")).withColumn("part", F.lit(None).cast("int")).withColumn("n", F.lit(9))
    ids = {r[0] for r in rows} | {777}
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = plain_reports(plain, ids)
    more = frame(spark, [(777,)], "conv_id long").union(table.select("conv_id"))
    assert got(V.repair_reports(table, more)) == want
    damaged = plain_reports(plain_damage(rows), {r[0] for r in rows})
    assert got(V.repair_reports(V.damage(table), table)) == damaged
    assert V.repair_reports(table.limit(0)).count() == 0


def test_one_long_conversation_is_split(spark, monkeypatch):
    monkeypatch.setattr(V, "SEGMENT", 13)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "x"]), rng.choice([f"w{t}.", f"w{t}", "same.", ""])) for t in range(700)] + [(1, 3, "user", "hot.")] * 400
    want = plain_reports(rows, {1})
    table = frame(spark, rows, SCHEMA)
    assert got(V.repair_reports(table)) == want  # over several tasks
    codes = bytes(rng.choice([1, 2, 3, 0, 6, 7, 10]) for _ in range(200))
    whole = V.distances(codes, list(V.END))
    for size in (1, 7, 64):  # in segments of any length the ends and walks are those of the whole
        parts = [codes[i : i + size] for i in range(0, 200, size)]
        after, told = list(V.END), []
        for p in reversed(parts):
            told.append((p, after))
            e = V.between_ends(p)
            after = [min(e[4 * q + r] + after[r] for r in range(4)) for q in range(4)]
        assert after == whole[:4]
        q, letters = 0, ""
        for p, a in reversed(told):
            piece, q = V.walk(p, V.distances(p, a), q)
            letters += piece
        assert letters == V.walk(codes, whole, 0)[0]


def test_repaired_turns_are_legal(spark):
    rows = random_rows(random.Random(5), 60)
    out = V.repaired_turns(frame(spark, rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r.position):
        by[r.conv_id].append(r)
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in v)) for v in by.values())
    assert all([r.position for r in v] == list(range(len(v))) for v in by.values())
    assert all(r.text == "" for r in out if r.edit == "I")
