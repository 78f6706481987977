import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.queries import op5_lpt_shards
from tests.llm.helpers import awkward, frame


def plain_lpt(items, shards):
    """Shard of each (size, name), largest first, then by name."""
    heap, placed = [(0, s) for s in range(shards)], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        placed[name] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def test_longest_first_is_plain_lpt():
    rng = random.Random(6)
    for case in range(300):
        shards, most = rng.randrange(1, 10), rng.choice((1, 3, 40, 1000))
        items = [(rng.randrange(most + 1), i) for i in range(rng.randrange(60))] + [(most * 20, 1000)] * (case % 2)
        want, got = plain_lpt(items, shards), {}
        names = defaultdict(list)
        for size, name in sorted(items):
            names[size].append(name)
        for size, first, end, turn in sharding.longest_first(Counter(s for s, _ in items).items(), shards):
            for k in range(first, end):
                got[names[size][k]] = turn[(k - first) % len(turn)]
        assert got == want, (case, shards, items)


def test_query_of_many_groups_is_plain_lpt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE", 500)
    monkeypatch.setattr(sharding, "HOT", 100)
    rows = [(i, f"t{i}" + "x" * (i * i % 97), "en", "s", 1) for i in range(100_000)] + [(200_000 + i, "copy", "en", "s", 1) for i in range(5_000)]
    out = sharding.shard_texts(frame(spark, rows).repartition(5), 8, keep=["doc_id", "text"]).collect()
    size = Counter()
    for r in rows:
        size[r[1]] += len(r[1]) + 1
    want = plain_lpt([(n, hashlib.sha256(t.encode()).digest()) for t, n in size.items()], 8)
    assert len(out) == len(rows) and all(want[hashlib.sha256(r.text.encode()).digest()] == r.shard for r in out)
    for s in range(8):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))


def test_query_balances_keeps_copies_and_numbers_slots(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = op5_lpt_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    load, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        text = docs[r.doc_id]
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    mean = sum(load.values()) / 8
    assert max(load.values()) - min(load.values()) < 0.02 * mean


def test_awkward_rows_and_empty_table(spark):
    docs = frame(spark, awkward())
    out = sharding.shard_texts(docs, 3).collect()
    assert len(out) == 10
    assert len({r.shard for r in out if r.text and r.text.startswith("The cat")}) == 1
    assert len({r.shard for r in out if not r.text}) == 1
    for s in range(3):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
    assert sharding.shard_texts(docs.limit(0), 3).count() == 0


def test_clashing_names(spark):
    docs = frame(spark, awkward()).withColumn("shard", F.lit(9)).withColumn("slot", F.lit("x"))
    try:
        sharding.shard_texts(docs, 3)
    except ValueError:
        pass
    else:
        raise AssertionError
    out = sharding.shard_texts(docs, 3, prefix="new_")
    assert {"shard", "slot", "new_shard", "new_slot"} <= set(out.columns) and out.count() == 10
