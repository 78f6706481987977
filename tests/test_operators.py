"""Operators that SQL can't express, on planted cases, invariants and plain re-computations."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking as C
from millrace.operators import documents as D
from millrace.operators import extraction as X
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import memory as M
from millrace.operators import pii as P
from millrace.operators import resolution as R
from millrace.operators import web as H
from millrace.sources import tables as S

DOCS = "doc_id long, text string"


def test_fixed_chunks_cover_the_text_and_keep_words():
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("w" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 300)))
        parts = C.fixed(text, C.ChunkConfig(100, 20))
        assert all(p.strip() for p in parts) and all(len(p) <= 150 for p in parts)
        words = {m.span() for m in re.finditer(r"\S+", text)}
        at = 0
        for p in parts:  # each chunk is a piece of the text that starts where the one before had not ended
            found = text.find(p, max(0, at - 60))
            assert found >= 0
            assert all(a >= found + len(p) or b <= found + len(p) for a, b in words), (p, text)
            at = found + len(p)
        assert at == len(text.rstrip()) or text[at:].strip() == ""


def test_recursive_chunks_are_no_longer_than_asked_and_lose_no_word():
    text = "\n\n".join(" ".join(f"s{i}w{k}" for k in range(40)) + "." for i in range(12))
    parts = C.recursive(text, C.ChunkConfig(300, 0))
    assert all(len(p) <= 300 for p in parts)
    assert " ".join(parts).split() == text.split()
    short = C.recursive("one. two.", C.ChunkConfig(300, 0))
    assert " ".join(short) == "one. two."


def test_semantic_chunks_join_a_short_one_to_the_next_once():
    assert C.semantic_merge(["aa", "bb", "cc"], 5, 100) == ["aa bb", "cc"]
    assert C.semantic_merge(["long enough", "bb"], 5, 100) == ["long enough", "bb"]
    assert C.semantic_merge(["aa", "bbbb bbbb"], 5, 11) == ["aa", "bbbb bbbb"]
    cats, cars = "Cats purr softly at night. " * 3, "Engines burn fuel on roads. " * 3
    topic = lambda t: [1.0, 0.0] if "Cats" in t else [0.0, 1.0]
    parts = C.semantic((cats + cars).strip(), topic)
    assert not any("Cats" in p and "Engines" in p for p in parts) or len(parts) == 1
    assert " ".join(parts).split() == (cats + cars).split()


def test_hierarchical_children_lie_in_their_parents(spark):
    text = " ".join(f"word{i}." for i in range(3000))
    out = C.hierarchical(spark.createDataFrame([(1, text), (2, ""), (3, None)], DOCS), ["doc_id"]).collect()
    assert {r.doc_id for r in out} == {1}
    assert {r.role for r in out} == {"parent", "child"}
    assert sum(r.role == "child" for r in out) > sum(r.role == "parent" for r in out)


def test_personal_data_spans_and_policies():
    text = "mail a.b@x.org card 4111 1111 1111 1111 no card 4111 1111 1111 1112 id 11010119900307123X call 555-123-4567 or 13812345678"
    found = {(k, text[a:b].strip()) for k, a, b in P.spans(text)}
    assert {("email", "a.b@x.org"), ("credit_card", "4111 1111 1111 1111"), ("id_card", "11010119900307123X"), ("phone", "555-123-4567"), ("phone", "13812345678")} <= found
    assert not any(k == "credit_card" and v.endswith("1112") for k, v in found)
    assert P.apply_policy("a.b@x.org!", [("email", 0, 9)], "anonymize") == "<EMAIL>!"
    assert P.apply_policy("a.b@x.org!", [("email", 0, 9)], "mask") == "a.*****rg!"
    assert P.spans(None) == [] and P.apply_policy(None, [], "mask") is None


def test_personal_data_spans_against_plain_precedence():
    rng = random.Random(3)
    pieces = ["4111111111111111", "a@b.co", "110101199003071234", "13812345678", "555 123 4567", "x", " ", "-", "1"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        kept = []  # every kind in turn takes the matches that don't start inside those of kinds before
        for kind, pattern in P.PATTERNS:
            mine = [(kind, *m.span()) for m in re.finditer(pattern, text) if kind != "credit_card" or P.luhn(m[0])]
            kept += [m for m in mine if not any(a <= m[1] < b for _, a, b in kept)]
        assert P.spans(text) == sorted(kept, key=lambda s: s[1]), text


def test_facts_of_every_family(spark):
    said = ["I like green tea.", "我更喜欢用键盘来", "我的名字是李雷。", "请总是先测试。", "千万不要删除数据。", "Never push on Friday.", "My favorite color is blue."]
    rows = [(1, i, "user", t) for i, t in enumerate(said)] + [(1, 99, "assistant", "I like spam.")]
    got = {(r.fact_type, r.key, r.value) for r in X.facts(spark.createDataFrame(rows, "c long, n int, role string, text string"), "c", "n", "role", "text").collect()}
    assert {("preference", "green tea", "green tea"), ("preference", "键盘", "键盘"), ("profile", "李雷", "李雷"), ("rule", "先测试", "先测试"), ("rule", "删除数据", "删除数据"), ("rule", "push on Friday", "push on Friday"), ("preference", "color", "blue")} <= got
    assert not any("spam" in v for _, _, v in got)


def test_entities_and_pairs_of_a_sentence(spark):
    docs = spark.createDataFrame([(1, "Anna Maria met Bob Stone. Acme Corp hired Anna Maria!"), (2, "Bob Stone left. Nothing here."), (3, None)], DOCS)
    found = X.entities(docs, "doc_id", "text")
    assert {(r.id, r.name, r.kind) for r in found.collect()} >= {(1, "Anna Maria", "other"), (1, "Acme Corp", "organization"), (2, "Bob Stone", "other")}
    pairs = {(r.a, r.b): r.n for r in X.co_occurrence(docs, found, "doc_id", "text").collect()}
    assert pairs == {("Anna Maria", "Bob Stone"): 1, ("Acme Corp", "Anna Maria"): 1}


def test_repeated_paragraphs_go():
    a = "The first paragraph speaks of one thing at some length, with quite enough different words that it counts as long."
    b = "Another one entirely, about other matters, in sentences whose every noun and verb differs from what stood before here."
    assert X.similar_paragraphs(f"{a}\n\n{b}\n\n{a}") == X.similar_paragraphs(f"{a}\n\n{b}")


def test_communities_part_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    out = {r.id: r.community for r in G.communities(spark.createDataFrame(edges, "source long, target long, weight double"), 1.0, 12).collect()}
    assert len({out[i] for i in range(5)}) == 1 and len({out[i] for i in range(10, 15)}) == 1 and out[0] != out[10]


def test_multi_hop_reaches_what_the_named_vertex_leads_to(spark):
    v = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma"), ("z", "Zeta")], "id string, name string")
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "source string, target string, weight double")
    out = G.multi_hop(e, v, "what about Alpha?", 5).collect()
    assert [r.id for r in out][:2] == ["b", "c"] and "z" not in {r.id for r in out} and "a" not in {r.id for r in out}


def test_routine_decisions(spark):
    rows = [("done", i, s, "x", "ok") for i, s in enumerate((0.1, 0.99))] + [("broken", i, 0.1 * i, "x", "failed") for i in range(3)] + [("long", i, 0.05 * i, "x", "ok") for i in range(12)] + [("fresh", 0, 0.1, "x", "ok")]
    out = {r.r: r.decision for r in M.decide(spark.createDataFrame(rows, "r string, n int, score double, verdict string, exec_status string"), "r", "n", 0.9, 12).collect()}
    assert out == {"done": "success", "broken": "unrecoverable", "long": "budget", "fresh": "continue"}


def test_claims_are_whole_and_repeatable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    one, two = ({r.k: r.worker for r in S.claim(x, "k", 7).collect()} for x in (rows, rows.repartition(5)))
    assert one == two and set(one.values()) == set(range(7))


def test_resolution_keeps_names_of_common_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rows = [(i, f"common{i:03} northern", "k", i / 100) for i in range(40)] + [(100, "common005 northern", "k", 0.9), (101, "Common005 northern, Inc.", "k", 0.1)]
    out = {r.old: r.new for r in R.resolve(spark.createDataFrame(rows, "id long, name string, kind string, confidence double")).collect()}
    assert out[5] == out[101] and out.get(100, out[5]) == out[5]


PAGE = """<html><head><title>T</title></head><body><nav>menu</nav><main><h1 id="h" class="big red">Head</h1><p class="x">One <b>bold</b></p><p>Two $a+b$ &amp; $5</p>
<table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>1</td></tr></table><pre><code class="language-py">x = 1</code></pre><img src="/i.png" alt="pic">
<math><semantics><annotation encoding="application/x-tex">\\\\alpha</annotation></semantics></math><script type="math/tex; mode=display">c^2</script></main><footer>foot</footer></body></html>"""


def test_page_parts():
    page = H.parse(H.main_content(PAGE), "http://x.org/")
    assert "Head" in page.text and "bold" in page.text and "menu" not in page.text and "foot" not in page.text
    assert page.tables == [[["K", "V"], ["a", "1"]]] and page.code == [("py", "x = 1")]
    assert ("http://x.org/i.png", "pic") in page.images or ("/i.png", "pic") in page.images
    root = H.tree(PAGE)
    assert [e.text() for e in H.find_all(root, "h1.big#h, p.x")] == ["Head", "One bold"]
    assert [e.text() for e in H.find_all(root, "main b")] == ["bold"] and H.find_all(root, "aside") == []
    assert list(H.math_formulas(PAGE)) == [("\\\\alpha", False, "annotation"), ("c^2", True, "script"), ("a+b", False, "text")]
    assert list(H.math_formulas(None)) == []


def test_fences_scores_and_formats():
    text = "a\n```py\nx\n```\n~~~\ny\n```\n~~~\nb\n```\nopen"
    assert D.fences(text) == ["```py\nx\n```\n", "~~~\ny\n```\n~~~\n", "```\nopen"]
    assert D.restore_fences("A\n```\nq\n```\n", ["```\nz\n```\n"]) == ("A\n```\nz\n```\n", True)
    assert D.restore_fences("A\n", ["```\nz\n```\n"]) == ("A\n", False)
    assert D.format_markdown("#A\ntext\n\n\n\n* x\n") == "# A\n\ntext\n\n- x\n"
    once = D.format_markdown(text)
    assert D.format_markdown(once) == once and D.format_markdown(None) == ""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events in four files; the last has a late and a repeated one."""
    path = f"{tmp_path_factory.mktemp('stream')}/events"
    rows = [(i, f"2024-01-01 {i // 4:02}:{i % 4 * 15:02}:00", i % 3, ("view", "error")[i % 2], float(i)) for i in range(48)]
    late = [(900, "2024-01-01 00:01:00", 1, "view", 1.0), (47, "2024-01-01 11:45:00", 2, "error", 47.0)]
    for k, part in enumerate((rows[:16], rows[16:32], rows[32:], late)):
        frame = spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.parquet(f"{path}/{k}")
    return path


def _stream(spark, files):
    from millrace.streaming import events as E

    schema = spark.read.parquet(f"{files}/0").schema
    return E, E.read_events(spark, f"{files}/*", schema, 1), spark.read.schema(schema).parquet(f"{files}/*")


def test_stream_of_events_equals_batch(spark, files, tmp_path):
    E, stream, batch = _stream(spark, files)
    assert stream.isStreaming
    E.to_table(E.typed(stream), f"{tmp_path}/typed", f"{tmp_path}/c1").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/typed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.typed(batch).collect()))
    # a restart from the checkpoint adds nothing
    E.to_table(E.typed(stream), f"{tmp_path}/typed", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/typed").count() == batch.count()


def test_stream_windows_leave_out_late_rows(spark, files, tmp_path):
    E, stream, batch = _stream(spark, files)
    E.to_table(E.windowed_counts(stream), f"{tmp_path}/w", f"{tmp_path}/c").awaitTermination()
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    want = {(r.start, r.event_type): (r.n, r.total) for r in E.windowed_counts(batch.where("event_id < 900").dropDuplicates(["event_id"])).collect()}
    assert got and len(got) >= len(want) - 4 and all(want[k] == v for k, v in got.items())  # the last windows are still open


def test_stream_dedup_and_upserts_equal_batch(spark, files, tmp_path):
    E, stream, batch = _stream(spark, files)
    E.to_table(E.deduplicated(stream, ["event_id"], "2 days"), f"{tmp_path}/d", f"{tmp_path}/c").awaitTermination()
    got = [r.event_id for r in spark.read.parquet(f"{tmp_path}/d").collect()]
    assert sorted(got) == sorted(r.event_id for r in batch.select("event_id").distinct().collect())
    state = {}

    def apply(rows, epoch):
        held = state.get("t")
        new = rows.select("user_id", "event_id", "value")
        state["t"] = spark.createDataFrame((new if held is None else S.upsert(held, new, ["user_id"], "event_id")).collect(), new.schema)
        if held is None:
            state["t"] = S.upsert(state["t"].limit(0), state["t"], ["user_id"], "event_id")

    E.upsert_each_batch(stream, f"{tmp_path}/c2", apply).awaitTermination()
    want = S.upsert(batch.select("user_id", "event_id", "value").limit(0), batch.select("user_id", "event_id", "value"), ["user_id"], "event_id")
    assert sorted(map(tuple, state["t"].collect())) == sorted(map(tuple, want.collect()))


def test_stream_fold_equals_batch(spark, files, tmp_path):
    E, stream, batch = _stream(spark, files)
    deltas = lambda d: d.select(F.col("user_id").alias("thread"), F.col("event_type").alias("key"), F.col("event_id").alias("sequence"), F.col("value").cast("string").alias("value"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = {}

    def apply(rows, epoch):
        found.update({(r.thread, r.key): (r.value, r.version) for r in rows.collect()})

    try:
        E.upsert_each_batch(E.fold_state_stream(deltas(stream.where("event_id < 900"))), f"{tmp_path}/c", apply).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {(r.thread, r.key): (r.value, r.version) for r in E.fold_state(deltas(batch.where("event_id < 900")), "thread", "sequence", "key", "value").collect()}
    assert found == want


VECTORS = "id long, block string, v array<double>, r double, name string, kind string, vector array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        v = rng.normal(size=4).tolist() if i % 4 else [1.0, 0.5, 0.0, 0.0]  # a quarter are copies
        rows.append((i, "xy"[i % 2], [0.0] * 4 if i == 7 else v, float(i % 5), f"n{i}", "xy"[i % 2], v))
    return rows, spark.createDataFrame(rows + [(900, "x", None, 1.0, "none", None, None)], VECTORS)


def near(rows, most):
    unit = {r[0]: np.array(r[2]) / max(np.linalg.norm(r[2]), 1e-300) for r in rows}
    return {(p[0], q[0]): d for p in rows for q in rows if p[0] != q[0] and p[1] == q[1] and (d := 1 - unit[p[0]] @ unit[q[0]]) <= most}


@pytest.mark.parametrize("tile", [13, 2000])
def test_tiles_give_what_all_pairs_give(vectors, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(R, "TILE", tile)
    rows, frame = vectors
    pairs, r = near(rows, 0.05), {x[0]: (-x[3], x[0]) for x in rows}
    got = {(x.a, x.b) for x in J.nearest_under(frame, "block", "id", "v", 0.05).collect()}
    assert got == {p for p in pairs if p[0] < p[1]}
    above = {}
    for a, b in pairs:
        if r[b] < r[a]:
            above.setdefault(a, []).append(b)
    close = J.nearest_above(frame, "block", "id", "v", "r", 0.05).collect()
    assert {x.a: round(x.distance, 9) + 0.0 for x in close} == {a: round(min(pairs[a, b] for b in bs), 9) + 0.0 for a, bs in above.items()}
    assert all(x.b in above[x.a] for x in close)
    high = {x.a: x.b for x in J.nearest_above(frame, "block", "id", "v", "r", 0.05, highest=True).collect()}
    assert high == {a: min(bs, key=r.get) for a, bs in above.items()}
    stars = J.stars_under(frame, "block", "id", "v", 0.05).collect()
    assert len(stars) <= 160 * (160 // tile + 2)
    label = {a: a for p in pairs for a in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.id: x.cluster for x in M.topic_clusters(frame, "block", "id", "v", 0.05).collect()} == label


@pytest.mark.parametrize("tile", [13, 2000])
def test_canonical_links_by_tiles_are_those_of_all_pairs(spark, vectors, monkeypatch, tile):
    monkeypatch.setattr(R, "TILE", tile)
    rows, frame = vectors
    canonical = spark.createDataFrame([(1000 + x[0], "c" + x[4], x[5], x[6]) for x in rows if x[0] % 5 == 0], "id long, name string, kind string, vector array<double>")
    got = {x.id: (x.canonical_id, x.decision) for x in R.link_canonical(frame, canonical, 0.9, 0.8).collect()}
    want = {900: (None, "new")}
    for x in rows:
        of = [(round(float(np.dot(x[6], y[6]) / np.linalg.norm(x[6]) / np.linalg.norm(y[6])), 12), 1000 + y[0]) for y in rows if y[0] % 5 == 0 and y[5] == x[5]]
        s, at = max(of)
        want[x[0]] = (at, "merge") if s >= 0.9 else (at, "review") if s >= 0.8 else (None, "new")
    assert got == want


def test_temporal_links_of_a_busy_key_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, 1_700_000_000 + rng.choice([0, 0, 0, rng.randrange(90) * 60, rng.randrange(4000)])) for i in range(300)]
    rows += [(None, 300, 1_700_000_000), ("a", 301, None)]
    frame = spark.createDataFrame(rows, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for limit in (1, 3):
        want = set()
        for k, i, t in rows[:300]:
            other = sorted((abs(t - u), j) for q, j, u in rows[:300] if q == k and j != i and abs(t - u) <= 1800)
            want |= {(i, j, round(max(0.3, 1 - g / 1800), 9)) for g, j in other[:limit]}
        assert {(x.a, x.b, round(x.weight, 9)) for x in J.temporal_links(frame, "k", "id", "ts", 30.0, limit).collect()} == want


def test_texts_are_mapped_in_bounded_pieces(spark):
    import pyarrow as pa

    from millrace.operators import textmap as M

    texts = ["x" * (M.BYTES // 3)] * 8 + [None, ""] + ["y" * (2 * M.BYTES)] + ["z"] * (3 * M.ROWS)
    pieces = list(M._pieces(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"]), 1))
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or (p.num_rows <= M.ROWS and sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) <= M.BYTES) for p in pieces)
    assert len(pieces) == 6
    assert list(M._pieces(pa.record_batch([pa.array([], pa.string())], names=["text"]), 0)) == []


def test_many_queries_are_scored_in_bounded_parts(spark):
    import numpy as np

    from millrace.operators import search as R

    rng = np.random.default_rng(3)
    x = rng.normal(size=(R.QUERIES_AT_ONCE * 2 + 5, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").coalesce(1)
    found = R.vector_topk_many(items, items.selectExpr("id as query_id", "embedding as vector"), 3).collect()
    y = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = {(i, j) for i, row in enumerate(y @ y.T) for j in np.argsort(-row)[:3].tolist()}
    assert {(r.query_id, r.id) for r in found} == want and len(found) == 3 * len(x)
