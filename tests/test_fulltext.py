"""Stems against published pairs; cover density and BM25 from the stored index against plain re-computations."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.functions.stemming import STOP_WORDS, with_stems
from millrace.operators import fulltext as T
from millrace.operators import search as S
from millrace.sources import versioned

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators
conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant
constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel
kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly
knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot generally general generously generous communism communism skies sky dying
die news news inning inning proceed proceed happy happi say say by by cries cri ties tie relational relat hopping hop hoping hope feed feed agreed agre
national nation vietnamization vietnam sensibility sensibl rationally ration formative format luxuriated luxuri""".split()


def test_stems_of_published_words(spark):
    want = dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    got = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in want], "word string")).collect()}
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}
    odd = {r.word: r.stem for r in with_stems(spark.createDataFrame([("x1ing",), ("été",), ("",), ("as",)], "word string")).collect()}
    assert odd == {"x1ing": "x1ing", "été": "été", "": "", "as": "as"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["running", "runs", "table", "tables", "the", "of", "fast", "faster", "node", "query", "queries"]
    rows = [(i, f"s{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(900, None, None), (901, "s1", "Query, TABLE... query!")]
    docs = spark.createDataFrame(rows, "id long, source string, content string")
    paths = {a: f"file://{tmp_path_factory.mktemp(a)}/index" for a in T.PATTERNS}
    for a, path in paths.items():
        T.write_index(docs, path, analyzer=a)
    return rows, docs, paths


def stem_of(spark, words):
    return {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}


def plain_density(places, terms):
    """Sum over all minimal spans, found by trying every combination of places."""
    at = sorted(x for t in terms for x in places.get(t, []))
    spans = {(min(c), max(c)) for c in product(*[places[t] for t in terms])}
    minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + max(0, (b - a) - (sum(a <= x <= b for x in at) - 1))) for a, b in minimal)


def test_cover_density_against_brute_force(spark, corpus):
    rows, _, paths = corpus
    stems = stem_of(spark, {w for _, _, t in rows for w in re.findall(r"\w+", (t or "").lower())})
    for query in ("running tables", "the fast query", "Nodes", "faster runs of queries tables"):
        terms = sorted({stems.get(w, "node" if w == "nodes" else w) for w in re.findall(r"\w+", query.lower()) if w not in STOP_WORDS})
        want = {}
        for i, _, text in rows:
            places = defaultdict(list)
            for n, w in enumerate(re.findall(r"\w+", (text or "").lower()), 1):
                if w not in STOP_WORDS:
                    places[stems[w]].append(n)
            if all(places.get(t) for t in terms):
                want[i] = plain_density(places, terms)
        got = {r.id: r.score for r in T.keyword_topk(spark, paths["english"], query, 1000).collect()}
        assert got.keys() == want.keys() and len(want) > 3
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert T.keyword_topk(spark, paths["english"], "the of", 5).count() == 0
    assert T.keyword_topk(spark, paths["english"], "unheard tables", 5).count() == 0


def test_bm25_from_the_index_equals_the_scan(spark, corpus):
    _, docs, paths = corpus
    asked = spark.createDataFrame([(1, "fast query query"), (2, "the node"), (3, "nothing known")], "query_id int, query string")
    want = {(r.query_id, r.id): round(r.score, 9) for r in S.bm25(docs, asked).collect()}
    assert {(r.query_id, r.id): round(r.score, 9) for r in T.bm25(spark, paths["plain"], asked).collect()} == want and len(want) > 50
    only = {(r.query_id, r.id): round(r.score, 9) for r in T.bm25(spark, paths["plain"], asked, sources=["s1"]).collect()}
    assert only == {(r.query_id, r.id): round(r.score, 9) for r in S.bm25(docs.where("source = 's1'"), asked).collect()}


def test_a_source_is_replaced_and_only_its_buckets_are_read(spark, corpus, tmp_path):
    _, docs, _ = corpus
    path = f"file://{tmp_path}/index"
    T.write_index(docs, path, analyzer="plain")
    asked = spark.createDataFrame([(1, "zebra")], "query_id int, query string")
    assert T.bm25(spark, path, asked).count() == 0
    new = spark.createDataFrame([(5000, "s1", "a zebra")], "id long, source string, content string")
    assert T.write_index(new, path, analyzer="plain")[0] == 2
    assert [r.id for r in T.bm25(spark, path, asked).collect()] == [5000]
    assert T.statistics(spark, path).first().n == docs.where("source <> 's1' or source is null").count() + 1
    assert Counter(r.lexeme for r in T.vocabulary(spark, path).collect())["zebra"] == 1
    found = versioned.read(spark, path).where((F.col("bucket") == 3) & F.col("lexeme").isin("zebra"))
    plan = found._jdf.queryExecution().toString()
    assert "(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(lexeme" in plan or "EqualTo(lexeme" in plan


def test_index_is_dealt_by_the_size_of_its_text(spark, tmp_path):
    few = spark.createDataFrame([(i, "running cats run", f"s{i % 3}") for i in range(30)], "id long, content string, source string")
    assert T.index_parts(few, "content", "source") == (int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    many = few.withColumn("content", F.repeat("content", 1_000_000))
    parts, split = T.index_parts(many, "content", "source")
    assert parts == -(-30 * 16_000_000 // T.PIECE) and split == -(-10 * 16_000_000 // (T.BUCKETS * T.PIECE))
    # words are stemmed where they are found: neither a join nor a table of them
    found = T.postings(few, "id", "content", "source")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.source, r.id, r.lexeme, r.tf, tuple(r.positions), r.len) for r in found.collect())
    want = [(f"s{i % 3}", i, w, len(p), p, 3) for i in range(30) for w, p in (("", ()), ("run", (1,)), ("cat", (2,)), ("run", (3,)))]
    assert got == sorted(want)
    # the scores of all queries for a document are added up where its postings are
    path = str(tmp_path / "index")
    T.write_index(few, path, analyzer="plain")
    plan = T.bm25(spark, path, spark.createDataFrame([(1, "cats"), (2, "run cats")], "query_id long, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "REPARTITION_BY_NUM" in plan
