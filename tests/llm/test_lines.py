import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import lines
from millrace.llm.queries import op6_line_dedup
from tests.llm.helpers import awkward, frame


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def plain(docs, least=20):
    """doc_id and text, in order: what stays of each text."""
    first, order = {}, []
    for d, (_, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip() and line not in first:
                first[line] = (d, n)
                order.append(line)
    # every line against all earlier ones whose lengths differ by one at most
    near, by_length = set(), {}
    for b in order:
        if len(b) >= least and any(within_one(a, b) for n in (len(b) - 1, len(b), len(b) + 1) for a in by_length.get(n, ())):
            near.add(b)
        by_length.setdefault(len(b), []).append(b)
    out = []
    for d, (_, text) in enumerate(docs):
        if text is None:
            out.append((0, 0, None))
            continue
        all_ = text.split("\n")
        kept = [x for n, x in enumerate(all_) if not x.strip() or (first[x] == (d, n) and x not in near)]
        out.append((len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def test_query_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = {i: (n, r, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, r, t) in zip(docs, plain(docs), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in op6_line_dedup(spark, sf).collect()}
    assert got == want and sum(r for _, r, _ in want.values()) > 20


def test_edits_of_every_kind_and_templates(spark):
    rng = random.Random(4)
    base = ["the quick brown fox jumps over the lazy dog", "a,b 12:30 of some-thing else 99999 (x)", "漢字かな交じり文の行がここに一つありますよそして続く", "😀 emoji éàü line with spaces  doubled here"]
    alphabet = list("ab z,1漢😀\t")
    out = []
    for _ in range(300):
        line = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 1, 2))):
            i = rng.randrange(len(line))
            kind = rng.randrange(3)
            if kind == 0:
                line[i] = rng.choice(alphabet)
            elif kind == 1:
                line.insert(rng.randrange(len(line) + 1), rng.choice(alphabet))
            else:
                del line[i]
        out.append("".join(line))
    out += [f"page number {i} of the same long template" for i in range(150)]
    rng.shuffle(out)
    docs = [(i, "\n".join(out[i * 5 : i * 5 + 5] + ["", "short", " \t"])) for i in range(90)]
    got = lines.dedup_lines(frame(spark, [(i, t, "en", "s", 1) for i, t in docs]), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain(docs)


def test_lines_about_the_least_length(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    texts = [base[:19], base[:20], base[:18], base[:19] + "!", "x" + base[:19], base[:20] + "??", base[:21]]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = lines.dedup_lines(frame(spark, [(i, t, "en", "s", 1) for i, t in docs]), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain(docs)
    assert [r.n_removed for r in got] == [0, 1, 0, 1, 1, 0, 1]


def test_awkward_rows_empty_table_and_clashes(spark):
    docs = frame(spark, awkward()).withColumn("n_lines", F.lit("mine")).withColumn("k1", F.lit(1)).withColumn("pos", F.lit(1))
    out = lines.dedup_lines(docs, prefix="l_").collect()
    assert len(out) == 10 and {r.n_lines for r in out} == {"mine"}
    cats = sorted(r.l_n_removed for r in out if r.text and r.text.startswith("The cat"))
    assert cats == [0, 1, 1]
    assert [(r.l_n_lines, r.l_kept_text) for r in out if r.text is None] == [(0, None)]
    assert [(r.l_n_lines, r.l_kept_text) for r in out if r.text == ""] == [(1, "")]
    assert lines.dedup_lines(docs.limit(0), prefix="l_").count() == 0
