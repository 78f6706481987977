"""Facts, entities and co-occurrence relations from text by patterns; topic labels; near-duplicate paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions import text as T

# Patterns of facts, with the key group and the value group of each.
FACTS = {
    "preference": [
        (r"(?i)我(?:最)?喜欢(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?i)我(?:比较)?偏好(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?i)我(?:比较)?倾向(?:于)?(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?i)我(?:更)?希望(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"我(?:更)?喜欢用(.+?)(?:来|做|进行)?(?:[，。,\.]|$)", 1, 1),
        (r"(?i)I (?:really )?like (.+?)(?:[,\.]|$)", 1, 1),
        (r"(?i)I prefer (.+?)(?:[,\.]|$)", 1, 1),
        (r"(?i)My (?:favorite|preferred) (.+?) is (.+?)(?:[,\.]|$)", 1, 2),
    ],
    "profile": [
        (r"我是(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"我叫(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"我(?:的)(?:名字|姓名|名)是(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"我(?:的)(.+?)是(.+?)(?:[，。,\.]|$)", 1, 2),
        (r"(?i)My name is (.+?)(?:[,\.]|$)", 1, 1),
        (r"(?i)I am (?:a |an )?(.+?)(?:[,\.]|$)", 1, 1),
        (r"(?i)I work (?:at|for|in) (.+?)(?:[,\.]|$)", 1, 1),
        (r"(?i)My (.+?) is (.+?)(?:[,\.]|$)", 1, 2),
    ],
    "rule": [
        (r"(?:请|务必|一定要?)不要(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?:请|务必|一定)要(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?:请|务必|一定要?)总是(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?:记住|请记住|记得)(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?:永远|绝不|千万不要)(.+?)(?:[，。,\.]|$)", 1, 1),
        (r"(?i)(?:Don't|Do not|Never) (.+?)(?:[,\.]|$)", 1, 1),
        (r"(?i)(?:Always|Must|Remember to) (.+?)(?:[,\.]|$)", 1, 1),
    ],
}
NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
ORGANIZATIONS = r"\b[A-Z][a-zA-Z]+\s+(?:Inc|Corp|LLC|Ltd|Company|Organization)\b"
DATE_NAME = r"(?i)^(?:published|updated|created|posted)?\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}$"
FILE_NAME = r"(?i)^.+\.(?:txt|sh|json|md|py|js|ts|tsx|jsx|yaml|yml|toml|cfg|ini|conf|env|lock)$"


def facts(turns: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """(conversation, fact_type, key, value) from user turns; the first of each type and key."""
    user = turns.where(F.col(role) == "user")
    found = []
    for n, (kind, patterns) in enumerate(FACTS.items()):
        for m, (pattern, k, v) in enumerate(patterns):
            pair = lambda g, p=pattern: F.regexp_extract_all(text, F.lit(p), F.lit(g))
            found.append(F.transform(F.arrays_zip(pair(k).alias("k"), pair(v).alias("v")), _fact(kind, n * 100 + m)))
    rows = user.select(conversation, F.col(order).alias("__o"), F.posexplode(F.concat(*found)).alias("i", "f")).select(conversation, "__o", "i", "f.*").where(F.length("key") >= 2)
    first = W.Window.partitionBy(conversation, "fact_type", "key").orderBy("__o", "rule", "i")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(conversation, "fact_type", "key", "value")


def _fact(kind: str, rule: int):
    return lambda x: F.struct(F.lit(kind).alias("fact_type"), F.lit(rule).alias("rule"), F.trim(x["k"]).alias("key"), F.trim(x["v"]).alias("value"))


def noise_name(name: Column, stopwords: list[str], known: list[str] = ()) -> Column:
    """Too short or long, a stopword, an address, a date, a code reference or a file name; known names never are."""
    n = F.trim(name)
    low = F.lower(n)
    bad = (F.length(n) <= 2) | (F.length(n) > 150) | low.isin(list(stopwords))
    shape = low.rlike(r"^(https?|ftp|ssh)://") | n.rlike(DATE_NAME) | n.rlike(r"^.+:\d+$") | n.rlike(FILE_NAME)
    return F.coalesce(bad | (~low.isin(list(known)) & shape), F.lit(True))


def entities(docs: DataFrame, id_col: str, text: str, stopwords: list[str] = ()) -> DataFrame:
    """(id, name, kind, confidence): capitalised names of several words (.5) and organisations (.6), each once a text."""
    body = F.regexp_replace(F.col(text), r"\s+", " ")
    take = lambda pattern, kind, score: F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("kind"), F.lit(score).alias("confidence")))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(take(NAMES, "other", 0.5), take(ORGANIZATIONS, "organization", 0.6))).alias("e")).select("id", "e.*")
    rows = rows.where((F.col("kind") == "organization") | ~noise_name(F.col("name"), list(stopwords)))
    return rows.groupBy("id", "name").agg(F.max_by("kind", "confidence").alias("kind"), F.max("confidence").alias("confidence"))


def co_occurrence(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    """(a, b, n): sentences that hold both names, over all texts; pairs are formed within a sentence only."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(F.col(text), r"\s+", " "), r"[.!?]+", -1)).alias("s", "sentence"))
    inside = parts.join(found.select("id", "name"), "id").where(F.contains("sentence", F.col("name"))).groupBy("id", "s").agg(F.array_sort(F.collect_set("name")).alias("names"))
    pairs = inside.select(F.posexplode("names").alias("i", "a"), "names").select("a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def topic_labels(docs: DataFrame, group: str, text: str, stopwords: list[str], k: int = 3) -> DataFrame:
    """(group, label): the k most frequent words of two characters or more, joined by ``_``; ties to the smaller word."""
    words = docs.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{2,}|[一-鿿]{2,}"), F.lit(0))).alias("w")).where(~F.col("w").isin(stopwords))
    counts = words.groupBy(group, "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.Window.partitionBy(group).orderBy(F.desc("n"), "w"))).where(F.col("r") <= k)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), "_").alias("label"))


def typed_entities(found: DataFrame, known: DataFrame, product: str = r"(?i)\b(gpt|llm|model|api|sdk)\b") -> DataFrame:
    """Kinds from a table of known names (name, known_kind), else product names by pattern."""
    both = found.join(known.withColumnRenamed("name", "__name"), F.lower("name") == F.lower("__name"), "left").drop("__name")
    return both.withColumn("kind", F.coalesce("known_kind", F.when(F.col("name").rlike(product), "product"), "kind")).drop("known_kind")


def similar_paragraphs(text: str | None, least: float = 0.6, size_ratio: float = 0.5, words: int = 15) -> str:
    """The text without paragraphs whose words mostly stand in an earlier one; short ones, formulas and captions stay."""
    import re

    kept: list[str] = []
    sets: list[frozenset] = []
    for p in re.split(r"\n\s*\n", text or ""):
        w = frozenset(re.findall(r"\w+", p.lower()))
        exempt = len(w) < words or "$$" in p or re.match(r"\s*(figure|table|fig\.)\s", p, re.I)
        if not exempt and any(len(w & s) / len(w | s) > least and min(len(w), len(s)) / max(len(w), len(s)) > size_ratio for s in sets):
            continue
        kept.append(p)
        if not exempt:
            sets.append(w)
    return "\n\n".join(kept)


def near_words(a: Column, b: Column, cosine: Column) -> Column:
    """Near-duplicate memories: cosine .85, or .80 with word overlap .7."""
    return (cosine >= 0.85) | ((cosine >= 0.80) & (T.jaccard(T.word_set(a), T.word_set(b)) >= 0.7))
