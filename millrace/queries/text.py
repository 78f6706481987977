"""Text, extraction, chunking and personal-data queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import intent as I
from millrace.functions import text as T
from millrace.operators import chunking as C
from millrace.operators import extraction as X
from millrace.operators import pii as P
from millrace.operators.textmap import flat_map_text
from millrace.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.tokens("text")).alias("tokens"), F.size(T.word_set("text")).alias("words"))


def sentence_counts(spark, sf):
    found = F.when(F.col("text").isNotNull(), T.sentences("text"))  # a text may have none, a null one has no count either
    return _docs(spark, sf).select("doc_id", F.size(found).alias("sentences"), F.md5(F.get(found, 0)).alias("first"))


def sentences_by_space(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.sentences_by_space("text")).alias("sentences")).where("sentences > 0")


def normalized_labels(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(",  Inc.")).alias("name"))
    return s.select("s_suppkey", T.normalize_label("name").alias("label"), T.blocking_key("name", F.lit("org")).alias("block"))


def query_hashes(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.query_hash("text").alias("hash"))


def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slugify("p_name").alias("slug"), T.slugify(F.lit("--")).alias("empty"))


def snippets(spark, sf):
    cut, more = T.snippet("text", 300)
    return _docs(spark, sf).select("doc_id", F.md5(cut).alias("digest"), more.alias("truncated"))


def cjk_ratios(spark, sf):
    d = _docs(spark, sf).withColumn("t", F.concat("text", F.lit("漢字 語")))
    return d.select("doc_id", F.round(T.cjk_ratio("t"), 6).alias("ratio"))


def email_lists(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(F.array_sort(T.emails("text")), ",").alias("emails")).where("emails <> ''")


def url_domains(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.domain("url").alias("domain"))


def cleaned_texts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.clean_text("text")).alias("digest"))


def markdown_strip(spark, sf):
    md = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n- **bold** item\n> quote [link](http://x.y) ![img](a.png) `code`\n\n\n\n1. one"))
    return _docs(spark, sf).select("doc_id", T.markdown_to_text(md).alias("plain"))


def content_quality(spark, sf):
    md = F.concat(F.lit("# A\n\n| a | b |\n|---|---|\n```\nx\n```\n$$y$$ and $z$ ![i](j)\n"), F.col("text"))
    return _docs(spark, sf).where("text not rlike '[$|`#!]'").select("doc_id", F.round(T.content_quality(md) - F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) * 0.001, 6).alias("score"))


def structure_scores(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(T.structured_share("text"), 6).alias("structured"), F.round(T.repetition("text"), 6).alias("repetition"))


def initial_retention(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(T.initial_retention("text", 1.2, F.col("role") == "user"), 6).alias("retention"))


def word_overlap(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.word_set("text").alias("w"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id").select("doc_id", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


QUESTIONS = ["how to bake", "when did I prefer tea", "What is love", "yesterday we met, what is it", "plain words", "", "compare a and b", "list all files", "explain it", "related entities of x", "the definition"]


def _questions(spark, sf):
    """Whole turns that begin with one of the questions, or with none."""
    asked = F.element_at(F.array(*map(F.lit, QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(asked, F.lit(" "), "text").alias("q"))


def memory_intents(spark, sf):
    q = _questions(spark, sf).withColumn("i", I.memory_intent("q"))
    return q.select("conv_id", "turn", "i.primary", F.array_join("i.boost_types", ",").alias("boost"), "i.confidence")


def search_intents(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", I.search_intent("q").alias("intent"))


def pii_counts(spark, sf):
    c = P.counts("text")
    return _docs(spark, sf).select("doc_id", *[v.alias(k) for k, v in c.items()])


def pii_spans(spark, sf):
    return P.detect(_docs(spark, sf), ["doc_id"])


def pii_redaction(spark, sf):
    red = P.redact(_docs(spark, sf), ["doc_id", "text"], policy="anonymize")
    return P.gate(red, "viewer", "text", "redacted").select("doc_id", F.sha2("visible", 256).alias("digest"))


def pattern_facts(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.concat(F.lit("I like "), F.substring_index("text", " ", 2), F.lit(". My color is "), F.substring_index("text", " ", 1), F.lit(". Never "), F.substring_index("text", " ", 3), F.lit(".")))
    return X.facts(c, "conv_id", "turn", "role", "text")


def named_entities(spark, sf):
    return X.entities(_docs(spark, sf), "doc_id", "text", ["the and"])


def entity_pairs(spark, sf):
    d = _docs(spark, sf)
    d = d.withColumn("text", F.concat(F.lit("Anna Maria met Bob Stone. Acme Corp hired Anna Maria! "), "text"))
    return X.co_occurrence(d, X.entities(d, "doc_id", "text"), "doc_id", "text")


def topic_labels(spark, sf):
    return X.topic_labels(_docs(spark, sf), "source", "text", ["the", "of", "and", "in", "on", "to", "is", "re", "es", "er"])


def deduplicated_paragraphs(spark, sf):
    d = _docs(spark, sf).withColumn("twice", F.concat_ws("\n\n", "text", "text"))
    return flat_map_text(d, "twice", lambda t: [(len(X.similar_paragraphs(t)),)], "kept int", ["doc_id"])


def _chunk_digests(chunks, *keys):
    """Per key: number of chunks, the longest one, and a digest of their contents in order."""
    order = [c for c in ("parent_index", "child_index", "chunk_index") if c in chunks.columns]
    content = F.transform(F.array_sort(F.collect_list(F.struct(*order, "content"))), lambda x: x["content"])
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("content")).alias("longest"), F.md5(F.array_join(content, "\x1f")).alias("digest"))


def chunks_fixed(spark, sf):
    return _chunk_digests(C.chunk(_docs(spark, sf), ["doc_id"], strategy="fixed"), "doc_id")


def chunks_recursive(spark, sf):
    return _chunk_digests(C.chunk(_docs(spark, sf), ["doc_id"], strategy="recursive"), "doc_id")


def chunks_hierarchical(spark, sf):
    return _chunk_digests(C.hierarchical(_docs(spark, sf), ["doc_id"]), "doc_id", "role")


def chunks_semantic(spark, sf):
    return _chunk_digests(C.chunk(_docs(spark, sf), ["doc_id"], strategy="semantic"), "doc_id")


def chunks_markdown(spark, sf):
    out = C.chunk(_docs(spark, sf), ["doc_id"], strategy="markdown")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    return out.groupBy("doc_id").agg(F.md5(joined).alias("digest"))


def chunks_by_length(spark, sf):
    return C.chunk(_docs(spark, sf), ["doc_id"], strategy="length").select("doc_id", "chunk_index", F.length("content").alias("size"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+$'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_QUOTED = lambda p: p.replace("'", "''")
_FACTS = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{kind}' AS fact_type, {n * 100 + m} AS rule, regexp_extract_all(text, '{_QUOTED(p)}', {k}) AS k, regexp_extract_all(text, '{_QUOTED(p)}', {v}) AS v, range(len(k)) AS i FROM t"
    for n, (kind, patterns) in enumerate(X.FACTS.items())
    for m, (p, k, v) in enumerate(patterns)
)
# word boundaries count letters outside ASCII too, which the patterns of DuckDB don't: they become underscores
_NAMED = rf"""w AS (SELECT id, regexp_replace(t, '[^\P{{L}}\x00-\x7F]', '_', 'g') AS w FROM d),
        m AS (SELECT id, unnest(list_distinct(regexp_extract_all(w, '{X.NAMES}'))) AS name, 'other' AS kind, 0.5::DOUBLE AS confidence FROM w UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(w, '{X.ORGANIZATIONS}'))), 'organization', 0.6::DOUBLE FROM w),
        e AS (SELECT id, name, arg_max(kind, confidence) AS kind, max(confidence) AS confidence FROM m WHERE kind = 'organization' OR (length(name) BETWEEN 3 AND 150 AND lower(name) <> 'the and') GROUP BY id, name)"""
_ASKED = f"a AS (SELECT conv_id, turn, {QUESTIONS!r}[(conv_id + turn) % {len(QUESTIONS)} + 1] || ' ' || text AS q FROM conversations)"
SQL = {
    "token_counts": f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS tokens, CAST(len(list_distinct({_TOK})) AS INTEGER) AS words FROM documents",
    "sentence_counts": f"SELECT doc_id, CAST(len({_SENT}) AS INTEGER) AS sentences, md5(({_SENT})[1]) AS first FROM documents",
    "normalized_labels": r"SELECT s_suppkey, lower(replace(s_name, '#', '#')) AS label, lower(s_name)[1:3] || '|org' AS block FROM (SELECT s_suppkey, regexp_replace(s_name, '[,.\-–—]', '', 'g') AS s_name FROM supplier)",
    "query_hashes": r"SELECT item_id, sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))[1:32] AS hash FROM benchmark",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'untitled' AS empty FROM part",
    "snippets": "SELECT doc_id, md5(text[1:300]) AS digest, length(text) > 300 AS truncated FROM documents",
    "cjk_ratios": r"WITH t AS (SELECT doc_id, regexp_replace(text || '漢字 語', '\s', '', 'g') AS t FROM documents) SELECT doc_id, round(3 / length(t), 6) AS ratio FROM t",
    "email_lists": f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_EMAIL}'))), ',') AS emails FROM documents WHERE regexp_matches(text, '{_EMAIL}')",
    "url_domains": "SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)', 1)), '') AS domain FROM pages",
    "cleaned_texts": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
    "markdown_strip": "SELECT doc_id, 'Title ' || doc_id || chr(10) || chr(10) || 'bold item' || chr(10) || 'quote link img code' || chr(10) || chr(10) || 'one' AS plain FROM documents",
    "content_quality": "SELECT doc_id, round(5 + 6 + 10 + 2 + 10 + 3 + 0.015::DOUBLE, 6) AS score FROM documents WHERE NOT regexp_matches(text, '[$|`#!]')",
    "structure_scores": rf"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS l, {_TOK} AS t FROM documents) SELECT doc_id, round(coalesce(len(list_filter(l, lambda s: regexp_matches(s, '^\s*([-*+]\s|\d+[.)]\s|#{{1,6}}\s|\|)'))) / nullif(len(l), 0), 0), 6) AS structured, round(coalesce(1 - len(list_distinct(t)) / nullif(len(t), 0), 0), 6) AS repetition FROM l",
    "initial_retention": r"WITH w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, (0.8::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * len(list_distinct(w)) / len(w)) + least(1.0::DOUBLE, len(w) / 50) * 0.2::DOUBLE) * 1.2::DOUBLE + CASE WHEN role = 'user' THEN 0.1::DOUBLE ELSE 0 END) END, 6) AS retention FROM w",
    "word_overlap": f"WITH w AS (SELECT doc_id, list_distinct({_TOK}) AS w FROM documents) SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1",
    "memory_intents": rf"""WITH {_ASKED}, m AS (SELECT *, regexp_matches(q, '(?i)\b(how\s+to|how\s+do|how\s+can|step|guide)\b') AS p, regexp_matches(q, '(?i)\b(prefer|favorite)\b') AS f, regexp_matches(q, '(?i)\b(when|yesterday|last\s+week|recall|history)\b') AS e, regexp_matches(q, '(?i)\b(what\s+is|what\s+does|define|meaning)\b') AS s FROM a)
        SELECT conv_id, turn, CASE WHEN trim(q) = '' THEN 'episodic' WHEN p THEN 'procedural' WHEN f THEN 'preference' WHEN e THEN 'episodic' WHEN s THEN 'semantic' ELSE 'episodic' END AS "primary",
        CASE WHEN trim(q) = '' THEN 'semantic' WHEN p THEN 'semantic,fact' WHEN f THEN 'semantic,episodic' WHEN e THEN 'semantic,fact' WHEN s THEN 'fact,episodic' ELSE 'semantic' END AS boost,
        CASE WHEN trim(q) = '' THEN 0.0 WHEN p THEN CASE WHEN e OR s THEN 0.55 ELSE 0.7 END WHEN f THEN 0.7 WHEN e THEN 0.65 WHEN s THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM m""",
    "search_intents": rf"""WITH {_ASKED} SELECT conv_id, turn, CASE WHEN regexp_matches(lower(q), 'how to define|what is|who invented|definition') THEN 'fact' WHEN regexp_matches(lower(q), 'explain|tell me about|overview|summary|describe') THEN 'exploration' WHEN regexp_matches(lower(q), 'vs\.?|compare|difference|better than') THEN 'comparison'
        WHEN regexp_matches(lower(q), 'list all|index|catalog|table of contents') THEN 'navigation' WHEN regexp_matches(lower(q), 'relation|graph|connected to|related entities') THEN 'graph_query' ELSE 'exploration' END AS intent FROM a""",
    "pattern_facts": f"""WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'user'),
        t AS (SELECT conv_id, turn, 'I like ' || array_to_string(w[1:2], ' ') || '. My color is ' || w[1] || '. Never ' || array_to_string(w[1:3], ' ') || '.' AS text FROM c), f AS ({_FACTS}),
        k AS (SELECT conv_id, turn, fact_type, rule, unnest(i) AS i, trim(unnest(k)) AS key, trim(unnest(v)) AS value FROM f)
        SELECT conv_id, fact_type, key, value FROM k WHERE length(key) >= 2 QUALIFY row_number() OVER (PARTITION BY conv_id, fact_type, key ORDER BY turn, rule, i) = 1""",
    "sentences_by_space": r"""WITH s AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM documents) SELECT doc_id, CAST(n AS INTEGER) AS sentences FROM s WHERE n > 0""",
    "named_entities": rf"""WITH d AS (SELECT doc_id AS id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), {_NAMED} SELECT id, name, kind, confidence FROM e""",
    "entity_pairs": rf"""WITH d AS (SELECT doc_id AS id, regexp_replace('Anna Maria met Bob Stone. Acme Corp hired Anna Maria! ' || text, '\s+', ' ', 'g') AS t FROM documents), {_NAMED},
        p AS (SELECT id, unnest(range(len(string_split_regex(t, '[.!?]+')))) AS s, unnest(string_split_regex(t, '[.!?]+')) AS sentence FROM d), i AS (SELECT id, s, name FROM p JOIN e USING (id) WHERE contains(sentence, name))
        SELECT x.name AS a, y.name AS b, count(*) AS n FROM i x JOIN i y ON x.id = y.id AND x.s = y.s AND x.name < y.name GROUP BY ALL""",
    "chunks_markdown": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''",
    "chunks_by_length": "WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''), i AS (SELECT doc_id, n, unnest(range(0, greatest(1, n - 200), 1800)) AS s FROM d) SELECT doc_id, CAST(s / 1800 AS INTEGER) AS chunk_index, CAST(least(2000, n - s) AS INTEGER) AS size FROM i",
    "topic_labels": "WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{2,}|[一-鿿]{2,}')) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM w WHERE w NOT IN ('the', 'of', 'and', 'in', 'on', 'to', 'is', 're', 'es', 'er') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM c) SELECT source, string_agg(w, '_' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY source",
}
