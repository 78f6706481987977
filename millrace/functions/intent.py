"""Rule-based intents of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import col

# Fixed patterns of memory queries.
PROCEDURAL = r"(?i)\b(how\s+to|how\s+do|how\s+can|step|guide)\b|步骤|流程|怎么做|怎样|如何|教程"
EPISODIC = r"(?i)\b(when|yesterday|last\s+week|recall|history)\b|今天|昨天|上周|去年|曾经|发生|那次|历史"
SEMANTIC = r"(?i)\b(what\s+is|what\s+does|define|meaning)\b|定义|含义|什么是|介绍"
PREFERENCE = r"(?i)\b(prefer|favorite)\b|偏好|喜欢|不喜欢|习惯"

# Fixed patterns of search queries, first match wins.
SEARCH_INTENTS = {
    "fact": ["什么是", "谁发明了", "定义", "意思", "how to define", "what is", "who invented", "definition"],
    "exploration": ["介绍", "概述", "总结", "explain", "tell me about", "overview", "summary", "describe"],
    "comparison": ["对比", "比较", "区别", "差异", r"vs\.?", "compare", "difference", "better than"],
    "navigation": ["列表", "目录", "索引", "所有.*文档", "list all", "index", "catalog", "table of contents"],
    "graph_query": ["关系", "关联", "图谱", "实体", "relation", "graph", "connected to", "related entities"],
}


def _intent(primary: str, boost: list[str], confidence: Column | float) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(primary).alias("primary"), F.array(*map(F.lit, boost)).alias("boost_types"), confidence.alias("confidence"))


def memory_intent(query: Column | str) -> Column:
    """Struct (primary, boost_types, confidence): procedural before preference, episodic and semantic."""
    q = F.trim(col(query))
    procedural, episodic, semantic, preference = (q.rlike(p) for p in (PROCEDURAL, EPISODIC, SEMANTIC, PREFERENCE))
    return (
        F.when(q.isNull() | (q == ""), _intent("episodic", ["semantic"], 0.0))
        .when(procedural, _intent("procedural", ["semantic", "fact"], F.when(episodic | semantic, F.lit(0.55)).otherwise(F.lit(0.7))))
        .when(preference, _intent("preference", ["semantic", "episodic"], 0.7))
        .when(episodic, _intent("episodic", ["semantic", "fact"], 0.65))
        .when(semantic, _intent("semantic", ["fact", "episodic"], 0.6))
        .otherwise(_intent("episodic", ["semantic"], 0.3))
    )


def search_intent(query: Column | str) -> Column:
    q = F.trim(F.lower(col(query)))
    out = None
    for name, patterns in SEARCH_INTENTS.items():
        hit = q.rlike("|".join(patterns))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("exploration"))
