"""English stemming (the published Porter2 rules) of a table of distinct words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words with a stem of their own, words that no step may change, beginnings after which region 1 starts, and the
# endings of steps 2 to 4 with what takes their place.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
INVARIANT_AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
REGION_1 = ["gener", "commun", "arsen"]
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off
over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now""".split()

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def _cut(w: Column, n: int | Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _in(w: Column, ending: str, region: Column) -> Column:
    return F.length(w) - len(ending) >= region


def _replace(w: Column, rules: dict[str, str], region: Column, also: Column | None = None) -> Column:
    """The longest ending of the rules decides: it is replaced if it lies in the region; ``also`` is what else may happen to a word."""
    out = None
    for ending in sorted(rules, key=len, reverse=True):
        hit = F.when(_in(w, ending, region), F.concat(_cut(w, len(ending)), F.lit(rules[ending]))).otherwise(w)
        out = F.when(F.endswith(w, F.lit(ending)), hit) if out is None else out.when(F.endswith(w, F.lit(ending)), hit)
    return out.otherwise(w if also is None else also)


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with the column ``stem``; words of one or two letters, or with other characters than a-z, stay as they are."""
    w, p1, p2 = F.col("__w"), F.col("__p1"), F.col("__p2")
    out = words.withColumn("__w", F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), "(?<=[aeiouy])y", "Y"))
    first = F.length(F.regexp_extract(w, f"^({'|'.join(REGION_1)})", 0))
    first = F.when(first > 0, first).otherwise(F.length(F.regexp_extract(w, f"^{_OTHER}*{_VOWEL}+{_OTHER}", 0)))
    out = out.withColumn("__p1", F.when(first > 0, first).otherwise(F.length(w)))
    second = F.length(F.regexp_extract(F.substring(w, p1 + 1, F.length(w)), f"^{_OTHER}*{_VOWEL}+{_OTHER}", 0))
    out = out.withColumn("__p2", F.when(second > 0, p1 + second).otherwise(F.length(w)))
    # 1a: plurals
    plural = F.when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ied") | w.endswith("ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
    plural = plural.when(w.endswith("us") | w.endswith("ss"), w).when(w.rlike(f"{_VOWEL}.+s$"), _cut(w, 1)).otherwise(w)
    out = out.withColumn("__w", plural).withColumn("__done", w.isin(INVARIANT_AFTER_1A))
    # 1b: past and present participles
    bare = F.regexp_replace(w, "(ed|edly|ing|ingly)$", "")
    bare = F.when(w.rlike("(eed|eedly)$"), F.lit(None)).when(w.rlike("(ed|edly|ing|ingly)$") & bare.rlike(_VOWEL), bare)
    out = out.withColumn("__bare", bare)
    bare = F.col("__bare")
    is_short = bare.rlike(_SHORT) & (F.length(bare) <= p1)
    mended = F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(bare, 1)).when(is_short, F.concat(bare, F.lit("e"))).otherwise(bare)
    ee = F.when(w.endswith("eedly"), F.when(_in(w, "eedly", p1), _cut(w, 3)).otherwise(w)).when(w.endswith("eed"), F.when(_in(w, "eed", p1), _cut(w, 1)).otherwise(w))
    out = out.withColumn("__w", F.when(F.col("__done"), w).otherwise(F.coalesce(ee, F.when(bare.isNotNull(), mended), w)))
    # 1c: a final y
    out = out.withColumn("__w", F.when(F.col("__done"), w).otherwise(F.regexp_replace(w, f"(?<=.{_OTHER})[yY]$", "i")))
    # 2 to 4: derivational endings, in regions 1, 1 and 2
    li = F.when(w.endswith("ogi"), F.when(w.endswith("logi") & _in(w, "ogi", p1), _cut(w, 1)).otherwise(w)).when(w.rlike("[cdeghkmnrt]li$") & _in(w, "li", p1), _cut(w, 2)).otherwise(w)
    out = out.withColumn("__w", F.when(F.col("__done"), w).otherwise(_replace(w, STEP_2, p1, li)))
    ative = F.when(w.endswith("ative") & _in(w, "ative", p2) & _in(w, "ative", p1), _cut(w, 5)).otherwise(w)
    out = out.withColumn("__w", F.when(F.col("__done"), w).otherwise(_replace(w, STEP_3, p1, ative)))
    ion = F.when(w.rlike("[st]ion$") & _in(w, "ion", p2), _cut(w, 3)).otherwise(w)
    out = out.withColumn("__w", F.when(F.col("__done"), w).otherwise(_replace(w, dict.fromkeys(STEP_4, ""), p2, ion)))
    # 5: a final e or l
    e = w.endswith("e") & (_in(w, "e", p2) | (_in(w, "e", p1) & ~_cut(w, 1).rlike(_SHORT)))
    final = F.when(e | (w.endswith("ll") & _in(w, "l", p2)), _cut(w, 1)).otherwise(w)
    out = out.withColumn("__w", F.when(F.col("__done"), w).otherwise(final))
    given = F.col(word)
    known = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    plain = (F.length(given) <= 2) | given.isin(INVARIANT) | ~given.rlike("^[a-z]+$")
    return out.withColumn(stem, F.when(plain, given).otherwise(F.coalesce(F.try_element_at(known, given), F.lower("__w")))).drop("__w", "__p1", "__p2", "__done", "__bare")
