"""Secret scans: pattern candidates, then corpus-wide ownership frequency, with DataFrame functions only.

A credential pasted from a manual turns up under many owners, or in many repositories of one; a live one belongs to one. Candidates
are hashed, counted by distinct repositories and owners, and told apart by both counts and by whether they look like a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import keeping
from millrace.plans.materialize import materialize

#: Fixed patterns: kind, what is matched, and the least characters of the whole match or of the value in group 2.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Method's own candidates: long runs of token characters that hold a digit, an upper and a lower letter.
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex")
#: Words of values that are examples, and the least length, distinct characters and character classes of one that looks live.
EXAMPLES = r"(?i)change|example|sample|dummy|test|your|xxx|password|passwd|secret|placeholder|insert|todo|none|null|foobar|1234|abcd|qwert|0000|9999"
LEAST_LENGTH, LEAST_DISTINCT, LEAST_CLASSES = 8, 6, 2
ASSIGN_LEAST = 6


_NONE = "cast(array() as array<struct<start:int,end:int,whole:string>>)"


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, whole) in code points.

    The text between matches comes from ``split`` on the same pattern, so each start is the length of all that stands before. Lengths
    are summed in runs of about the square root of their number, then over the runs, as an array grows by copying.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(found, gaps, lambda w, g: F.struct(F.length(g).alias("gap"), F.length(w).alias("n"), w.alias("whole")))
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / width).cast("int")), lambda r: F.slice(steps, r * width + 1, width))
    length = lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"])
    sums = lambda values: F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    starts = sums(F.transform(runs, length))
    inner = lambda run: sums(F.transform(run, lambda x: x["gap"] + x["n"]))

    def place(run: Column, at: Column) -> Column:
        span = lambda x, before: F.struct((at + before + x["gap"]).alias("start"), (at + before + x["gap"] + x["n"]).alias("end"), x["whole"].alias("whole"))
        return F.zip_with(run, F.slice(inner(run), F.lit(1), F.size(run)), span)

    placed = F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), place))
    return F.when(F.size(found) > 0, placed).otherwise(F.expr(_NONE))


def _where(text: Column, hint: Column, pattern: str) -> Column:
    """``located`` where the cheap ``hint`` holds, which every match needs."""
    return F.when(hint, located(text, pattern)).otherwise(F.expr(_NONE))


def _tagged(spans: Column, kind: str, order: int, value: Column | None = None, keep: Column | None = None) -> Column:
    """Structs (start, ord, end, kind, value) of spans."""
    pick = (lambda s: F.regexp_extract(s["whole"], ASSIGN, 2)) if kind == "assign" else (lambda s: s["whole"])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), pick(s).alias("value")))


def looks_live(value: Column) -> Column:
    """Not short, of several classes of characters (digits, upper and lower letters, others), not repetitive, no word of an example."""
    classes = sum((value.rlike(c).cast("int") for c in ("[0-9]", "[A-Z]", "[a-z]", "[^0-9A-Za-z]")), F.lit(0))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LEAST_LENGTH) & (distinct >= LEAST_DISTINCT) & (classes >= LEAST_CLASSES) & ~value.rlike(EXAMPLES)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All of ``docs``' columns but the text, and ``spans``: the base spans and the method's own, by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    # cheap tests first: most texts have no candidate
    assign = F.filter(_tagged(_where(body, body.rlike(NAMES), ASSIGN), "assign", 0), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    access = _tagged(_where(body, F.contains(body, F.lit("AKIA")), ACCESS), "access", 1)
    hexes = _tagged(_where(body, body.rlike(HEX), HEX), "hex", 2)
    random = F.filter(_tagged(_where(body, body.rlike(RANDOM), RANDOM), "random", 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    return docs.withColumn("spans", F.array_sort(F.concat(assign, access, hexes, random))).drop(text)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """(value_hash, n_repositories, n_owners, n_uses) of each candidate value over the whole corpus.

    Counted from distinct (value, owner, repository) rows, which are pre-aggregated before the shuffle, so one value that is
    everywhere is no hot key.
    """
    uses = found.select(F.explode("spans").alias("s"), F.col(repository).alias("repository"), F.col(owner).alias("owner"))
    uses = uses.groupBy(F.sha2(F.col("s.value"), 256).alias("value_hash"), "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return uses.groupBy("value_hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n_uses"))


@keeping("secret_spans")
def scan(docs: DataFrame, text: str = "text", repository: str = "source", owner: str = "source", keep: list[str] | None = None, copied_owners: int = 3, copied_repositories: int = 5, prefix: str = "") -> DataFrame:
    """``keep`` columns with ``secret_spans``: structs (kind, start, end, value_hash, n_owners, n_repositories, live, base).

    ``live``: the value is held by fewer than ``copied_owners`` owners and stands in fewer than ``copied_repositories`` repositories,
    and it looks like a secret (``looks_live``); others are widely copied or plain examples. Base spans (assignments, access keys,
    hexadecimal runs) are always kept; a value the method adds (a random-looking run) is kept if it is live. Offsets are code points, end exclusive. Null text counts as empty; null
    owners count as none; repeated rows are scanned one by one. The values themselves never leave the operator.
    """
    keep = docs.columns if keep is None else keep
    name = f"{prefix}secret_spans"
    if name in keep:
        raise ValueError(f"column {name} exists; give a prefix")
    source = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, *[F.col(c).alias(a) for c, a in ((text, "__t"), (repository, "__repository"), (owner, "__owner"))])
    found = candidates(source, "__t")
    found = materialize(found.withColumn("spans", F.transform("spans", lambda s: s.withField("looks", looks_live(s["value"])).withField("value", F.sha2(s["value"], 256)))))
    owners = materialize(ownership(found, "__repository", "__owner"))
    exploded = found.where(F.size("spans") > 0).select("__row", F.explode("spans").alias("s")).select("__row", "s.*")
    # spans of one widely copied value may be hot: the join's large side can be split
    judged = exploded.join(owners, F.sha2(F.col("value"), 256) == F.col("value_hash"), "left")
    live = (F.coalesce(F.col("n_owners"), F.lit(0)) < copied_owners) & (F.coalesce(F.col("n_repositories"), F.lit(0)) < copied_repositories) & F.col("looks")
    judged = judged.where((F.col("kind") != "random") | live)
    span = F.struct("start", "ord", "end", "kind", F.col("value").alias("value_hash"), "n_owners", "n_repositories", live.alias("live"), (F.col("kind") != "random").alias("base"))
    by_row = judged.groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("__spans"))  # a row's own spans only
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,value_hash:string,n_owners:bigint,n_repositories:bigint,live:boolean,base:boolean>>)")
    with_spans = found.where(F.size("spans") > 0).join(by_row, "__row", "left").select(*keep, F.coalesce("__spans", none).alias(name))
    return found.where(F.size("spans") == 0).select(*keep, none.alias(name)).union(with_spans)
