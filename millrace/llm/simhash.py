"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside buckets, components over the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import keeping
from millrace.llm.textbatch import BATCH_BYTES, pieces, trimmed
from millrace.operators.components import component_labels
from millrace.plans.materialize import broadcast_if_small, free, materialize, shuffle_parts

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingles hashed at once; a longer text is summed in steps.
STEP = 1 << 18
#: Bins of a text's parity sketch.
BINS = 512
#: Distances in a bucket at which members of unlike classes meet, round after round.
ROUNDS = ((0, 16), (16, 256), (256, None))
#: Pairs of a row and a 64-lane word compared at once, and fingerprints of one bucket compared in one task.
TILE, BUCKET = 1 << 15, 1 << 15


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 hashes (seed 42) of the ``width``-word shingles of the text, STEP at a time.

    Letters A-Z are lower-cased, words are runs of anything but the six ASCII spaces, shingles keep repeats; a text of fewer words
    is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        to = min(n, at + STEP)
        yield np.array([digest(body[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is 1 if set in over half the hashes of the shingles of the text; a text without words has fingerprint 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        ones += _bits(h)
        n += len(h)
    return _majority(ones, n)


def fingerprints(docs: DataFrame, text: str, keep: list[str], width: int = 4) -> DataFrame:
    """``keep`` and the fingerprint as a signed long, column ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width) for _, texts in pieces(batch, "__text") for t in texts]
            rest = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*[x for x in batch.schema.names if x != "__text"], "fp"])

    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("__text").schema)
    return source.mapInArrow(trimmed(run), f"{fields}fp long")


# --- comparison ---------------------------------------------------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Vertical layout: planes[j, w] holds bit j of fingerprints 64w to 64w+63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int, nearest: bool = False) -> np.ndarray:
    """For query i and the 64 lanes of word ``words[i]``: the bits of the lanes in ``lanes[i]`` at distance ``radius`` or less.

    All 64 distances of a word advance together: each plane's difference is added by carry-save to bitwise counters, and a word
    is abandoned once all its lanes exceed the radius. With ``nearest``, only the lanes at the least distance of the word stay, and
    a second array has that distance (64 where there is none).
    """
    depth = int(radius + 1).bit_length()
    start = np.uint64((1 << depth) - 1 - radius)  # counters start so that exceeding the radius overflows them
    alive = np.flatnonzero(lanes)
    out = np.zeros(len(queries), np.uint64)
    counters = [np.full(len(alive), ALL if (int(start) >> b) & 1 else np.uint64(0)) for b in range(depth)]
    over = ~lanes[alive]
    for j in range(64):
        carry = planes[j, words[alive]] ^ (np.uint64(0) - ((queries[alive] >> np.uint64(j)) & ONE))
        for b in range(depth):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if j % 4 == 3:
            left = over != ALL
            if not left.all():
                alive, over = alive[left], over[left]
                counters = [c[left] for c in counters]
                if not len(alive):
                    break
    out[alive] = ~over
    if not nearest:
        return out
    # the least counter of the lanes that are left, from its highest bit down
    best, distance = ~over, np.zeros(len(alive), np.int64)
    for b in reversed(range(depth)):
        low = best & ~counters[b]
        best = np.where(low != 0, low, best)
        distance += np.where(low != 0, 0, 1 << b)
    out[alive] = best
    least = np.full(len(queries), 64)
    least[alive[best != 0]] = distance[best != 0] - int(start)
    return out, least


def _links(keys: np.ndarray, fps: np.ndarray, radius: int, labels: np.ndarray | None = None, low: int = 0, high: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one key (keys are sorted) at distance ``radius`` or less, tile by tile.

    With ``labels``, only pairs of unlike labels; they are more than ``low`` and, if given, at most ``high`` places apart.
    """
    n = len(fps)
    planes = bit_planes(fps)
    begin, end = np.arange(n) + 1 + low, np.searchsorted(keys, keys, "right")
    if high is not None:
        end = np.minimum(end, np.arange(n) + 1 + high)
    if labels is not None:
        padded = np.zeros(planes.shape[1] * 64, np.int64)
        padded[:n] = labels
        padded = padded.reshape(-1, 64)
    spans = np.where(end > begin, (end - 1) // 64 - begin // 64 + 1, 0)
    rows = np.flatnonzero(spans)
    done = np.concatenate([[0], np.cumsum(spans[rows])])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(done, done[at] + TILE, "right")) - 1)
        mine, count = rows[at:to], spans[rows[at:to]]
        i = np.repeat(mine, count)
        word = np.repeat(begin[mine] // 64, count) + np.arange(len(i)) - np.repeat(done[at:to] - done[at], count)
        first = np.clip(begin[i] - word * 64, 0, 63).astype(np.uint64)
        last = np.clip(end[i] - word * 64, 1, 64).astype(np.uint64)
        lanes = (ALL << first) & (ALL >> (np.uint64(64) - last))
        if labels is not None:
            lanes &= np.packbits(padded[word] != labels[i][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
        hit = within(fps[i], planes, word, lanes, radius)
        some = np.flatnonzero(hit)
        if len(some):
            bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(bits)
            yield i[some[r]], word[some[r]] * 64 + lane
        at = to


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs into ``root``, where each root is the least index of its set."""
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp) sorted by key: to each linked fingerprint, the first one of its local component."""

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = np.arange(len(fp))
        for a, b in _links(key, fp, radius):
            _join(root, a, b)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        held.append((key, fp))
        if key[0] == key[-1] or len(key) < 2:  # a bucket that goes on; its size is bounded by the split of large ones
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(key, key[-1]))
        held = [(key[cut:], fp[cut:])]
        yield solve(key[:cut], fp[:cut])
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _pieces_of(n: int, radius: int) -> tuple[int, int]:
    """Into how many pieces to cut 64 bits, and how many of them a key joins: at radius r, some pieces - r are equal.

    More fingerprints take longer keys, so that buckets stay small; links are exact for any choice.
    """
    for extra in range(1, 5):
        if (64 * extra) // (radius + extra) >= np.log2(max(2, n)) - 1 or extra == 4:
            return radius + extra, extra
    raise AssertionError


def _deal(keyed: DataFrame) -> DataFrame:
    """Rows (key, fp, ...) sorted by key; buckets above a bound are dealt over blocks, each pair of blocks under a key of its own."""
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    large = materialize(large.select("key", F.ceil(F.col("n") / (BUCKET // 2)).cast("int").alias("blocks")))
    if not large.isEmpty():
        columns = keyed.columns
        block = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = keyed.join(large, "key", "left").withColumn("mine", block).withColumn("other", other)
        key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        keyed = dealt.withColumn("key", key).select(*columns)
    # a key met once has nothing to compare: rows of one key are adjacent after the sort
    return keyed.repartition(shuffle_parts(keyed.sparkSession), "key").sortWithinPartitions("key", "fp")


def link_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column ``fp``) whose components are those of all links at ``radius`` or less.

    By the pigeonhole principle two linked fingerprints agree in some combination of pieces; each combination is a bucket key.
    Inside a bucket all are compared, bit-sliced, and only a star of each local component leaves it, so a dense group gives as
    many rows as members. Buckets above a bound are dealt over tasks by blocks, each pair of blocks compared once.
    """
    count, join = _pieces_of(fps.count(), radius)
    bounds = [64 * i // count for i in range(count + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(count), join)):
        mask = sum(((1 << (bounds[p + 1] - bounds[p])) - 1) << bounds[p] for p in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask))))
    keyed = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    return _deal(keyed).mapInArrow(trimmed(lambda it: _compare(it, radius)), "a long, b long").distinct()


@keeping("fingerprint", "component_id")
def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (``doc_id`` by default) with ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc id reachable).

    Documents are linked at ``radius`` differing bits or fewer; texts without words have fingerprint 0 and are linked like any
    other. Null ids are ignored in the minimum, so a component of null ids has a null id. Repeated rows stay repeated.
    """
    keep = [doc_id] if keep is None else keep
    names = [f"{prefix}fingerprint", f"{prefix}component_id"]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    rows = docs.select(*keep, F.col(doc_id).alias("__id"), F.col(text).alias("__t"))
    rows = materialize(fingerprints(rows, "__t", [*keep, "__id"], width))
    unique = materialize(rows.groupBy("fp").agg(F.min("__id").alias("low")))
    labels = component_labels(link_fingerprints(unique.select("fp"), radius))
    classes = unique.join(labels, unique["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component"))
    found = classes.join(lowest, "root").select("fp", "component")
    return rows.join(found, "fp").select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(names[0]), F.col("component").alias(names[1]))


# --- texts of a least similarity ------------------------------------------------------------------------------------------------


def _sketch(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Adds the fingerprint ``fp`` and ``bands`` hashes of ``rows`` min-hashes each to the columns but the last, the text."""
    rng = np.random.default_rng(5)
    factor, shift = (rng.integers(0, 1 << 63, bands * rows, np.uint64) << ONE | ONE for _ in range(2))
    for batch in batches:
        fps, keys = [], []
        for _, texts in pieces(batch, batch.schema.names[-1]):
            for text in texts:
                ones, n, least = np.zeros(64, np.int64), 0, np.full(bands * rows, ALL)
                for h in shingle_hashes(text, width):
                    ones += _bits(h)
                    n += len(h)
                    h = np.unique(h)
                    for k in range(bands * rows):
                        x = h * factor[k] + shift[k]
                        least[k] = min(least[k], (x ^ (x >> np.uint64(29))).min())
                fps.append(_majority(ones, n))
                keys.append(least)
        band = np.array(keys, np.uint64).reshape(-1, bands, rows)
        key = np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.zeros((len(band), 1), np.uint64)
        for k in range(rows):
            key = (key ^ band[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        lists = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32) if key.size else np.zeros(len(band) + 1, np.int32), pa.array(key.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=[*batch.schema.names[:-1], "fp", "bands"])


def _nearest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, id, label) sorted by key to (a, b): each row's nearest one of its bucket of another label, a < b."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, fp, id_, label = (table.column(c).to_numpy() for c in ("key", "fp", "id", "label"))
        n = len(key)
        queries, planes = fp.view(np.uint64), bit_planes(fp.view(np.uint64))
        labels = np.zeros(planes.shape[1] * 64, np.int64)
        labels[:n] = label
        labels = labels.reshape(-1, 64)
        low, high = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
        best, partner = np.full(n, 64), np.full(n, -1)
        rows = np.flatnonzero(high - low > 1)
        spans = (high[rows] - 1) // 64 - low[rows] // 64 + 1
        done = np.concatenate([[0], np.cumsum(spans)])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(done, done[at] + TILE, "right")) - 1)
            count = spans[at:to]
            i = np.repeat(rows[at:to], count)
            word = np.repeat(low[rows[at:to]] // 64, count) + np.arange(len(i)) - np.repeat(done[at:to] - done[at], count)
            first = np.clip(low[i] - word * 64, 0, 63).astype(np.uint64)
            last = np.clip(high[i] - word * 64, 1, 64).astype(np.uint64)
            lanes = (ALL << first) & (ALL >> (np.uint64(64) - last))
            lanes &= np.packbits(labels[word] != label[i][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
            hit, distance = within(queries[i], planes, word, lanes, radius, nearest=True)
            some = np.flatnonzero(hit)
            # of each row's words the one of least distance, and of it the first lane
            some = some[np.lexsort((word[some], distance[some], i[some]))]
            some = some[np.concatenate([[True], i[some][1:] != i[some][:-1]])] if len(some) else some
            lane = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").argmax(1) if len(some) else some
            best[i[some]], partner[i[some]] = distance[some], word[some] * 64 + lane
            at = to
        found = np.flatnonzero(partner >= 0)
        a, b = id_[found], id_[partner[found]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy()
        if key[0] == key[-1]:  # a bucket that goes on; its size is bounded by the split of large ones
            continue
        table = pa.Table.from_batches(held)
        cut = len(table) - int((key == key[-1]).sum())
        held = table.slice(cut).to_batches()
        yield solve(table.slice(0, cut))
    if held:
        yield solve(pa.Table.from_batches(held))


def _others(batches: Iterator[pa.RecordBatch], radius: int, similarity: float, low: int, high: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, id, label, n, sketch) sorted by key to (a, b), a < b: all members of a bucket of unlike labels that may be alike.

    They must be near by fingerprint, and the bins in which their sketches differ, no more than the shingles that only one of them
    has, must not be too many for the similarity.
    """
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, fp, id_, label, n = (table.column(c).to_numpy() for c in ("key", "fp", "id", "label", "n"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(key), -1)
        for i, j in _links(key, fp.view(np.uint64), radius, label, low, high):
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
            may = apart <= (n[i] + n[j]) * (1 - similarity) / (1 + similarity) + 1e-6
            a, b = id_[i[may]], id_[j[may]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy()
        if key[0] == key[-1]:  # a bucket that goes on; its size is bounded by the split of large ones
            continue
        table = pa.Table.from_batches(held)
        cut = len(table) - int((key == key[-1]).sum())
        held = table.slice(cut).to_batches()
        yield from solve(table.slice(0, cut))
    if held:
        yield from solve(pa.Table.from_batches(held))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, n, its distinct shingles as four bytes each, a sketch: which of BINS hold an odd number of them)."""
    for batch in batches:
        sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t.as_py(), width)]) >> np.uint64(32)).astype(np.uint32) for t in batch.column(1)]
        sketch = [np.packbits(np.bincount((x % BINS).astype(np.int64), minlength=BINS) & 1).tobytes() for x in sets]
        out = [pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(sketch, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["id", "n", "shingles", "sketch"])


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, shingles of a, of b) to the (a, b) of that Jaccard similarity or more; two empty sets are alike."""
    for batch in batches:
        ok = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint32) for k in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= similarity * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each pair of leading keys in a batch: copies are not shuffled."""
    for batch in batches:
        seen = dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(seen) < batch.num_rows:
            first: dict = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                first.setdefault(key, i)
            batch = batch.take(pa.array(list(first.values()), pa.int64()))
        yield batch


@keeping("component_id", "component")
def similar_texts(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = 5,
    similarity: float = 0.8,
    bands: int = 8,
    band_rows: int = 3,
    radius: int = 24,
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """``keep`` columns (``doc_id`` by default) with ``component_id`` (smallest doc id reachable) and ``component`` (its number).

    Documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more; it is verified
    for every link. At 0.8, fingerprints differ in some 10 of 64 bits, too many for pigeonhole keys, so the buckets here are bands
    of min-hashes, of which two such texts share one with probability 0.997. In a bucket each text first meets the nearest one by
    fingerprint, bit-sliced, within ``radius`` bits (five standard deviations above what such texts differ in); those verified are
    one class. Then all members of unlike classes meet that are so near, by ROUNDS of growing distance in the bucket, of which
    the last has no end: no two that share a bucket stay apart unless they were refused.

    Equal texts are one text. Texts without words are alike. Null ids are ignored in the minimum, so a component of null ids has a
    null id; ``component`` tells it apart all the same. Repeated rows stay repeated.
    """
    keep = [doc_id] if keep is None else keep
    names = [f"{prefix}component_id", f"{prefix}component"]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.xxhash64(body).alias("__k1"), F.xxhash64(F.lit("b"), body).alias("__k2")]
    source = docs.select(*keep, F.col(doc_id).alias("__id"), *key, body.alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("__text").schema)
    rows = materialize(source.mapInArrow(trimmed(lambda it: _sketch(it, width, bands, band_rows)), f"{fields}fp long, bands array<bigint>"), batch_bytes=BATCH_BYTES)
    unique = rows.groupBy("__k1", "__k2").agg(F.min("__id").alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    unique = materialize(unique.withColumn("id", F.monotonically_increasing_id()))
    keyed = unique.select(F.explode("bands").alias("key"), "fp", "id")
    # buckets of one text have nothing to compare
    shared = keyed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    keyed = materialize(keyed.join(shared, "key", "left_semi"))

    pairs = materialize(_deal(keyed.withColumn("label", F.col("id"))).mapInArrow(trimmed(lambda it: _nearest(it, radius)), "a long, b long").distinct())
    # all texts that have a near one meet it in the first round
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(unique.select("id", "__k1", "__k2"), "id")
    once = source.select("__k1", "__k2", "__text").mapInArrow(trimmed(_first_rows), "__k1 long, __k2 long, __text string")
    found = once.join(broadcast_if_small(wanted), ["__k1", "__k2"]).select("id", "__text").mapInArrow(trimmed(lambda it: _sets(it, width)), "id long, n int, shingles binary, sketch binary")
    content = materialize(found.dropDuplicates(["id"]), batch_bytes=BATCH_BYTES)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(content.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(content.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return materialize(both.select("a", "b", "x", "y").mapInArrow(trimmed(lambda it: _alike(it, similarity)), "a long, b long"), batch_bytes=BATCH_BYTES)

    labels, tried = component_labels(verified(pairs)), pairs
    for low, high in ROUNDS:
        labelled = keyed.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "fp", "id", F.coalesce("label", "id").alias("label"))
        labelled = materialize(labelled)
        mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
        open_ = labelled.join(mixed, "key", "left_semi").join(content.select("id", "n", "sketch"), "id").select("key", "fp", "id", "label", "n", "sketch")
        near = _deal(open_).mapInArrow(trimmed(lambda it, low=low, high=high: _others(it, radius, similarity, low, high)), "a long, b long").distinct()
        pairs = materialize(near.join(tried, ["a", "b"], "left_anti"))
        new, tried = verified(pairs), tried.union(pairs)
        if not new.isEmpty():
            labels = component_labels(new.union(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
        free(labelled, new)
    free(keyed, content)
    classes = unique.select("__k1", "__k2", "low", "id")
    classes = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("label", "id"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component"))
    found = classes.select("__k1", "__k2", "root").join(lowest, "root")
    return rows.join(found, ["__k1", "__k2"]).select(*keep, F.col("component").alias(names[0]), F.col("root").alias(names[1]))
