"""Near-duplicate records with small edits (problem 7).

MinHash LSH forest. Every text in plain form is a set of its runs of ``WIDTH`` characters. Its signature has ``TREES`` paths of ``LEVELS`` min-hashes, a byte of each: one number
a tree, so that the numbers in sorted order are the leaves of a prefix trie and those that share a prefix stand together. Two texts meet where the prefixes of one of their paths are equal.

Prefixes start at full depth and are shortened adaptively. The pairs found and verified at one depth, each counted as many times as pairs of its similarity are found at that depth (``hit_chance``), estimate
how many there are in truth, and from this what share any other depth would find; one pair more is supposed in every class of similarity, so that few finds prove little. While the estimate is
below the target, the longest prefix that is expected to reach it comes next, and only pairs not yet seen are verified. So a collection of very similar copies stays at long prefixes, which keep unlike texts
apart however many there are, and one whose pairs lie near the threshold goes to short ones. Verification is exact, on the whole texts; before it only pairs are dropped whose numbers of distinct
runs rule out the threshold, which loses nothing.

Scale: exact copies (equal in plain form) are set aside first by a pre-aggregated minimum, so a text repeated for a third of all rows takes part once; only its
membership is kept. Prefixes meet in an equi-join, so that AQE splits a hot one; nothing is collected per prefix, none is
capped. Which texts must move for verification is told by a bit map of a byte a text at most 16 MB; where there are too many for it, all texts move once.

Null texts and texts shorter than ``WIDTH`` have no runs and are in no pair. Repeated rows are pairs. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.functions.plaintext import plain_form
from strandkg.llm.textarrays import blocks, code_points, distinct, mixed, window_hashes
from strandkg.session import written

WIDTH, THRESHOLD, TREES, TARGET = 3, 0.7, 25, 0.9995
#: Levels of a path: one byte each of a number of 64 bits.
LEVELS = 8
#: Classes of similarity from the threshold to 1, for the estimate.
CLASSES = 15
LARGEST_MAP = 1 << 27


def hit_chance(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """The chance that two texts of that similarity share a prefix of that depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def expected_recall(found: np.ndarray, at: int, depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """The share of all similar pairs that prefixes of ``depth`` are expected to find, by the pairs of each class of similarity ``found`` by prefixes of depth ``at``."""
    lowest = threshold + (1 - threshold) * np.arange(CLASSES) / CLASSES
    true = found / hit_chance(lowest, at, trees) + 1
    return float((true * hit_chance(lowest, depth, trees)).sum() / true.sum())


def next_depth(found: np.ndarray, at: int, target: float = TARGET, threshold: float = THRESHOLD, trees: int = TREES) -> int | None:
    """The longest shorter prefix expected to reach the target (1, where none is); None where ``at`` reaches it."""
    if at == 1 or expected_recall(found, at, at, threshold, trees) >= target:
        return None
    return next((d for d in range(at - 1, 1, -1) if expected_recall(found, at, d, threshold, trees) >= target), 1)


def signatures(texts: list[str], trees: int = TREES, width: int = WIDTH, seed: int = 1) -> np.ndarray:
    """(texts x trees) paths of texts that have one run at least; the first level is the highest byte."""
    k = trees * LEVELS
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)
    points, starts = code_points(texts)
    hashes = (window_hashes(points, width) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((k, len(texts)), np.uint32)
    chunk, first = 1 << 15, 0
    buffer = np.empty(0, np.uint32)
    while first < len(texts):  # as many texts at a time as stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + chunk, "right")) - 1)
        kept = np.concatenate([hashes[starts[i] : starts[i + 1] - width + 1] for i in range(first, last)])
        at = np.concatenate([[0], np.cumsum(np.diff(starts[first : last + 1])[:-1] - width + 1)])
        if len(buffer) < len(kept):
            buffer = np.empty(len(kept), np.uint32)
        out = buffer[: len(kept)]
        for i in range(k):
            np.multiply(kept, factors[i], out=out)
            np.add(out, shifts[i], out=out)
            least[i, first:last] = np.minimum.reduceat(out, at)
        first = last
    paths = np.zeros((trees, len(texts)), np.uint64)
    for i in range(k):
        tree = i // LEVELS
        paths[tree] = (paths[tree] << np.uint64(8)) | (mixed(least[i].astype(np.uint64) + np.uint64(i)) & np.uint64(255))
    return paths.T


_SIGNED = pa.schema([("id", pa.int64()), ("same", pa.int64()), ("same2", pa.int64()), ("n", pa.int32()), ("paths", pa.list_(pa.int64()))])


def _sign(texts: list[str], ids: pa.Array, trees: int) -> pa.RecordBatch:
    paths = signatures(texts, trees)
    digests = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
    same = np.frombuffer(digests, np.int64).reshape(-1, 2)
    flat = pa.ListArray.from_arrays(np.arange(0, (len(texts) + 1) * trees, trees, dtype=np.int32), pa.array(np.ascontiguousarray(paths).view(np.int64).ravel()))
    n = [len(x) for x in _codes(*code_points(texts))]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(same[:, i])) for i in (0, 1)), pa.array(n, pa.int32()), flat], schema=_SIGNED)


def _signed(trees: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [plain_form(t) for t in batch.column("text").to_pylist()]
            keep = [i for i, t in enumerate(texts) if len(t) >= WIDTH]
            texts, ids = [texts[i] for i in keep], batch.column("id").take(pa.array(keep, pa.int64()))
            for part in blocks([len(t) for t in texts]):
                yield _sign(texts[part], ids.slice(part.start, part.stop - part.start), trees)

    return run


def _bit_map(ids: DataFrame, size: int) -> np.ndarray:
    """A bit map of ``size`` bits that has the bit of each id's hash: built by a distributed aggregate of rows of 4 KB."""
    spot = F.pmod(F.xxhash64("id"), F.lit(size))
    rows = ids.select(spot.alias("spot")).groupBy(F.expr("bitmap_bucket_number(spot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits")).collect()
    out = np.zeros(size // 8 + 8192, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(part)] |= part
    return out


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, text) that ``ids`` may hold, by the bit map; rows beyond do no harm."""
    size = 1 << max(16, (8 * ids.count()).bit_length())
    if size > LARGEST_MAP:
        return texts.select("id", "text")
    bits = _bit_map(ids, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            # Bucket numbers start at 1 and bit positions at 0 for the spot 1; bucket 0 holds spot 0 only.
            number, position = np.where(spot > 0, 1 + (spot - 1) // 32768, 0), np.where(spot > 0, (spot - 1) % 32768, 0)
            byte = (number - 1) * 4096 + position // 8
            hit = (bits[np.maximum(byte, 0)] >> (position % 8)) & 1
            mask = pa.array((hit == 1) | (spot == 0))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(mask), batch.column("text").filter(mask)], names=["id", "text"])

    spot = F.pmod(F.xxhash64("id"), F.lit(size)).cast("long").alias("spot")
    return texts.select("id", "text", spot).mapInArrow(run, "id long, text string")


def _codes(points: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The distinct runs of each text, sorted: three code points of 21 bits each make one exact number."""
    p = points.astype(np.uint64)
    runs_ = (p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:] if len(p) > 2 else p[:0]
    return [distinct(runs_[starts[i] : max(starts[i], starts[i + 1] - WIDTH + 1)]) for i in range(len(starts) - 1)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _verify(threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text_a, text_b = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            lengths = pc.add(pc.utf8_length(text_a), pc.utf8_length(text_b)).to_pylist()
            for part in blocks(lengths):
                at = range(part.start, part.stop)
                sides: dict[int, str] = {}
                for ids, texts in ((a, text_a), (b, text_b)):
                    for i in at:
                        if (x := ids[i].as_py()) not in sides:
                            sides[x] = plain_form(texts[i].as_py())
                known = dict(zip(sides, _codes(*code_points(list(sides.values()))), strict=True))
                found = []
                for i in at:
                    x, y = a[i].as_py(), b[i].as_py()
                    both = _common(known[x], known[y])
                    if both and (s := both / (len(known[x]) + len(known[y]) - both)) >= threshold:
                        found.append((x, y, s))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


def _candidates(leaves: DataFrame, depth: int, threshold: float, seen: DataFrame | None) -> DataFrame:
    """(a, b) of the texts, a < b, that share a prefix of that depth in some tree, may be similar enough by their numbers of runs and were not ``seen``."""
    # Tree and prefix as one number: should two ever get the same, verification tells them apart.
    node = F.xxhash64("tree", F.shiftrightunsigned("path", 8 * (LEVELS - depth))).alias("node")
    left = leaves.select(F.col("id").alias("a"), F.col("n").alias("n_a"), node)
    right = left.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"), "node")
    enough = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold)
    pairs = left.join(right, "node").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    return written(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "candidates")


def _verified(candidates: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    needed = _needed(texts, candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    with_b = candidates.join(needed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold), "a long, b long, similarity double"), "verified")


def near_duplicates(texts: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives: a < b, similarity; membership: id, rep) of ``texts`` (id, text), ids unique.

    A representative is the smallest id of the texts equal in plain form. Every pair of rows that is similar follows from the
    two tables: rows of one representative, and rows of two paired ones.
    """
    texts = texts.select("id", "text").where("id is not null and text is not null")
    signed = written(texts.mapInArrow(_signed(trees), "id long, same long, same2 long, n int, paths array<long>"), "signatures")
    reps = signed.groupBy("same", "same2").agg(F.min("id").alias("rep"))
    members = written(signed.select("id", "same", "same2").join(reps, ["same", "same2"]).select("id", "rep"), "members")
    copies = members.where("id <> rep").select("id")
    leaves = signed.join(copies, "id", "left_anti").select("id", "n", F.posexplode("paths").alias("tree", "path"))
    depth, seen, pairs = LEVELS, None, None
    step = (1 - threshold) / CLASSES
    while depth is not None:
        new = _candidates(leaves, depth, threshold, seen)
        seen = new if seen is None else seen.unionByName(new)
        verified = _verified(new, texts, threshold)
        pairs = verified if pairs is None else pairs.unionByName(verified)
        place = F.least(F.floor((F.col("similarity") - threshold) / step + 1e-9), F.lit(CLASSES - 1)) if step > 0 else F.lit(0)
        found = np.zeros(CLASSES)
        for r in pairs.groupBy(place.cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n")).collect():
            found[r["place"]] = r["n"]
        depth = next_depth(found, depth, target, threshold, trees)
    return pairs, members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of similar rows (id_a < id_b): the expansion of representatives, only as large as the answer."""
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copies = members.join(several, "rep", "left_semi")
    one, two = copies.select(F.col("id").alias("x"), "rep"), copies.select(F.col("id").alias("y"), "rep")
    within = one.join(two, "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id in it) of the ends of ``edges`` (a, b), by alternating large and small stars until nothing changes; each round is written and read again."""
    links = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    state = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        links = written(small, "links")
    roots = links.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return links.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per text: id, its group (the smallest id of all texts linked to it) and the number of other representatives it is linked to."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    joined = members.join(components(pairs).withColumnRenamed("id", "rep"), "rep", "left").join(ends, "rep", "left")
    return joined.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
