"""Evaluation passages leaking into training text (problem 8).

Winnowing: of every window of ``w`` hashes in a row of ``k`` letters the smallest is kept as a fingerprint, in the passages and in all documents, so two texts that share
``k + w - 1`` letters share a fingerprint of it for certain. Fingerprints of documents and passages are joined, each hit is extended to both sides, and the span counts when it reaches
``shared`` letters. With ``k + w - 1 <= shared`` no long enough span can be missed, and no shorter one gets through.

The join is on the fingerprint. The passages' side is the small one: its size is counted, fingerprints at 20 bytes each and the letters of every passage once, and while it stays under
``MAX_BYTES`` it is broadcast as sorted arrays, so that documents without a hit leave the scan at once and no document is shuffled. Beyond that size
the same rows meet in a shuffled join, where a frequent fingerprint splits by AQE; hits are then brought together per diagonal (document, passage, shift), of which a passage's length bounds the number.

Letters and digits only count (Unicode letters and numbers), case and width are equal. Null, blank and short texts and passages match nothing. Whole texts are read. Repeated documents
give rows each; repeated passages under several item ids too. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.llm.textarrays import blocks, code_points, window_hashes
from strandkg.session import written

SHARED, K = 60, 30
#: Bytes of fingerprints and passages that may be broadcast.
MAX_BYTES = 32_000_000
_other = re.compile(r"[\W_]+")
_wide = re.compile("[！-～ﾠ-ﾾ]")


def letters(text: str | None) -> str:
    """The letters and digits of ``text`` in one case and width."""
    if not text:
        return ""
    if _wide.search(text):
        text = "".join(unicodedata.normalize("NFKC", ch) if "！" <= ch <= "ￜ" else ch for ch in text)
    return _other.sub("", text.lower())


def fingerprints(texts: list[str], k: int = K, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of the winnowed fingerprints of texts of letters."""
    points, starts = code_points(texts)
    hashes, w = window_hashes(points, k), shared - k + 1
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[:n]
    crosses = np.arange(n) + k > starts[owner + 1]
    # High half of the hash, then the position from the end: the smallest of a window is its rightmost smallest hash, wherever the window lies.
    low = np.uint64(2**32 - 1)
    valued = np.where(crosses, np.uint64(2**64 - 1), (hashes & ~low) | (low - np.arange(n, dtype=np.uint64)))
    # The smallest of each w in a row, by doubling.
    width, least = 1, valued
    while width * 2 <= w:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - w + 1], least[w - width : w - width + n - w + 1])
    inside = np.arange(n - w + 1) + w - 1 + k <= starts[owner[: n - w + 1] + 1]
    # A position is kept when it is the least of some window that lies inside its text: of every window, so that repeated text keeps what the same text elsewhere keeps.
    kept = np.zeros(n, bool)
    kept[(low - (least[inside] & low)).astype(np.int64)] = True
    at = np.flatnonzero(kept)
    return owner[at], at - starts[owner[at]], hashes[at]


def spans(document: str, passage: str, hits: list[tuple[int, int]], shared: int = SHARED) -> bool:
    """Whether a span of ``shared`` equal letters grows from one of ``hits`` (position in document, in passage)."""
    grown: dict[int, int] = {}  # shift -> up to where in the document the span there was followed
    for i, j in sorted(hits):
        if i < grown.get(i - j, -1):
            continue
        a = b = 0
        while i - a > 0 and j - a > 0 and document[i - a - 1] == passage[j - a - 1]:
            a += 1
        while i + b < len(document) and j + b < len(passage) and document[i + b] == passage[j + b]:
            b += 1
        if a + b >= shared and b:
            return True
        grown[i - j] = i + b
    return False


def _prints(batches: Iterator[pa.RecordBatch], key: str, text: str, k: int, shared: int) -> Iterator[pa.RecordBatch]:
    """(key, at, print) of a column of letters."""
    for batch in batches:
        texts_all = [t or "" for t in batch.column(text).to_pylist()]
        for part in blocks([len(t) for t in texts_all]):
            owner, at, hashes = fingerprints(texts_all[part], k, shared)
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(part.start).take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(hashes.view(np.int64))], names=[key, "at", "print"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = pa.array([letters(t) for t in batch.column("passage").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("item_id").cast(pa.int64()), folded], names=["pid", "item_id", "letters"])


def find_leaks(documents: DataFrame, passages: DataFrame, shared: int = SHARED, k: int = K, most: int = MAX_BYTES) -> DataFrame:
    """(doc_id, item_id) where ``shared`` letters in a row of a passage occur in a document.

    ``documents``: (doc_id, text); ``passages``: (item_id, passage).
    """
    numbered = passages.where("item_id is not null and passage is not null").select(F.monotonically_increasing_id().alias("pid"), "item_id", "passage")
    held = written(numbered.mapInArrow(_folded, "pid long, item_id long, letters string"), "passages").where(F.length("letters") >= shared)
    prints = written(held.select("pid", "letters").mapInArrow(lambda batches: _prints(batches, "pid", "letters", k, shared), "pid long, at int, print long"), "prints")
    size = 20 * prints.count() + held.agg(F.coalesce(F.sum(F.octet_length("letters") + 60), F.lit(0))).first()[0]
    texts = documents.select("doc_id", "text").where("text is not null")
    if size <= most:
        return texts.mapInArrow(_matcher(held.toPandas(), prints.toPandas(), documents.sparkSession, shared, k), "doc_id long, item_id long")
    return _joined(texts, held, prints, shared, k)


def _matcher(held, prints, spark, shared: int, k: int):  # noqa: ANN001, ANN202
    """``held`` (pid, item_id, letters) and ``prints`` (pid, at, print) as one broadcast: each passage once, the fingerprints sorted."""
    held = held.sort_values("pid")
    order = np.argsort(prints["print"].to_numpy(), kind="stable")
    of = np.searchsorted(held["pid"].to_numpy(), prints["pid"].to_numpy()[order]).astype(np.int32)
    sent = spark.sparkContext.broadcast((prints["print"].to_numpy()[order], of, prints["at"].to_numpy()[order].astype(np.int32), held["item_id"].to_numpy(), held["letters"].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of, ats, items, passages = sent.value
        for batch in batches:
            folded_all, ids_all = [letters(t) for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            for part in blocks([len(t) for t in folded_all]):
                folded, ids = folded_all[part], ids_all[part]
                owner, at, hashes = fingerprints(folded, k, shared)
                left = np.searchsorted(keys, hashes.view(np.int64), "left")
                right = np.searchsorted(keys, hashes.view(np.int64), "right")
                hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for x in np.flatnonzero(right > left):
                    for y in range(left[x], right[x]):
                        hits[int(owner[x]), int(of[y])].append((int(at[x]), int(ats[y])))
                # A document counts once per item, however many passages the item has.
                both = dict.fromkeys((d, int(items[p])) for (d, p), places in hits.items() if spans(folded[d], passages[p], places, shared))
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in both], pa.int64()), pa.array([i for _, i in both], pa.int64())], names=["doc_id", "item_id"])

    return run


def _joined(texts: DataFrame, held: DataFrame, prints: DataFrame, shared: int, k: int) -> DataFrame:
    """The same by a shuffled join of fingerprints, for passages of any size. Only the fingerprints of documents are shuffled for the join; their texts follow for those with hits."""

    def document_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = pa.array([letters(t) for t in batch.column("text").to_pylist()], pa.string())
            yield from _prints(iter([pa.RecordBatch.from_arrays([batch.column("row"), folded], names=["row", "letters"])]), "row", "letters", k, shared)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "item_id", "text", "letters", "shift", "ats")), strict=True)
            found = [(r, d, i) for r, d, i, text, passage, shift, ats in rows if spans(letters(text), passage, [(at, at - shift) for at in ats], shared)]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["row", "doc_id", "item_id"])

    rows = written(texts.withColumn("row", F.expr("uuid()")), "documents")
    made = rows.select("row", "text").mapInArrow(document_prints, "row string, at int, print long")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    hits = made.join(prints.select("pid", F.col("at").alias("item_at"), "print"), "print").select("row", "pid", shift, "at").groupBy("row", "pid", "shift").agg(F.collect_list("at").alias("ats"))
    found = hits.join(rows, "row").join(held, "pid").select("row", "doc_id", "item_id", "text", "letters", "shift", "ats")
    return found.mapInArrow(verify, "row string, doc_id long, item_id long").distinct().select("doc_id", "item_id")
