"""Mixing sources to target weights (problem 9).

Entropy balancing: of all document rates whose tokens add up to a source's target, those nearest to 1 in relative entropy are exponential in the document's tokens,
``rate = min(exp(lambda_source * tokens / mean), max_repeats)``. The lambdas solve the convex dual by Newton steps, guarded by bisection; a step is one distributed aggregate over the histogram (source, tokens, documents), to which the
corpus is pre-aggregated (exact, as the rate depends on nothing else), and the state of all sources is a table too, so that neither documents nor sources are held by the driver. Rates become whole copies by systematic rounding along the documents' sizes, inside salted
blocks of a source, so that a block misses its tokens by a document at most and no source, however large, is sorted in one task: ``copies`` is ``floor(rate)`` or one more, on average the rate, and never above ``max_repeats``.

A source whose documents repeated ``max_repeats`` times fall short of its target gives all of that, which the report shows. Sources absent from the targets take no share; targets without documents
reach 0; null sources belong to none; null and blank texts have 0 tokens and are copied 0 times. Null weights count as 0, null caps as 1. A source named twice has its weights added and its larger cap. Repeated documents are documents each, tokenised once
in a task. Empty tables give empty results. Steps that don't settle are an error.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandkg.session import written

#: A file of ranks (``.tiktoken``) or of a tokenizer (``.json``), the same path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_ROWS = 200_000
TOLERANCE, MOST_STEPS = 1e-6, 200
#: Counts of repeated texts a task remembers; beyond that they are counted again.
REMEMBERED = 500_000
_SPACE = "[ \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space that the library's own splitting can't take: all but the last character of one are a piece by themselves.
_run = re.compile(f"({_SPACE}{{9999,}})(?={_SPACE}(?!{_SPACE}))")
_loaded: dict[str, Callable[[str], int]] = {}


def _counter(path: str) -> Callable[[str], int]:
    """How many tokens a text has; loaded once in a Python worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _loaded[path] = lambda text: sum(len(encode(part)) for part in (_run.split(text) if len(text) > 9999 else (text,)))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _loaded[path] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    return _loaded[path]


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of documents (doc_id, source, text) by the tokenizer file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = _counter(path), {}
        for batch in batches:
            counts = []
            for text in batch.column("text").to_pylist():
                if not text:
                    counts.append(0)
                    continue
                key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                if (n := known.get(key)) is None:
                    n = count(text)
                    if len(known) < REMEMBERED:
                        known[key] = n
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])

    slim = documents.select("doc_id", "source", F.when(F.trim("text") != "", F.col("text")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, source string, n_tokens long")


def _rate() -> F.Column:
    return F.when(F.col("n_tokens") > 0, F.least(F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(50.0))), F.col("cap"))).otherwise(0.0)


def _targets(targets: DataFrame) -> DataFrame:
    """(source, weight, cap) of (source, weight, max_repeats)."""
    weight, cap = F.coalesce("weight", F.lit(0.0)).cast("double"), F.coalesce("max_repeats", F.lit(1)).cast("double")
    return targets.where("source is not null").groupBy("source").agg(F.sum(weight).alias("weight"), F.max(cap).alias("cap"))


def _start(histogram: DataFrame, wanted: DataFrame, total: float | None) -> DataFrame:
    """The state of each source with tokens before the first step: its target, and lambda where that needs no search (all copies, or none)."""
    sums = histogram.where("n_tokens > 0").groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).cast("double").alias("tokens"), F.sum("n").alias("n"))
    state = written(sums.join(wanted, "source"), "sources")
    whole = state.agg(F.sum("weight")).first()[0] or 0.0
    share = F.col("weight") / F.lit(whole or 1.0)
    if total is None:
        total = state.where("weight > 0 and cap > 0").agg(F.min(F.col("tokens") * F.col("cap") / share)).first()[0] or 0.0
    target, most = F.lit(float(total)) * share, F.col("tokens") * F.col("cap")
    full, none = target >= most * (1 - 1e-12), target <= 0
    lam = F.when(none, -1e6).when(full, 1e6).otherwise(0.0)
    ends = [F.lit(x).alias(c) for c, x in (("low", -math.inf), ("high", math.inf))]
    return state.select("source", "weight", "cap", "n", (F.col("tokens") / F.col("n")).alias("mean"), target.alias("target"), lam.alias("lam"), *ends, (full | none).alias("done"))


def _step(histogram: DataFrame, state: DataFrame) -> DataFrame:
    """The state after one Newton step of every source that isn't done."""
    x, rate, lam = F.col("n_tokens"), F.col("rate"), F.col("lam")
    rated = histogram.join(state.where("not done").select("source", "lam", "mean", "cap"), "source").withColumn("rate", _rate())
    slope = F.when(rate < F.col("cap"), F.col("n") * rate * x * x / F.col("mean")).otherwise(0.0)
    sums = rated.groupBy("source").agg(F.sum(F.col("n") * rate * x).alias("got"), F.sum(slope).alias("slope"))
    off = F.col("got") - F.col("target")
    done = F.col("done") | F.coalesce(F.abs(off) <= TOLERANCE * F.col("target"), F.lit(False))
    low, high = F.when(~done & (off < 0), lam).otherwise(F.col("low")), F.when(~done & (off > 0), lam).otherwise(F.col("high"))
    moved = state.join(sums, "source", "left").select("*", off.alias("off"), low.alias("low2"), high.alias("high2"), done.alias("done2"))
    newton = F.when(F.col("slope") > 0, lam - F.col("off") / F.col("slope"))
    middle = F.when((F.col("low2") > -math.inf) & (F.col("high2") < math.inf), (F.col("low2") + F.col("high2")) / 2).otherwise(lam + F.when(F.col("off") < 0, 2.0).otherwise(-2.0))
    inside = F.coalesce((newton > F.col("low2")) & (newton < F.col("high2")), F.lit(False))
    to = F.when(F.col("done2"), lam).otherwise(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.when(inside, newton).otherwise(middle))))
    return moved.select("source", "weight", "cap", "n", "mean", "target", to.alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("done2").alias("done"))


def solve(histogram: DataFrame, wanted: DataFrame, total: float | None) -> DataFrame:
    """(source, weight, cap, n, mean, target, lam, ...) of the dual. ``histogram``: (source, n_tokens, n); ``wanted``: (source, weight, cap)."""
    state = written(_start(histogram, wanted, total), "state")
    for _ in range(MOST_STEPS):
        if state.where("not done").isEmpty():
            return state
        state = written(_step(histogram, state), "state")
    raise RuntimeError(f"the dual did not settle in {MOST_STEPS} steps")


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, copies) of all documents of target sources; report per target source).

    ``total``: the size asked for in tokens; where None, the largest that every source can serve within its ``max_repeats``.
    """
    wanted = written(_targets(targets), "targets")
    counted = written(count_tokens(documents.join(wanted.select("source"), "source", "left_semi"), path), "tokens")
    histogram = written(counted.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "histogram")
    state = solve(histogram, wanted, total)
    solved = state.select("source", "lam", "mean", "cap")
    rated = counted.join(solved, "source").withColumn("rate", _rate())
    blocks = max(1, math.ceil((state.agg(F.sum("n")).first()[0] or 0) / BLOCK_ROWS))
    place = F.xxhash64("doc_id", "n_tokens", F.lit(seed))
    block = Window.partitionBy("source", "block").orderBy("n_tokens", "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "block", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    part = rated.withColumn("place", place).withColumn("block", F.pmod(F.col("place"), F.lit(blocks))).withColumn("part", F.col("rate") - F.floor("rate"))
    run = part.withColumn("upto", F.round(F.sum("part").over(block), 9) + start)
    copies = (F.floor("rate") + F.floor("upto") - F.floor(F.round(F.col("upto") - F.col("part"), 9))).cast("int")
    mixed = run.select("doc_id", "source", "n_tokens", F.least(copies, F.col("cap").cast("int")).alias("copies"))
    sums = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.max("copies").alias("most_copies"))
    asked = wanted.join(state.select("source", "target"), "source", "left").select("source", "weight", F.col("cap").cast("int").alias("max_repeats"), F.coalesce("target", F.lit(0.0)).alias("target_tokens"))
    joined = written(asked.join(sums, "source", "left"), "report")
    all_tokens = F.lit(joined.agg(F.sum("actual_tokens")).first()[0] or 0)
    share = F.coalesce(F.try_divide(F.coalesce("actual_tokens", F.lit(0)), all_tokens), F.lit(0.0)).alias("actual_share")
    report = joined.select("source", "weight", "max_repeats", "target_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "available_tokens", "actual_tokens", "most_copies")], share)
    return mixed, report
