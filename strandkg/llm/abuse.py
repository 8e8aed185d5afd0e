"""Abusive, hateful and sexual content (problem 10).

Per category a cumulative-link ordinal regression predicts how severely a document offends: 0 not at all, 1 in one sentence, 2 in several.
P(grade >= k) = logistic(w.x - theta_k) with one weight vector ``w`` for both thresholds; the severity put out is the expected grade. ``x`` are sparse features only: hashed character
n-grams of the document's two telling sentences (the second only where it offends by itself), and a few cues of form. There are no word lists and no prior weights: what offends is learned from the labels.

Labels are few and belong to documents, so the fit is multiple-instance. A document that lacks the category is represented by the sentences that look worst, mined round by round; one that has it by the sentence of highest
score and, where another one reaches the first threshold too, by both, which makes it a document of grade 2. Before any weights exist a sentence scores by the share of its n-grams that no document
without the category has. Only n-grams of documents with a category have weights, so the model stays small. The fit takes at most ``MAX_LABELLED`` labelled documents (chosen by
a hash of their id) to the driver; all documents are scored, whole, each where it is: no shuffle, so no hot source.

Texts are read as a reader would: markup, accents, width and invisible characters taken out, quoted words left out, marks put between the characters of a word removed, figures standing for letters read as letters.

Null and blank texts score 0 and contain nothing. Undecided (null) labels and labels of unknown documents are left out; without labels nothing is found. Repeated documents and labels count each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.llm.textarrays import blocks, code_points, window_hashes

CATEGORIES = ("abuse", "hate", "sexual")
MAX_LABELLED = 6000
BITS = 20
#: The bucket of no n-gram.
NONE = 1 << BITS
NGRAMS = (1, 2, 3, 4, 6)
#: Cues of form: patterns of linear time over readable sentences.
CUES = (r"[0-9]", r"[!?]", r"你|您|\byou\b|\byour\b", r"[a-z]", r"^.{0,12}$")
#: Starting thresholds, the least the first one may become (so that a sentence of unknown n-grams alone is never found), and the pull of the weights towards 0.
THETA, LOWEST, DECAY = (1.0, 4.0), 0.3, 2e-5
#: Of the fit: rounds of mining, sentences mined in a round for each document with the category (and as a least number), steps in a round.
ROUNDS, MINED, LEAST, STEPS = 4, 2, 500, 120
#: Characters of labelled text worked on at a time in the fit.
FIT_BLOCK = 200_000

_markup = re.compile(r"<[^<>]*>")
_sentence = re.compile(r"[^。！？!?；\n]+[。！？!?；]*[”」』]?")
_english = re.compile(r"(?<=[a-z0-9)\"'][.;])\s+")
_quoted = re.compile(r"[“\"「『«][^“”\"「」『』«»]*[”\"」』»]")
_between = re.compile(r"(?<=[一-鿿])[\s./\\丶·•|~^*_、\-–—]{1,2}(?=[一-鿿])")
_spelled = re.compile(r"(?<![^\W_])(?:[^\W_][\-.*_ /·]){2,}[^\W_](?![^\W_])")
_leet = str.maketrans("013457@$!", "oieastasi")
_leet_word = re.compile(r"(?<![\w@$])(?=[a-z0-9@$!-]*[a-z])(?=[a-z0-9@$!-]*[0134579@$])[a-z0-9@$!]+(?![\w@$])")
#: What ``_unmasked`` may change: a pattern of linear time (no look-around), wider than its own.
_MASKED = r"\p{Han}[\s./\\丶·•|~^*_、–—-]{1,2}\p{Han}|(?:^|[^a-z0-9])[a-z0-9](?:[-.*_ /·][a-z0-9]){2,}|[a-z][!0134579@$]|[0134579@$][a-z]"
_QUOTES = "[“\"「『«]"


def _unmasked(text: str) -> str:
    text = _between.sub("", text)
    text = _spelled.sub(lambda m: re.sub(r"[\-.*_ /·]", "", m[0]) if re.search("[a-z]", m[0]) else m[0], text)
    return _leet_word.sub(lambda m: m[0].translate(_leet), text)


def _own_words(text: str) -> str:
    own = _quoted.sub(" ", text)  # what is quoted are not the author's words, unless all is
    return own if len(own.strip(" 。,.")) * 3 > len(text) else text


def readable_all(lines: list[str]) -> list[str]:
    """Sentences as a reader takes them: width, case, accents and invisible characters for all at once, the rest where there may be something to do."""
    folded = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.utf8_normalize(pa.array(lines, pa.string()), "NFKD")), r"[\p{Mn}\p{Cf}]", ""))
    out = folded.to_pylist()
    for pattern, change in ((_QUOTES, _own_words), (_MASKED, _unmasked)):
        for i in np.flatnonzero(pc.match_substring_regex(folded, pattern).to_numpy(zero_copy_only=False)):
            out[i] = change(out[i])
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; none of a null or blank one."""
    if not text:
        return []
    plain = _markup.sub(" ", html.unescape(text)) if "<" in text or "&" in text else text
    return [s for part in _sentence.findall(plain) for s in _english.split(part) if s.strip()]


def cues(lines: list[str]) -> np.ndarray:
    """The cues of form of readable sentences, a row each."""
    column = pa.array(lines, pa.string())
    return np.stack([pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False) for p in CUES], axis=1).astype(np.float32)


def buckets(lines: list[str]) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Where each sentence begins (one entry more than sentences), and per length of n-gram the bucket of the one that begins at each character, ``NONE`` where it would cross into the next sentence. Figures are all alike."""
    points, starts = code_points(lines)
    points = np.where((points > 48) & (points < 58), np.uint32(48), points)

    def each() -> Iterator[np.ndarray]:
        for k in NGRAMS:
            bucket = (window_hashes(points, k) >> np.uint64(64 - BITS)).astype(np.int32)
            for back in range(1, k):  # the last k - 1 characters of a sentence begin none
                at = starts[1:] - back
                bucket[at[(at >= starts[:-1]) & (at < len(bucket))]] = NONE
            yield bucket

    return starts, each()


def ngrams(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of n-gram (sentence, bucket) of each place where one begins."""
    starts, each = buckets(lines)
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), np.diff(starts))
    for bucket in each:
        inside = np.flatnonzero(bucket != NONE)
        yield owner[inside], bucket[inside]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scale(lines: list[str]) -> np.ndarray:
    """What a sentence's n-grams are multiplied by, so that long ones don't outweigh short ones."""
    return 1 / np.sqrt(np.maximum(4, [len(t) for t in lines]))


class Model:
    """Weights per category of cues and hashed n-grams, and two thresholds each."""

    def __init__(self) -> None:
        self.dense = np.zeros((len(CUES), len(CATEGORIES)))
        self.hashed = np.zeros((NONE + 1, len(CATEGORIES)), np.float32)
        self.theta = np.array([THETA] * len(CATEGORIES), float)

    def margins(self, lines: list[str]) -> np.ndarray:
        """w.x of each readable sentence and category; every n-gram with a weight counts."""
        starts, each = buckets(lines)
        at_character = np.zeros((starts[-1] + 1, len(CATEGORIES)), np.float32)
        for bucket in each:
            at_character[: len(bucket)] += self.hashed[bucket]
        out = np.add.reduceat(at_character, starts[:-1], axis=0, dtype=float)
        out[np.diff(starts) == 0] = 0
        return out * _scale(lines)[:, None] + cues(lines) @ self.dense

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the expected grades, and whether a sentence offends: grade 1 or more is then the likelier."""
        split = [sentences(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        severity, has = np.zeros((len(texts), len(CATEGORIES))), np.zeros((len(texts), len(CATEGORIES)), bool)
        if not len(owner):
            return severity, has
        margins = self.margins(readable_all([s for found in split for s in found]))
        some = np.unique(owner)
        for c in range(len(CATEGORIES)):
            order = np.lexsort((-margins[:, c], owner))
            first = np.searchsorted(owner, some)
            one = margins[order[first], c]
            second = np.minimum(first + 1, len(owner) - 1)
            two = np.where(owner[order[second]] == some, margins[order[second], c], -np.inf)
            latent = one + np.where((second > first) & (two >= self.theta[c, 0]), np.maximum(two, 0), 0)
            severity[some, c] = sum(_logistic(latent - t) for t in self.theta[c])
            has[some, c] = one >= self.theta[c, 0]
        return severity, has

    def fit(self, texts: list[str], labels: list[str]) -> Model:
        """``labels``: ``none`` or categories joined by ``+``."""
        bags = [sentences(t) or [" "] for t in texts]
        lines = readable_all([s for b in bags for s in b])
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        named = [set(x.split("+")) & set(CATEGORIES) for x in labels]
        dirty = np.array([bool(x) for x in named])[bag]
        # The n-grams of documents with a category, numbered; sentences as rows of them.
        known = np.zeros(NONE + 1, bool)
        for part in blocks([len(t) for t in lines], FIT_BLOCK):
            for at, bucket in ngrams(lines[part]):
                known[bucket[dirty[part][at]]] = True
        kept = np.flatnonzero(known)
        number = np.full(NONE + 1, -1, np.int32)
        number[kept] = np.arange(len(kept))
        grams, sizes, counts = [], [], []
        for part in blocks([len(t) for t in lines], FIT_BLOCK):
            parts = [(at, number[bucket]) for at, bucket in ngrams(lines[part])]
            n = part.stop - part.start
            sizes.append(sum(np.bincount(at, minlength=n) for at, _ in parts))
            at, gram = np.concatenate([at[g >= 0] for at, g in parts]), np.concatenate([g[g >= 0] for _, g in parts])
            grams.append(gram[np.argsort(at, kind="stable")])
            counts.append(np.bincount(at, minlength=n))
        size = np.concatenate(sizes)
        rows = _Rows(np.concatenate(grams), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), _scale(lines), cues(lines), len(kept))
        for c, category in enumerate(CATEGORIES):
            has = np.array([category in x for x in named])
            clean = rows.seen(~has[bag])
            unseen = rows.sums((~clean).astype(float)) / np.maximum(1, size)
            w, v = self._rounds(c, rows, bag, has, unseen)
            self.dense[:, c], self.hashed[kept, c] = w, v
        return self

    def _rounds(self, c: int, rows: _Rows, bag: np.ndarray, has: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, v, theta = np.zeros(len(CUES)), np.zeros(rows.width), np.array(THETA, float)
        self.theta[c] = theta
        if not has.any():
            return w, v
        mined = np.zeros(len(bag), bool)
        for turn in range(ROUNDS):
            best = np.lexsort((-scores, bag))
            first = np.searchsorted(bag, np.arange(len(has)))
            one, second = best[first], best[np.minimum(first + 1, len(bag) - 1)]
            worst = one[~has & ~mined[one]]
            worst = worst[np.argsort(-scores[worst], kind="stable")]
            mined[worst[: max(LEAST, MINED * int(has.sum()))]] = True
            both = has & (bag[second] == np.arange(len(has))) & (second != one) & (turn > 0) & (scores[second] >= theta[0])
            hit, bad = one[has], np.flatnonzero(mined)
            extra = np.where(both[has], second[has], -1)
            x = rows.take(np.concatenate([hit, bad]), np.concatenate([extra, np.full(len(bad), -1)]))
            grade = np.concatenate([1 + both[has], np.zeros(len(bad), int)])
            w, v = _ascend(x, grade, w, v, theta)
            scores = rows.dot(w, v)
        self.theta[c] = theta
        return w, v


class _Rows:
    """Sentences as sparse rows of numbered n-grams, scaled, beside their cues."""

    def __init__(self, gram: np.ndarray, edges: np.ndarray, scale: np.ndarray, dense: np.ndarray, width: int) -> None:
        self.gram, self.edges, self.scale, self.dense, self.width = gram, edges, scale, dense, width

    def dot(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.sums(v) * self.scale + self.dense @ w

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each row the sum of its n-grams' values, many rows at a time."""
        out = np.zeros(len(self.scale))
        for part in blocks(np.diff(self.edges).tolist()):
            low, high = self.edges[part.start], self.edges[part.stop]
            at = np.repeat(np.arange(part.stop - part.start), np.diff(self.edges[part.start : part.stop + 1]))
            out[part] = np.bincount(at, values[self.gram[low:high]], part.stop - part.start)
        return out

    def seen(self, wanted: np.ndarray) -> np.ndarray:
        """Which n-grams the ``wanted`` rows have."""
        out = np.zeros(self.width, bool)
        for i in np.flatnonzero(wanted):
            out[self.gram[self.edges[i] : self.edges[i + 1]]] = True
        return out

    def take(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, n-gram, value, cues) of documents that are the sum of one sentence and, where not -1, a second one."""
        who = np.concatenate([np.arange(len(first)), np.flatnonzero(second >= 0)])
        what = np.concatenate([first, second[second >= 0]])
        n = self.edges[what + 1] - self.edges[what]
        at = np.repeat(self.edges[what] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        dense = np.zeros((len(first), self.dense.shape[1]))
        np.add.at(dense, who, self.dense[what])
        return np.repeat(who, n), self.gram[at], np.repeat(self.scale[what], n), dense


def _ascend(x: tuple, grade: np.ndarray, w: np.ndarray, v: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient ascent of the penalised likelihood from ``w`` and ``v``; ``theta`` is changed in place."""
    owner, gram, value, dense = x
    used, gram = np.unique(gram, return_inverse=True)
    n = len(grade)
    weight = 1 / n
    length = float(np.bincount(owner, value * value, n).max(initial=1.0)) + dense.shape[1]
    step = 4 / max(1.0, length)
    here = np.concatenate([w, v[used], theta])
    last, ahead = here.copy(), here.copy()
    a, b = len(w), len(w) + len(used)
    start = np.concatenate([np.zeros(b), THETA])
    pull = np.concatenate([np.full(b, DECAY), [0.01, 0.01]])
    for turn in range(STEPS):
        s = dense @ ahead[:a] + np.bincount(owner, value * ahead[a:b][gram], n)
        p1, p2 = _logistic(s - ahead[b]), _logistic(s - ahead[b + 1])
        gap = np.maximum(p1 - p2, 1e-6)
        slope = weight * np.where(grade == 0, -p1, np.where(grade == 1, 1 - p1 - p2, 1 - p2))
        lower = weight * np.where(grade == 0, p1, np.where(grade == 1, -p1 * (1 - p1) / gap, 0))
        upper = weight * np.where(grade == 1, p2 * (1 - p2) / gap, np.where(grade == 2, -(1 - p2), 0))
        rise = np.concatenate([dense.T @ slope, np.bincount(gram, value * slope[owner], len(used)), [lower.sum(), upper.sum()]])
        here = ahead + step * (rise - pull * (ahead - start)) * np.concatenate([np.full(b, 1.0), [0.2, 0.2]])
        here[b] = max(here[b], LOWEST)
        here[b + 1] = max(here[b + 1], here[b] + 0.5)
        ahead = here + turn / (turn + 3) * (here - last)
        last = here
    v = v.copy()
    v[used] = here[a:b]
    theta[:] = here[b:]
    return here[:a], v


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The model of at most ``most`` labelled documents: ``labels`` (doc_id, category), ``documents`` (doc_id, text)."""
    chosen = labels.where("category is not null and doc_id is not null").select("doc_id", "category").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["category"], r["text"]))
    return Model().fit([r["text"] for r in rows], [r["category"] for r in rows]) if rows else Model()


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of ``documents`` (doc_id, source, text) the expected grade of each category and whether the document contains it."""
    kept = np.flatnonzero(model.hashed.any(axis=1))  # all that the fit gave a weight
    small = (model.dense, model.theta, kept, model.hashed[kept])
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(c, pa.float64()) for c in CATEGORIES], *[(f"has_{c}", pa.bool_()) for c in CATEGORIES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model()
        m.dense, m.theta = small[0], small[1]
        m.hashed[small[2]] = small[3]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in blocks([len(t or "") for t in texts]):
                severity, has = m.judge(texts[part])
                ids = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "source")]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, severity.T.copy()), *map(pa.array, has.T.copy())], schema=schema)

    names = ", ".join([f"{c} double" for c in CATEGORIES] + [f"has_{c} boolean" for c in CATEGORIES])
    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id long, source string, {names}")


def source_rates(scored: DataFrame) -> DataFrame:
    """Per source the share of documents that contain each category, and the mean expected severity."""
    shares = [F.avg(F.col(f"has_{c}").cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), *shares, F.avg(F.greatest(*CATEGORIES)).alias("mean_severity"))
