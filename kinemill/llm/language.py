"""Language identification by hierarchical discrimination.

Languages are grouped into families by how alike their mean letter n-gram profiles are. One-versus-rest linear
support vector machines choose the family; one-versus-one linear support vector machines then choose the language
within it. Training takes a bounded sample of labelled rows: of each language the ``per_language`` distinct texts with
the smallest hashes, or fewer where all languages together would pass ``max_texts``. The driver gets their features, of
a fixed size each, never a text. Prediction covers every row and reads the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if no labelled row
is there to learn from; with a single language every other text is that language; equal margins go to the language
first in the alphabet; repeated rows train once and are predicted one by one; a very long text is worked on by itself;
an empty table gives an empty result; result columns get underscores until they differ from the columns kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, joined, scratch_path, slices, small, texts_of

UNDETERMINED = "und"
DIMENSIONS = 2048
_LETTER = re.compile(r"[^\W\d_]")
#: Rows of one a language that go to every task: at most some MB.
MOST_BROADCAST = 100_000
#: Of a language with fewer texts no bound is learned.
LEAST_TEXTS = 20
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha())
#: ASCII that isn't a letter becomes a space.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def profiles(texts: list[str]) -> np.ndarray:
    """Rows of unit length: square roots of hashed byte n-gram frequencies (1 to 3), over whole lower-case texts."""
    out = np.empty((len(texts), DIMENSIONS), np.float32)
    for a, b in slices(texts, 500_000):
        octets, begins = joined([t.lower() for t in texts[a:b]], "\n")
        x = _LETTERS[octets].astype(np.uint32)
        row = np.zeros(len(x), np.int64)
        row[begins[1:]] = DIMENSIONS
        row = np.cumsum(row)
        two = x[:-1] << 8 | x[1:]
        three = two[:-1] << 8 | x[2:]
        counts = np.zeros((b - a) * DIMENSIONS)
        for grams, shift in ((x[x > 32], row[x > 32]), (two[two != 8224], row[: len(two)][two != 8224]), (three[three != 2105376], row[: len(three)][three != 2105376])):
            h = (grams * np.uint32(2654435761)) >> np.uint32(32 - 11)
            counts += np.bincount(shift + h, minlength=len(counts))
        counts = np.sqrt(counts.reshape(b - a, DIMENSIONS))
        out[a:b] = counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)
    return out


def magnitudes(texts: list[str]) -> np.ndarray:
    """Of each text, the number of binary digits of its count of letter bytes, 15 at most."""
    return np.array([min(15, len(t.encode("utf-8", "replace").translate(None, _OTHERS)).bit_length()) for t in texts], int)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of an L2 support vector machine by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    square = (x * x).sum(1) + 1 / (2 * cost)
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            step = (1 - y[i] * (x[i] @ w) - alpha[i] / (2 * cost[i])) / square[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def families_of(means: np.ndarray, alike: float) -> list[list[int]]:
    """Average-link groups of languages whose mean profiles have a cosine of ``alike`` at least, or two groups."""
    groups = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    near = unit @ unit.T
    while len(groups) > 2:
        pairs = [(near[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2)]
        best, i, j = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        if best < alike and len(groups) <= (len(means) + 1) // 2:
            break
        groups[i] += groups.pop(j)
    return groups


@dataclass
class Hierarchy:
    languages: list[str]
    families: list[list[int]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    #: Of each language, log frequencies of n-grams and the least likelihood of its texts by magnitude.
    logs: np.ndarray | None = None
    bounds: np.ndarray | None = None

    @classmethod
    def fit(cls, langs: list[str], profiles_: np.ndarray, alike: float = 0.93) -> Hierarchy:
        languages = sorted(set(langs))
        model = cls(languages)
        label = np.array([languages.index(v) for v in langs], int)
        if len(languages) < 2:
            model.families = [[i] for i in range(len(languages))]
            return model
        x = profiles_.astype(np.float64)
        model.families = families_of(np.array([x[label == k].mean(0) for k in range(len(languages))]), alike)
        own = {k: f for f, members in enumerate(model.families) for k in members}
        family = np.array([own[k] for k in label])
        if len(model.families) > 1:
            model.family_weights = np.array([linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in range(len(model.families))])
        for members in model.families:
            for a, b in combinations(members, 2):
                at = (label == a) | (label == b)
                model.pairs[a, b] = linear_svm(x[at], np.where(label[at] == a, 1.0, -1.0))
        return model

    def calibrate(self, found: dict[int, list[tuple[float, int]]]) -> None:
        """Bounds from the likelihoods and magnitudes of each language's texts and cuts.

        A bound is the least likelihood at a magnitude or any above, less a quarter of its distance to the median and
        0.4 at least, so that text of the language stays at any length.
        """
        self.bounds = np.full((len(self.languages), 16), -np.inf)
        for k, pairs in found.items():
            value, size = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            bound, told = np.inf, [m for m in range(16) if (size == m).sum() >= LEAST_TEXTS]
            for m in told[::-1]:
                at = value[size == m]
                bound = min(bound, at.min() - max(0.4, (np.median(at) - at.min()) / 4))
                # also for longer texts of magnitudes with too few; below the shortest magnitude nothing is told
                self.bounds[k, m:][np.isneginf(self.bounds[k, m:])] = bound

    def predict(self, texts: list[str], reject: bool = False) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; if ``reject``, none of a text that is unlike all texts of its language."""
        known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        if not self.languages or not known.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        x = profiles([texts[i] for i in at]).astype(np.float64)
        sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
        score, pick = np.ones(len(at)), np.zeros(len(at), int)
        if self.family_weights is not None:
            margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
            pick, order = margins.argmax(1), np.sort(margins, axis=1)
            score = sure((order[:, -1] - order[:, -2]) / 2)
        label = np.zeros(len(at), int)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(pick == f)
            votes, least = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                w = self.pairs[a, b]
                margin = x[rows] @ w[:-1] + w[-1]
                votes[:, i] += margin > 0
                votes[:, j] += margin <= 0
                least[:, i] += margin
                least[:, j] -= margin
            best = (votes + 1e-3 * np.tanh(least)).argmax(1) if len(members) > 1 else np.zeros(len(rows), int)
            label[rows] = np.array(members)[best]
            if len(members) > 1:
                score[rows] *= sure(least[np.arange(len(rows)), best] / (len(members) - 1))
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if reject:
            # a text stays if it is like any learned language's; where no bound is known, only the predicted one's counts
            bounds = self.bounds[:, magnitudes([texts[i] for i in at])].T
            fits = np.square(x) @ self.logs >= bounds
            told = fits[np.arange(len(at)), label] | (fits & np.isfinite(bounds)).any(1)
            at, label, score = at[told], label[told], score[told]
        for i, k in zip(at.tolist(), label.tolist(), strict=True):
            langs[i] = self.languages[k]
        scores[at] = score
        return langs, scores


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_texts(docs: DataFrame, per_language: int, max_texts: int, text_col: str, lang_col: str) -> DataFrame:
    """(l, h, t, r): of each language the distinct texts with the smallest hashes, numbered from 1 by them."""
    labelled = docs.select(docs[lang_col].alias("l"), docs[text_col].alias("t")).where("l is not null and t is not null")
    hashed = labelled.withColumn("h", F.xxhash64("t", "l"))
    # Texts are counted once, as they train: copies share a hash, so they would fall under the cut or over it together.
    sizes = hashed.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n"))
    known = sizes.agg(F.count("*").alias("n")).first()["n"]
    per_language = min(per_language, max(1, max_texts // max(1, known)))
    # A cut in the hashes leaves a little more than the bound of each language; only those are ranked. One row a
    # language goes to every task, if they are few enough; else texts and sizes meet by language.
    sizes = F.broadcast(sizes) if known <= MOST_BROADCAST else sizes
    near = hashed.join(sizes, "l").where(F.pmod("h", F.lit(1 << 20)) / (1 << 20) < F.lit(2 * per_language + 20) / F.col("n")).select("l", "h", "t")
    once = near.groupBy("l", "h").agg(F.min("t").alias("t"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= per_language)


def train(docs: DataFrame, per_language: int = 600, max_texts: int = 12_000, text_col: str = "text", lang_col: str = "lang", bounds: bool = False) -> Hierarchy:
    """Fit on the labelled rows of ``docs``; the driver gets ``max_texts`` features of 4 KB at most.

    ``bounds`` also learns what identify() needs to reject text.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "language")
    sample_texts(docs, per_language, max_texts, text_col, lang_col).write.parquet(path)
    picked = spark.read.schema("l string, h long, t string, r int").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            found = [x.tobytes() for x in profiles(batch.column("t").to_pylist()).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("h"), pa.array(found, pa.binary())], ["l", "h", "x"])

    rows = sorted((r["l"], r["h"], r["x"]) for r in picked.select("l", "h", "t").mapInArrow(run, "l string, h long, x binary").collect())
    if not rows:
        return Hierarchy([])
    langs, x = [r[0] for r in rows], np.frombuffer(b"".join(r[2] for r in rows), np.float16).reshape(len(rows), DIMENSIONS)
    del rows
    model = Hierarchy.fit(langs, x)
    if bounds:
        _learn_bounds(model, picked, langs, x)
    discard(spark, path)
    return model


def _learn_bounds(model: Hierarchy, picked: DataFrame, langs: list[str], x: np.ndarray, cuts: int = 4) -> None:
    """Likelihoods of each text and of cuts of it under the frequencies of the other half of its language's texts."""
    at = {k: np.flatnonzero(np.array(langs) == v) for k, v in enumerate(model.languages)}
    frequencies = lambda rows: np.log(np.square(x[rows].astype(np.float64)).mean(0) + 1e-6) if len(rows) else np.zeros(DIMENSIONS)
    model.logs = np.stack([frequencies(at[k]) for k in at], 1)
    other = {v: (frequencies(at[k][1::2]).astype(np.float32), frequencies(at[k][::2]).astype(np.float32)) for k, v in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            out: list[tuple] = []
            for lang, h, t, r in zip(*(batch.column(c).to_pylist() for c in ("l", "h", "t", "r")), strict=True):
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                own = [t] + [t[(a := int(rng.integers(max(1, len(t))))) : a + (2 << int(rng.integers(13)))] for _ in range(cuts)]
                own = [p for p in own if _LETTER.search(p)]
                if own:
                    value = np.square(profiles(own), dtype=np.float64) @ other[lang][(r - 1) % 2]
                    out += [(lang, v, m) for v, m in zip(value.tolist(), magnitudes(own).tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.int32()), strict=True)], ["l", "value", "size"])

    found: dict[int, list[tuple[float, int]]] = {}
    for r in picked.mapInArrow(run, "l string, value double, size int").collect():
        found.setdefault(model.languages.index(r["l"]), []).append((r["value"], r["size"]))
    model.calibrate({k: v for k, v in found.items() if len(at[k]) >= LEAST_TEXTS})


def identify(docs: DataFrame, model: Hierarchy, keep: list[str], text_col: str = "text", reject: bool = False, result_cols: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred and score; no shuffle. The model is a few weights a language.

    With ``reject``, lang_pred is ``und`` for text that is unlike the texts of every learned language.
    """
    results = fresh(keep, *result_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                langs, scores = model.predict(texts[a:b], reject)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *results])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text_col].alias("text")).mapInArrow(run, f"{kinds}, `{results[0]}` string, `{results[1]}` double")
