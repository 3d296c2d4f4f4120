"""Reading level of documents (problem 10).

Method: gradient-boosted regression trees over the distributions of word length, vocabulary, syntax and cohesion,
trained on graded samples and calibrated by cross-validation: folds hold whole sources where the samples name theirs, else
whole samples. Documents are cleaned before, and the samples are also learnt in worn forms (without punctuation, as short
extracts), so that markup and missing full stops don't move a grade. Grades are profiled by source of the documents.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.measures import source_key

BANDS = ("primary", "middle", "secondary", "expert")
#: At most so many graded samples are used for training, those with the smallest ids.
MOST_SAMPLES = 5000
ROUNDS, RATE, DEPTH, LEAF, FOLDS = 80, 0.1, 3, 4, 5

TAG = re.compile(r"<[^<>]{0,200}>|\[[^\[\]]{0,80}\]|\((?:fig\.|\d)[^()]{0,30}\)")
LABEL = re.compile(r"(?m)^\s*(?:>>\s*)?[^\W\d_][\w .'-]{0,40}:\s+")
BULLET = re.compile(r"(?m)^\s*(?:>>|[-*•·–—#>]+|\d+[.)])\s+")
CLOCK = re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\b")
SCAN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;]+[\"')\]]*\s|\n")
VOWELS = re.compile(r"[aeiouy]+")
# Words that tie clauses, and endings of learned English words.
CONNECTIVES = frozenset("because although however therefore since unless whereas while when if so but and or before after until though notwithstanding irrespective moreover nevertheless which that".split())
LEARNED = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "ology", "ical", "ally", "ism", "ised", "ized", "ation")


def clean(text: str) -> str:
    text = html.unescape(text)
    return CLOCK.sub(" ", BULLET.sub("", LABEL.sub("", TAG.sub(" ", BULLET.sub("", text)))))


class _Lexicon:
    """Figures of each distinct word, computed once: rows of a matrix that a text's words pick from."""

    MOST = 500_000

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, 12))

    def row(self, w: str) -> tuple[float, ...]:
        n, beats = len(w), max(1, len(VOWELS.findall(w)))
        return n, n * n, n >= 7, n >= 10, n <= 3, beats, beats >= 3, beats >= 4, w.endswith(LEARNED), w in CONNECTIVES, w in ("the", "of", "by"), 1.0

    def pick(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > self.MOST:
            self.at.clear()
        found = []
        for w in words:
            k = self.at.get(w)
            if k is None:
                k = self.at[w] = len(self.at)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self.row(w)
            found.append(k)
        return self.rows[found]


LEXICON = _Lexicon()
N_FEATURES = 18


#: Words in a window of the type-token ratio.
WINDOW = 100


def variety(words: list[str]) -> float:
    """Mean type-token ratio of all windows of WINDOW neighbouring words; of a shorter text the ratio itself."""
    n = len(words)
    if n <= WINDOW:
        return len(set(words)) / max(1, n)
    last: dict[str, int] = {}
    before = []
    for t, w in enumerate(words):
        before.append(last.get(w, -1))
        last[w] = t
    # A word counts in the windows that hold it and not its previous occurrence.
    t = np.arange(n)
    opens = np.maximum(np.array(before) + 1, np.maximum(t - WINDOW + 1, 0))
    return int(np.maximum(0, np.minimum(t, n - WINDOW) - opens + 1).sum()) / (WINDOW * (n - WINDOW + 1))


def features(text: str | None) -> list[float]:
    """Distribution figures of a text; zeros for a text without words. One pass over words and sentence ends."""
    sentences: list[list[str]] = []
    open_: list[str] = []
    body = clean(text or "")
    for t in SCAN.findall(body):
        if t[0].isalpha():
            open_.append(t)
        elif open_:
            sentences.append(open_)
            open_ = []
    if open_:
        sentences.append(open_)
    raw = [w for s in sentences for w in s]
    # Names say nothing about difficulty: capitalised words are left out, unless the text is in capitals or title case.
    words = [w.lower() for i, w in enumerate(raw) if i == 0 or not w[0].isupper()]
    if 2 * len(words) < len(raw):
        words = [w.lower() for w in raw]
    if not words:
        return [0.0] * N_FEATURES
    picked = LEXICON.pick(words)
    n = len(words)
    length, square, seven, ten, three, beats, beats3, beats4, learned, ties, small, _ = picked.mean(0).tolist()
    by_length = np.sort(picked[:, 0])
    sizes = sorted(map(len, sentences))
    mean = sum(sizes) / len(sizes)
    spread = (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5
    stems = [s for s in ({w.lower() for w in s if len(w) > 3} for s in sentences) if s]
    shared = [len(a & b) / min(len(a), len(b)) for a, b in zip(stems, stems[1:])]
    return [
        length, max(0.0, square - length * length) ** 0.5, float(by_length[(3 * n) // 4]), float(by_length[(9 * n) // 10]), seven, ten, three, beats, beats3, beats4,
        variety(words), learned, min(float(sizes[len(sizes) // 2]), 60.0), min(spread, 60.0), ties, body.count(",") / n, small, sum(shared) / len(shared) if shared else 0.0,
    ]


def worn(text: str) -> list[str]:
    """The text itself, without its punctuation, and as two extracts."""
    sentences = re.split(r"(?<=[.!?])\s+", text)
    half = max(1, len(sentences) // 2)
    return [text, re.sub(r"[^\w\s'’]", "", text), " ".join(sentences[:half]), " ".join(sentences[half:]) or text]


class Forest:
    """Least-squares boosted regression trees of bounded depth; scoring is vectorised over rows."""

    def __init__(self, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, leaf: int = LEAF):
        self.rounds, self.rate, self.depth, self.leaf = rounds, rate, depth, leaf
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.base, self.trees = float(y.mean()), []
        order = np.argsort(x, axis=0, kind="stable")
        at = np.full(len(y), self.base)
        for _ in range(self.rounds):
            tree = self._grow(x, y - at, order, np.ones(len(y), dtype=bool), self.depth)
            self.trees.append(tree)
            at = at + self.rate * self._walk(tree, x)
        return self

    def _grow(self, x: np.ndarray, rest: np.ndarray, order: np.ndarray, inside: np.ndarray, depth: int):  # noqa: ANN202
        n, total = int(inside.sum()), float(rest[inside].sum())
        best = (1e-9, None, None)
        if depth and n >= 2 * self.leaf:
            for j in range(x.shape[1]):
                rows = order[:, j][inside[order[:, j]]]
                v, left = x[rows, j], np.cumsum(rest[rows])[:-1]
                k = np.arange(1, n)
                gain = left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n
                gain[(v[1:] <= v[:-1]) | (k < self.leaf) | (n - k < self.leaf)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
        if best[1] is None:
            return total / max(n, 1)
        below = inside & (x[:, best[1]] <= best[2])
        return best[1], best[2], self._grow(x, rest, order, below, depth - 1), self._grow(x, rest, order, inside & ~below, depth - 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:  # noqa: ANN001
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, at, low, high = tree
        return np.where(x[:, j] <= at, self._walk(low, x), self._walk(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


class Grader:
    """A forest, and the line that maps its output onto grades without bias, fitted on predictions for held-out samples."""

    def __init__(self, forest: Forest, slope: float, shift: float, error: float, accuracy: float):
        self.forest, self.slope, self.shift, self.error, self.accuracy = forest, slope, shift, error, accuracy

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.forest.predict(x) + self.shift, 0, len(BANDS) - 1)

    @staticmethod
    def band(grade: float) -> str:
        return BANDS[int(np.floor(min(max(grade, 0.0), len(BANDS) - 1.0) + 0.5))]


def train(samples: list[tuple[str, str]], sources: list[str] | None = None) -> Grader:
    """samples: (text, band); folds hold whole sources, one after another, or whole samples, with all their worn forms."""
    number = {s: k for k, s in enumerate(sorted(set(sources)))} if sources else {}
    fold_of = [number[s] % FOLDS for s in sources] if len(number) > 1 else [i % FOLDS for i in range(len(samples))]
    forms = [(features(w), BANDS.index(band), fold_of[i]) for i, (text, band) in enumerate(samples) for w in worn(text)]
    x, y, fold = (np.array(c, dtype=float) for c in zip(*forms))
    held = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any() and (fold != f).any():
            held[fold == f] = Forest().fit(x[fold != f], y[fold != f]).predict(x[fold == f])
    slope, shift = np.polyfit(held, y, 1) if held.std() > 1e-9 else (1.0, 0.0)
    fit = np.clip(slope * held + shift, 0, len(BANDS) - 1)
    return Grader(Forest().fit(x, y), float(slope), float(shift), float(np.abs(fit - y).mean()), float((np.floor(fit + 0.5) == y).mean()))


def train_on(samples: DataFrame) -> Grader | None:
    """Trains on the driver on at most MOST_SAMPLES samples; of a repeated sample_id the greatest text counts; rows with
    null text or another band take no part. None without samples."""
    known = samples.where(F.col("text").isNotNull() & F.col("band").isin(*BANDS))
    source = F.coalesce(source_key(F.col("source")), F.lit("")) if "source" in samples.columns else F.lit("")
    rows = known.groupBy("sample_id").agg(F.max(F.struct("text", "band", source.alias("source"))).alias("s")).orderBy("sample_id").limit(MOST_SAMPLES).select("s.*").collect()
    if not rows:
        return None
    return train([(r["text"], r["band"]) for r in rows], [r["source"] for r in rows])


def reading_levels(documents: DataFrame, samples: DataFrame, lang: str = "en", grader: Grader | None = None) -> DataFrame:
    """(doc_id, source, lang, grade, band, reason) of every document: grade from 0 (primary) to 3 (expert), calibrated, and
    the nearest band. Without grade and band the reason is `language` (another than the samples', or none), `samples` (none
    to learn from) or `words` (none in the text); of a repeated doc_id the greatest text counts, those of the language
    first; rows without doc_id take no part."""
    grader = grader or train_on(samples)
    spoken = F.coalesce(F.lower(F.trim("lang")) == lang, F.lit(False))
    known = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", F.lower(F.trim("lang")).alias("lang"), spoken.alias("spoken"))
    texts = known.where("spoken").select("doc_id", "source", "text")
    measured = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("grade", pa.float64()), ("band", pa.string())])

    def grade(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            text = batch.column("text").to_pylist()
            x = np.array([features(t) for t in text], dtype=float).reshape(len(text), -1)
            g = grader.grade(x) if len(x) and grader else np.zeros(len(x))
            read = [bool(r.any()) and grader is not None for r in x]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "source": batch.column("source"), "size": [len(t or "") for t in text],
                    "grade": [round(float(v), 6) if ok else None for v, ok in zip(g, read)], "band": [Grader.band(v) if ok else None for v, ok in zip(g, read)],
                },
                schema=measured,
            )

    graded = texts.mapInArrow(grade, "doc_id bigint, source string, size bigint, grade double, band string")
    reason = F.when(F.col("grade").isNull(), F.lit("words" if grader else "samples"))
    graded = graded.select("doc_id", "source", F.lit(lang).alias("lang"), F.lit(True).alias("spoken"), "size", "grade", "band", reason.alias("reason"))
    others = known.where("not spoken").select("doc_id", "source", "lang", "spoken", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"), F.lit(None).cast("double").alias("grade"), F.lit(None).cast("string").alias("band"), F.lit("language").alias("reason"))
    one = graded.unionByName(others).groupBy("doc_id").agg(F.max(F.struct("spoken", "size", "grade", "band", "source", "lang", "reason")).alias("d"))
    return one.select("doc_id", "d.source", "d.lang", "d.grade", "d.band", "d.reason")


def levels_by_source(documents: DataFrame, samples: DataFrame, lang: str = "en") -> DataFrame:
    """A row a source, however spelt (null: none named): documents, how many are graded, their mean grade and quartiles, how
    many are of each band; and the grader's cross-validated mean error and share in band, the same in all rows."""
    grader = train_on(samples)
    levels = reading_levels(documents, samples, lang, grader).withColumn("source", source_key(F.col("source")))
    quartile = lambda p: F.round(F.percentile_approx("grade", p, 10_000), 3)
    nan = float("nan")
    return levels.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count("grade").alias("graded"), F.round(F.avg("grade"), 4).alias("mean_grade"), quartile(0.25).alias("low"), quartile(0.5).alias("middle_grade"), quartile(0.75).alias("high"),
        *(F.count(F.when(F.col("band") == b, 1)).alias(b) for b in BANDS),
        F.lit(round(grader.error, 6) if grader else nan).alias("mean_error"), F.lit(round(grader.accuracy, 6) if grader else nan).alias("in_band"),
    )
