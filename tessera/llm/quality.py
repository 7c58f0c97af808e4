"""Quality classifier from weak labels: overlapping heuristics, expectation-maximisation, and a hashed linear scorer.

1. LABELLERS look at every text and vote good, bad or nothing. The counts of vote patterns over all rows, at most
   3^len(LABELLERS) of them, are all that EM needs: it estimates each labeller's votes given the hidden class (a vote
   left out carries no information) and gives every pattern a posterior.
2. Posterior labels of a sample of about SAMPLE rows, chosen by a hash of id and text, train a logistic scorer on features
   hashed to FEATURES places: runs of four characters of the text's shape (letters, digits and white space by kind,
   punctuation as it is), and binned statistics of its words. A row is of good quality if its score is 0.5 or more.
3. Words that mark toxic rows among a sample of about LABELLED labelled rows form a lexicon: those in five toxic texts or
   more that chance does not explain. A row whose words weigh up to TOXIC or more is toxic. Without labels nothing is.

A row is kept if it is of good quality and not toxic. Training is bounded and on the driver; votes, scores and counts are
a narrow map over all rows, on whole texts.

Edge cases: a null, empty or blank text draws no vote and is rejected, its score being 0; rows with equal text get equal
scores; an empty table gives an empty result; if all rows look alike the scorer follows the prior of good text; a label row
without a document, or with null labels, is ignored; columns beside id and text are handed through or ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 8_000
LABELLED = 20_000
FEATURES = 1 << 12
TOXIC = 3.0
CHANCE = 1e-6
GOOD, BAD = 1, 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~|<>{}[]\\_=+!?-/"]] = True
_RARE = [ord(c) for c in "#$%&*@^~|<>{}[]\\_=+"]
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[c for c in range(256) if c >= 128 or chr(c).islower()]] = ord("a")
_SHAPE[[c for c in range(128) if chr(c).isupper()]] = ord("A")
_SHAPE[[c for c in range(128) if chr(c).isdigit()]] = ord("0")
_SHAPE[[*range(9, 14), 32]] = 32


class Looks:
    """What the labellers and the scorer see of a text, counted once."""

    def __init__(self, text: str | None):
        raw = (text or "").encode()
        self.bytes = np.frombuffer(raw, np.uint8)
        self.words = raw.split()
        n = self.n = len(self.words)
        times = np.bincount(self.bytes, minlength=256)
        upper, lower = int(times[65:91].sum()), int(times[97:123].sum())
        self.letters = upper + lower
        self.caps = upper / max(1, self.letters)
        self.size = len(raw)
        self.rare = int(times[_RARE].sum()) / max(1, self.size)
        self.shouts = int(times[33]) / max(1, n)
        self.bars = int(times[124]) / max(1, n)
        self.again = sum(map(eq, self.words, self.words[1:])) / max(1, n - 1)
        self.variety = len(set(self.words)) / max(1, n)
        self.short = sum(map((3).__ge__, map(len, self.words))) / max(1, n)
        self.stops = int(times[[44, 46, 58, 59, 63]].sum()) / max(1, n)
        b = self.bytes
        self.runs = (np.count_nonzero((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & _SYMBOL[b[2:]]) if len(b) > 2 else 0) / max(1, n)


def _vote(enough: bool, bad: bool, good: bool) -> int:
    return 0 if not enough else BAD if bad else GOOD if good else 0


LABELLERS = {
    "caps": lambda x: _vote(x.letters >= 20, x.caps > 0.4, x.caps < 0.15),
    "symbols": lambda x: _vote(x.size >= 20, x.rare > 0.05, x.rare < 0.02),
    "shouts": lambda x: _vote(x.n >= 5, x.shouts > 0.2, x.shouts < 0.05),
    "bars": lambda x: _vote(x.n >= 10, x.bars > 0.1, x.bars < 0.02),
    "again": lambda x: _vote(x.n >= 10, x.again > 0.2, x.again < 0.05),
    "variety": lambda x: _vote(x.n >= 50, x.variety < (0.2 if x.n < 5000 else 0.04), x.variety > 0.3),
    "short": lambda x: _vote(x.n >= 50, x.short < 0.03, x.short > 0.15),
    "runs": lambda x: _vote(x.n >= 5, x.runs > 0.15, x.runs < 0.02),
}


def pattern_of(looks: Looks) -> int:
    out = 0
    for labeller in LABELLERS.values():
        out = out * 3 + labeller(looks)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """rows of votes, one column a labeller."""
    out = np.zeros((len(patterns), len(LABELLERS)), np.int64)
    for k in range(len(LABELLERS) - 1, -1, -1):
        out[:, k] = patterns % 3
        patterns = patterns // 3
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good of each pattern; of each labeller P(votes bad | good), P(votes bad | bad); P(good)."""
    votes = votes_of(patterns)
    weight = counts.astype(np.float64)
    says_bad = votes == BAD
    said = votes != 0
    wrong, right, good = np.full(len(LABELLERS), 0.05), np.full(len(LABELLERS), 0.4), 0.8
    posterior = np.full(len(patterns), good)
    for _ in range(rounds):
        ratio = math.log(good / (1 - good)) + np.where(said, np.where(says_bad, np.log(wrong / right), np.log((1 - wrong) / (1 - right))), 0.0).sum(1)
        posterior = 1 / (1 + np.exp(-np.clip(ratio, -500, 500)))
        g, b = weight * posterior, weight * (1 - posterior)
        # pseudo-counts: labellers are taken to be better than chance until the rows say otherwise
        wrong = ((g[:, None] * says_bad).sum(0) + 0.5) / ((g[:, None] * said).sum(0) + 10)
        right = ((b[:, None] * says_bad).sum(0) + 4) / ((b[:, None] * said).sum(0) + 10)
        wrong, right = np.minimum(wrong, 0.5), np.clip(right, wrong + 1e-6, 1 - 1e-6)
        good = float(np.clip((g.sum() + 8) / (weight.sum() + 10), 1e-3, 1 - 1e-3))
    return posterior, np.stack([wrong, right]), good


def features(looks: Looks) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed features."""
    s = _SHAPE[looks.bytes].astype(np.uint32)
    if len(s) >= 4:
        code = s[:-3] | s[1:-2] << np.uint32(8) | s[2:-1] << np.uint32(16) | s[3:] << np.uint32(24)
        code, times = np.unique((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), return_counts=True)
        value = np.sqrt(times / len(s))
    else:
        code, value = np.empty(0, np.uint32), np.empty(0)
    binned = [(k, min(9, int(v * scale))) for k, (v, scale) in enumerate(((looks.caps, 10), (looks.rare, 50), (looks.shouts, 10), (looks.bars, 10), (looks.again, 10), (looks.variety, 10), (looks.short, 10), (looks.runs, 10), (looks.stops, 10), (math.log2(looks.n + 1), 0.5)))]
    own = np.array([(1_000_003 * (k + 1) + 7919 * v) * 0x9E3779B1 % 2**32 >> (32 - 12) for k, v in binned], np.int64)
    return np.concatenate([code.astype(np.int64), own]), np.concatenate([value, np.full(len(own), 0.5)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the last one its bias, by gradient descent with momentum on soft labels."""
    w = np.zeros(FEATURES + 1)
    w[-1] = math.log(prior / (1 - prior))
    if not rows:
        return w
    place = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # both classes weigh alike
    weight = labels / max(labels.sum(), 1e-9) + (1 - labels) / max((1 - labels).sum(), 1e-9) if min(labels.sum(), (1 - labels).sum()) >= 1 else np.full(len(rows), 1.0)
    weight /= weight.sum()
    speed = np.zeros_like(w)
    for _ in range(steps):
        z = np.bincount(row, value * w[place], len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        gradient = np.append(np.bincount(place, value * error[row], FEATURES), error.sum()) + decay * np.append(w[:-1], 0.0)
        speed = 0.9 * speed - 2.0 * gradient
        w += speed
    return w


def toxic_weight(words: list[bytes], marks: dict[bytes, float]) -> float:
    return sum(marks.get(w, 0.0) for w in {w.lower().strip(b".,;:!?|*$%&#\"'()") for w in set(words)}) if marks else 0.0


class Model:
    def __init__(self, posterior: dict[int, float], weights: np.ndarray, marks: dict[bytes, float]):
        self.posterior, self.weights, self.marks = posterior, weights, marks

    def judge(self, text: str | None) -> tuple[float, float, float, bool]:
        """weak posterior, score, toxic weight, keep."""
        looks = Looks(text)
        if not looks.n:
            return self.posterior.get(0, 0.5), 0.0, 0.0, False
        place, value = features(looks)
        z = float(value @ self.weights[place] + self.weights[-1])
        score = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
        toxic = toxic_weight(looks.words, self.marks)
        return self.posterior.get(pattern_of(looks), 0.5), score, toxic, score >= 0.5 and toxic < TOXIC


def _drawn(wanted: int, rows: int) -> int:
    """The hash up to which about `wanted` of so many rows are drawn."""
    return int(min(1.0, wanted / max(1, rows)) * (2**64 - 2**11)) - 2**63 + 2**11 - 1 if wanted < rows else 2**63 - 1


def learn(docs: DataFrame, labels: DataFrame | None, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """labels: id, toxic."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found.update(pattern_of(Looks(t)) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select(text_column).mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3^len(LABELLERS) rows
    pattern, count = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    posterior, _, good = estimate(pattern, count)
    by_pattern = dict(zip(pattern.tolist(), posterior.tolist()))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            drawn = batch.column(0).to_pylist()
            new = [k for k, h in enumerate(drawn) if h not in seen and not seen.add(h)]  # copies within a task are looked at once
            looks = [Looks(batch.column(1)[k].as_py()) for k in new]
            found = [features(x) for x in looks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([drawn[k] for k in new], pa.int64()), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary()), pa.array([by_pattern.get(pattern_of(x), 0.5) for x in looks], pa.float64())],
                names=["drawn", "place", "value", "label"],
            )

    drawn, share = F.xxhash64(id_column, text_column), _drawn(SAMPLE, int(count.sum()))
    some = docs.where((drawn <= share) & F.col(text_column).rlike(r"\S")).select(drawn.alias("drawn"), F.col(text_column).alias("text")).mapInArrow(sample, "drawn long, place binary, value binary, label double")
    taken = some.dropDuplicates(["drawn"]).orderBy("drawn").limit(2 * SAMPLE).toArrow()  # about SAMPLE rows
    place, value, label = (taken.column(c).to_pylist() for c in ("place", "value", "label"))
    weights = train([(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for p, v in zip(place, value)], np.array(label), good)
    marks: dict[bytes, float] = {}
    if labels is not None:
        usable = labels.select(F.col(id_column).alias("_label_id"), F.col("toxic").cast("int").alias("_toxic")).where("_label_id is not null and _toxic is not null")
        chosen = F.xxhash64("_label_id")
        some = usable.where(chosen <= _drawn(LABELLED, usable.count())).groupBy("_label_id").agg(F.max("_toxic").alias("_toxic")).orderBy(chosen).limit(2 * LABELLED)
        texts = docs.select(F.col(id_column).alias("_doc_id"), F.col(text_column).alias("_text")).join(some, F.col("_doc_id") == F.col("_label_id")).select("_text", "_toxic")
        marks = lexicon(texts)
    return Model(by_pattern, weights, marks)


def _telling(yes: int, no: int, whole: tuple[int, int]) -> bool:
    """Whether a word stands in so many toxic texts of those that hold it by chance with a probability of CHANCE at most (Chernoff's bound)."""
    n, p = yes + no, whole[0] / max(1, sum(whole))
    if not 0 < p < 1 or yes <= p * n:
        return False
    a = yes / n
    return n * (a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if no else 0.0)) >= -math.log(CHANCE)


def lexicon(texts: DataFrame) -> dict[bytes, float]:
    """The lexicon of labelled texts, their words counted on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.strip(b".,;:!?|*$%&#\"'()") for w in (text or "").encode().lower().split()}
                (yes if y else no).update(words | {b""})
        words = list(yes)
        words += [w for w in no if w not in yes]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([yes[w] for w in words], pa.int64()), pa.array([no[w] for w in words], pa.int64())], names=["word", "yes", "no"])

    once = texts.groupBy(F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text"), F.max("_toxic").alias("_toxic")).select("_text", "_toxic")
    found = once.mapInArrow(count, "word binary, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    rows = found.where((F.col("yes") >= 5) & (F.col("no") <= 0.05 * F.col("yes")) | (F.length("word") == 0)).collect()  # words of a bounded sample
    whole = next(((r[1], r[2]) for r in rows if not r[0]), (0, 0))
    out = {}
    for word, k, other in rows:
        weight = math.log((k + 0.5) / (whole[0] + 1)) - math.log((other + 0.5) / (whole[1] + 1))
        if word and weight >= TOXIC and _telling(k, other, whole):
            out[bytes(word)] = weight
    return out


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, weak_posterior, score, toxic_weight, keep of every row."""
    kind = docs.schema[id_column].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[sent.value.judge(t) for t in batch.column(1).to_pylist()])) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(found, (pa.float64(), pa.float64(), pa.float64(), pa.bool_()))]], names=[id_column, "weak_posterior", "score", "toxic_weight", "keep"])

    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind.simpleString()}, weak_posterior double, score double, toxic_weight double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of docs that the model keeps."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.judge(t)[3] for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
