"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

Kernel of two tokens. A token is its letters between two marks for its ends. Its features are its subsequences of three
letters with at most MOST_GAP letters left out at either place, each weighted DECAY to the number of letters left out; the
kernel is the cosine of the two feature vectors, and zero below LEAST_KERNEL. So ``idiot`` is close to ``idxiot``, and
``i.d.i.o.t`` is the same (marks and digits within a token are dropped, and single letters in a row are read as one token).

Kernel of a text and a landmark: the sum over the text's tokens, over their number plus SHORT, times SCALE. Landmarks are
the tokens whose document frequency most sets toxic labelled documents off, and the commonest tokens of the other ones that are like them.
Nyström features are the kernel values times the inverse root of the landmarks' own kernel matrix. The machine (squared
hinge, balanced classes, solved by Newton's method) is trained on the labelled texts' features, and a logistic function
of its value, fitted to the same texts, is the score.

Setting small values to zero makes the landmarks' matrix slightly indefinite; its negative and vanishing eigenvalues are left
out of the map, which is the nearest positive semidefinite kernel on the landmarks.

Training takes a bounded sample: about ``most_toxic`` toxic and ``most_other`` other labelled documents, chosen by a hash
of their ids. Scoring covers all documents and whole texts, with nothing but the text as input.

Every token is judged by the same kernel, however long: a long token's subsequences are counted piece by piece into one table of
all codes, with pieces that overlap by as much as a subsequence spans, so memory is bounded and the value is that of the whole.

Defined results: null and empty texts have no token like a landmark and get the score of all such texts; without labels of
both kinds, and from empty tables, every score is 0; repeated rows get equal scores; where an id is labelled more than once, the
largest label counts; where a labelled id has several rows, the text with the smallest hash is learnt from; landmarks that are
equally telling are taken in the order of their letters; columns beside id and text may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import hash_fraction, held_out, materialise, strings

ORDER = 3
MOST_GAP = 2
DECAY = 0.5
LEAST_KERNEL = 0.55
LANDMARKS = 96
#: A text counts as so many tokens more, so that one token of a short text does not decide.
SHORT = 40
SCALE = 50.0
#: A token must be in so many toxic sampled documents to be a landmark.
LEAST_DOCS = 3
#: Tokens a worker remembers.
KEPT_TOKENS = 600_000
#: Letters whose subsequences are held at a time. A longer token is counted piece by piece, to the same result.
PIECE = 1 << 16
SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?!\w)")
NOT_LETTER = re.compile(r"[\W\d_]+")
FIRST, LAST, LETTERS = 62, 63, 64


@cache
def _letter_numbers() -> np.ndarray:
    """A number from 0 to 61 for every code point: 26 for a to z, 36 shared by the others."""
    points = np.arange(0x110000)
    out = 26 + points % 36
    out[97:123] = np.arange(26)
    return out.astype(np.int64)


def letters_of(token: str) -> str:
    return NOT_LETTER.sub("", token.lower())


def tokens_of(text: str) -> list[str]:
    """White-space tokens, and every row of single letters as one more token."""
    low = text.lower()
    return low.split() + [m[0] for m in SPELT.finditer(low)]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words together: number of the word, code of the subsequence, weight; ordered by neither."""
    joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 2)
    codes = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    inner = np.ones(len(codes), dtype=bool)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    codes[inner] = _letter_numbers()[joined]
    codes[ends - 1], codes[ends - sizes - 2] = LAST, FIRST
    word = np.repeat(np.arange(len(words)), sizes + 2)
    w, c, weight = [], [], []
    for g in range(MOST_GAP + 1):
        for h in range(MOST_GAP + 1):
            span = g + h + 2
            if span >= len(codes):
                continue
            same = word[span:] == word[:-span]
            code = codes[:-span] * LETTERS**2 + codes[1 + g : len(codes) - span + 1 + g] * LETTERS + codes[span:]
            w.append(word[:-span][same])
            c.append(code[same])
            weight.append(np.full(int(same.sum()), DECAY ** (g + h)))
    if not w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(w), np.concatenate(c), np.concatenate(weight)


def counted(word: str) -> np.ndarray:
    """The weights of all codes of one word, however long: pieces overlap so that each subsequence is in one of them."""
    out, reach = np.zeros(LETTERS**3), 2 * MOST_GAP + 2
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.empty(len(points) + 2, dtype=np.int64)
    codes[0], codes[-1] = FIRST, LAST
    codes[1:-1] = _letter_numbers()[points]
    for a in range(0, len(codes), PIECE):
        some = codes[a : a + PIECE + reach]
        for g in range(MOST_GAP + 1):
            for h in range(MOST_GAP + 1):
                n = min(PIECE, len(some) - g - h - 2)
                if n > 0:
                    code = some[:n] * LETTERS**2 + some[1 + g : 1 + g + n] * LETTERS + some[g + h + 2 : g + h + 2 + n]
                    out += DECAY ** (g + h) * np.bincount(code, minlength=LETTERS**3)
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with equal codes of a word added up and each word's vector of length one."""
    word, code, weight = _grams(words)
    if not len(word):
        return word, code, weight
    key = word * LETTERS**3 + code
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.add.reduceat(weight, first)
    word, code = key[first] // LETTERS**3, key[first] % LETTERS**3
    size = np.sqrt(np.bincount(word, weight**2, minlength=len(words)))
    return word, code, weight / size[word]


@dataclass
class Landmarks:
    """Landmark tokens with their features as a table that finds those which share a subsequence."""

    words: list[str]

    def __post_init__(self) -> None:
        word, code, weight = features(self.words)
        self.codes, place = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes) + 1, len(self.words)))
        self.table[place, word] = weight
        #: For each code the largest weight that a landmark has there.
        self.largest = self.table.max(axis=1, initial=0.0)
        self.slot = np.full(LETTERS**3, len(self.codes), dtype=np.int32)
        self.slot[self.codes] = np.arange(len(self.codes))

    def kernels(self, words: list[str]) -> dict[int, np.ndarray]:
        """By number of the word its kernel values with all landmarks, for words that have any over zero."""
        if not words or not self.words:
            return {}
        word, code, weight = _grams(words)
        # What a landmark with the largest weight everywhere would have, over a length that equal codes would only make
        # larger, bounds each kernel value.
        size = np.bincount(word, weight**2, minlength=len(words))
        total = np.bincount(word, weight * self.largest[self.slot[code]], minlength=len(words))
        near = np.flatnonzero(total >= LEAST_KERNEL * np.sqrt(np.maximum(size, 1e-12)) * (1 - 1e-9))
        near = near[total[near] > 0]
        out = {}
        for a in range(0, len(near), 512):
            some = near[a : a + 512]
            w, c, x = features([words[k] for k in some])
            slots = self.slot[c]
            hit = slots < len(self.codes)
            w, parts = w[hit], x[hit, None] * self.table[slots[hit]]
            values = np.zeros((len(some), len(self.words)))
            if len(w):
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                values[w[first]] = np.add.reduceat(parts, first, axis=0)
            values[values < LEAST_KERNEL] = 0
            out |= {int(k): np.round(v, 9) for k, v in zip(some, values, strict=True) if v.any()}
        return out


    def long_kernel(self, word: str) -> np.ndarray | None:
        """The same for one word of any length; None where all values are zero."""
        weight = counted(word)
        values = weight[self.codes] @ self.table[:-1] / np.sqrt(max(float(weight @ weight), 1e-12))
        values[values < LEAST_KERNEL] = 0
        return np.round(values, 9) if values.any() else None


class Matcher:
    """Finds the tokens of texts that are like a landmark; remembers tokens it has judged."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        self.judged: set[str] = set()
        self.near: dict[str, np.ndarray] = {}

    def judge(self, tokens: set[str]) -> None:
        if len(self.judged) > KEPT_TOKENS:
            self.judged, self.near = set(), {}
        new = sorted(tokens - self.judged)
        some: list[str] = []
        words: list[str] = []
        held = 0
        for t in new:
            word = letters_of(t)
            if len(word) > PIECE:
                if (v := self.landmarks.long_kernel(word)) is not None:
                    self.near[t] = v
                continue
            some.append(t)
            words.append(word)
            held += len(word) + 2
            if held > PIECE:
                self._judge(some, words)
                some, words, held = [], [], 0
        self._judge(some, words)
        self.judged.update(new)

    def _judge(self, tokens: list[str], words: list[str]) -> None:
        for k, v in self.landmarks.kernels(words).items():
            self.near[tokens[k]] = v

    def vectors(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """For each text its kernel values with the landmarks, None where all are zero."""
        lists = [tokens_of(t) for t in texts]
        self.judge(set().union(*lists) if lists else set())
        near = self.near
        for tokens in lists:
            found = [t for t in tokens if t in near] if not near.keys().isdisjoint(tokens) else []
            yield SCALE * np.sum([near[t] for t in found], axis=0) / (len(tokens) + SHORT) if found else None


@dataclass
class ToxicityModel:
    landmarks: list[str]
    #: Weights of the kernel values (the machine's weights times the Nyström map), its offset, and the logistic function's.
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def matcher(self) -> Matcher:
        if getattr(self, "_matcher", None) is None:
            self._matcher = Matcher(Landmarks(self.landmarks))
        return self._matcher

    def scores(self, texts: list[str]) -> list[float]:
        if not self.landmarks:
            return [0.0] * len(texts)
        out = []
        for vector in self.matcher().vectors(texts):
            value = self.offset + (float(vector @ self.weights) if vector is not None else 0.0)
            x = self.slope * value + self.shift
            out.append(round(1 / (1 + math.exp(-max(-50.0, min(50.0, x)))), 9))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_matcher"}


#: Models by the key that a query gave them, so that a worker keeps what it has judged from batch to batch.
_held: dict[str, ToxicityModel] = {}


def train_machine(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise |w|^2 / 2 plus c times the balanced squared hinge losses; y is 1 or -1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    active = None
    for _ in range(rounds):
        now = y * (z @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a, k = z[now], cost[now, None]
        w = np.linalg.solve(ridge + 2 * a.T @ (k * a), 2 * a.T @ (k[:, 0] * y[now]))
    return w[:-1], float(w[-1])


def logistic(values: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic function of the values, with targets drawn in from 0 and 1 by the counts."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([values, np.ones_like(values)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), z.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = sorted({w for w in (letters_of(t) for t in tokens_of(text or "")) if len(w) >= ORDER})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32())], ["word", "toxic"])


def _lookalikes(words: list[str]):
    """Distinct tokens of other documents that are like a landmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Landmarks(words))
        for batch in batches:
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                tokens = set(tokens_of(text or ""))
                matcher.judge(tokens)
                found = sorted({letters_of(t) for t in tokens if t in matcher.near} - set(words))
                yield pa.RecordBatch.from_arrays([pa.array([] if toxic else found, pa.string())], ["word"])

    return run


def _vectors(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Landmarks(words))
        for batch in batches:
            at, rows = [], []
            for text in strings(batch.column(0)):
                (x,) = matcher.vectors([text or ""])
                x = np.zeros(len(words)) if x is None else np.round(x, 9)
                at.append(np.flatnonzero(x).tolist())
                rows.append(x[x != 0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "at", "k"])

    return run


def sampled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_other: int) -> DataFrame:
    """``text`` and ``toxic`` of the training sample, stored."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["t"]: r["n"] for r in known.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, most_toxic / max(1, counts.get(True, 0))))).otherwise(F.lit(min(1.0, most_other / max(1, counts.get(False, 0)))))
    chosen = known.where(hash_fraction(F.col("_id"), F.lit("toxic")) < share)
    # The sample has about most_toxic + most_other rows whatever the input's size, so it can be sent to all executors.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # One row for each id, so that a labelled id on many rows leaves the sample bounded.
    one = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", (F.col("toxic") == 1).cast("int").alias("toxic"))).alias("r"))
    return materialise(one.select("r.text", "r.toxic"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_other: int = 8000, landmarks: int = LANDMARKS) -> ToxicityModel:
    rows = sampled(docs, labels, most_toxic, most_other)
    totals = rows.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    n1 = int(totals["a"] or 0)
    n0 = int(totals["n"]) - n1
    nothing = ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0)
    if not n1 or not n0:
        return nothing
    words = rows.mapInArrow(_distinct_tokens, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("n") - F.col("a") + 0.5) / (n0 + 1)
    z = F.round((p1 - p0) / F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 9)
    # A landmark is at least three times as frequent in toxic documents.
    top = words.where((F.col("a") >= LEAST_DOCS) & (p1 >= 3 * p0)).withColumn("z", z).orderBy(F.col("z").desc(), "word").limit(landmarks).collect()
    if not top:
        return nothing
    names = [r["word"] for r in top]
    like = rows.mapInArrow(_lookalikes(names), "word string").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    names += [r["word"] for r in like.orderBy(F.col("n").desc(), "word").limit(landmarks // 2).collect()]
    found = rows.mapInArrow(_vectors(names), "toxic int, at array<int>, k array<double>").collect()
    found.sort(key=lambda r: (r["toxic"], r["at"], r["k"]))
    k = np.zeros((len(found), len(names)))
    for row, r in zip(k, found, strict=True):
        row[r["at"]] = r["k"]
    y = np.array([1.0 if r["toxic"] else -1.0 for r in found])
    own = Landmarks(names)
    gram = np.array([v if (v := own.kernels([w]).get(0)) is not None else np.zeros(len(names)) for w in names])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6
    nystroem = vectors[:, good] / np.sqrt(values[good])
    w, offset = train_machine(k @ nystroem, y)
    weights = np.round(nystroem @ w, 9)
    slope, shift = logistic(k @ weights + offset, y)
    return ToxicityModel(names, weights, round(offset, 9), round(slope, 9), round(shift, 9))


def scored(text: Column, model: ToxicityModel) -> Column:
    """The score of a text column."""
    key = repr((model.landmarks, model.weights.tolist(), model.offset, model.slope, model.shift))

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        from glyphloom.llm import toxicity

        if key not in toxicity._held:
            toxicity._held.clear()
            toxicity._held[key] = model
        held = toxicity._held[key]
        out: list[float] = []
        texts = [t or "" for t in strings(column)]
        for a in range(0, len(texts), 1000):
            out += held.scores(texts[a : a + 1000])
        return pa.array(out, pa.float64())

    return run(text)
