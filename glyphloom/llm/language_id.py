"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from its code point, so all workers agree). A letter n-gram is
bound by multiplying its letters' vectors, each rotated by its place; a text is the bundle (sum) of its n-grams. A
language's prototype is the sum of its training documents' unit vectors, from which the mean prototype is taken so that
what all languages share does not count. A document gets the language whose prototype has the largest cosine with it.

Training takes a bounded sample: at most about ``sample`` documents of each language, chosen by a hash of their ids.
Prediction covers every document and the whole of its text.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so does every text if there is nothing
to learn from. Ties go to the language that is first in order. Repeated rows get equal results. Long texts are bundled
piece by piece, so memory doesn't grow with them. An empty table gives an empty one. Input columns that clash with the result's
are replaced. A model holds one prototype for each distinct language; their number is taken to be that of languages.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import fresh, hash_fraction, held_out, hold, sole, strings

DIM = 1024
N = 3
SEED = 17
UNKNOWN = "und"
#: Code points bundled at a time.
PIECE = 1 << 18
#: n-gram vectors that a worker keeps.
KEPT_NGRAMS = 40_000
SCALE = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=[SEED, code]))
    return (rng.integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


def bind(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, given as their code points packed 21 bits each, the first one highest."""
    out = np.ones((len(codes), DIM), dtype=np.int8)
    for place in range(N):
        letters, which = np.unique((codes >> np.uint64(21 * place)) & np.uint64(0x1FFFFF), return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c)), place) for c in letters])[which]
    return out


class NgramMemory:
    """The vectors of n-grams seen lately. When KEPT_NGRAMS are held, they are dropped for those that come next."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, DIM), dtype=np.int8)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors; the numbers are whole, so their order changes nothing."""
        out = np.zeros(DIM, dtype=np.float64)
        for a in range(0, len(codes), 4096):
            some, n = codes[a : a + 4096], counts[a : a + 4096].astype(np.float32)
            places = self.places(some)
            out += n @ self.table[places].astype(np.float32)
        return out

    def places(self, codes: np.ndarray) -> np.ndarray:
        keys = codes.tolist()
        if any(k not in self.rows for k in keys):
            new = [k for k in keys if k not in self.rows]
            if len(self.rows) + len(new) > KEPT_NGRAMS:
                self.rows, new = {}, keys
            a, b = len(self.rows), len(self.rows) + len(new)
            if b > len(self.table):
                self.table = np.concatenate([self.table, np.empty((max(b, 2 * len(self.table)) - len(self.table), DIM), dtype=np.int8)])
            self.table[a:b] = bind(np.array(new, dtype=np.uint64))
            self.rows.update(zip(new, range(a, b), strict=True))
        return np.fromiter(map(self.rows.__getitem__, keys), dtype=np.int64, count=len(keys))


@cache
def memory() -> NgramMemory:
    hold("language", memory.cache_clear)
    return NgramMemory()


def encode(text: str | None) -> np.ndarray | None:
    """The unit vector of a text, None if it has no letter."""
    if text is None:
        return None
    out, letters = np.zeros(DIM), _is_letter()
    carry = np.array([32], dtype=np.uint64)
    found = False
    for a in range(0, len(text), PIECE):
        points = np.frombuffer(text[a : a + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[points]
        found = found or bool(is_letter.any())
        points = np.where(is_letter, points, 32).astype(np.uint64)
        points = np.concatenate([carry, points, [32]] if a + PIECE >= len(text) else [carry, points]).astype(np.uint64)
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points = points[keep]
        if len(points) >= N:
            grams = points[: len(points) - N + 1]
            for k in range(1, N):
                grams = (grams << np.uint64(21)) | points[k : len(points) - N + 1 + k]
            out += memory().bundle(*np.unique(grams, return_counts=True))
        carry = points[-(N - 1) :]
    size = float(np.linalg.norm(out))
    return out / size if found and size else None


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Unit prototypes, after the mean was taken off, and that mean.
    prototypes: np.ndarray
    mean: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = encode(text)
        if vector is None or not self.languages:
            return UNKNOWN, 0.0
        vector = vector - self.mean
        size = float(np.linalg.norm(vector))
        cosines = np.round(self.prototypes @ vector / size, 12) if size else np.zeros(len(self.languages))
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))

    def to_json(self) -> str:
        return json.dumps({"languages": self.languages, "prototypes": self.prototypes.tolist(), "mean": self.mean.tolist()})

    @staticmethod
    def from_json(text: str) -> LanguageModel:
        x = json.loads(text)
        return LanguageModel(tuple(x["languages"]), np.array(x["prototypes"]).reshape(-1, DIM), np.array(x["mean"]))


def model_of(sums: dict[str, np.ndarray]) -> LanguageModel:
    """The model of the languages' summed unit vectors."""
    names = tuple(sorted(sums))
    if not names:
        return LanguageModel((), np.zeros((0, DIM)), np.zeros(DIM))
    rows = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    mean = rows.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    rows = rows - mean
    return LanguageModel(names, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12), mean)


def _bundles(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
            if (vector := encode(text)) is not None:
                sums[lang] = sums.get(lang, 0) + np.round(vector * SCALE).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])


def fit(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns from documents that are not held out and whose language is not null, about ``sample`` of each language."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("lang")).where(~held_out(F.col("i")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return model_of({})
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = rows.where(hash_fraction(F.col("i"), F.lit("lang")) < share).select("t", "lang")
    parts = chosen.mapInArrow(_bundles, "lang string, v array<bigint>")
    cells = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    sums: dict[str, np.ndarray] = {}
    for r in cells:
        sums.setdefault(r["lang"], np.zeros(DIM))[r["k"]] = r["x"]
    return model_of({k: v for k, v in sums.items() if np.linalg.norm(v)})


def predicted(text: Column, model: LanguageModel) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def run(column: pa.Array) -> pa.Array:
        sole("language")
        found = [model.predict(t) for t in strings(column)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    p = fresh(docs, "_p")
    return docs.select(*rest, predicted(F.col(text), model).alias(p)).select(*rest, f"{p}.lang_pred", f"{p}.score")
