"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier learnt from the labelled table gives every document posteriors of two label columns (quality, toxic); their
products are its memberships in four domains. The mixing problem is to find a rate of at least 0 for every document such
that the domains' expected token totals, the sum over documents of tokens times membership times rate, come closest to
the targets, in least squares of each domain's relative deviation. It is solved by projected gradient steps from rate 1.

Scale. Documents whose log-odds agree to 1/CELLS share a rate. They are summed up by these cells once (before the shuffle):
their tokens and, with exact posteriors, their tokens in each domain. Each step is one aggregation over the table of cells, of
at most (2 * LIMIT * CELLS + 1)^2 rows whatever the input's size, and the totals that it compares with the targets are those of the
exact posteriors. Residuals are divided by the domains' present shares; for memberships that add up to 1 this bounds the
curvature by 1, so full steps converge; they are taken with momentum, which is dropped where it leads away.
The descent ends when no total is off by ``tolerance`` of what its domain has. Targets may be out of reach: it also ends when twenty
rounds have lowered the squares' sum by less than a thousandth, or after ``rounds``, and then a warning says how far off the totals are.

Classifier: naive Bayes over a few binned measurements of the text and over the presence of words that set the labelled
documents apart. It is fitted on at most about ``per_class`` labelled documents of each class, chosen by a hash of
their ids; held-out documents are not used.

Defined results: null and empty texts have no tokens and keep their posteriors (of the measurements of an empty text);
without labels every posterior is 1/2; repeated rows have equal rates; ids that are labelled twice count by their
largest labels, and of a labelled id's rows the text with the smallest hash is learnt from; words that are equally telling are
taken in the order of their letters; an empty table gives an empty result; whole texts are read; columns beside id and text may
have any name.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import discard, hash_fraction, held_out, materialise

#: Log-odds are held within LIMIT of 0; documents that agree in them to 1/CELLS share a rate.
LIMIT = 12.0
CELLS = 16
#: Rounds that must lower the squares' sum by a thousandth.
PATIENCE = 20
SPACE = "[\\x20\\x09-\\x0D]+"
TARGETS_OF = ("quality", "toxic")
#: Domains: whether quality and toxic are 1 in them, and the weights asked for.
DOMAINS = {"clean": (1, 0), "toxic": (1, 1), "poor": (0, 0), "poor_toxic": (0, 1)}
WEIGHTS = {"clean": 0.92, "toxic": 0.02, "poor": 0.05, "poor_toxic": 0.01}
#: Words of each label column's lexicon, and the sampled documents that a word must be in.
LEXICON = 128
LEAST_DOCS = 3
#: Standard errors by which a word's frequencies in the two classes must differ.
LEAST_Z = 4.0
#: Bounds of the bins of each measurement; a value belongs to the bin after the bounds it is over.
BINS = {
    "symbols": (0.0, 0.05, 0.3), "capitals": (0.05, 0.3), "distinct": (0.2, 0.5), "letters": (0.3, 0.6),
    "length": (3.0, 5.0, 12.0), "words": (9.0, 50.0), "repeats": (0.0, 0.2),
}


def tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""))


def measured(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_w`` (lower-case words), ``_n`` (tokens) and the number of each measurement's bin."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = rows.withColumn("_t", t).withColumn("_w", F.array_remove(F.split(F.lower("_t"), "[^\\p{L}]+"), "")).withColumn("_s", F.array_remove(F.split("_t", SPACE), ""))
    n, chars = F.greatest(F.size("_s"), F.lit(1)), F.greatest(F.char_length("_t"), F.lit(1))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.withColumn("_l", lines)
    values = {
        "symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")) / n,
        "capitals": F.regexp_count("_t", F.lit("\\p{Lu}")) / chars,
        "distinct": F.size(F.array_distinct("_s")) / n,
        "letters": F.regexp_count("_t", F.lit("\\p{L}")) / chars,
        "length": F.char_length("_t") / n,
        "words": F.size("_s").cast("double"),
        "repeats": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.greatest(F.size("_l"), F.lit(1)),
    }
    bins = []
    for name, bounds in BINS.items():
        of = F.lit(0)
        for b in bounds:
            of = of + F.when(values[name] > b, 1).otherwise(0)
        bins.append(of.alias(f"_{name}"))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return step.select(*kept, "_w", F.size("_s").cast("long").alias("_n"), *bins)


@dataclass
class Posterior:
    """Log-odds of one label column: of a text without any of the words, by bin, and by word."""

    prior: float = 0.0
    bins: dict[str, list[float]] = field(default_factory=lambda: {n: [0.0] * (len(b) + 1) for n, b in BINS.items()})
    words: dict[str, float] = field(default_factory=dict)

    def column(self) -> Column:
        """The log-odds; needs the columns of ``measured``."""
        odds = F.lit(self.prior)
        for name, weights in self.bins.items():
            odds = odds + F.element_at(F.array(*map(F.lit, weights)), F.col(f"_{name}") + 1)
        if self.words:
            known = F.array(*map(F.lit, sorted(self.words)))
            weights = F.create_map(*(F.lit(x) for w in sorted(self.words) for x in (w, self.words[w])))
            odds = odds + F.aggregate(F.array_intersect("_w", known), F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
        return F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), odds)), 9)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text: str = "text") -> dict[str, Posterior]:
    known = labels.select(F.col("doc_id").alias("_id"), *((F.col(c) == 1).cast("int").alias(c) for c in TARGETS_OF))
    known = known.where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(*(F.max(c).alias(c) for c in TARGETS_OF)).dropna()
    classes = {tuple(r[c] for c in TARGETS_OF): r["n"] for r in known.groupBy(*TARGETS_OF).agg(F.count("*").alias("n")).collect()}
    if not classes:
        return {c: Posterior() for c in TARGETS_OF}
    share = F.lit(0.0)
    for key, n in classes.items():
        same = F.lit(True)
        for c, v in zip(TARGETS_OF, key, strict=True):
            same = same & (F.col(c) == v)
        share = F.when(same, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = known.where(hash_fraction(F.col("_id"), F.lit("mixing")) < share)
    # The sample has about per_class rows of each class whatever the input's size, so it can be sent to all executors.
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    # One row for each id, so that a labelled id on many rows leaves the sample bounded.
    one = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", *TARGETS_OF)).alias("r"))
    sample = materialise(measured(one.select("r._text", *(f"r.{c}" for c in TARGETS_OF)), "_text").drop("_text", "_n"), "mixing-sample")
    sums = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in TARGETS_OF)).first()
    words = sample.select(F.explode(F.array_distinct("_w")).alias("word"), *TARGETS_OF).where(F.length("word") > 2)
    words = words.groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in TARGETS_OF)).where(F.col("n") >= LEAST_DOCS)
    cells = sample.select(F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.col(f"_{n}").alias("v")) for n in BINS))).alias("x"), *TARGETS_OF)
    counts = cells.groupBy("x.f", "x.v").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in TARGETS_OF)).collect()
    out = {}
    for c in TARGETS_OF:
        n1 = int(sums[c] or 0)
        n0 = int(sums["n"]) - n1
        whole1 = sum(n for key, n in classes.items() if key[TARGETS_OF.index(c)] == 1)
        whole0 = sum(classes.values()) - whole1
        p = Posterior(prior=math.log((whole1 + 0.5) / (whole0 + 0.5)))
        for name, bounds in BINS.items():
            seen = {r["v"]: (r[c], r["n"] - r[c]) for r in counts if r["f"] == name}
            k = len(bounds) + 1
            p.bins[name] = [math.log((seen.get(v, (0, 0))[0] + 1) / (n1 + k)) - math.log((seen.get(v, (0, 0))[1] + 1) / (n0 + k)) for v in range(k)]
        p1, p0 = (F.col(c) + 0.5) / (n1 + 1.0), (F.col("n") - F.col(c) + 0.5) / (n0 + 1.0)
        z = F.round((p1 - p0) / F.sqrt(p1 * (1 - p1) / max(n1, 1) + p0 * (1 - p0) / max(n0, 1)), 9)
        # Words of the class that is the rarer one: they are what sets it off.
        rare = F.when(F.lit(n1 <= n0), (p1 >= 3 * p0) & (F.col(c) >= LEAST_DOCS)).otherwise((p0 >= 3 * p1) & (F.col("n") - F.col(c) >= LEAST_DOCS))
        gone = F.log((1 - p1) / (1 - p0))
        top = words.where(rare).select("word", (F.log(p1 / p0) - gone).alias("w"), gone.alias("gone"), F.abs(z).alias("z"))
        top = top.where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "word").limit(LEXICON).collect()
        p.words = {r["word"]: round(r["w"], 9) for r in top}
        p.prior += sum(round(r["gone"], 9) for r in top)
        out[c] = p
    discard(sample)
    return out


def memberships(model: dict[str, Posterior]) -> list[Column]:
    """``q`` and ``t``: the log-odds of quality and toxic."""
    return [model["quality"].column().alias("q"), model["toxic"].column().alias("t")]


def cell(odds: str) -> Column:
    return F.round(F.col(odds) * CELLS).cast("int")


def weight_of(domain: str, q: Column | None = None, t: Column | None = None) -> Column:
    """A document's membership in a domain, from the log-odds ``q`` and ``t``."""
    quality, toxic = DOMAINS[domain]
    one = lambda odds, yes: 1 / (1 + F.exp(-odds if yes else odds))
    return one(F.col("q") if q is None else q, quality) * one(F.col("t") if t is None else t, toxic)


def cells_of(rows: DataFrame) -> DataFrame:
    """The bounded table of cells: ``cq``, ``ct``, ``n`` (tokens) and by domain ``m_`` (its tokens) and ``g_`` (its share of them).

    It is summed up by as many tasks as the partial sums need; only the result, of a bounded size, becomes one file.
    """
    mass = {d: F.sum((F.col("_n") * weight_of(d)).cast("decimal(20,6)")).cast("double") for d in DOMAINS}
    summed = rows.groupBy(cell("q").alias("cq"), cell("t").alias("ct")).agg(F.sum("_n").cast("double").alias("n"), *(m.alias(f"m_{d}") for d, m in mass.items()))
    summed = materialise(summed, "mixing-sums")
    middle = {d: weight_of(d, F.col("cq") / CELLS, F.col("ct") / CELLS) for d in DOMAINS}
    shares = (F.when(F.col("n") > 0, F.col(f"m_{d}") / F.col("n")).otherwise(middle[d]).alias(f"g_{d}") for d in DOMAINS)
    cells = materialise(summed.coalesce(1).select("*", *shares), "mixing-cells")
    discard(summed)
    return cells


def solve(cells: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, rounds: int = 400, tolerance: float = 1e-5, stored: int = 20) -> DataFrame:
    """``cq``, ``ct`` and ``rate`` of the table of cells, stored.

    ``weights`` are the domains' shares of ``budget`` tokens (as many as there are, if not given). Rates are carried as an
    expression over the steps taken and written every ``stored`` rounds, so the expression doesn't grow further.
    """
    weights = weights or WEIGHTS
    names = list(DOMAINS)
    scale = sum(weights.values())
    present = cells.agg(*(F.sum(f"m_{d}").alias(d) for d in names)).first()
    have = {d: float(present[d] or 0.0) for d in names}
    total = sum(have.values())
    goal = {d: (budget or total) * weights.get(d, 0.0) / scale for d in names}
    reachable = [d for d in names if have[d] > 0]
    table = cells.withColumns({"r": F.lit(1.0), "y": F.lit(1.0)})
    held: DataFrame | None = None
    steps: list[list[float]] = []

    def moved() -> Column:
        """``r``, the rates after the steps, and ``y``, those carried on by the momentum."""
        start = F.struct(F.col("r"), F.col("y"))
        if not steps:
            return start
        last = len(reachable)

        def step(at: Column, s: Column) -> Column:
            r = F.greatest(F.lit(0.0), at["y"] - sum((F.col(f"g_{d}") * s[k] for k, d in enumerate(reachable)), F.lit(0.0)))
            return F.struct(r.alias("r"), F.greatest(F.lit(0.0), r + s[last] * (r - at["r"])).alias("y"))

        return F.aggregate(F.array(*(F.array(*map(F.lit, s)) for s in steps)), start, step)

    momentum, squares, off = 1.0, [], 0.0
    for k in range(rounds if reachable else 0):
        if len(steps) == stored:
            now = materialise(table.withColumn("_s", moved()).withColumns({"r": F.col("_s.r"), "y": F.col("_s.y")}).drop("_s"), "mixing-rates")
            if held is not None:
                discard(held)
            table = held = now
            steps = []
        sums = table.withColumn("_s", moved()).agg(*(F.sum(F.col(f"m_{d}") * F.col("_s.y")).alias(d) for d in reachable)).first()
        step = [(float(sums[d]) - goal[d]) / have[d] for d in reachable]
        off = max(map(abs, step))
        squares.append(sum(x * x for x in step))
        if off < tolerance:
            steps.append([*step, 0.0])
            break
        if k and squares[-1] > squares[-2]:
            momentum = 1.0
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        steps.append([*step, (momentum - 1) / after])
        momentum = after
        if k >= PATIENCE and squares[-1] > 0.999 * squares[-1 - PATIENCE]:
            break
    if off >= tolerance:
        warnings.warn(f"after {len(squares)} rounds the totals are off by up to {off:.2g} of what the domains have", stacklevel=2)
    rates = materialise(table.withColumn("_s", moved()).select("cq", "ct", F.round("_s.r", 6).alias("rate")).coalesce(1), "mixing-solved")
    if held is not None:
        discard(held)
    return rates


def rated(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens``, memberships by domain, ``rate`` and ``expected_tokens``."""
    model = fit(docs, labels, id_col=id_col, text=text)
    rows = measured(docs.select(id_col, text), text).select(id_col, "_n", *memberships(model))
    rows = materialise(rows, "mixing-rows")
    cells = cells_of(rows)
    rates = solve(cells, weights)
    discard(cells)
    # The cells are bounded, see above.
    joined = rows.withColumns({"cq": cell("q"), "ct": cell("t")}).join(F.broadcast(rates), ["cq", "ct"])
    return joined.select(id_col, F.col("_n").alias("n_tokens"), *(F.round(weight_of(d), 9).alias(f"p_{d}") for d in DOMAINS), "rate", F.round(F.col("_n") * F.col("rate"), 6).alias("expected_tokens"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part, and one more with the rest's probability.

    The draw is a hash of the id, so a repeated run makes the same choice.
    """
    model = fit(docs, labels, id_col=id_col, text=text)
    names = docs.columns
    rows = measured(docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names))), f"_c{names.index(text)}")
    own = [F.col(f"_c{k}") for k in range(len(names))]
    rows = materialise(rows.select(*own, "_n", *memberships(model)), "mixing-rows")
    cells = cells_of(rows.select("_n", "q", "t"))
    rates = solve(cells, weights)
    discard(cells)
    draw = hash_fraction(F.col(f"_c{names.index(id_col)}"), F.lit("mix"))
    times = F.floor(F.col("rate") + draw).cast("int")
    chosen = rows.withColumns({"cq": cell("q"), "ct": cell("t")}).join(F.broadcast(rates), ["cq", "ct"]).where(times > 0).withColumn("_times", F.explode(F.sequence(F.lit(1), times)))
    return chosen.select(*(c.alias(n) for c, n in zip(own, names, strict=True)))
