"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger holds its measurements and a bitmask of the rules that the
document fails. A policy is a versioned mask: a document is kept if it fails none of the policy's rules. Policies are
then compared, and rules ablated, by bitwise aggregation over the ledger, without looking at a text again.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows are judged each for itself;
an empty table gives an empty ledger. All of a text is read, however long. A value at a rule's bound passes, so there are no ties. Columns of the input that clash with the ledger's own are
replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import fresh

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5

#: Measurements in the ledger, in this order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document fails; its place in RULES is its bit."""

    name: str
    fails: Column | None = None

    def condition(self) -> Column:
        n, col = F.greatest(F.col("n_words"), F.lit(1)), F.col
        return {
            "few_words": col("n_words") < 10,
            "repeated_windows": 100 * col("n_repeat_words") > 20 * col("n_words"),
            "symbols": 100 * col("n_symbols") > 30 * n,
            "duplicate_lines": 100 * col("n_dup_lines") > 50 * F.greatest(col("n_lines"), F.lit(1)),
            "long_words": col("word_chars") > 25 * n,
            "short_words": col("word_chars") < 2 * n,
            "few_letters": 100 * col("n_letters") < 50 * col("word_chars"),
        }[self.name]


RULES = tuple(Rule(n) for n in ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "few_letters"))
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}

#: Policies by version: the rules a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(BIT[n] for n in dict.fromkeys(names))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words; empty where the text has fewer words."""
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows that occur at least twice. Windows count as equal if their 64-bit hashes are."""
    at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(at)

    def covered(s: Column) -> Column:
        def same(k: Column) -> Column:
            return F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))

        hit = F.filter(F.transform(s, lambda x, k: F.when(same(k) | F.when(k > 0, same(k - 1)).otherwise(False), x["i"])), lambda i: i.isNotNull())
        starts = F.array_sort(hit)
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.aggregate(F.array(ordered), F.lit(0).cast("long"), lambda _, s: covered(s)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the MEASURES to the rows of ``docs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c not in MEASURES]
    w, lines, h, whole = (fresh(docs, n) for n in ("_words", "_lines", "_hashes", "_whole"))
    step = docs.select(*(F.col(f"`{c}`") for c in kept), t.alias(whole))
    step = step.withColumn(w, words_of(F.col(whole)))
    step = step.withColumn(lines, F.filter(F.split(F.col(whole), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    step = step.withColumn(h, window_hashes(F.col(w)))
    return step.select(
        *(F.col(f"`{c}`") for c in kept),
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(h)).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(whole, F.lit("\\p{L}")).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without their text, with the measurements and ``failed``, the bitmask of failed rules."""
    bits = None
    for rule in RULES:
        bit = F.when(rule.condition(), F.lit(BIT[rule.name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text).drop(text).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...] = "v1", out: str = "kept") -> DataFrame:
    return rows.withColumn(out, F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that fail nothing else of the policy.

    The ledger is reduced to one count per distinct bitmask (at most 2^rules of them) before anything else.
    """
    mask = policy_mask(policy)
    counts = rows.groupBy((F.col("failed").bitwiseAND(F.lit(mask))).alias("bits")).agg(F.count("*").alias("n"))
    names = POLICIES[policy] if isinstance(policy, str) else policy
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in names)))
    per = counts.select("bits", "n", rules.alias("r"))
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
