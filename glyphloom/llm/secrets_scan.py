"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

The patterns find assignments to names of secrets, access keys and long hexadecimal strings. Beyond them, every run of
credential characters is a candidate and is scored by each format's automaton (see ``grammar``): the logarithm of its
likelihood over that of a uniform string of the same length. Four fifths of a format's labelled credentials, by a hash, make its
automaton; the rest calibrate it: a candidate is a secret if for some format the score is at least LEAST_SCORE and at least what
all but the lowest hundredth of the format's held-out credentials have; merged states have forgotten lengths, so it must also be
at least half as long as the format's shortest labelled credential and at most twice as long as its longest. Plain words so
short that none of their length reaches any format's threshold (``least_length``, from the automata) need not be scored. Where a
whole run is no secret, the same is asked of its parts: from its start or from a letter or digit behind any other character, to
its end or before any character that is neither letter nor digit.
Parts that pass and overlap make one span, so that no end of a credential stays. Candidates that lie within a span of the
patterns add nothing.

Labelled credentials come from a table (``fit_table``) or a list; without any, they are made by public formats' rules from a fixed seed.

Defined results: null counts as the empty text, which has no spans; spans are in code points, end exclusive, ordered by
start and then by kind; a candidate that several formats accept is one span, so ties between formats change nothing; repeated
rows get equal results; an empty table gives an empty result; whole texts are read; columns beside the text may have any name.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import fresh, hash_fraction, sole, strings
from glyphloom.llm.grammar import SMOOTH, Automaton, infer

KINDS = ("assign", "access", "hex", "grammar")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN_CHARS = "[A-Za-z0-9+/_.=-]"
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
LEAST_SCORE = 8.0
#: One in so many labelled credentials is held out of its automaton and calibrates it.
HELD_OUT = 5
#: Longest length for which ``least_length`` looks.
LONGEST_LEAST = 256
#: Phases of a string, with the symbols of each and whether it may take more than one of them: here a plain word, small but for
#: its first letter, with marks behind it.
WORD_LIKE = ((string.ascii_letters, False), (string.ascii_lowercase, True), (".=", True))
MASK = "[REDACTED]"

HEX_CHARS = "0123456789abcdef"
UPPER = string.ascii_uppercase + string.digits
ALNUM = string.ascii_letters + string.digits
URL_SAFE = ALNUM + "_-"

#: Public formats: pieces that are fixed, or an alphabet and the lengths it may have. Fixed values.
FORMATS = {
    "access": [("AKIA", "ASIA"), (UPPER, (16,))],
    "hex": [(HEX_CHARS, (32, 40, 64))],
    "code_host": [("ghp_", "gho_", "ghs_"), (ALNUM, (36,))],
    "code_host_fine": [("github_pat_",), (ALNUM, (22,)), ("_",), (ALNUM, (59,))],
    "code_host_two": [("glpat-",), (URL_SAFE, (20,))],
    "packages": [("npm_",), (ALNUM, (36,))],
    "chat": [("xoxb-", "xoxp-"), (string.digits, (11, 12)), ("-",), (string.digits, (12,)), ("-",), (ALNUM, (24,))],
    "mail": [("SG.",), (URL_SAFE, (22,)), (".",), (URL_SAFE, (43,))],
    "maps": [("AIza",), (URL_SAFE, (35,))],
    "payment": [("sk_live_", "rk_live_", "sk_test_", "rk_test_"), (ALNUM, (24,))],
    "web_token": [("eyJhbGciOi",), (ALNUM, (10, 14)), (".eyJ",), (URL_SAFE, (20, 40)), (".",), (URL_SAFE, (43,))],
}


def labelled_credentials(per_format: int = 1000, seed: int = 7) -> list[tuple[str, str]]:
    """Format and value of credentials made by the FORMATS' rules."""
    rnd, out = random.Random(seed), []
    for name, pieces in FORMATS.items():
        for _ in range(per_format):
            made = []
            for piece in pieces:
                if len(piece) == 2 and isinstance(piece[1], tuple):
                    made.append("".join(rnd.choice(piece[0]) for _ in range(rnd.choice(piece[1]))))
                else:
                    made.append(rnd.choice(piece))
            out.append((name, "".join(made)))
    return out


@dataclass(frozen=True)
class Detector:
    """Automata by format, each with the score that a candidate must reach and the lengths that it may have."""

    formats: tuple[tuple[str, Automaton, float, tuple[int, int]], ...]

    def score(self, text: str) -> tuple[str, float]:
        """The format by which the candidate is furthest above the score asked for, and by how much."""
        chance = -len(text) * math.log(len(ALPHABET))
        able = ((m.log_likelihood(text) - chance - least, name) for name, m, least, (a, b) in self.formats if a <= len(text) <= b)
        best = max(able, default=(-math.inf, ""))
        return best[1], best[0]

    def parts(self, run: str) -> list[tuple[int, int]]:
        """Start and end of the parts of a run that reach the score asked for, in order; those that overlap are one.

        One pass for each format, which carries all starts that aren't yet too far back.
        """
        found = []
        for (_, _, least, (shortest, longest)), (moves, unseen, ends) in zip(self.formats, self.tables, strict=True):
            starts: list[list] = []
            for at, c in enumerate(run):
                if not at or (c.isalnum() and not run[at - 1].isalnum()):
                    starts.append([0, 0.0, at])
                if starts and at - starts[0][2] >= longest:
                    starts.pop(0)
                for s in starts:
                    s[0], gain = moves[s[0]].get(c, (s[0], unseen[s[0]]))
                    s[1] += gain
                if at + 1 == len(run) or not run[at + 1].isalnum():
                    found += [(a, at + 1) for state, score, a in starts if at + 1 - a >= shortest and score + ends[state] >= least]
        found.sort()
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    @cached_property
    def candidate(self) -> re.Pattern | None:
        """Runs that may be secrets, or have some in them; None without formats.

        Of runs that are a plain word, with marks behind it, only those are taken that are as long as one must be to reach a threshold.
        """
        if not self.formats:
            return None
        word = min(max(a, least_length(m, least, t, WORD_LIKE)) for (_, m, least, (a, _)), t in zip(self.formats, self.tables, strict=True))
        shortest = min(a for *_, (a, _) in self.formats)
        marks = 3
        skipped = f"(?![A-Za-z][a-z]{{0,{word - marks - 2}}}[.=]{{0,{marks}}}(?!{RUN_CHARS}))" if word > marks + 2 else ""
        return re.compile(f"(?<!{RUN_CHARS}){skipped}{RUN_CHARS}{{{shortest},}}")

    @cached_property
    def tables(self) -> list[tuple[list[dict[str, tuple[int, float]]], list[float], list[float]]]:
        """Per format and state: the moves with what they add to a score, what an unseen symbol and what the end adds."""
        out, chance = [], math.log(len(ALPHABET))
        for _, m, _, _ in self.formats:
            whole = [t + SMOOTH * (m.symbols + 1) for t in m.totals]
            moves = [{c: (nxt, math.log((n + SMOOTH) / w) + chance) for c, (nxt, n) in x.items()} for x, w in zip(m.moves, whole, strict=True)]
            out.append((moves, [math.log(SMOOTH / w) + chance for w in whole], [math.log((e + SMOOTH) / w) for e, w in zip(m.ends, whole, strict=True)]))
        return out


def least_length(automaton: Automaton, least: float, table: tuple, phases: tuple[tuple[str, bool], ...]) -> int:
    """The least length at which the likeliest string's score reaches ``least``; LONGEST_LEAST if none up to it does.

    Strings take their symbols from the phases in turn, or pass them over. An unseen symbol is always at hand, so the result is a bound.
    """
    moves, unseen, ends = table
    best = {(-1, 0): 0.0}
    for length in range(1, LONGEST_LEAST):
        new: dict[tuple[int, int], float] = {}
        for (phase, state), score in best.items():
            again = phase >= 0 and phases[phase][1]
            for k in range(phase if again else phase + 1, len(phases)):
                for c, (nxt, gain) in [*moves[state].items(), ("", (state, unseen[state]))]:
                    if c in phases[k][0]:
                        new[k, nxt] = max(new.get((k, nxt), -math.inf), score + gain)
        best = new
        if max(score + ends[state] for (_, state), score in best.items()) >= least - 1e-6:
            return length
    return LONGEST_LEAST


def fit(labelled: list[tuple[str, str]] | None = None, most: int = 2000, alpha: float = 0.05) -> Detector:
    """Automata of labelled credentials: at most ``most`` of each format, the first in the order of their hashes."""
    rows = labelled_credentials() if labelled is None else labelled
    by: dict[str, set[str]] = {}
    for name, value in rows:
        if name is not None and value:
            by.setdefault(name, set()).add(value)
    out = []
    for name in sorted(by):
        values = sorted(by[name], key=lambda v: hashlib.sha256(v.encode()).digest())[:most]
        # So few that none can be spared calibrate what they have made.
        held = values[::HELD_OUT] if len(values) >= 2 * HELD_OUT else values
        learnt = [v for k, v in enumerate(values) if k % HELD_OUT] if len(values) >= 2 * HELD_OUT else values
        m = infer(learnt, len(ALPHABET), alpha)
        scores = sorted(m.log_likelihood(v) + len(v) * math.log(len(ALPHABET)) for v in held)
        out.append((name, m, max(LEAST_SCORE, scores[len(scores) // 100]), (-(-min(map(len, values)) // 2), 2 * max(map(len, values)))))
    return Detector(tuple(out))


def fit_table(labelled: DataFrame, kind: str = "kind", value: str = "value", most: int = 2000, alpha: float = 0.05) -> Detector:
    """The same from a table of credentials: about ``most`` distinct ones of each kind, by a hash, are brought to the driver.

    Rows without kind or value, and empty values, count for nothing; a table without others gives a detector of the patterns alone.
    """
    rows = labelled.select(F.col(kind).alias("kind"), F.col(value).alias("value")).where("kind is not null and value <> ''").distinct()
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("kind") == name, F.lit(min(1.0, most / n))).otherwise(share)
    return fit([(r["kind"], r["value"]) for r in rows.where(hash_fraction(F.col("value")) < share).collect()], 2 * most, alpha)


@lru_cache(maxsize=1)
def default_detector() -> Detector:
    return fit()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's number and end of what the patterns find, in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def grammar_spans(text: str, detector: Detector, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same of candidates that an automaton accepts and that lie in no span of the patterns."""
    if detector.candidate is None:
        return []
    out = []
    for m in detector.candidate.finditer(text):
        value = m[0].strip(".=")
        a = m.start() + m[0].index(value)
        b = a + len(value)
        if any(x <= a and b <= y for x, _, y in base):
            continue
        if detector.score(value)[1] >= 0:
            out.append((a, 3, b))
        elif not m[0].isalnum():
            found = ((m.start() + x, m.start() + y) for x, y in detector.parts(m[0]))
            out += [(x, 3, y) for x, y in found if not any(c <= x and y <= d for c, _, d in base)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(text: Column, detector: Detector) -> Column:
    """A struct for a text column: counts of the patterns' spans, digest of them, all spans, and the text with them masked."""
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked")

    @F.arrow_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, masked string")
    def run(column: pa.Array) -> pa.Array:
        sole("secrets")
        rows = []
        for t in strings(column):
            base = base_spans(t or "")
            spans = sorted(base + grammar_spans(t or "", detector, base))
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), masked(t, spans) if spans else None))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return run(text)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with MASK in place of every span; spans that overlap count as one."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame, detector: Detector | None = None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with secrets masked in ``text``; ``length``, where there is such a column, follows the text."""
    scan = fresh(docs, "_scan")
    found = docs.withColumn(scan, scanned(F.col(text), detector or default_detector()))
    new = F.coalesce(F.col(f"{scan}.masked"), F.col(text))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(new.alias(c))
        elif c == length:
            kept = F.when(F.col(f"{scan}.masked").isNull(), F.col(c)).otherwise(F.char_length(f"{scan}.masked"))
            columns.append(kept.cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return found.select(*columns)
