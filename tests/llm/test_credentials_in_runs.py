import itertools
import math
import random
import re
from collections import Counter

import pytest

from glyphloom.llm import secrets_scan as S

NEW = S.labelled_credentials(200, seed=123)


def covered(before, after):
    """By format, how many fresh credentials lie within one span."""
    detector, found = S.default_detector(), Counter()
    for name, value in NEW:
        text = f"see {before}{value}{after} end"
        base = S.base_spans(text)
        a = 4 + len(before)
        found[name] += any(x <= a and a + len(value) <= y for x, _, y in base + S.grammar_spans(text, detector, base))
    return found


@pytest.mark.parametrize("before, after", [("=", ""), ("GH_PAT=", ""), ("https://example.com/v1/x?key=", ""), ("example.com/hook/", ""), ("my-host.example.com/hook-", "/tail.txt")])
def test_as_good_as_alone(before, after):
    alone, here = covered("", ""), covered(before, after)
    assert min(alone.values()) >= 0.95 * 200 and all(here[n] >= alone[n] - 1 for n in S.FORMATS)


def test_what_is_masked():
    value = next(v for n, v in NEW if n == "code_host" and S.default_detector().score(v)[1] >= 0)
    text = f"GH_PAT={value}, docs/2024-01-02/read_me-version.1.2.3-final and a/b={value}"
    base = S.base_spans(text)
    spans = S.grammar_spans(text, S.default_detector(), base)
    assert S.masked(text, spans) == "GH_PAT=[REDACTED], docs/2024-01-02/read_me-version.1.2.3-final and a/b=[REDACTED]"


def every_run(text, detector, base):
    """Brute force: every run of credential characters, however short, scored by every automaton."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
        value = m[0].strip(".=")
        at = m.start() + m[0].index(value)
        if any(x <= at and at + len(value) <= y for x, _, y in base):
            continue
        chance = -len(value) * math.log(len(S.ALPHABET))
        if any(a <= len(value) <= b and f.log_likelihood(value) - chance >= least for _, f, least, (a, b) in detector.formats):
            out.append((at, 3, at + len(value)))
        elif not m[0].isalnum():
            found = ((m.start() + x, m.start() + y) for x, y in detector.parts(m[0]))
            out += [(x, 3, y) for x, y in found if not any(c <= x and y <= d for c, _, d in base)]
    return out


def test_no_candidate_is_passed_over(spark, sf):
    rnd, detector = random.Random(2), S.default_detector()
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["x" * 5000, "-" * 3000, "=" * 80 + "\n" + "a-" * 300, "0123456789" * 50]
    texts += ["".join(rnd.choice("aeSGAIzeyJhbXyz.=-_/ 019") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    for _, value in NEW[::10]:
        k = rnd.randrange(len(value))
        texts += [f"at {value}. Or {value[:k]}", value[k:], value.translate({ord(c): None for c in "0123456789"}), f"{value}..=", "A" + value[:12]]
    for text in texts:
        base = S.base_spans(text)
        assert S.grammar_spans(text, detector, base) == every_run(text, detector, base)


ANY = ((S.ALPHABET, True),)


@pytest.mark.parametrize("phases", [ANY, (("abcZ", False), ("abc", True), (".", True)), (("ab", True),)])
def test_least_length(phases):
    """The bound against all strings over a small alphabet: none that is shorter reaches the score."""
    detector = S.fit([("k", v) for v in ["ab", "abab", "ababab", "abc", "aab"] * 2])
    (_, m, _, _), table = detector.formats[0], detector.tables[0]
    symbols = "".join(f"[{re.escape(x)}]{'*' if more else '?'}" for x, more in phases)
    scores = [(len(t), m.log_likelihood(t) + len(t) * math.log(len(S.ALPHABET))) for n in range(1, 6) for t in map("".join, itertools.product("abc.Z", repeat=n)) if re.fullmatch(symbols, t)]
    for least in [x for _, x in scores][::7]:
        assert S.least_length(m, least, table, phases) <= min(n for n, x in scores if x >= least)


def test_labelled_table(spark):
    """Formats learnt from a table; nulls and empty values count for nothing."""
    rows = [("own", f"own-{random.Random(k).getrandbits(64):016x}") for k in range(400)]
    table = spark.createDataFrame([*rows, rows[0], (None, "x" * 20), ("own", None), ("own", "")], "kind string, value string")
    detector = S.fit_table(table)
    fresh = [f"own-{random.Random(-k).getrandbits(64):016x}" for k in range(1, 200)]
    assert [f[0] for f in detector.formats] == ["own"]
    assert sum(bool(S.grammar_spans(f"a {v}, b", detector, [])) for v in fresh) >= 0.95 * len(fresh)
    assert S.grammar_spans("plain words with no such thing", detector, []) == []
    none = S.fit_table(table.limit(0))
    assert none.formats == () and S.grammar_spans(fresh[0], none, []) == []
