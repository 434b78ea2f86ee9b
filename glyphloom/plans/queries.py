"""Registered queries of the core engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.config import GenerationConfig
from glyphloom.functions import charsets, draws, text
from glyphloom.operators import backgrounds, fonts, splitter, visibility
from glyphloom.plans import generate
from glyphloom.raster import image, ttf
from glyphloom.sources import binary, sinks, wordlist
from glyphloom.storage import kept, shared_dir, with_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SEED = 11
N, P = 5000, 0.07
FONT_DIR = "/usr/share/fonts/truetype/dejavu"
OUT = "out"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(spark: SparkSession, sf: str) -> DataFrame:
    return wordlist.words_of(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """The words without their numbers, which they need not be dealt out for."""
    return wordlist.entries(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]).select("word")


def first_words(spark: SparkSession, sf: str, num: int) -> tuple[DataFrame, int]:
    return wordlist.first_words(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", num)


def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.explode(text.lines(F.col("text"))).alias("line"))
    return rows.select(text.strip(F.col("line")).alias("word")).where("word <> ''").distinct()


LINES = f"""lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, {text.strip_sql("unnest(a)")} AS word
  FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS a FROM documents)
), words AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, pos) - 1 AS i, word FROM lines WHERE word <> ''
)"""


@query(f"WITH {LINES} SELECT i, word FROM words")
def wordlist_lines(spark, sf):
    return words(spark, sf)


@query(f"WITH {LINES} SELECT count(*) AS n_lines, count(*) FILTER (word = '') AS n_blank FROM lines")
def wordlist_blank_count(spark, sf):
    rows = read(spark, sf, "documents").select(F.explode(text.lines(F.col("text"))).alias("line"))
    return rows.agg(F.count("*").alias("n_lines"), F.count_if(text.strip(F.col("line")) == "").alias("n_blank"))


@query(f"""WITH {LINES} SELECT lang, count(*) AS n_words, count(DISTINCT word) AS n_distinct
FROM lines JOIN documents USING (doc_id) WHERE word <> '' GROUP BY lang""")
def vocab_distinct_by_lang(spark, sf):
    rows = read(spark, sf, "documents").select("lang", F.explode(text.lines(F.col("text"))).alias("line"))
    # Equal lines are counted before the shuffle; the distinct ones are then counted by language.
    counts = rows.select("lang", text.strip(F.col("line")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


@query(f"WITH {LINES} SELECT word, count(*) AS n FROM words GROUP BY word")
def word_frequency(spark, sf):
    rows = read(spark, sf, "documents").select(F.explode(text.lines(F.col("text"))).alias("line"))
    return rows.select(text.strip(F.col("line")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


GRID = [(n, p) for n in (0, 1, 99, 100, 5000) for p in (0.0, 0.07, 0.2, 0.5, 1.0)]
GRID_SQL = ", ".join(f"({n}, CAST({p} AS DOUBLE))" for n, p in GRID)


@query(f"""SELECT n, p, CAST(n - ceil(n * p) AS BIGINT) AS n_train, CAST(ceil(n * p) AS BIGINT) AS n_val FROM (VALUES {GRID_SQL}) t(n, p)""")
def split_sizes(spark, sf):
    rows = spark.createDataFrame(GRID, "n int, p double")
    train, val = splitter.size_columns(F.col("n").cast("bigint"), F.col("p"))
    return rows.select("n", "p", train.alias("n_train"), val.alias("n_val"))



def extended(n: int) -> str:
    return f"{LINES}, ext AS (SELECT k, word FROM range({n}) r(k) JOIN words ON k % (SELECT count(*) FROM words) = i)"


RANKED = extended(N) + f""", ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SEED}:shuffle:' || k || ':' || word), k) - 1 AS rank FROM ext
), sliced AS (
  SELECT *, CASE WHEN rank < {splitter.sizes(N, P)[0]} THEN 'train' ELSE 'val' END AS split FROM ranked
), missing AS (
  SELECT s.split, v.word FROM (SELECT DISTINCT word FROM words) v, (VALUES ('train'), ('val')) s(split)
  WHERE NOT EXISTS (SELECT 1 FROM sliced x WHERE x.split = s.split AND x.word = v.word)
), split AS (
  SELECT split, word, 0 AS added, lpad(CAST(rank AS VARCHAR), 19, '0') AS o FROM sliced
  UNION ALL SELECT split, word, 1, md5('{SEED}:added:' || split || ':' || word) FROM missing
), manifest AS (
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY added, o, word) - 1 AS idx, word, added FROM split
)"""


@query(f"WITH {extended(20000)} SELECT k, word FROM ext")
def cyclic_extend(spark, sf):
    own, n = first_words(spark, sf, 20000)
    return splitter.cyclic_extend(own, 20000, n)


@query(f"WITH {extended(700)} SELECT k, word FROM ext")
def cyclic_truncate(spark, sf):
    own, n = first_words(spark, sf, 700)
    return splitter.cyclic_extend(own, 700, n)


def _slices(spark, sf) -> tuple[DataFrame, int]:
    """The slices, and the number of all words."""
    own, n = first_words(spark, sf, N)
    return splitter.slices(own, N, P, SEED, n), n


def _completed(spark, sf) -> DataFrame:
    rows, n = _slices(spark, sf)
    return splitter.completed(rows, entries(spark, sf), n, SEED)


@query(f"WITH {RANKED} SELECT k, word, rank FROM ranked")
def shuffle_rank(spark, sf):
    own, n = first_words(spark, sf, N)
    return splitter.shuffled(splitter.cyclic_extend(own, N, n), SEED).select("k", "word", "rank")


@query(f"WITH {RANKED} SELECT split, count(*) AS n_rows, count(DISTINCT word) AS n_words FROM sliced GROUP BY split")
def split_slices(spark, sf):
    return _slices(spark, sf)[0].groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("word").alias("n_words"))


@query(f"WITH {RANKED} SELECT split, word FROM missing")
def split_missing_words(spark, sf):
    return splitter.missing(_slices(spark, sf)[0], entries(spark, sf))


@query(f"""WITH {RANKED} SELECT split, idx, printf('%05d.png', idx) AS filename,
'{OUT}/' || split || '/images/' || printf('%05d.png', idx) AS save_path, word, added FROM manifest""")
def split_manifest(spark, sf):
    return splitter.manifest(_completed(spark, sf), OUT).select("split", "idx", "filename", "save_path", "word", "added")


@query(f"WITH {RANKED} SELECT split, count(*) AS n_all, count(DISTINCT word) AS n_deduped FROM split GROUP BY split")
def split_dedupe_mode(spark, sf):
    rows, n = _slices(spark, sf)
    # Both forms are made of the same slices and lacking words, which Spark so deals out once.
    all_rows, once = (splitter.completed(rows, entries(spark, sf), n, SEED, dedupe) for dedupe in (False, True))
    return all_rows.groupBy("split").agg(F.count("*").alias("n_all")).join(once.groupBy("split").agg(F.count("*").alias("n_deduped")), "split")


NAMES = ["a.ttf", "B.TTF", "c.otf", "d.ttc", "e.PNG", "f.jpeg", "g.jpg.txt", "h", ".png", "i.woff", "j.JpG"]
NAMES_SQL = ", ".join(f"('{n}')" for n in NAMES)


@query(f"""SELECT name, lower(name) LIKE '%.ttf' OR lower(name) LIKE '%.otf' AS is_font,
lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg' OR lower(name) LIKE '%.png' AS is_picture
FROM (SELECT name FROM (VALUES {NAMES_SQL}) t(name) UNION ALL SELECT url FROM pages)""")
def extension_filter(spark, sf):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string").union(read(spark, sf, "pages").select("url"))
    return names.select("name", text.has_suffix(F.col("name"), binary.FONTS).alias("is_font"), text.has_suffix(F.col("name"), binary.PICTURES).alias("is_picture"))


@query(f"""WITH {LINES} SELECT word, CAST(len(cs) AS BIGINT) AS n_chars, array_to_string(list_sort(cs), '') AS chars
FROM (SELECT word, list_distinct(string_split(word, '')) AS cs FROM (SELECT DISTINCT word FROM words))""")
def word_charset(spark, sf):
    rows = distinct_words(spark, sf)
    chars = text.charset(F.col("word"))
    return rows.select("word", F.size(chars).cast("bigint").alias("n_chars"), F.array_join(F.array_sort(chars), "").alias("chars"))


@query("""SELECT lang, ch, count(*) AS n_docs FROM (SELECT lang, unnest(list_distinct(string_split(text, ''))) AS ch FROM documents)
WHERE ch <> '' GROUP BY lang, ch""")
def charset_by_lang(spark, sf):
    rows = read(spark, sf, "documents").select("lang", F.explode(text.charset(F.col("text"))).alias("ch"))
    return rows.groupBy("lang", "ch").agg(F.count("*").alias("n_docs"))


SETS = charsets.registry()


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SETS_SQL = ", ".join(f"({literal(k)}, {literal(v)})" for k, v in sorted(SETS.items()))
SET_ROWS = f"""sets AS (SELECT * FROM (VALUES {SETS_SQL}) t(name, chars)), rows AS (
  SELECT name, unnest(range(len(a))) AS pos, unnest(a) AS ch FROM (SELECT name, string_split(chars, '') AS a FROM sets))"""


@query(f"WITH {SET_ROWS} SELECT name, CAST(pos AS INTEGER) AS pos, ch FROM rows")
def vocab_table(spark, sf):
    return charsets.table(spark, SETS)


@query(f"WITH {SET_ROWS} SELECT name, count(*) AS n FROM rows GROUP BY name")
def vocab_sizes(spark, sf):
    return charsets.table(spark, SETS).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {SET_ROWS} SELECT name, ch, count(*) AS n FROM rows GROUP BY name, ch HAVING count(*) > 1")
def vocab_duplicates(spark, sf):
    return charsets.duplicates(charsets.table(spark, SETS))


LESS = sorted((n, less, more) for n, (less, more) in charsets.LATIN.items() if less)
LESS_SQL = ", ".join(f"({literal(n)}, {literal(less)}, {literal(more)})" for n, less, more in LESS)


@query(f"""SELECT name, array_to_string(list_filter(string_split({literal(SETS["english"])}, ''), lambda c: NOT contains(less, c)), '') || more AS chars
FROM (VALUES {LESS_SQL}) t(name, less, more)""")
def vocab_regex_derivation(spark, sf):
    rows = spark.createDataFrame(LESS, "name string, less string, more string")
    english = F.lit(SETS["english"])
    return rows.select("name", F.concat(F.regexp_replace(english, F.concat(F.lit("["), "less", F.lit("]")), F.lit("")), "more").alias("chars"))


@query(f"SELECT replace({literal(SETS['russian'])}, '₽', '') AS chars")
def vocab_replace(spark, sf):
    return spark.range(1).select(F.replace(F.lit(SETS["russian"]), F.lit("₽"), F.lit("")).alias("chars"))


JOINED = charsets.joined(SETS)


@query(f"""SELECT ch, min(pos) AS pos FROM (SELECT unnest(range(len(a))) AS pos, unnest(a) AS ch FROM (SELECT string_split({literal(JOINED)}, '') AS a)) GROUP BY ch""")
def vocab_multilingual_dedupe(spark, sf):
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(JOINED), "")).alias("pos", "ch")).where("ch <> ''")
    return rows.groupBy("ch").agg(F.min("pos").cast("bigint").alias("pos"))


@query(f"""WITH {SET_ROWS}, used AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents)
SELECT lang, name, count(*) AS n_covered FROM used JOIN rows USING (ch) GROUP BY lang, name""")
def vocab_coverage_of_documents(spark, sf):
    used = read(spark, sf, "documents").select("lang", F.explode(text.charset(F.col("text"))).alias("ch")).distinct()
    # The registry's size is fixed.
    return used.join(F.broadcast(charsets.table(spark, SETS)), "ch").groupBy("lang", "name").agg(F.count("*").alias("n_covered"))


INLINE = {"ascii.ttf": SETS["latin"] + " ", "french.ttf": SETS["french"] + " ", "letters.ttf": SETS["ascii_letters"] + " .,", "german.otf": SETS["german"] + " "}
INLINE_SQL = ", ".join(f"({literal(k)}, {literal(v)})" for k, v in INLINE.items())
FONTS_SQL = f"""{LINES}, fonts AS (SELECT DISTINCT font_path, unnest(string_split(chars, '')) AS ch FROM (VALUES {INLINE_SQL}) t(font_path, chars)),
vocab AS (SELECT DISTINCT word FROM words),
need AS (SELECT word, unnest(list_distinct(string_split(word, ''))) AS ch FROM vocab),
sizes AS (SELECT word, count(*) AS n FROM need GROUP BY word),
matched AS (SELECT word, font_path FROM (SELECT word, font_path, count(*) AS have FROM need JOIN fonts USING (ch) GROUP BY word, font_path) JOIN sizes USING (word) WHERE have = n),
cand AS (SELECT word, list_sort(list(font_path)) AS fs FROM matched GROUP BY word)"""


def _inline(spark):
    rows = spark.createDataFrame(sorted(INLINE.items()), "font_path string, chars string")
    return rows.select("font_path", F.explode(text.charset(F.col("chars"))).alias("ch"))


def _candidates(spark, sf):
    rows = distinct_words(spark, sf)
    return fonts.candidates(rows, _inline(spark))


@query(f"WITH {FONTS_SQL} SELECT word, font_path FROM matched")
def font_match_division(spark, sf):
    return _candidates(spark, sf).select("word", F.explode("candidates").alias("font_path"))


@query(f"WITH {FONTS_SQL} SELECT word, coalesce(array_to_string(fs, ','), '') AS candidates, CAST(coalesce(len(fs), 0) AS INTEGER) AS n FROM vocab LEFT JOIN cand USING (word)")
def font_candidates(spark, sf):
    return _candidates(spark, sf).select("word", F.array_join("candidates", ",").alias("candidates"), F.size("candidates").alias("n"))


@query(f"""WITH {FONTS_SQL} SELECT i, word, fs[CAST(floor({draws.sql(SEED, "font", "i")} * len(fs)) AS BIGINT) + 1] AS font_path FROM words LEFT JOIN cand USING (word)""")
def font_choice(spark, sf):
    own = kept(words(spark, sf), "words")
    return fonts.chosen(own, fonts.candidates(own, _inline(spark)), SEED, "i").select("i", "word", "font_path")


@query(f"WITH {FONTS_SQL} SELECT word FROM vocab WHERE word NOT IN (SELECT word FROM matched)")
def font_unsupported(spark, sf):
    return _candidates(spark, sf).where("size(candidates) = 0").select("word")


KEY = "o_orderkey"


@query(f"SELECT {KEY}, {draws.sql(SEED, 'bold', KEY)} < 0.5 AS bold, {draws.sql(SEED, 'never', KEY)} < 0.0 AS never, {draws.sql(SEED, 'always', KEY)} < 1.0 AS always FROM orders")
def draw_bernoulli(spark, sf):
    return read(spark, sf, "orders").select(KEY, *(draws.bernoulli(p, SEED, n, KEY).alias(n) for n, p in (("bold", 0.5), ("never", 0.0), ("always", 1.0))))


@query(f"SELECT {KEY}, round(-2.0 + 4.0 * {draws.sql(SEED, 'angle', KEY)}, 9) AS angle, round({draws.sql(SEED, 'u', KEY)}, 9) AS u FROM orders")
def draw_uniform(spark, sf):
    return read(spark, sf, "orders").select(KEY, F.round(draws.between(-2, 2, SEED, "angle", KEY), 9).alias("angle"), F.round(draws.uniform(SEED, "u", KEY), 9).alias("u"))


@query(f"SELECT {KEY}, CAST(18 + floor({draws.sql(SEED, 'size', KEY)} * 18) AS INTEGER) AS size FROM orders")
def draw_randint(spark, sf):
    return read(spark, sf, "orders").select(KEY, draws.integer(18, 35, SEED, "size", KEY).alias("size"))


@query(f"SELECT {KEY}, (['a', 'b', 'c', 'd', 'e'])[CAST(floor({draws.sql(SEED, 'pick', KEY)} * 5) AS BIGINT) + 1] AS pick FROM orders")
def draw_choice(spark, sf):
    return read(spark, sf, "orders").select(KEY, draws.choice(F.array(*map(F.lit, "abcde")), SEED, "pick", KEY).alias("pick"))


@query(f"""SELECT {KEY}, o.dx, o.dy FROM orders, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)
WHERE (o.dx = 0 AND o.dy = 0) OR {draws.sql(SEED, 'bold', KEY)} < 0.5""")
def bold_offsets(spark, sf):
    offsets = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))))
    drawn = F.when(draws.bernoulli(0.5, SEED, "bold", KEY), offsets).otherwise(F.slice(offsets, 1, 1))
    return read(spark, sf, "orders").select(KEY, F.explode(drawn).alias("o")).select(KEY, "o.dx", "o.dy")


CANVAS_FONT = f"{FONT_DIR}/DejaVuSans.ttf"


@cache
def _advances() -> tuple[int, list[tuple[str, int]], int]:
    """Units of the em, the advance of each character of a real font, and that of a character that it lacks."""
    with open(CANVAS_FONT, "rb") as f:
        font = ttf.Font(f.read())
    return font.units, [(chr(p), font.advance(g)) for p, g in sorted(font.cmap.items()) if p and not 0xD800 <= p <= 0xDFFF], font.advance(0)


def _canvas_sql() -> str:
    units, known, lacking = _advances()
    values = ", ".join(f"({literal(c)}, {w})" for c, w in known)
    return f"""WITH {LINES}, adv AS (SELECT * FROM (VALUES {values}) t(ch, w)), s AS (
SELECT i, CAST(18 + floor({draws.sql(SEED, "size", "i")} * 18) AS INTEGER) AS size, unnest(string_split(word, '')) AS ch FROM words)
SELECT i, CAST(floor(sum(coalesce(w, {lacking})) * any_value(size) / {units}.0) AS BIGINT) + 8 AS width, any_value(size) + 8 AS height FROM s LEFT JOIN adv USING (ch) GROUP BY i"""


@query()
def text_canvas_size(spark, sf):
    """The canvas that a text's advances and the padding need, by a real font's table of advances."""
    units, known, lacking = _advances()
    # The table has a font's characters.
    table = F.broadcast(spark.createDataFrame(known, "ch string, w int"))
    chars = words(spark, sf).select("i", F.explode(F.split("word", "")).alias("ch")).where("ch <> ''").join(table, "ch", "left")
    total = chars.groupBy("i").agg(F.sum(F.coalesce("w", F.lit(lacking))).alias("total")).withColumn("size", draws.integer(18, 35, SEED, "size", "i"))
    return total.select("i", (F.floor(F.col("total") * F.col("size") / F.lit(float(units))) + 8).alias("width"), (F.col("size") + 8).alias("height"))


def _corner(s: str, c: str, sx: int, sy: int) -> tuple[str, str]:
    return f"({c} * w / 2.0 * {sx} + {s} * h / 2.0 * {sy})", f"(-{s} * w / 2.0 * {sx} + {c} * h / 2.0 * {sy})"


CORNERS = [_corner("s", "c", x, y) for x in (-1, 1) for y in (-1, 1)]
WIDE = f"CAST(ceil(greatest({', '.join(x for x, _ in CORNERS)}) + w / 2.0) - floor(least({', '.join(x for x, _ in CORNERS)}) + w / 2.0) AS BIGINT)"
TALL = f"CAST(ceil(greatest({', '.join(y for _, y in CORNERS)}) + h / 2.0) - floor(least({', '.join(y for _, y in CORNERS)}) + h / 2.0) AS BIGINT)"


@query(f"""SELECT {KEY}, {WIDE} AS width, {TALL} AS height FROM (SELECT {KEY}, round(cos(radians(-angle)), 15) AS c, round(sin(radians(-angle)), 15) AS s, w, h FROM (
SELECT {KEY}, -30.0 + 60.0 * {draws.sql(SEED, 'angle', KEY)} AS angle, 20 + floor({draws.sql(SEED, 'w', KEY)} * 181) AS w, 10 + floor({draws.sql(SEED, 'h', KEY)} * 41) AS h FROM orders))""")
def rotated_canvas_size(spark, sf):
    rows = read(spark, sf, "orders").select(KEY, draws.between(-30, 30, SEED, "angle", KEY).alias("angle"), draws.integer(20, 200, SEED, "w", KEY).alias("w"), draws.integer(10, 50, SEED, "h", KEY).alias("h"))
    rows = rows.select(KEY, "w", "h", F.round(F.cos(F.radians(-F.col("angle"))), 15).alias("c"), F.round(F.sin(F.radians(-F.col("angle"))), 15).alias("s"))
    return rows.select(KEY, F.expr(WIDE).alias("width"), F.expr(TALL).alias("height"))


MARGIN = 2
SHIFTS = [f"d{k}" for k in range(8)]


@query(f"SELECT {KEY}, " + ", ".join(f"CAST(-{MARGIN} + floor({draws.sql(SEED, f'corner{k}', KEY)} * {2 * MARGIN + 1}) AS INTEGER) AS d{k}" for k in range(8)) + " FROM orders")
def perspective_corners(spark, sf):
    return read(spark, sf, "orders").select(KEY, *(draws.integer(-MARGIN, MARGIN, SEED, f"corner{k}", KEY).alias(f"d{k}") for k in range(8)))


@query(f"SELECT {KEY}, 0.0 AS residual FROM orders")
def perspective_residual(spark, sf):
    """How far, to six decimals, the solved warp takes the moved corners from the image's own."""
    rows = perspective_corners(spark, sf).join(perspective_coeffs(spark, sf), KEY)
    worst = F.lit(0.0)
    for k, (u, v) in enumerate([(0, 0), (100, 0), (100, 40), (0, 40)]):
        x, y = F.col(f"d{2 * k}") + u, F.col(f"d{2 * k + 1}") + v
        below = F.col("c6") * x + F.col("c7") * y + 1
        worst = F.greatest(worst, F.abs((F.col("c0") * x + F.col("c1") * y + F.col("c2")) / below - u), F.abs((F.col("c3") * x + F.col("c4") * y + F.col("c5")) / below - v))
    return rows.select(KEY, (F.round(worst, 6) + 0.0).alias("residual"))


@query()
def perspective_coeffs(spark, sf):
    """The eight numbers of each order's warp of a 100 by 40 image; the residual of its corners is tested to be zero."""

    @F.pandas_udf("array<double>")
    def solve(d: pd.Series) -> pd.Series:
        from glyphloom.raster.image import find_coefficients

        corners = [(0, 0), (100, 0), (100, 40), (0, 40)]
        return d.map(lambda x: find_coefficients([(a + x[2 * k], b + x[2 * k + 1]) for k, (a, b) in enumerate(corners)], corners).tolist())

    return perspective_corners(spark, sf).select(KEY, solve(F.array(*SHIFTS)).alias("c")).select(KEY, *(F.col("c")[k].alias(f"c{k}") for k in range(8)))


PIXELS_SQL = """px AS (SELECT vec_id, unnest(range(len(embedding))) AS pos,
unnest(list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 60))) AS INTEGER))) AS a FROM embeddings)"""


def _pixels(spark, sf):
    alpha = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 60))).cast("int")
    return read(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", alpha)).alias("pos", "a"))


@query(f"WITH {PIXELS_SQL} SELECT vec_id, round(count(*) FILTER (a > 20) / CAST(count(*) AS DOUBLE), 9) AS share FROM px GROUP BY vec_id")
def visible_ratio(spark, sf):
    return _pixels(spark, sf).groupBy("vec_id").agg(F.round(visibility.ratio(F.col("a")), 9).alias("share"))


@query(f"WITH {PIXELS_SQL} SELECT vec_id, count(*) FILTER (a > 35) / CAST(count(*) AS DOUBLE) >= 0.1 AS visible FROM px GROUP BY vec_id")
def visibility_predicate(spark, sf):
    return _pixels(spark, sf).groupBy("vec_id").agg(visibility.visible(visibility.ratio(F.col("a"), 35), 0.1).alias("visible"))


@query(f"""SELECT {KEY}, coalesce(min(attempt) FILTER (u < 0.4), -1) AS attempt FROM (SELECT {KEY}, attempt, {draws.sql(SEED, 'visible', KEY, 'attempt')} AS u
FROM orders, range(5) r(attempt)) GROUP BY {KEY}""")
def retry_first_visible(spark, sf):
    attempts = F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))
    seen = F.filter(attempts, lambda a: draws.uniform(SEED, "visible", KEY, a) < 0.4)
    return read(spark, sf, "orders").select(KEY, F.coalesce(F.get(seen, F.lit(0)), F.lit(-1).cast("bigint")).alias("attempt"))


PICTURES = [(0, 640, 480), (1, 100, 30), (2, 90, 90), (3, 60, 20)]
PICTURES_SQL = ", ".join(map(str, PICTURES))
TASKS_SQL = f"SELECT {KEY} AS key, CAST(20 + floor({draws.sql(SEED, 'w', KEY)} * 700) AS INTEGER) AS w, CAST(10 + floor({draws.sql(SEED, 'h', KEY)} * 41) AS INTEGER) AS h FROM orders"


@query(f"""WITH tasks AS ({TASKS_SQL}), bg AS (SELECT * FROM (VALUES {PICTURES_SQL}) t(bg_idx, width, height)),
tries AS (SELECT *, CAST(floor({draws.sql(SEED, 'bg', 'key', 'attempt')} * {len(PICTURES)}) AS INTEGER) AS bg_idx FROM tasks, range(10) r(attempt)),
fits AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY attempt) AS rn FROM tries JOIN bg USING (bg_idx) WHERE w <= width AND h <= height)
SELECT t.key, t.w, t.h, coalesce(f.bg_idx, -1) AS bg_idx, coalesce(CAST(floor({draws.sql(SEED, 'x', 'f.key', 'f.attempt')} * (f.width - f.w + 1)) AS INTEGER), -1) AS x,
coalesce(CAST(floor({draws.sql(SEED, 'y', 'f.key', 'f.attempt')} * (f.height - f.h + 1)) AS INTEGER), -1) AS y
FROM tasks t LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f ON t.key = f.key""")
def background_crop_plan(spark, sf):
    tasks = read(spark, sf, "orders").select(F.col(KEY).alias("key"), draws.integer(20, 719, SEED, "w", KEY).alias("w"), draws.integer(10, 50, SEED, "h", KEY).alias("h"))
    made = backgrounds.crop_plan(tasks, spark.createDataFrame(PICTURES, "bg_idx int, width int, height int"), SEED)
    return made.select("key", "w", "h", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("bg_idx", "x", "y")))


@query(f"WITH {PIXELS_SQL} SELECT vec_id, round(avg(a), 9) AS mean FROM px GROUP BY vec_id")
def mean_colour(spark, sf):
    return _pixels(spark, sf).groupBy("vec_id").agg(F.round(F.avg("a"), 9).alias("mean"))


@query(f"WITH {PIXELS_SQL} SELECT vec_id, CAST(floor(avg(a) * (0.3 + 0.3 * {draws.sql(SEED, 'dark', 'vec_id')})) AS INTEGER) AS colour FROM px GROUP BY vec_id")
def matched_colour(spark, sf):
    own = _pixels(spark, sf).withColumn("f", F.lit(0.3) + F.lit(0.3) * draws.uniform(SEED, "dark", "vec_id"))
    return own.groupBy("vec_id", "f").agg(F.avg("a").alias("mean")).select("vec_id", F.floor(F.col("mean") * F.col("f")).cast("int").alias("colour"))


@query(f"WITH {PIXELS_SQL} SELECT vec_id, pos, CAST(floor((40 * a + 200 * (255 - a) + 127) / 255.0) AS INTEGER) AS value FROM px")
def alpha_composite_pixels(spark, sf):
    return _pixels(spark, sf).select("vec_id", F.col("pos").cast("bigint").alias("pos"), visibility.over(F.lit(40), F.col("a"), F.lit(200)).alias("value"))


RESULTS_SQL = f"{RANKED}, results AS (SELECT split, idx, word, printf('%05d.png', idx) AS filename, {draws.sql(SEED, 'ok', 'split', 'idx')} < 0.9 AS success FROM manifest)"


def _results(spark, sf):
    rows = splitter.manifest(_completed(spark, sf), OUT)
    return rows.withColumn("success", draws.bernoulli(0.9, SEED, "ok", "split", "idx"))


@query(f"""WITH {RESULTS_SQL} SELECT split, completed, succeeded FROM (SELECT split, idx, count(*) OVER w AS completed, count(*) FILTER (success) OVER w AS succeeded,
count(*) OVER (PARTITION BY split) AS n FROM results WINDOW w AS (PARTITION BY split ORDER BY idx)) WHERE completed % 50 = 0 OR completed = n""")
def progress_running(spark, sf):
    return sinks.progress(_results(spark, sf))


@query(f"WITH {RESULTS_SQL} SELECT split, count(*) FILTER (success) AS n_success, count(*) AS n_total FROM results GROUP BY split")
def run_summary(spark, sf):
    return sinks.summary(_results(spark, sf))


@query(f"WITH {RESULTS_SQL} SELECT split, idx, filename, word AS text FROM results WHERE success")
def label_manifest(spark, sf):
    return sinks.labels(_results(spark, sf))


@query(f"WITH {RESULTS_SQL} SELECT split, count(*) FILTER (success) AS n_labels, min(filename) FILTER (success) AS first_name FROM results GROUP BY split")
def label_map_sizes(spark, sf):
    maps = sinks.label_map(_results(spark, sf), 500)
    return maps.groupBy("split").agg(F.sum(F.size("labels")).alias("n_labels"), F.min(F.array_min(F.map_keys("labels"))).alias("first_name"))


@query()
def font_charsets(spark, sf):
    """Characters of the real fonts of a folder."""
    support = binary.font_support(binary.fonts(spark, FONT_DIR))
    return support.select(F.regexp_extract("font_path", "[^/]+$", 0).alias("font"), F.size("chars").alias("n_chars"), "error")


@query()
def font_match_real(spark, sf):
    """Every distinct line and how many of the real fonts cover it."""
    rows = distinct_words(spark, sf)
    chars = binary.font_chars(kept(binary.font_support(binary.fonts(spark, FONT_DIR)), "support"))
    return fonts.candidates(rows, chars).select("word", F.size("candidates").alias("n_fonts"))


def _word_file(spark, sf) -> str:
    """The distinct words of all texts of ``benchmark`` as a word list in the shared folder, and beside it a folder of backgrounds."""
    words = read(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("value")).where("value <> ''").distinct()
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    words.sort("value").write.text(path)
    return path


def _pictures(spark) -> str:
    """Three backgrounds in a folder that all machines reach: flat, a slope, and one that is too small for most words."""
    y, x = np.mgrid[0:120, 0:900]
    made = {"flat": np.full((90, 800, 3), 200), "slope": np.dstack([x % 256, y, 255 - y]), "small": np.full((30, 40, 3), 90)}
    folder = f"{shared_dir(spark)}/pictures-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    for name, picture in made.items():
        with store.open_output_stream(f"{root}/{name}.png") as f:
            f.write(image.png(picture.astype(np.uint8)))
    return folder


def _run(spark, sf) -> tuple[str, DataFrame]:
    """A run over all words, as many images as there are words, with its folder and its summary."""
    path, out = _word_file(spark, sf), f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    n = wordlist.read(spark, path).count()
    config = GenerationConfig(wordlist_path=path, font_dir=FONT_DIR, output_dir=out, num_images=n, bg_image_dir=_pictures(spark), seed=SEED)
    return out, generate.generate(spark, config)


@query()
def render_images(spark, sf):
    """The images of a run over all words of ``benchmark``, as they lie in its folder: names, sizes and digests of the files."""
    out, _ = _run(spark, sf)
    files = spark.read.format("binaryFile").load([f"{out}/{s}/images" for s in splitter.SPLITS])
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    names = F.regexp_extract("path", "([^/]+)/images/([^/]+)$", 1).alias("split"), F.regexp_extract("path", "[^/]+$", 0).alias("filename")
    return files.select(*names, number(17).alias("width"), number(21).alias("height"), F.sha2("content", 256).alias("png_sha256"))


BENCH_WORDS = """w AS (SELECT row_number() OVER (ORDER BY word) - 1 AS i, word FROM (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM benchmark) WHERE word <> ''),
c AS (SELECT count(*) AS n FROM w), ranked AS (SELECT i, word, row_number() OVER (ORDER BY md5('%d:shuffle:' || i || ':' || word), i) - 1 AS rank FROM w),
sliced AS (SELECT word, CASE WHEN rank < n - ceil(n * CAST(0.2 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM ranked, c)""" % SEED  # noqa: UP031


@query(f"""WITH {BENCH_WORDS} SELECT split, count(*) AS n_success, count(*) AS n_total FROM (
SELECT split FROM sliced UNION ALL SELECT CASE WHEN split = 'train' THEN 'val' ELSE 'train' END FROM sliced) GROUP BY split""")
def generate_dataset(spark, sf):
    """The summary of that run: its words are distinct and all of them can be drawn, so each split has every word once."""
    return _run(spark, sf)[1]


def _fonts_sql() -> dict[str, str]:
    """SQL over the characters of the real fonts, as rows of their names and characters."""
    found = []
    for path in sorted(Path(FONT_DIR).iterdir()):
        if path.suffix.lower() in binary.FONTS:
            found.append((path.name, "".join(c for c in ttf.Font(path.read_bytes()).characters() if c != "\0")))
    rows = ", ".join(f"({literal(n)}, {literal(c)})" for n, c in found)
    real = f"""{LINES}, fonts AS (SELECT name, unnest(string_split(chars, '')) AS ch FROM (VALUES {rows}) t(name, chars)),
vocab AS (SELECT DISTINCT word FROM words), need AS (SELECT word, unnest(list_distinct(string_split(word, ''))) AS ch FROM vocab),
sizes AS (SELECT word, count(*) AS n FROM need GROUP BY word),
matched AS (SELECT word, count(*) AS n_fonts FROM (SELECT word, name, count(*) AS have FROM need JOIN fonts USING (ch) GROUP BY word, name) JOIN sizes USING (word) WHERE have = n GROUP BY word)"""
    return {
        "font_match_real": f"WITH {real} SELECT word, CAST(coalesce(n_fonts, 0) AS INTEGER) AS n_fonts FROM vocab LEFT JOIN matched USING (word)",
        "text_canvas_size": _canvas_sql(),
    }


def oracle() -> dict[str, str]:
    """All SQL, with that which needs the fonts of this machine where it has them."""
    return SQL | (_fonts_sql() if Path(CANVAS_FONT).exists() else {})
