"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text is reduced to counts, the counts to a vector of transformed rates,
each a multiple of 1 / ``GRID``, so that sums are exact and nothing depends on
how rows are dealt to tasks. Per group (language and source), per language and
over the table a minimum-covariance-determinant estimate is found by
concentration steps over all rows: starting from coordinatewise medians and
quartile widths, rows are ranked by Mahalanobis distance, the nearest ``SHARE``
is kept, and mean and covariance are taken anew. A step is one pass: counts, sums
and sums of products are added up per 1/``OCTAVE`` octave of distance, a bounded
histogram in which the cut is found; rows of one such part are kept together.

A group's estimate is drawn towards its language's, and that towards the
table's, as if ``PRIOR`` texts more had been seen there; its factor (median
distance against the chi-square median) likewise. So small groups change over
to their language gradually, at no threshold. A text is rejected if its distance
passes a chi-square limit. All steps are grouped aggregates that combine on the
map side; a group's rows never meet in one task, and no row reaches the driver.

Variances have a floor (``FLOORS``), as most clean texts have no symbols or
repeats at all.

Defined results: null or empty text has no words and fails; null language or
source is a group of its own; repeated rows are all returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import map_bytes, store

#: Words of a window that is looked for twice in a text.
WINDOW = 8
#: Fixed limits: fewest words, most words (percent) in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of a group that concentration steps keep; steps; texts that the wider estimate counts for.
SHARE, STEPS, PRIOR = 0.75, 4, 100
#: Vector entries are multiples of one part in this; distances are ranked in this many parts of an octave.
GRID, OCTAVE = 1024, 64
#: Rejected texts are further out than all but this share of a normal population (z of one in a million).
LIMIT_Z = 4.753424
#: Vector entries and the least standard deviation of each.
FLOORS = {"v_length": 0.10, "v_symbol": 0.05, "v_upper": 0.08, "v_digit": 0.10, "v_mark": 0.08, "v_lines": 0.15,
          "v_repeat": 0.15}
NAMES = list(FLOORS)
#: Parts that the rows of a group are dealt to when they meet its estimate.
SALTS = 32
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?.,;:'\"()[]{}=/\\_-+~^`@"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the list, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = h[:n].copy()
    for k in range(1, window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # hashes only nominate: windows are compared by their words
    at = np.flatnonzero(np.isin(rolled, twice)).tolist()
    grams = [tuple(words[i:i + window]) for i in at]
    count = Counter(grams)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for i, g in zip(at, grams):
        if count[g] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def count_text(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then upper, digits, marks, lines with words."""
    words = text.split()
    joined = b"".join(words)
    chars = int(np.count_nonzero((np.frombuffer(joined, dtype=np.uint8) & 0xC0) != 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(joined)

    def number(some: bytes) -> int:
        return size - len(joined.translate(None, some))

    return (len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), number(_UPPER), number(_DIGITS), number(_MARKS), len(lines))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks",
           "n_lines")


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    fields = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])
    return map_bytes(docs, text_col, keep, fields, lambda: count_text)


def _vector(counts: DataFrame) -> DataFrame:
    """Mean word length as a logarithm, rates as arcsines of their roots."""
    def rate(x: str, of: str) -> F.Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(x) / F.greatest(F.col(of), F.lit(1)))))

    return (counts.withColumn("v_length", F.log((F.col("word_chars") + 5) / (F.col("n_words") + 1)))
            .withColumn("v_symbol", rate("n_symbols", "word_chars"))
            .withColumn("v_upper", rate("n_upper", "word_chars"))
            .withColumn("v_digit", rate("n_digits", "word_chars"))
            .withColumn("v_mark", rate("n_marks", "word_chars"))
            .withColumn("v_lines", rate("n_dup_lines", "n_lines"))
            .withColumn("v_repeat", rate("n_repeat_words", "n_words")))


def _groups(rows: DataFrame) -> DataFrame:
    """Keys of each row's group ``g`` and of its language ``lg``; vector entries on the grid."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("lang", "source"))
    on_grid = {c: F.round(F.col(c) * GRID) / GRID for c in NAMES}
    return rows.withColumns(on_grid | {"g": F.concat(F.lit("s:"), lang, F.lit("/"), source), "lg": F.concat(F.lit("l:"), lang)})


def _with_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows to one row per group ``g``; a group's rows go to ``SALTS`` tasks, and each gets the group's row."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*NAMES), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["g", "__salt"], how).drop("__salt")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]


def _distance(names: list[str] = NAMES) -> F.Column:
    """Squared Mahalanobis distance of a row to the centre (m_i) under the inverse covariance (w_ij)."""
    gap = [F.col(c) - F.col(f"m_{i}") for i, c in enumerate(names)]
    total = F.lit(0.0)
    for i, j in _pairs():
        total = total + gap[i] * gap[j] * F.col(f"w_{i}_{j}") * (1.0 if i == j else 2.0)
    return total


_MEANS, _COVS, _INVERSE = ([f"m_{i}" for i in range(len(NAMES))], [f"c_{i}_{j}" for i, j in _pairs()],
                            [f"w_{i}_{j}" for i, j in _pairs()])


def _inverted(moments: DataFrame, centred: bool = False) -> DataFrame:
    """From ``key`` columns, means m_i and mean products c_i_j (covariances if ``centred``) to means, covariances, the
    inverse covariance with variances floored."""
    floors = np.array([FLOORS[c] for c in NAMES])
    keys = [c for c in moments.columns if c not in _MEANS + _COVS]
    schema = T.StructType([moments.schema[c] for c in keys]
                          + [T.StructField(c, T.DoubleType()) for c in [*_MEANS, *_COVS, *_INVERSE]])

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[c] for c in _MEANS])
                cov = np.zeros((len(NAMES), len(NAMES)))
                for (i, j), c in zip(_pairs(), _COVS):
                    cov[i, j] = cov[j, i] = r[c] - (0 if centred else mean[i] * mean[j])
                short = np.maximum(0.0, floors ** 2 - np.diag(cov))
                floored = cov + np.diag(short + 1e-3 * floors ** 2)
                inverse = np.linalg.inv(floored)
                out.append([*(r[k] for k in keys), *mean, *(cov[i, j] for i, j in _pairs()),
                            *(inverse[i, j] for i, j in _pairs())])
            yield pd.DataFrame(out, columns=schema.names)

    return moments.mapInPandas(run, schema)


def chi_square(p: int, z: float) -> float:
    """Chi-square quantile with ``p`` degrees of freedom at a normal ``z`` (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _ranked(counted: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per key the value at each share's rank, from rows of key, value and number ``k`` (a bounded histogram per key)."""
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("k").over(Window.partitionBy(*keys))
    upto = counted.withColumn("__upto", F.sum("k").over(order)).withColumn("__all", total)
    return upto.groupBy(*keys).agg(F.first("__all").alias("n"), F.array(*[
        F.min(F.when(F.col("__upto") >= share * F.col("__all"), F.col(value))) for share in shares]).alias("at"))


def _octave(d2: F.Column) -> F.Column:
    return F.floor(F.log2(d2 + 2.0 ** -20) * OCTAVE).cast("int")


def _nearest(codes: DataFrame, share: float) -> DataFrame:
    """``g, n``, means and mean products over the nearest ``share`` of each group's rows of ``g, code`` and vectors."""
    products = {c: F.col(NAMES[i]) * F.col(NAMES[j]) for (i, j), c in zip(_pairs(), _COVS)}
    sums = dict(zip(_MEANS, map(F.col, NAMES))) | products
    hist = codes.groupBy("g", "code").agg(F.count(F.lit(1)).alias("k"), *[F.sum(x).alias(c) for c, x in sums.items()])
    order = Window.partitionBy("g").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    parts = hist.withColumn("__upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy("g")))
    # the part that holds the cut's rank is the last one kept
    kept = parts.where(F.col("__upto") - F.col("k") < share * F.col("n"))
    return kept.groupBy("g", "n").agg(*[(F.sum(c) / F.sum("k")).alias(c) for c in sums])


def estimates(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """``g, n``, means and covariances of each group's estimate over rows of ``g`` and vectors."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(NAMES)]))
    counted = rows.select("g", values.alias("v")).groupBy("g", "v.i", "v.x").agg(F.count(F.lit(1)).alias("k"))
    quartiles = _ranked(counted, ["g", "i"], "x", [0.25, 0.5, 0.75])
    floor = F.element_at(F.array(*[F.lit(f) for f in FLOORS.values()]), F.col("i") + 1)
    width = F.greatest((F.col("at")[2] - F.col("at")[0]) / 1.349, floor)
    spread = (quartiles.select("g", "n", "i", F.col("at")[1].alias("m"), width.alias("b")).groupBy("g")
              .agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}_{i}")
                                              for i in range(len(NAMES)) for c in "mb"]))
    start = spread.select("g", "n", *_MEANS, *[(F.col(f"b_{i}") ** 2 if i == j else F.lit(0.0)).alias(c)
                                               for (i, j), c in zip(_pairs(), _COVS)])
    params = store(_inverted(start, centred=True), "mcd-start")
    for _ in range(steps):
        codes = _with_group(rows, params.drop("n", *_COVS)).select("g", *NAMES, _octave(_distance()).alias("code"))
        params = store(_inverted(_nearest(codes, share)), "mcd-step")
    return params.drop(*_INVERSE)


def _drawn(narrow: DataFrame, wide: DataFrame, on: str, names: list[str]) -> DataFrame:
    """Columns ``names`` of one table drawn towards those of a wider group, by numbers of texts; ``on`` names the wider group."""
    w = wide.select(F.col("g").alias(on), *[F.col(c).alias(f"__{c}") for c in names])
    size = F.col("n").cast("double")
    met = narrow.join(w, on, "left")
    mixed = [F.coalesce((size * F.col(c) + PRIOR * F.col(f"__{c}")) / (size + PRIOR), F.col(c)).alias(c) for c in names]
    return met.select(*[c for c in narrow.columns if c not in names], *mixed)


def group_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per group ``g``: n, the inverse covariance and centre drawn towards its language's and the table's, and ``factor``."""
    worded = rows.where("n_words > 0")
    levels = F.explode(F.array("g", "lg", F.lit("all")))
    found = estimates(worded.select(levels.alias("level"), *NAMES).withColumnRenamed("level", "g"), steps)
    names = [*_MEANS, *_COVS]
    whole = found.where("g = 'all'")
    langs = _drawn(found.where("g LIKE 'l:%'").withColumn("of", F.lit("all")), whole, "of", names).drop("of")
    keys = worded.select("g", "lg").distinct()
    own = _drawn(found.where("g LIKE 's:%'").join(keys, "g"), langs, "lg", names)
    params = store(_inverted(own, centred=True).select("g", "lg", "n", *_MEANS, *_INVERSE), "mcd-drawn")
    codes = _with_group(worded.drop("lg"), params).select("g", "lg", _octave(_distance()).alias("code"))
    counted = store(codes.groupBy("g", "lg", "code").agg(F.count(F.lit(1)).alias("k")), "distance-counts")

    def factors(key: str) -> DataFrame:
        some = counted.groupBy(F.col(key).alias("g"), "code").agg(F.sum("k").alias("k"))
        median = F.pow(F.lit(2.0), (F.col("at")[0] + 0.5) / OCTAVE)
        return _ranked(some, ["g"], "code", [0.5]).select("g", F.greatest(F.lit(1.0), median / chi_square(len(NAMES), 0.0)).alias("factor"))

    drawn = _drawn(params.join(factors("g"), "g"), factors("lg"), "lg", ["factor"])
    return store(drawn.select("g", *_MEANS, *_INVERSE, "factor"), "mcd-factors")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS,
          limit_z: float = LIMIT_Z) -> DataFrame:
    """Counts per document, ``base_failed``, its squared robust ``distance`` and the verdict ``kept``."""
    counts = text_counts(docs, [id_col, "lang", "source"], text_col)
    rows = store(_groups(_vector(store(counts, "text-counts"))), "text-vectors")
    params = group_estimates(rows, steps)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    distance = F.when(F.col("n_words") > 0, _distance() / F.col("factor"))
    limit = chi_square(len(NAMES), limit_z)
    return _with_group(rows, params, "left").select(
        F.col(id_col).alias("doc_id"), *_COUNTS, failed.alias("base_failed"), distance.alias("distance"),
        (~failed & (F.coalesce(distance, F.lit(0.0)) <= limit)).alias("kept"))
