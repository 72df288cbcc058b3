"""Quality rules with DataFrame functions only: base rules, then robust multivariate outliers.

A minimum-covariance-determinant estimate of transformed text statistics is made for each language and source,
for each language, and for all documents. Three starts (quartile ranges; correlations of tanh; of spatial signs) each
take concentration steps, which keep the three quarters of the documents nearest the centre and take their mean and
covariance again; the start whose covariance has the least determinant goes on for further steps. A group's estimate is
then drawn towards its language's, and that towards all documents', the more the fewer documents it has: own and
parent's are weighed ``w`` to ``PULL``, where w is the number of documents inside the estimate beyond the p + 1 that any covariance
in p dimensions needs. So every group has an estimate, of whatever size. A document goes if its Mahalanobis distance exceeds the cut.

Medians and distance limits come from histograms, which add up over partitions: no group is ever gathered in one
task, and reruns agree. Statistics of whole texts are made inside each row from arrays; nothing is exploded or
shuffled but one row of numbers a document.

Defined results: null or empty text has no words and fails the base rules; null language or source is
a group of its own; repeated rows are judged alike and each kept; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bind, durable, few, join_groups, table

SYMBOLS = "#*$%&|<>"  # a character class holds them as they are
WINDOW = 5
#: Share of a group inside the estimate, concentration steps of each start and of the best one, documents that the parent's
#: estimate counts as, histogram steps a unit.
SHARE, STEPS, MORE, PULL, FINE = 0.75, 2, 2, 30, 64
#: Probability of the chi-square cut, and how far above it a document must lie: the statistics are
#: discrete and heavy-tailed, so a clean document may lie far out in one of them.
CUT, SLACK = 0.9999, 1.2
#: So many words of five characters are added to each text: means over a few words vary more.
PRIOR = 20
#: Standard deviation of each transformed statistic that the judging covariance has besides the estimate's: counts are
#: discrete, and a group in which one is zero for nearly all documents must not reject the first that differs a little.
DIMS = {"x_words": 0.5, "x_length": 0.10, "x_symbols": 0.05, "x_upper": 0.05, "x_marks": 0.05}


def repeated(words: Column) -> Column:
    """Words that lie in a window of five found twice or more; ``words``: their hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(j > 0, same(j, j - 1)).otherwise(False) | same(j, j + 1))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        add = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(bind(pairs, twice), start, add, lambda a: a["n"])

    counted = bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(counted)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts of each whole text, as longs."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.array_remove(F.split(t, f"{SPACE_CLASS}+"), ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda x, some: F.length(F.regexp_replace(x, f"[{some}]+", ""))
    counts = {
        "n_words": F.col("_w.n"),
        "word_chars": without(t, SPACE_CLASS[1:-1]),
        "n_symbols": F.length(t) - without(t, SYMBOLS),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.col("_w.r"),
        "n_upper": F.length(t) - without(t, "\\p{Lu}"),
        "n_marks": F.length(t) - without(t, "!?"),
    }
    rows = docs.withColumn("_w", bind(words, lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("r"))))
    return rows.select(F.col(doc_id).alias("doc_id"), "lang", "source", *(c.cast("long").alias(k) for k, c in counts.items()))


def transformed(rows: DataFrame) -> DataFrame:
    chars = F.col("word_chars") + PRIOR * 5
    return rows.withColumns({
        "x_words": F.log1p("n_words"),
        "x_length": F.log(chars / (F.col("n_words") + PRIOR)),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_upper": F.sqrt(F.col("n_upper") / chars),
        "x_marks": F.sqrt(F.col("n_marks") / chars),
    })


def chi_square(x: float, p: float) -> float:
    """P(chi-square with p degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi_quantile(q: float, p: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, p) < q else (low, mid)
    return high


#: Whose estimate: level 0 has a language and source, 1 a language, 2 neither.
GROUP = ["level", "g_lang", "g_source"]


def at_levels(rows: DataFrame) -> DataFrame:
    """Each row three times, with the keys of the groups that it helps to estimate."""
    rows = rows.withColumn("level", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return rows.withColumns({"g_lang": F.when(F.col("level") < 2, F.col("lang")), "g_source": F.when(F.col("level") < 1, F.col("source"))})


def _quantiles(rows: DataFrame, by: list[str], value: Column, ranks: list[float]) -> DataFrame:
    """For each key the upper edges of the histogram bins that reach the ranks; counts add up before the shuffle."""
    bins = rows.withColumn("_bin", F.floor(value * FINE)).groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    to, whole = Window.partitionBy(*by).orderBy("_bin"), Window.partitionBy(*by)
    bins = bins.withColumn("_to", F.sum("_n").over(to)).withColumn("_all", F.sum("_n").over(whole))
    edge = lambda r: F.min(F.when(F.col("_to") >= F.col("_all") * r, (F.col("_bin") + 1) / FINE))
    return bins.groupBy(*by).agg(*(edge(r).alias(f"_q{i}") for i, r in enumerate(ranks)), F.max("_all").alias("_all"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def first_estimates(rows: DataFrame) -> DataFrame:
    """GROUP, start, size, m{i}, c{i}_{j}: medians, and three covariances with the squared quartile ranges on the diagonal."""
    p = len(DIMS)
    long = rows.select(*GROUP, F.posexplode(F.array(*map(F.col, DIMS))).alias("_dim", "_x"))
    q = _quantiles(long, [*GROUP, "_dim"], F.col("_x"), [0.25, 0.5, 0.75])
    at = lambda c, i: F.max(F.when(F.col("_dim") == i, c))
    sd = lambda i, floor: F.greatest((at(F.col("_q2"), i) - at(F.col("_q0"), i)) / 1.349, F.lit(floor))
    middles = durable(q.groupBy(*GROUP).agg(F.max("_all").alias("size"), *(at(F.col("_q1"), i).alias(f"m{i}") for i in range(p)), *(sd(i, floor).alias(f"s{i}") for i, floor in enumerate(DIMS.values()))))
    rows = join_groups(rows, middles, GROUP, F.col("doc_id"))
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(DIMS)]
    rows = rows.withColumns({f"t{i}": F.tanh(z[i]) for i in range(p)} | {"_r": F.sqrt(sum((x * x for x in z), F.lit(1e-12)))})
    rows = rows.withColumns({f"u{i}": z[i] / F.col("_r") for i in range(p)})
    sums = [F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}_{j}") for k in "tu" for i, j in _pairs()]
    got = rows.groupBy(*GROUP).agg(F.first("size").alias("size"), *(F.first(f"{k}{i}").alias(f"{k}{i}") for k in "ms" for i in range(p)), *sums)

    def start(n: int, k: str) -> Column:
        """The covariance with the correlations of the sums ``k``; none where it is empty."""
        alike = lambda i, j: F.lit(0.0) if not k else F.coalesce(F.try_divide(F.col(f"{k}{i}_{j}"), F.sqrt(F.col(f"{k}{i}_{i}") * F.col(f"{k}{j}_{j}"))), F.lit(0.0)) * 0.999
        cells = (((F.col(f"s{i}") * F.col(f"s{j}")) * (F.lit(1.0) if i == j else alike(i, j))).alias(f"c{i}_{j}") for i, j in _pairs())
        return F.struct(F.lit(n).alias("start"), *cells)

    got = got.select(*GROUP, "size", *(f"m{i}" for i in range(p)), F.explode(F.array(start(0, ""), start(1, "t"), start(2, "u"))).alias("_s"))
    return got.select(*GROUP, "_s.start", "size", *(f"m{i}" for i in range(p)), *(f"_s.c{i}_{j}" for i, j in _pairs()))


def whitened(estimate: DataFrame) -> DataFrame:
    """The estimate with its Cholesky factor, l{i}_{j}, in place of the covariance, and the determinant's logarithm."""
    p, keys = len(DIMS), [c for c in estimate.columns if c in (*GROUP, "lang", "source", "start", "size")]
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            estimate = estimate.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    determinant = sum((2 * F.log(f"l{i}_{i}") for i in range(1, p)), 2 * F.log("l0_0"))
    return estimate.select(*keys, determinant.alias("log_det"), *(f"m{i}" for i in range(p)), *(f"l{i}_{j}" for i, j in _pairs()))


def distances(rows: DataFrame, white: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """The rows with d2, the squared Mahalanobis distance by whitened estimates."""
    rows = join_groups(rows, white, keys, F.col("doc_id"), how, small)
    for i, x in enumerate(DIMS):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"l{i}_{i}"))
    return rows.withColumn("d2", sum(F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(DIMS))))


def concentrate(rows: DataFrame, estimate: DataFrame, small: bool) -> DataFrame:
    """One step: the mean and covariance of the nearest share of each group, for each start."""
    # small tables are cut off from their history: planning would take longer than the work
    p, far, keys = len(DIMS), distances(rows, durable(whitened(estimate)), GROUP, small), [*GROUP, "start"]
    nearness = F.log(F.col("d2") + 1e-6)
    limits = durable(_quantiles(far, keys, nearness, [SHARE]).select(*keys, F.col("_q0").alias("_limit")))
    near = join_groups(far, limits, keys, F.col("doc_id"), small=small).where(nearness < F.col("_limit"))
    # sums about the last centre: no digits cancel
    y = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(DIMS)]
    sums = [F.sum(y[i]).alias(f"s{i}") for i in range(p)] + [F.sum(y[i] * y[j]).alias(f"s{i}_{j}") for i, j in _pairs()]
    got = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), *(F.first(f"m{i}").alias(f"o{i}") for i in range(p)), *sums)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    widen = SHARE / chi_square(chi_quantile(SHARE, p), p + 2)  # makes the covariance of the share that of the whole, for normal data
    cov = lambda i, j: widen * (F.col(f"s{i}_{j}") / F.col("n") - mean[i] * mean[j])
    return durable(got.select(*keys, "size", *((F.col(f"o{i}") + mean[i]).alias(f"m{i}") for i in range(p)), *(cov(i, j).alias(f"c{i}_{j}") for i, j in _pairs())))


def estimates(good: DataFrame) -> tuple[DataFrame, bool]:
    """GROUP, size, m{i}, c{i}_{j} with the least determinant found, and whether they are few; ``good``: rows at all levels."""
    estimate = durable(first_estimates(good))
    small = few(estimate, [*GROUP, "start"])  # later estimates are of these groups
    for _ in range(STEPS):
        estimate = concentrate(good, estimate, small)
    marks = durable(whitened(estimate)).select(*GROUP, F.struct("log_det", "start").alias("_d")).groupBy(*GROUP).agg(F.min("_d").alias("_d"))
    best = marks.select(*GROUP, F.col("_d.start").alias("_start"))
    estimate = durable(join_groups(estimate, best, GROUP, F.lit(0), small=small).where("start = _start").drop("_start"))
    for _ in range(MORE):
        estimate = concentrate(good, estimate, small)
    return estimate, small


def pulled(estimate: DataFrame, small: bool) -> DataFrame:
    """lang, source, m{i}, c{i}_{j}: each group's estimate drawn towards its language's, and that towards all documents'."""
    p = len(DIMS)
    names = [f"m{i}" for i in range(p)] + [f"c{i}_{j}" for i, j in _pairs()]
    level = lambda n, *keys: estimate.where(F.col("level") == n).select(*(F.col(f"g_{k}").alias(k) for k in keys), "size", *names)
    parent = lambda df: df.withColumnsRenamed({c: f"p_{c}" for c in [*names, "size"]})
    beyond = F.greatest(F.lit(0.0), SHARE * F.col("size") - (p + 1))
    weight = beyond / (beyond + PULL)
    blend = [(weight * F.col(c) + (1 - weight) * F.col(f"p_{c}")).alias(c) for c in names]
    langs = level(1, "lang").join(F.broadcast(parent(level(2))))  # one row
    langs = langs.select("lang", "size", *blend)
    groups = join_groups(level(0, "lang", "source"), parent(langs), ["lang"], F.col("source"), small=small).select("lang", "source", *blend)
    floor = list(DIMS.values())
    return groups.withColumns({f"c{i}_{i}": F.col(f"c{i}_{i}") + floor[i] ** 2 for i in range(p)})


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base_failed, d2 (null if no document of its group passes the base rules) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = durable(transformed(statistics(docs)).withColumn("base_failed", failed))
    estimate, small = estimates(at_levels(rows.where(~F.col("base_failed")).select("doc_id", "lang", "source", *DIMS)))
    judged = distances(rows, durable(whitened(durable(pulled(estimate, small)))), ["lang", "source"], small, "left")
    cut = SLACK * chi_quantile(CUT, len(DIMS))
    names = [c for c in rows.columns if not c.startswith("x_")]
    return judged.select(*names, "d2").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(False)))


def op7_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
