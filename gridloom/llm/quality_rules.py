"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules reject short and repetitive texts. For the others five statistics are transformed (log
of the mean word length; square roots of the shares of symbols, capitals with exclamation marks,
repeated lines, and words in repeated windows). Per language and source a minimum-covariance-
determinant estimate of their centre and scatter is made from the base-passing documents: from two
starts concentration steps keep the h = 75 % nearest documents and estimate anew; the start that ends
with the smaller determinant wins. A text is rejected if its squared Mahalanobis distance is over `CUTOFF`.

Languages come first (starts: medians with quartile ranges; plain means and covariances), then each
language and source (starts: the language's estimate; own means). No group is too small for an estimate,
and no count switches from one to another: to the moments of a group's nearest documents those of `PRIOR`
documents like its language's are added (for a language: like all languages' together). A source with ten
documents is judged nearly as its language, one with a thousand by itself.

A concentration step is one aggregation: documents are counted and summed by group and distance bin
(a geometric grid), and the moments of the nearest bins are running sums over a few hundred bins, so
nothing is sorted or gathered by group, however large. The subset ends with the bin in which h is
reached. Each variance is kept above a floor, so statistics that hardly vary in a group do not turn
rounding into outliers. For the verdict, repeated lines and repeated words also get the error of their
count in the text itself, 1/(4 n) for the square root of a share of n (words count in threes, as windows
do): one repeated line of three is no outlier, nearly half of a hundred is.

Nulls in language or source form groups of their own; a null or empty text has no words and fails.
Repeated rows count each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import staged, unstaged

SPACE = r"[\x20\x09-\x0D]+"
P = 5
#: Smallest standard deviations of the five transformed statistics.
FLOORS = (0.05, 0.04, 0.03, 0.08, 0.09)
#: Of the last two statistics, the column that each counts and the variance of its root share times that count.
COUNTED = {3: ("n_lines", 0.25), 4: ("n_words", 0.75)}
PRIOR = 50
H = 0.75
#: H over the share of the chi-square law of P + 2 degrees below the H quantile of that of P.
CONSISTENCY = 1.41
#: Quantile 1 - 1e-6 of the chi-square law of P degrees.
CUTOFF = 35.9
STEPS = 3
BINS_PER_E = 40


def base_statistics(docs: DataFrame, *kept: str, text: str = "text") -> DataFrame:
    """The columns `kept`, lang and source of docs, with the base counts and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumn("words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    parts = parts.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))
    windows = F.slice(F.transform("hashes", window), F.lit(1), F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = parts.select(
        *kept, "lang", "source", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_replace(t, r"[^#*$%&|<>\p{Lu}!]+", "").alias("marks"),
        lines.alias("lines"), windows.alias("windows"),
    )
    parts = parts.withColumn("n_symbols", F.length(F.regexp_replace("marks", r"[^#*$%&|<>]+", "")).cast("long")).withColumn("n_loud", F.length(F.regexp_replace("marks", r"[#*$%&|<>]+", "")).cast("long"))
    parts = parts.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    parts = parts.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    places = F.filter("sorted", lambda x, k: x["h"].eqNullSafe(F.get("sorted", k - 1)["h"]) | x["h"].eqNullSafe(F.get("sorted", k + 1)["h"]))
    parts = parts.withColumn("places", F.sort_array(F.transform(places, lambda x: x["i"])))
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    out = parts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("marks", "lines", "windows", "sorted", "places")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), share("n_symbols", "word_chars"), share("n_loud", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.select("*", *(v.alias(f"z{i}") for i, v in enumerate(values)))


def _known(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name)))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"z{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in _pairs())]


def _cholesky(rows: DataFrame) -> DataFrame:
    """The covariance in c_ij replaced by its Cholesky factor."""
    for i in range(P):
        for j in range(i + 1):
            left = F.col(f"c{i}{j}")
            for k in range(j):
                left = left - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            rows = rows.withColumn(f"c{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 100))) if i == j else left / F.col(f"c{j}{j}"))
    return rows


def _factored(moments: DataFrame, *keys: str) -> DataFrame:
    """n and sums -> centre m_i, covariance v_ij, Cholesky factor c_ij of the scaled and floored covariance, logarithm of its determinant."""
    out = moments.select(*keys, *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *((F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")).alias(f"v{i}{j}") for i, j in _pairs()))
    out = out.select("*", *((CONSISTENCY * F.col(f"v{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _pairs()))
    return _with_determinant(_cholesky(out))


def _with_determinant(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log_det", sum((2 * F.log(f"c{i}{i}") for i in range(1, P)), 2 * F.log("c00")))


def _distance(rows: DataFrame) -> DataFrame:
    """rows with z, m and c -> the same with the squared Mahalanobis distance d2."""
    for i in range(P):
        left = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"c{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", left / F.col(f"c{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0")))


def _counted_distance(rows: DataFrame) -> DataFrame:
    """The same with the counting errors of each row's text added to its group's covariance. They concern the last
    two statistics, so only the part of these that the others leave unexplained is inverted anew, two by two."""
    for i in range(P):
        left = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(min(i, 3)):
            left = left - F.col(f"c{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", left / F.col(f"c{i}{i}") if i < 3 else left)
    error = lambda i: COUNTED[i][1] / F.greatest(F.col(COUNTED[i][0]), F.lit(1))
    a, b = F.col("c33") * F.col("c33") + error(3), F.col("c33") * F.col("c43")
    d = F.col("c43") * F.col("c43") + F.col("c44") * F.col("c44") + error(4)
    y = [F.col(f"y{i}") for i in range(P)]
    return rows.withColumn("d2", y[0] * y[0] + y[1] * y[1] + y[2] * y[2] + (d * y[3] * y[3] - 2 * b * y[3] * y[4] + a * y[4] * y[4]) / (a * d - b * b))


NAMES = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _pairs())]


def _shrunk(moments: DataFrame, prior: DataFrame, on: str) -> DataFrame:
    """Moments with those of PRIOR documents added that are like the prior's (n and sums, by `on`)."""
    one = prior.select(F.col(on), *((PRIOR * F.col(c) / F.col("n")).alias(f"prior_{c}") for c in NAMES))
    return moments.join(one, on).select(*(c for c in moments.columns if c not in NAMES), *((F.col(c) + F.col(f"prior_{c}")).alias(c) for c in NAMES))


def _pooled(moments: DataFrame, *keys: str) -> DataFrame:
    return moments.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in NAMES))


def _concentrated(rows: DataFrame, starts: DataFrame, prior: DataFrame | None) -> DataFrame:
    """The better start of each group after STEPS steps. prior: moments by group; None: those of all groups together."""
    now = staged(starts, "mcd")
    order = Window.partitionBy("grp", "start").orderBy("bin")
    for _ in range(STEPS):
        near = _distance(rows.join(now.drop("log_det"), "grp")).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS_PER_E))
        bins = near.groupBy("grp", "start", "bin").agg(*_sums())
        upto = bins.select("grp", "start", "bin", F.sum("n").over(Window.partitionBy("grp", "start")).alias("whole"), *(F.sum(c).over(order).alias(c) for c in NAMES))
        enough = upto.where(F.col("n") >= F.ceil(H * F.col("whole"))).withColumn("turn", F.row_number().over(order)).where("turn = 1").select("grp", "start", *NAMES)
        if prior is None:
            enough = staged(enough, "nearest")
            new = _shrunk(enough, _pooled(enough, "start"), "start")
        else:
            new = _shrunk(enough, prior, "grp")
        before, now = now, staged(_factored(new, "grp", "start"), "mcd")
        unstaged(before, enough)
    best = now.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    out = staged(now.join(best, ["grp", "start"]).drop("log_det", "start"), "estimates")
    unstaged(now)
    return out


def estimates(rows: DataFrame) -> DataFrame:
    """rows(l, cell, z0..) of base-passing documents -> centre m and factor c of each cell (column cell)."""
    zs = [f"z{i}" for i in range(P)]
    plain = staged(rows.groupBy("cell", "l").agg(*_sums()), "moments")
    by_lang = _pooled(plain.withColumnRenamed("l", "grp"), "grp").withColumn("start", F.lit("means"))
    means = _factored(_shrunk(by_lang, _pooled(by_lang, "start"), "start"), "grp", "start")
    quartiles = rows.groupBy(F.col("l").alias("grp")).agg(F.count("*").alias("n"), *(F.percentile_approx(z, [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i, z in enumerate(zs)))
    spread = [((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349 + FLOORS[i]).alias(f"c{i}{i}") for i in range(P)]
    none = [F.lit(0.0).alias(f"{x}{i}{j}") for x in "cv" for i, j in _pairs() if x == "v" or i != j]
    medians = quartiles.select("grp", F.lit("medians").alias("start"), *(F.col(f"p{i}")[1].alias(f"m{i}") for i in range(P)), *spread, *none)
    lang = _concentrated(rows.select(F.col("l").alias("grp"), *zs), means.unionByName(_with_determinant(medians)), None)

    cells = plain.select("cell", "l").withColumnRenamed("l", "grp").join(lang, "grp").drop("grp").withColumnRenamed("cell", "grp")
    cells = staged(cells, "languages")
    prior = cells.select("grp", F.lit(1.0).alias("n"), *(F.col(f"m{i}").alias(f"s{i}") for i in range(P)), *((F.col(f"v{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"q{i}{j}") for i, j in _pairs()))
    own = _factored(_shrunk(plain.drop("l").withColumnRenamed("cell", "grp"), prior, "grp"), "grp").withColumn("start", F.lit("means"))
    starts = own.unionByName(_with_determinant(cells).withColumn("start", F.lit("language")))
    out = _concentrated(rows.select(F.col("cell").alias("grp"), *zs), starts, prior)
    unstaged(plain, lang, cells)
    return out.withColumnRenamed("grp", "cell")


def _statistics(docs: DataFrame, *kept: str) -> DataFrame:
    """docs(kept.., lang, source, text) -> the columns kept, the base counts, base_failed, z0.., l and cell."""
    stats = transformed(base_statistics(docs, *kept)).withColumn("l", _known("lang"))
    return stats.withColumn("cell", F.concat_ws("\n", "l", _known("source")))


def _estimated(stats: DataFrame) -> DataFrame:
    return estimates(stats.where("NOT base_failed").select("l", "cell", *(f"z{i}" for i in range(P))))


def _judged(stats: DataFrame, found: DataFrame) -> DataFrame:
    """stats with d2 and kept."""
    judged = _counted_distance(stats.join(found, "cell", "left"))
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    stats = staged(_statistics(docs, "doc_id"), "statistics")
    judged = _judged(stats, _estimated(stats))
    return judged.select(F.col("doc_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"))


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps: each carries its columns to its own verdict, so ids may be null or
    repeated. The statistics are computed once and staged with the rows that pass the base rules; only rows of
    statistics are shuffled. The result reads what is staged in its `reads`."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    stats = staged(_statistics(rows, "row").withColumn("row", F.when(~F.col("base_failed"), F.col("row"))), "statistics")
    out = _judged(stats, _estimated(stats)).where("kept").select("row.*")
    out.reads = stats
    return out
