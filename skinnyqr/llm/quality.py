"""Quality rules: robust multivariate outliers per language and source.

Every document gets a vector of transformed statistics.  For each group
(language, source) a minimum-covariance-determinant estimate is found from
deterministic starts and concentration steps; documents whose Mahalanobis
distance from it is large are rejected.  All steps are SQL expressions.

Statistics are rounded to thousandths and kept as integers, so sums and
cross products are exact, whatever the partitioning.  A concentration step
is one aggregation: sums per (group, distance bin), then the bins that hold
the nearest share of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, broadcast_if_small, free_name, save, save_counted, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
STATS = ("f1", "f2", "f3", "f4", "f5")
#: Least standard deviation of each statistic, in thousandths: what counts as no difference at all.
#: With f4's, a line in three words that repeats an earlier one is enough for rejection (labelled good documents reach
#: a quarter of that).  f5 is at most ln 3, as the base rule rejects beyond, and good documents reach it: it only adds.
FLOORS = (150, 350, 350, 300, 600)
#: Share of a group that the determinant is minimised over.
SHARE = 0.75
STARTS = 2
#: Concentration ends when no group's determinant falls any more; more steps than this would be an error.
MOST_STEPS = 100
#: Squared distances: of points that enter the reweighted estimate (97.5 % of chi-square, 5 degrees), and of rejection.
REWEIGHT, REJECT = 12.83, 24.0
#: Groups with fewer documents are estimated together, first per language.
MIN_GROUP = 40
#: Verdicts that may be broadcast (16 bytes each).
MAX_BROADCAST = 2_000_000
CAP = 6400  # distance bins: 64 per unit, all beyond 100 in one


def base_columns(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols and n_dup_lines as the contract counts them; null text: empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    return {
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
        "dup_lines_": lines,
    }


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper.

    n_repeat_words: words that lie in a five-word window found at least
    twice in the text.  Windows are compared by 64-bit hash within one text;
    the positions of repeated windows come from one sort per text, so long
    texts cost n log n.
    """
    keep = docs.columns if keep is None else keep
    text = F.col(text_col).cast("string")
    base = base_columns(text)
    lines = base.pop("dup_lines_")
    one = docs.select(*keep, *(c.alias(f"q_{n}") for n, c in base.items()), lines.alias("q_lines"), F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("q_h"))
    two = one.select(
        "*",
        F.size("q_h").alias("q_n"),
        window_hashes(F.col("q_h"), 5).alias("q_w"),
    )
    repeated = F.expr(
        "CASE WHEN q_w IS NULL OR size(array_distinct(q_w)) = size(q_w) THEN NULL ELSE "
        "array_sort(transform(q_w, (h, i) -> struct(h AS h, i AS i))) END"
    )
    three = two.select("*", repeated.alias("q_s")).select(
        "*",
        F.expr(
            "array_sort(transform(filter(transform(q_s, (x, j) -> CASE WHEN (j > 0 AND q_s[greatest(j - 1, 0)].h = x.h) OR "
            "(j < size(q_s) - 1 AND q_s[least(j + 1, size(q_s) - 1)].h = x.h) THEN x.i ELSE -1 END), p -> p >= 0), p -> p))"
        ).alias("q_p"),
    )
    covered = F.expr("CASE WHEN q_p IS NULL THEN 0L ELSE aggregate(q_p, struct(-5 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(p - a.last, 5) AS n), a -> a.n) END")
    return three.select(
        *keep,
        F.col("q_n").cast("long").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.col("q_n_upper").alias("n_upper"),
    )


#: The vector: word length, symbols, capitals, repeated lines, repeated windows; logarithms of smoothed rates.
VECTOR = {
    "f1": "ln((word_chars + 50) / (n_words + 10.0))",
    "f2": "ln(1 + 100.0 * n_symbols / (word_chars + 50.0))",
    "f3": "ln(1 + 100.0 * n_upper / (word_chars + 50.0))",
    "f4": "ln(1 + 10.0 * n_dup_lines / (n_words + 10.0))",
    "f5": "ln(1 + 10.0 * n_repeat_words / (n_words + 10.0))",
}
BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def start_distance(kind: int) -> str:
    """Squared distance of a start: coordinatewise robust scores, summed (0) or their largest (1)."""
    z = [f"({f} - med_{f}) / greatest(1.4826 * mad_{f}, {w}.0)" for f, w in zip(STATS, FLOORS)]
    return " + ".join(f"({x}) * ({x})" for x in z) if kind == 0 else f"greatest({', '.join(f'({x}) * ({x})' for x in z)})"


def fit_columns(sums: str = "") -> list[list[tuple[str, str]]]:
    """Layers of (name, SQL): mean, covariance with floors, its Cholesky factor and log-determinant.

    From n, s_<i> and s_<i><j>, the count, sums and cross sums of a subset.
    """
    r = range(len(STATS))
    cov = [(f"m{i}", f"s_{i} / cast(n AS double)") for i in r]
    for i in r:
        for j in range(i + 1):
            floor = f" + {float(FLOORS[i] ** 2)}" if i == j else ""
            cov.append((f"c{i}{j}", f"cast(s_{j}{i} AS double) / n - (cast(s_{i} AS double) / n) * (cast(s_{j} AS double) / n){floor}"))
    layers = [cov]
    for j in r:
        minus = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        layers.append([(f"l{j}{j}", f"sqrt(greatest(c{j}{j}{minus}, 1.0))")])
        below = [(f"l{i}{j}", f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}") for i in range(j + 1, len(STATS))]
        if below:
            layers.append(below)
    layers.append([("det", " * ".join(f"l{i}{i}" for i in r))])
    return layers


def distance_layers() -> list[list[tuple[str, str]]]:
    """Layers that end in d2, the squared Mahalanobis distance, by forward substitution."""
    out = []
    for i in range(len(STATS)):
        out.append([(f"y{i}", f"({STATS[i]} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}")])
    out.append([("d2", " + ".join(f"y{i} * y{i}" for i in range(len(STATS))))])
    return out


FIT = ["n", *(f"m{i}" for i in range(5)), *(f"l{i}{j}" for i in range(5) for j in range(i + 1))][1:]
MOMENTS = [("n", "count(*)"), *((f"s_{i}", f"sum({STATS[i]})") for i in range(5)), *((f"s_{j}{i}", f"sum({STATS[i]} * {STATS[j]})") for i in range(5) for j in range(i + 1))]


def _layers(df: DataFrame, layers) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in layer))
    return df


def _concentrate(points: DataFrame, distance: str) -> DataFrame:
    """Estimate of each (grp, start) from the share of points with the least ``distance``."""
    binned = points.selectExpr("grp", "start", *STATS, f"cast(floor(64 * least(sqrt({distance}), {CAP // 64}.0)) AS int) AS bin")
    sums = binned.groupBy("grp", "start", "bin").agg(*(F.expr(sql).alias(name) for name, sql in MOMENTS))
    upto = sums.selectExpr("*", "sum(n) OVER (PARTITION BY grp, start ORDER BY bin) AS upto", "sum(n) OVER (PARTITION BY grp, start) AS total")
    inner = upto.filter(f"upto - n < {SHARE} * total").groupBy("grp", "start").agg(*(F.sum(name).alias(name) for name, _ in MOMENTS))
    return _layers(inner, fit_columns())


def estimates(stats: DataFrame, keep: Scratch) -> DataFrame:
    """(grp, m*, l*): reweighted minimum-covariance-determinant estimate of every group.

    Each start is concentrated until its determinant stops falling: a step
    takes the nearest SHARE of the group under the last estimate, and is
    undone where the determinant did not fall, which ends that start.
    """
    save = keep.save
    mid = save(stats.groupBy("grp").agg(*(F.expr(f"percentile({f}, 0.5)").alias(f"med_{f}") for f in STATS)), "medians")
    off = stats.join(mid, "grp").groupBy("grp").agg(*(F.expr(f"percentile(abs({f} - med_{f}), 0.5)").alias(f"mad_{f}") for f in STATS))
    rough = save(mid.join(off, "grp"), "rough")
    near = stats.join(rough, "grp").withColumn("start", F.explode(F.array(*(F.lit(i) for i in range(STARTS)))))
    kinds = " ".join(f"WHEN {i} THEN {start_distance(i)}" for i in range(STARTS))
    fit = save(_concentrate(near, f"CASE start {kinds} END"), "fit").select("grp", "start", "det", *FIT)
    done = None  # starts that have ended
    for _ in range(MOST_STEPS):
        again = _layers(stats.join(fit.drop("det"), "grp"), distance_layers())
        new = _concentrate(again, "d2").select("grp", "start", "det", *FIT)
        old = fit.select("grp", "start", F.col("det").alias("old"), *(F.col(c).alias(f"old_{c}") for c in FIT))
        step = save(new.join(old, ["grp", "start"]), "step")
        over = step.filter("det >= old").select("grp", "start", F.col("old").alias("det"), *(F.col(f"old_{c}").alias(c) for c in FIT))
        done = over if done is None else done.unionByName(over)
        fit = step.filter("det < old").select("grp", "start", "det", *FIT)
        if fit.isEmpty():
            break
    else:
        raise RuntimeError(f"concentration has not ended after {MOST_STEPS} steps")
    fit = done
    best = fit.selectExpr("*", "row_number() OVER (PARTITION BY grp ORDER BY det, start) AS place").filter("place = 1").drop("place", "det", "start")
    inside = _layers(stats.join(best, "grp"), distance_layers()).filter(f"d2 <= {REWEIGHT}")
    final = inside.groupBy("grp").agg(*(F.expr(sql).alias(name) for name, sql in MOMENTS))
    return save(_layers(final, fit_columns()).select("grp", *FIT), "estimates")


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, distance2 and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in
    repeated windows; such rows do not enter the estimates and are not kept.
    Other rows are kept while their squared distance is at most REJECT.
    Null and empty texts have no words (base_failed).  Null languages and
    sources are a group like any other.  Repeated rows count as often as
    they occur; other columns are ignored.
    """
    src = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    stats = statistics(src, keep=["doc_id", "lang", "source"])
    stats = stats.selectExpr("*", f"{BASE_FAILED} AS base_failed", *(f"cast(round(1000 * {sql}) AS long) AS {f}" for f, sql in VECTOR.items()))
    with Scratch(docs.sparkSession) as keep:
        return save(_verdicts(stats, keep), "quality")


def _verdicts(stats: DataFrame, keep: Scratch) -> DataFrame:
    stats = keep.save(stats, "stats")
    good = stats.filter("NOT base_failed")
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = f"CASE WHEN n >= {MIN_GROUP} THEN"
    in_lang = "sum(CASE WHEN n >= {0} THEN 0 ELSE n END) OVER (PARTITION BY lang)".format(MIN_GROUP)
    groups = sizes.selectExpr("lang", "source", "n", f"{in_lang} AS rest").selectExpr(
        "lang", "source", f"{small} concat('s', char(9), lang, char(9), source) WHEN rest >= {MIN_GROUP} THEN concat('l', char(9), lang) ELSE 'all' END AS grp"
    )
    groups = keep.save(groups, "groups")
    vectors = keep.save(good.join(groups, ["lang", "source"]).select("grp", *STATS), "vectors")
    far = _layers(stats.join(groups, ["lang", "source"], "left").join(estimates(vectors, keep), "grp", "left"), distance_layers())
    return far.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        f"NOT base_failed AND coalesce(d2 <= {REJECT}, true) AS kept", "round(d2, 6) AS distance2", "grp",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that quality_table keeps, with all their columns.

    The verdict travels with a 128-bit hash of the row's text, language and
    source, on which rows that repeat agree, so ids may be null or repeated.
    """
    key = free_name(docs, "quality_key")
    own = [F.col(c) for c in (text_col, lang_col, source_col)]
    marked = docs.withColumn(key, F.struct(F.xxhash64(*own).alias("x"), F.xxhash64(F.lit(1), *reversed(own)).alias("y")))
    view = marked.select(F.col(key).alias("doc_id"), own[0].alias("text"), own[1].alias("lang"), own[2].alias("source"))
    bad, n = save_counted(quality_table(view).filter("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "rejected")
    return marked.join(broadcast_if_small(bad, MAX_BROADCAST, n), key, "left_anti").drop(key)
