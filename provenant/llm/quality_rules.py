"""Quality rules with a robust test for multivariate outliers. DataFrame expressions only.

Base rules count words, symbols, repeated lines and repeated five-word windows of every whole text. What passes them
is judged by a minimum-covariance-determinant estimate of its language and source: vectors of transformed statistics
are rejected by Mahalanobis distance. The subset of least determinant is searched from several starts: each takes a few
concentration steps, the one whose covariance has the least determinant goes on, and it stops where the determinant no
longer falls. A step is one aggregation over a narrow table of statistics, so no group is ever gathered in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, cut, is_empty

SPACE = r"[ \x09-\x0D]+"
#: Least documents that a language and source needs for an estimate of its own; smaller ones of a language are pooled, and
#: documents of smaller pools are judged by the estimate of all documents together.
MIN_GROUP = 60
#: Part of a group that a concentration step keeps.
SUBSET = 0.75
#: Centres and shapes that the search starts from, by medians: deviations alone, and correlations of bounded scores or of directions.
STARTS = 3
#: Concentration steps of every start, and most of the one that goes on; the logarithm of its determinant has settled when it falls by less.
STEPS, MOST_STEPS, SETTLED = 2, 30, 1e-3
#: Rejected beyond this squared distance: the 0.999 quantile of chi-squared with six degrees of freedom.
CUTOFF = 22.4577
#: The 0.75 quantile of chi-squared with six degrees of freedom, to which a group's own quantile is scaled.
CHI2_SUBSET = 7.8408
#: Most groups whose estimates are broadcast, at about 0.5 kB each; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000

#: Name and least standard deviation of each transformed statistic. Repeats up to the base rule's bound are at most three
#: of theirs from none, and lines repeated with them add little; symbols at every eighth word are more than four of theirs.
STATS = {"x_words": 0.25, "x_length": 0.06, "x_symbols": 0.08, "x_lines": 0.12, "x_repeats": 0.15, "x_upper": 0.04}


def word_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks (long) to docs.

    A null text counts as an empty one: all counts are 0. Every row yields a row; ties and repeated rows count alike.
    """
    at = "__provenant_"
    text, trimmed, words, lines, keys, order, places = (at + x for x in ("text", "trim", "words", "lines", "keys", "order", "places"))
    keep = docs.columns
    c = F.col
    got = docs.withColumn(text, F.coalesce(column(docs, text_col), F.lit("")))
    got = got.withColumn(trimmed, F.expr(f"trim(BOTH ' \t\n\x0b\f\r' FROM {text})"))
    got = got.withColumns({
        words: F.when(c(trimmed) == "", F.array().cast("array<string>")).otherwise(F.split(c(trimmed), SPACE)),
        lines: F.filter(F.split(c(text), "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")),
        "n_symbols": F.regexp_count(c(text), F.lit("[#*$%&|<>]")).cast("long"),
        "n_upper": F.length(F.regexp_replace(c(text), r"[^\p{Lu}]+", "")).cast("long"),
        "n_marks": F.regexp_count(c(text), F.lit("[!?=~^_{}\\\\\\[\\]]")).cast("long"),
    })
    got = got.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        # A key for each window of five words. Equal windows of one text get equal keys; 64 bits tell others apart.
        keys: F.expr(f"if(size({words}) < 5, cast(array() as array<bigint>), transform(sequence(0, size({words}) - 5), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2], {words}[i + 3], {words}[i + 4])))"),
    })
    # Only a text with some key twice has its windows sorted; then a window counts if a neighbour has the same key.
    got = got.withColumn(order, F.expr(f"if(size(array_distinct({keys})) < size({keys}), array_sort(transform({keys}, (k, i) -> struct(k as k, i as i))), null)"))
    got = got.withColumn(places, F.expr(f"sort_array(filter(transform({order}, (s, j) -> if(s.k <=> get({order}, j - 1).k or s.k <=> get({order}, j + 1).k, s.i, null)), p -> p is not null))"))
    # Each such window covers the words up to the next one, five at most.
    got = got.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform({places}, (p, j) -> least(5, coalesce(get({places}, j + 1) - p, 5))), 0L, (a, x) -> a + x), 0L)"))
    return got.select(*(column(got, x) for x in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _transformed(stats: DataFrame) -> DataFrame:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumns({
        "x_words": F.log1p("n_words"),
        # Means of few words vary more; the root of their number brings short and long texts to one scale.
        "x_length": (F.log(chars / n) - F.log(F.lit(5.0))) * F.least(F.sqrt(n / 200.0), F.lit(1.0)),
        "x_symbols": F.sqrt((F.col("n_symbols") + F.col("n_marks")) / n) * F.least(F.sqrt(n / 100.0), F.lit(1.0)),
        "x_lines": F.log1p("n_dup_lines") / 4,
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
        # About one letter of 64 is a capital. Without a centre, the root would make short texts lack capitals.
        "x_upper": (F.sqrt(F.col("n_upper") / chars) - 0.125) * F.least(F.sqrt(n / 100.0), F.lit(1.0)),
    })


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _with_cholesky(rows: DataFrame, cov: dict[tuple[str, str], Column], names: list[str]) -> DataFrame:
    """Adds the lower Cholesky factor of a covariance, entry by entry, as structs would be too deep to share, and log_det."""
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = cov[b, a] - _total([F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]) if j else cov[b, a]
            rows = rows.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return rows.withColumn("log_det", 2 * _total([F.log(f"l_{i}_{i}") for i in range(len(names))]))


def _kept(names: list[str]) -> list[str]:
    """Columns of an estimate besides its group."""
    return [*(f"m_{x}" for x in names), *(f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)), "log_det"]


def _measured(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds distance, the squared one by the estimate that rows carry."""
    c = F.col
    for i, x in enumerate(names):
        rest = c(x) - c(f"m_{x}")
        rows = rows.withColumn(f"y_{i}", (rest - _total([c(f"l_{i}_{k}") * c(f"y_{k}") for k in range(i)]) if i else rest) / c(f"l_{i}_{i}"))
    return rows.withColumn("distance", _total([c(f"y_{i}") * c(f"y_{i}") for i in range(len(names))]))


def _moments(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """n, t_x and t_x_y: sums of values and of their products."""
    cols = list(values)
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"t_{x}") for x, v in values.items()), *(F.sum(values[a] * values[b]).alias(f"t_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]))


def _covariance(cols: list[str]) -> dict[tuple[str, str], Column]:
    c = F.col
    return {(a, b): (c(f"t_{a}_{b}") - c(f"t_{a}") * c(f"t_{b}") / c("n")) / c("n") for i, a in enumerate(cols) for b in cols[i:]}


def _starts(stats: DataFrame, group: list[str], names: dict[str, float], near) -> DataFrame:
    """group, start and the first estimates of each group, stored."""
    cols, c = list(names), F.col
    medians = cut(stats.groupBy(*group).agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"m_{x}") for x in cols)), "medians")
    off = stats.join(near(medians), group)
    spreads = cut(off.groupBy(*group).agg(*(F.percentile_approx(F.abs(c(x) - c(f"m_{x}")), 0.5, 2000).alias(f"s_{x}") for x in cols)).join(medians, group), "spreads")
    wide = {x: F.greatest(1.4826 * c(f"s_{x}"), F.lit(least)) for x, least in names.items()}
    scored = stats.join(near(spreads), group).withColumns({f"z_{x}": (c(x) - c(f"m_{x}")) / wide[x] for x in cols})
    length = F.greatest(F.sqrt(_total([c(f"z_{x}") * c(f"z_{x}") for x in cols])), F.lit(1e-9))
    bounded = _moments(scored, group, {x: F.tanh(f"z_{x}") for x in cols})
    turned = _moments(scored.withColumn("length", length), group, {x: c(f"z_{x}") / c("length") for x in cols})
    one = [spreads.withColumns({f"r_{a}_{b}": F.lit(float(a == b)) for i, a in enumerate(cols) for b in cols[i:]})]
    for made in (bounded, turned):
        cov = _covariance(cols)
        size = {x: F.sqrt(F.greatest(cov[x, x], F.lit(1e-9))) for x in cols}
        # A share of the identity keeps shapes regular where a statistic hardly varies.
        one.append(made.select(*group, *((F.lit(1.0) if a == b else 0.95 * cov[a, b] / (size[a] * size[b])).alias(f"r_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:])).join(spreads, group))
    whole = reduce(DataFrame.unionByName, [df.withColumn("start", F.lit(k)) for k, df in enumerate(one)])
    shaped = _with_cholesky(whole, {(a, b): c(f"r_{a}_{b}") * wide[a] * wide[b] for i, a in enumerate(cols) for b in cols[i:]}, cols)
    return cut(shaped.select(*group, "start", *_kept(cols)), "starts")


def concentrated(rows: DataFrame, estimate: DataFrame, group: list[str], names: dict[str, float], near) -> DataFrame:
    """The estimates of the parts of groups that are nearest by the given ones, of which rows of other groups are left out. Stored."""
    cols, c = list(names), F.col
    limit = _measured(rows.join(near(estimate), group), cols).groupBy(*group).agg(F.percentile_approx("distance", SUBSET, 2000).alias("limit")).join(near(estimate), group)
    inside = _measured(rows.join(near(limit), group), cols).filter("distance <= limit")
    # Moments about the last centre lose no digits.
    centre = [f"m_{x}" for x in cols]
    made = _moments(inside, [*group, *centre], {x: c(x) - c(f"m_{x}") for x in cols})
    cov = {(a, b): v + (F.lit(names[a] ** 2) if a == b else F.lit(0.0)) for (a, b), v in _covariance(cols).items()}
    moved = {f"m_{x}": c(f"m_{x}") + c(f"t_{x}") / c("n") for x in cols}
    return cut(_with_cholesky(made, cov, cols).withColumns(moved).select(*group, *_kept(cols)), "estimates")


def least_determinants(stats: DataFrame, group: list[str], names: dict[str, float]) -> DataFrame:
    """group, m_x, l_i_j (the covariance's Cholesky factor) and log_det of the estimate of each group of stats, a stored table.

    From each start STEPS concentration steps are taken; the one of least determinant goes on until that no longer falls.
    """
    cols, c = list(names), F.col
    few = stats.select(*group).distinct().count() * STARTS <= BROADCAST_GROUPS
    near = lambda df: F.broadcast(df) if few else df
    now = _starts(stats, group, names, near)
    each = stats.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    for _ in range(STEPS):
        now = concentrated(each, now, [*group, "start"], names, near)
    least = lambda df, *by: df.groupBy(*group).agg(F.min_by(F.struct(*_kept(cols)), F.struct("log_det", *by)).alias("e")).select(*group, "e.*")
    moving = cut(least(now, "start"), "best")
    passed = [moving]
    for _ in range(MOST_STEPS):
        further = concentrated(stats, moving, group, names, near)
        moving = further.join(near(moving.select(*group, c("log_det").alias("was"))), group).filter(c("log_det") < c("was") - SETTLED).drop("was")
        if is_empty(moving):
            break
        passed.append(moving)
    return cut(least(reduce(DataFrame.unionByName, passed)), "best")


def robust_distance(stats: DataFrame, group: list[str], names: dict[str, float]) -> DataFrame:
    """Adds distance (double): the squared Mahalanobis distance by the minimum-covariance-determinant estimate.

    stats must be a stored table. group: columns without nulls. names: statistics and the least deviation of each.
    """
    cols, c = list(names), F.col
    best = least_determinants(stats, group, names)
    near = F.broadcast if best.count() <= BROADCAST_GROUPS else lambda df: df
    scale = cut(_measured(stats.join(near(best), group), cols).groupBy(*group).agg(F.percentile_approx("distance", SUBSET, 2000).alias("limit")).join(best, group), "scales")
    scaled = c("distance") * F.least(F.lit(1.0), CHI2_SUBSET / F.greatest(c("limit"), F.lit(1e-9)))
    return _measured(stats.join(near(scale), group), cols).withColumn("distance", scaled).select(*stats.columns, "distance")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Judges every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    distance (double; null where the base rules fail). A null text is empty and fails; a null language or source is a
    group like any other. The least deviations bound an estimate of however few documents from below.
    Repeated rows are judged alike, an empty table gives an empty result, other columns are ignored.
    """
    ids = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), F.coalesce(column(docs, lang_col), F.lit("\x00")).alias("lang"), F.coalesce(column(docs, source_col), F.lit("\x00")).alias("source"))
    counted = word_statistics(ids).drop("text")
    stats = cut(_transformed(counted).withColumn("base_failed", base_failed()), "rules")
    sound = stats.filter("not base_failed")
    sizes = cut(sound.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("="), "source")).otherwise(F.lit("*"))), "sizes")
    pools = sizes.groupBy("lang", "pool").agg(F.sum("n").alias("n_pool")).filter(F.col("n_pool") >= MIN_GROUP)
    groups = cut(sizes.join(pools, ["lang", "pool"]).select("lang", "source", "pool"), "groups")
    all_judged = groups.count() == sizes.count()
    groups = F.broadcast(groups) if sizes.count() <= BROADCAST_GROUPS else groups
    plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    placed = stats.join(groups, ["lang", "source"], "left").withColumn("pool", F.when(~F.col("base_failed"), F.col("pool")))
    sound = placed.filter("not base_failed").select(*plain, "lang", "pool", *STATS)
    asked = sound.filter("pool is not null").withColumn("asked", F.lit(True))
    if not all_judged:
        asked = asked.unionByName(sound.withColumn("asked", F.col("pool").isNull()).withColumns({"lang": F.lit("\x01"), "pool": F.lit("\x01")}))
    judged = robust_distance(cut(asked, "judged"), ["lang", "pool"], STATS).filter("asked")
    judged = judged.select(*plain, (F.col("distance") <= CUTOFF).alias("kept"), "distance")
    rest = placed.filter("base_failed").select(*plain, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(rest)
