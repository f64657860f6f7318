"""Quality rules: robust outliers of text statistics, per language and source.

Each text gives a vector of transformed statistics. Within each (language, source) a
minimum-covariance-determinant estimate is made by concentration steps from four
deterministic starts: medians with median deviations, the plain mean and covariance, the
covariance of squashed deviations, and the half of the rows nearest to the medians. In a step
the share `KEEP` of rows nearest to the current centre gives the next mean and covariance,
made consistent for normal rows by `CONSISTENCY`; after `TRIAL` steps the start with the
smallest determinant goes on alone, and each group stops when its own determinant falls no
more. Languages and all rows together are estimated in the same way. A group's estimate
is then drawn towards that of its language, and the language's towards that of all, by weights
that are equal at `PRIOR` rows: a group of any size has its own, a small one leans on what is
around it, and no row count switches between the two. Rows whose robust Mahalanobis
distance is beyond a chi-square quantile go.

Everything is DataFrame work on one slim table; a group adds up through partial sums, and
its quantiles come from counts per bin, so a group may hold any share of the rows. Centres
and factors, a row for each group, travel to the rows as a broadcast up to `MOST_BROADCAST`
groups and by a join beyond.

Null and empty texts have no words and fail the base rule; null languages and sources are
groups of their own; repeated rows get a verdict each; ties at a quantile fall on one side
together; extra columns, whatever their names, play no part and are kept by
keep_documents(); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.durable import discard, durable
from graphloom.llm.common import WORD

LEAST_WORDS = 50
REPEAT_PERCENT = 50
KEEP = 0.75
#: KEEP over the chance that a chi-square variable with seven degrees is below the KEEP quantile with five.
CONSISTENCY = 1.412
#: Steps of all starts, and how little the log of a determinant falls once the best has settled.
TRIAL, SETTLED = 3, 2e-3
#: At how many rows a group's own estimate and the one around it weigh the same.
PRIOR = 100.0
MOST_BROADCAST = 100_000
#: Smallest standard deviation of each statistic: statistics that are nearly constant in clean text.
FLOORS = {"v_word": 0.05, "v_symbol": 0.03, "v_line": 0.12, "v_repeat": 0.12, "v_upper": 0.05}
#: Squared distance beyond which a row is an outlier: the 1 - 1e-7 quantile of chi-square with five degrees.
CUTOFF = 40.9
#: Width of the bins that quantiles are read from: of scaled statistics, and of the log of distances.
BIN, LOG_BIN = 0.05, 0.005


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """From the hash of the window at each place: how many words the repeated windows cover.

    Each hash, with its place in its low bits, is one long, so a sort of longs brings equal
    windows together. The full hashes then settle equality.
    """
    bits = F.length(F.bin(F.size(hashes))).cast("int")

    def covered(mask: Column) -> Column:
        high = lambda p: p.bitwiseAND(F.bitwise_not(mask))
        place = lambda p: p.bitwiseAND(mask).cast("int")
        same = lambda p, q: F.coalesce((high(p) == high(q)) & (F.get(hashes, place(p)) == F.get(hashes, place(q))), F.lit(False))
        packed = F.sort_array(F.transform(hashes, lambda h, i: high(h).bitwiseOR(i.cast("long"))))
        doubled = let(packed, lambda sorted_: F.filter(sorted_, lambda p, i: same(p, F.get(sorted_, i - 1)) | same(p, F.get(sorted_, i + 1))))
        end = F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["words"] + F.least(F.lit(3), p - acc["last"])).cast("int").alias("words"), p.alias("last"))
        return F.aggregate(F.sort_array(F.transform(doubled, place)), end, step)["words"]

    return let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, covered)


def word_windows(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more in the text."""

    def counted(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated_words(h))))

    return let(words, counted).cast("long")


def statistics(docs: DataFrame, *keys: str | Column) -> DataFrame:
    """Key columns, lang, source and the counts of each text."""
    named = docs.select(*keys).columns
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word_counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), word_windows(w).alias("repeat")))
    cut = docs.select(*keys, "lang", "source", F.length(text).cast("long").alias("_chars"), count(r"[\x20\x09-\x0D]").alias("_space"), count(r"[#*$%&|<>]").alias("n_symbols"), count(r"\p{Lu}").alias("n_upper"), line_counts.alias("_lines"), word_counts.alias("_words"))
    return cut.select(
        *named,
        "lang",
        "source",
        F.col("_words.n").alias("n_words"),
        (F.col("_chars") - F.col("_space")).alias("word_chars"),
        "n_symbols",
        F.col("_lines.dup").alias("n_dup_lines"),
        F.col("_words.repeat").alias("n_repeat_words"),
        F.col("_lines.n").alias("n_lines"),
        "n_upper",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vectors() -> dict[str, Column]:
    """Transformed statistics: square roots of shares, and the log of the mean word length."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return {
        "v_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "v_symbol": share("n_symbols", "word_chars"),
        "v_line": share("n_dup_lines", "n_lines"),
        "v_repeat": share("n_repeat_words", "n_words"),
        "v_upper": share("n_upper", "word_chars"),
    }


VECTOR = list(FLOORS)


PAIRS = [(a, b) for i, a in enumerate(VECTOR) for b in VECTOR[: i + 1]]


def _moments(rows: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """Mean and covariance, scaled, of the rows of each group."""
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s_{v}") for v in VECTOR], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in PAIRS])
    centre = [(F.col(f"s_{v}") / F.col("n")).alias(f"m_{v}") for v in VECTOR]
    floor = lambda a, b: F.lit(FLOORS[a] ** 2 if a == b else 0.0)
    spread = [(scale * F.greatest(F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n") ** 2, F.lit(0.0) if a == b else F.lit(-1e300)) + floor(a, b)).alias(f"c_{a}_{b}") for a, b in PAIRS]
    return sums.select(*by, *centre, *spread)


def _factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_a_b of the covariance and the log of its determinant."""
    for i, a in enumerate(VECTOR):
        for j, b in enumerate(VECTOR[: i + 1]):
            rest = F.col(f"c_{a}_{b}")
            for k in VECTOR[:j]:
                rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            estimates = estimates.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}_{b}"))
    return estimates.withColumn("logdet", 2 * reduce(lambda x, y: x + y, [F.log(f"l_{v}_{v}") for v in VECTOR]))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, from the joined centre and factor."""
    total = F.lit(0.0)
    for i, a in enumerate(VECTOR):
        z = F.col(a) - F.col(f"m_{a}")
        for b in VECTOR[:i]:
            z = z - F.col(f"l_{a}_{b}") * F.col(f"_z_{b}")
        rows = rows.withColumn(f"_z_{a}", z / F.col(f"l_{a}_{a}"))
        total = total + F.col(f"_z_{a}") ** 2
    return rows.withColumn("d2", total).drop(*[f"_z_{v}" for v in VECTOR])


def _beside(rows: DataFrame, table: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of one row, or one for each start, a group."""
    return rows.join(F.broadcast(table) if few else table, "group", how)


def _bin_quantile(rows: DataFrame, by: list[str], value: Column, share: float, width: float) -> DataFrame:
    """by and the upper edge of the first bin that reaches the share: counts per bin, then a running sum."""
    bins = rows.groupBy(*by, F.floor(value / width).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    return bins.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(every)).filter(F.col("_upto") >= share * F.col("_all")).groupBy(*by).agg(((F.min("_bin") + 1) * width).alias("_edge"))


def _medians(rows: DataFrame, values: dict[str, Column], out: str) -> DataFrame:
    """One row a group with the median of each value, in units of its floor, as {out}_{name}."""
    flat = rows.select("group", F.explode(F.array(*[F.struct(F.lit(v).alias("name"), (x / FLOORS[v]).alias("x")) for v, x in values.items()])).alias("_s"))
    middle = _bin_quantile(flat.select("group", F.col("_s.name").alias("name"), F.col("_s.x").alias("x")), ["group", "name"], F.col("x"), 0.5, BIN)
    return durable(middle.groupBy("group").agg(*[F.max(F.when(F.col("name") == v, (F.col("_edge") - BIN / 2) * FLOORS[v])).alias(f"{out}_{v}") for v in values]), "quality-medians")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Four estimates of each group to begin with."""
    middle = _medians(rows, {v: F.col(v) for v in VECTOR}, "m")
    centred = _beside(rows, middle, few)
    spread = _medians(centred, {v: F.abs(F.col(v) - F.col(f"m_{v}")) for v in VECTOR}, "d")
    scale = {v: F.sqrt((1.4826 * F.col(f"d_{v}")) ** 2 + F.lit(FLOORS[v] ** 2)) for v in VECTOR}
    known = durable(middle.join(spread, "group").select("group", *[f"m_{v}" for v in VECTOR], *[x.alias(f"d_{v}") for v, x in scale.items()]), "quality-scales")
    diagonal = known.select("group", *[f"m_{v}" for v in VECTOR], *[(F.col(f"d_{a}") ** 2 if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for a, b in PAIRS])
    z = {v: (F.col(v) - F.col(f"m_{v}")) / F.col(f"d_{v}") for v in VECTOR}
    scaled = _beside(rows, known, few)
    # covariance of squashed deviations, in the units of the statistics again
    squashed = _moments(scaled.select("group", *[F.tanh(x).alias(v) for v, x in z.items()]), ["group"])
    squashed = squashed.select("group", *[f"c_{a}_{b}" for a, b in PAIRS]).join(known, "group")
    squashed = squashed.select("group", *[f"m_{v}" for v in VECTOR], *[(F.col(f"c_{a}_{b}") * F.col(f"d_{a}") * F.col(f"d_{b}")).alias(f"c_{a}_{b}") for a, b in PAIRS])
    far = scaled.select("group", *VECTOR, F.log(sum((x**2 for x in z.values()), F.lit(1e-12))).alias("_log"))
    half = _bin_quantile(far, ["group"], F.col("_log"), 0.5, LOG_BIN)
    nearest = _moments(_beside(far, half, few).filter(F.col("_log") < F.col("_edge")), ["group"])
    begin = {"median": diagonal, "mean": _moments(rows, ["group"]), "squashed": squashed, "nearest": nearest}
    return reduce(DataFrame.unionByName, [found.withColumn("start", F.lit(name)) for name, found in begin.items()])


def _best(estimates_: DataFrame) -> DataFrame:
    first = Window.partitionBy("group").orderBy("logdet", "start")
    return estimates_.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def _stepped(rows: DataFrame, current: DataFrame, keep: float, few: bool) -> DataFrame:
    """The estimates after one concentration step, of the groups and starts in current."""
    far = _distance(_beside(rows, current, few)).select("group", "start", F.log(F.col("d2") + 1e-12).alias("_log"))
    edge = _bin_quantile(far, ["group", "start"], F.col("_log"), keep, LOG_BIN)
    near = _distance(_beside(rows, current.join(edge, ["group", "start"]), few)).filter(F.log(F.col("d2") + 1e-12) < F.col("_edge"))
    return _factor(_moments(near, ["group", "start"], CONSISTENCY))


def estimates(rows: DataFrame, keep: float = KEEP, few: bool = True) -> DataFrame:
    """One robust centre, covariance and Cholesky factor per group. rows: group and the vector; few: not many groups.

    Every step of a group but its last lowers the log of its determinant by `SETTLED` at
    least, and the floors bound that from below, so the steps end without a limit.
    """
    current = durable(_factor(_starts(rows, few)), "mcd")
    for step in range(1, TRIAL + 1):
        found = _stepped(rows, current, keep, few)
        before, current = current, durable(_best(found) if step == TRIAL else found, "mcd")
        discard(before)
    done = []
    while True:
        after = durable(_stepped(rows, current, keep, few), "mcd")
        fell = current.select("group", F.col("logdet").alias("_was")).join(after.select("group", "logdet"), "group", "left")
        moving = durable(fell.filter(F.col("_was") - F.col("logdet") >= SETTLED).select("group"), "mcd-moving")
        done.append(durable(current.join(moving, "group", "left_anti"), "mcd-settled"))
        discard(current)
        current = durable(after.join(moving, "group", "left_semi"), "mcd")
        discard(after)
        discard(moving)
        if current.isEmpty():
            return reduce(DataFrame.unionByName, done).select("group", *[f"m_{v}" for v in VECTOR], *[f"{x}_{a}_{b}" for x in "cl" for a, b in PAIRS], "logdet")


def _leaning(inner: DataFrame, outer: DataFrame, prior: float) -> DataFrame:
    """Estimates of inner groups (group, outer, n), drawn towards the group around each.

    Centres and covariances weigh n^2 to prior^2, as few rows, a third of them odd, say little. How far the two centres lie apart does not
    widen the covariance, or a few odd rows that make up a small group would hide themselves.
    A group without an estimate of its own has the outer one.
    """
    around = outer.select(F.col("group").alias("outer"), *[F.col(f"m_{v}").alias(f"o_m_{v}") for v in VECTOR], *[F.col(f"c_{a}_{b}").alias(f"o_c_{a}_{b}") for a, b in PAIRS])
    both = inner.join(around, "outer").withColumn("_own", F.when(F.col(f"m_{VECTOR[0]}").isNull(), 0.0).otherwise(F.col("n") ** 2 / (F.col("n") ** 2 + prior**2)))
    mixed = lambda c: F.when(F.col("_own") == 0, F.col(f"o_{c}")).otherwise(F.col("_own") * F.col(c) + (1 - F.col("_own")) * F.col(f"o_{c}"))
    # written, so that the factor's sums are not spelt out for each of its uses
    return durable(both.select("group", *[mixed(c).alias(c) for c in [*(f"m_{v}" for v in VECTOR), *(f"c_{a}_{b}" for a, b in PAIRS)]]), "mcd-leaning")


def judge(docs: DataFrame, *keys: str | Column, prior: float = PRIOR, cutoff: float = CUTOFF) -> DataFrame:
    """Key columns, the counts, base_failed, d2 (squared robust distance) and kept."""
    named_keys = docs.select(*keys).columns
    lang, source = (F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c)) for c in ("lang", "source"))
    grouped = durable(statistics(docs, *keys).withColumn("base_failed", base_failed()).withColumns(vectors()).withColumns({"group": F.to_json(F.struct(lang.alias("l"), source.alias("s"))), "_lang": F.to_json(F.struct(lang.alias("l")))}), "quality-statistics")
    every = F.lit("{}")
    # what the steps read again and again, slim: each row in its group, its language and among all
    vectors_ = durable(grouped.filter(~F.col("base_failed")).select(F.explode(F.array("group", "_lang", every)).alias("group"), *VECTOR), "quality-vectors")
    size = durable(grouped.filter(~F.col("base_failed")).groupBy("group", "_lang").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    few = size.count() <= MOST_BROADCAST
    raw = durable(estimates(vectors_, few=few), "mcd-best")
    discard(vectors_)
    langs = size.groupBy(F.col("_lang").alias("group")).agg(F.sum("n").alias("n")).withColumn("outer", every)
    by_lang = _leaning(langs.join(raw, "group", "left"), raw.filter(F.col("group") == every), prior)
    found = durable(_factor(_leaning(size.withColumnRenamed("_lang", "outer").join(raw, "group", "left"), by_lang, prior)), "mcd-factor")
    judged = _distance(_beside(grouped, found, few, "left"))
    outlier = F.coalesce(F.col("d2") > cutoff, F.lit(False))
    return judged.select(*named_keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", (~F.col("base_failed") & ~outlier).alias("kept"))


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The rows travel beside their statistics in one column, so no name can clash and the
    verdict needs no join with the texts.
    """
    return judge(docs, F.struct("*").alias("row"), **options).filter("kept").select("row.*")
