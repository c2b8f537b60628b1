"""Judge requests, verdict parsing and score reports.

Verdicts are parsed per row with column expressions.  Reports are grouped aggregates
(partial aggregation before the shuffle); windows only run over already-aggregated
rows (models x levels), never over raw verdicts.  Pairwise model comparison joins the scores
with themselves on (query, level), where a row meets one row of each other model.

Formulas marked *derived* are ours (the published numbers give no formula).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates as TP
from ..functions import verdicts as V
from ..functions.text import normalize

K = ["query_id", "model_id", "level"]
GROUP = ["model_id", "level"]

# Criteria the judges are asked to score.
LRQI_CRITERIA = ["Relevance", "Engagement", "Detail", "Clarity", "Perceived Intelligence", "Overall score"]
EQDQ_CRITERIA = ["Relevance", "Engagement", "Detail", "Clarity", "Placeholder Quality",
                 "Placeholder Choices Quality", "Overall score"]
OVERALL = "Overall score"
CHOICES = "Placeholder Choices Quality"
# Explanation word limits (effort judge; binary judges).
EFFORT_WORD_LIMIT, BINARY_WORD_LIMIT = 15, 25


def request_id(metric: str, keys: list[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(metric), *[F.col(k).cast("string") for k in keys]))


def judge_requests(metric: str, df: DataFrame, values: dict, keys: list[str] = K) -> DataFrame:
    """one rendered request per row with a stable ``request_id``."""
    tpl = TP.JUDGE_TEMPLATES[metric]
    return df.select(request_id(metric, keys).alias("request_id"), F.lit(metric).alias("metric"), *keys,
                     TP.render(tpl, values).alias("prompt"))


def parse_effort(df: DataFrame, raw: str = "raw", keys: list[str] = K) -> DataFrame:
    """F2 (+F5): effort labels, explanation and their 1..4 scores; nulls when malformed."""
    # parse once into a column; fields are read from it (the parse is not repeated per field)
    p = df.select(*keys, V.parse_effort(F.col(raw)).alias("_qx_v"))
    v = F.col("_qx_v")
    return p.select(*keys, v["explanation"].alias("explanation"),
                    v["comprehension_score"].alias("comprehension"), v["modification_score"].alias("modification"),
                    V.ordinal(v["comprehension_score"]).alias("comprehension_score"),
                    V.ordinal(v["modification_score"]).alias("modification_score"))


def parse_review(df: DataFrame, raw: str = "raw", keys: list[str] = K) -> DataFrame:
    """review text to ``(line_no, criterion, label)`` rows; review prose lines skipped."""
    lines = df.select(*keys, F.posexplode(V.review_lines(F.col(raw))).alias("line_no", "line"))
    return (lines.filter(V.is_review_line("line"))
            .select(*keys, F.col("line_no").cast("bigint").alias("line_no"),
                    V.review_criterion("line").alias("criterion"), V.review_label("line").alias("label")))


def score_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """``score`` 1..4 (null for NA/unknown) and ``status`` ok/na/invalid."""
    b = df.withColumn("_qx_b", V.bare_label(F.col(label)))  # one regex pass per label
    return (b.withColumn("score", V.ordinal("_qx_b", bare=True)).withColumn("status", V.label_status("_qx_b", bare=True))
            .drop("_qx_b"))


def parse_binary(df: DataFrame, raw: str = "raw", keys: list[str] = K) -> DataFrame:
    """Highly Likely -> true, Highly Unlikely -> false, anything else -> null."""
    p = df.select(*keys, V.parse_json_object(F.col(raw), V.BINARY_FIELDS).alias("_qx_v"))
    return p.select(*keys, V.binary_verdict(F.col("_qx_v.Score")).alias("verdict"),
                    F.col("_qx_v.Explanation").alias("explanation"))


def judge_validity(df: DataFrame, criteria: list[str], raw: str = "raw", group=GROUP) -> DataFrame:
    """per group: verdicts, unparsable verdicts, missing expected criteria, unknown labels.

    Per-verdict counts are array expressions on the verdict's own lines (no explode).
    """
    lines = F.filter(V.review_lines(F.col(raw)), lambda l: V.is_review_line(l))
    crit = F.array_distinct(F.transform(lines, lambda l: V.review_criterion(l)))
    present = F.size(F.array_intersect(crit, F.array(*[F.lit(c) for c in criteria])))
    unknown = F.size(F.filter(lines, lambda l: V.label_status(V.review_label(l)) == "invalid"))
    per = df.select(*group, (F.size(lines) == 0).alias("unparsable"),
                    F.when(F.size(lines) > 0, F.lit(len(criteria)) - present).otherwise(F.lit(0)).alias("missing"),
                    unknown.alias("unknown"))
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("verdicts"), F.count_if("unparsable").alias("unparsable"),
                                   F.sum("missing").cast("bigint").alias("missing_criteria"),
                                   F.sum("unknown").cast("bigint").alias("unknown_labels"))


def word_count(c) -> Column:
    n = normalize(c, lower=False)
    return F.when(n.isNull(), F.lit(None)).when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ", -1)))


def explanation_limit(df: DataFrame, source: str, limit: int, keys: list[str] = K) -> DataFrame:
    """explanations at or over the word limit."""
    n = word_count(F.col("explanation"))
    return df.select(F.lit(source).alias("source"), *keys, n.cast("bigint").alias("n_words")).filter(F.col("n_words") >= limit)


def choices_label(raw) -> Column:
    return V.review_label(F.regexp_extract(raw, r"(?m)^(- " + CHOICES + r":.*)$", 1))


def na_consistency(eqdq: DataFrame, drafts: DataFrame, keys: list[str] = K, group=GROUP) -> DataFrame:
    """F8: NA on the choices criterion iff the draft has no placeholder (1:1 join on the verdict key)."""
    from ..functions.placeholders import has_placeholder

    v = eqdq.select(*keys, (F.lower(choices_label(F.col("raw"))) == V.NA_LABEL).alias("is_na"))
    d = drafts.select(*keys, has_placeholder("draft").alias("has_ph"))
    j = v.join(d, keys)
    return (j.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(F.col("is_na") == F.col("has_ph")).alias("inconsistent")))


def metric_rollup(scored: DataFrame) -> DataFrame:
    """F9 (derived): mean score and n by model, level, criterion with all rollup subtotals."""
    ok = scored.filter(F.col("score").isNotNull())
    return (ok.rollup("model_id", "level", "criterion")
            .agg(F.grouping_id().cast("bigint").alias("gid"), F.count(F.lit(1)).alias("n"),
                 F.round(F.avg("score"), 6).alias("mean_score")))


def score_distribution(parsed: DataFrame) -> DataFrame:
    """F10 (derived): count and share of each label per model, level, criterion."""
    counts = (parsed.groupBy("model_id", "level", "criterion", V.bare_label("label").alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("model_id", "level", "criterion")  # over aggregated rows only
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def overall_means(scored: DataFrame) -> DataFrame:
    return (scored.filter((F.col("criterion") == OVERALL) & F.col("score").isNotNull())
            .groupBy("model_id", "level").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")))


def uplift(scored: DataFrame) -> DataFrame:
    """F11 (derived): ``(mean(level) - mean(level 0)) / mean(level 0)`` of the overall score."""
    m = overall_means(scored)
    base = m.filter(F.col("level") == 0).select("model_id", F.col("mean_score").alias("base_score"))
    j = m.filter(F.col("level") > 0).join(base, "model_id", "left")
    return j.select("model_id", "level", F.round("mean_score", 6).alias("mean_score"),
                    F.round("base_score", 6).alias("base_score"),
                    F.round(F.try_divide(F.col("mean_score") - F.col("base_score"), F.col("base_score")), 6).alias("uplift"))


_PER_DIGEST = 8  # replicates that one MD5 (32 hexadecimal digits) gives a weight to
# Cumulative probabilities of the Poisson distribution with mean 1, times 65,536 and rounded.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def poisson_weight(digits) -> Column:
    """0..8 from four hexadecimal digits: how many of ``POISSON`` they reach (mean 1)."""
    u = F.conv(digits, 16, 10).cast("int")
    return sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))


def bootstrap_uplift(scored: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """F17 (derived): F11's uplift with a 95 % interval by the Poisson bootstrap over queries.

    In replicate r every query counts as often as a Poisson weight drawn from ``md5(seed:query_id:r div 8)`` says, for all its models and
    levels alike, so reruns agree and no resampled row exists.  A score row meets ``replicates / 8`` digests, each
    adding to eight weighted sums, and is folded before the shuffle into one row per (model, level, digest).  ``boot_mean``,
    ``low`` and ``high`` are the mean and the 2.5 % and 97.5 % points (interpolated) of the replicates' uplifts; a replicate whose
    level 0 has no weight, or no score, gives none.
    """
    ok = scored.filter((F.col("criterion") == OVERALL) & F.col("score").isNotNull()).select("query_id", "model_id", "level", F.col("score").cast("bigint").alias("score"))
    digests = F.sequence(F.lit(0), F.lit(-(-replicates // _PER_DIGEST) - 1))
    d = ok.withColumn("_qx_d", F.explode(digests))
    d = d.withColumn("_qx_md5", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("_qx_d").cast("string"))))
    d = d.select("model_id", "level", "_qx_d", "score", *[poisson_weight(F.substring("_qx_md5", 4 * i + 1, 4)).cast("bigint").alias(f"_qx_w{i}") for i in range(_PER_DIGEST)])
    sums = d.groupBy("model_id", "level", "_qx_d").agg(
        *[F.sum(f"_qx_w{i}").alias(f"w{i}") for i in range(_PER_DIGEST)], *[F.sum(F.col(f"_qx_w{i}") * F.col("score")).alias(f"s{i}") for i in range(_PER_DIGEST)])
    # from here on models x levels x replicates rows
    each = F.array(*[F.struct((F.col("_qx_d") * _PER_DIGEST + i).alias("r"), F.try_divide(F.col(f"s{i}").cast("double"), F.col(f"w{i}")).alias("mean")) for i in range(_PER_DIGEST)])
    means = sums.select("model_id", "level", F.explode(each).alias("x")).select("model_id", "level", "x.r", "x.mean").where(F.col("r") < replicates)
    base = means.where("level = 0").select("model_id", "r", F.col("mean").alias("base"))
    ups = means.where("level > 0").join(base, ["model_id", "r"]).select("model_id", "level", F.try_divide(F.col("mean") - F.col("base"), F.col("base")).alias("u"))
    spread = ups.groupBy("model_id", "level").agg(F.count("u").alias("n_replicates"), F.round(F.avg("u"), 6).alias("boot_mean"),
                                                  F.round(F.percentile("u", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("u", F.lit(0.975)), 6).alias("high"))
    return uplift(scored).join(spread, ["model_id", "level"], "left").select("model_id", "level", "uplift", "n_replicates", "boot_mean", "low", "high")


def intent_rate(binary: DataFrame, group=GROUP) -> DataFrame:
    """F12 (derived): share of positive verdicts among valid ones."""
    return (binary.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("n_valid"),
                                       F.round(F.avg(F.col("verdict").cast("double")), 6).alias("rate")))


def effort_summary(effort: DataFrame, group=GROUP) -> DataFrame:
    """mean comprehension and modification effort (1..4) per group."""
    return (effort.groupBy(*group).agg(F.count("comprehension_score").alias("n_valid"),
                                       F.round(F.avg("comprehension_score"), 6).alias("mean_comprehension"),
                                       F.round(F.avg("modification_score"), 6).alias("mean_modification")))


def effort_crosstab(effort: DataFrame, by: str = "level") -> DataFrame:
    """4 x 4 table of comprehension (rows) by modification (columns), literal pivot values."""
    ok = effort.filter(F.col("comprehension_score").isNotNull() & F.col("modification_score").isNotNull())
    t = ok.groupBy(by, "comprehension_score").pivot("modification_score", [1, 2, 3, 4]).agg(F.count(F.lit(1)))
    return t.select(by, "comprehension_score",
                    *[F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint").alias(f"mod_{i}") for i in range(1, 5)])


def edit_distance(drafts: DataFrame, finals: DataFrame, keys: list[str] = K) -> DataFrame:
    """Levenshtein distance and distinct words added / removed from draft to final."""
    j = drafts.join(finals, keys)
    dw, fw = F.split("draft", " ", -1), F.split("final_query", " ", -1)
    return j.select(*keys, F.levenshtein("draft", "final_query").cast("bigint").alias("levenshtein"),
                    F.size(F.array_except(fw, dw)).cast("bigint").alias("words_added"),
                    F.size(F.array_except(dw, fw)).cast("bigint").alias("words_removed"))


_LCS_BITS = 62  # words of the second text a block of the table holds


def common_subsequence(a, b) -> Column:
    """Length of the longest common subsequence of two word arrays, repeats included: one fold in the JVM, exact at any length.

    The dynamic-programming row over ``b`` is kept as bits, ``_LCS_BITS`` words to a number (a 0 bit where the row rises by one).
    A word of ``a`` with the bit mask M of its places in ``b`` turns the row V into ``(V + (V & M)) | (V & ~M)``, the
    carry of the sum going on to the next block.  So a word costs one step a block instead of one a word.
    """
    low = F.lit((1 << _LCS_BITS) - 1)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    n = F.size(b)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / _LCS_BITS).cast("int")), lambda i: F.slice(b, i * _LCS_BITS + 1, _LCS_BITS))  # one empty at least
    full = F.transform(blocks, lambda words: F.lit((1 << _LCS_BITS) - 1))

    def places(words, w):
        """Bits of the words of a block that equal ``w``."""
        return F.aggregate(words, F.struct(zero.alias("mask"), one.alias("bit")), lambda acc, x: F.struct(
            (acc["mask"] + F.when(x == w, acc["bit"]).otherwise(zero)).alias("mask"), (acc["bit"] * 2).alias("bit")), lambda acc: acc["mask"])

    def row(v, w):
        pairs = F.zip_with(v, blocks, lambda old, words: F.struct(old.alias("v"), places(words, w).alias("m")))

        def block(acc, p):
            total = p["v"] + p["v"].bitwiseAND(p["m"]) + acc["carry"]
            kept = p["v"].bitwiseAND(F.bitwise_not(p["m"]))
            return F.struct(F.shiftright(total, _LCS_BITS).alias("carry"), F.concat(acc["out"], F.array(total.bitwiseAND(low).bitwiseOR(kept))).alias("out"))

        empty = F.struct(zero.alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(pairs, empty, block, lambda acc: acc["out"])

    rises = F.aggregate(a, full, row, lambda v: F.aggregate(v, zero, lambda acc, x: acc + _LCS_BITS - F.bit_count(x)))
    return F.coalesce(rises, zero)


def word_edits(drafts: DataFrame, finals: DataFrame, keys: list[str] = K) -> DataFrame:
    """words kept in place, moved, added and removed from draft to final, repeats included.

    ``kept`` is the longest common subsequence of the two word lists; words beyond it that stand on both sides are
    ``moved``; the rest of the draft is ``removed``, the rest of the final ``added``.  So kept + moved + removed are the
    draft's words and kept + moved + added the final's.  A null text has no words.
    """
    def words(c):
        return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " ", -1), lambda w: w != "")

    j = drafts.join(finals, keys).select(*keys, words("draft").alias("_qx_a"), words("final_query").alias("_qx_b"))
    j = j.select(*keys, "_qx_a", "_qx_b", F.when(F.col("_qx_a") == F.col("_qx_b"), F.size("_qx_a").cast("bigint"))
                 .otherwise(common_subsequence(F.col("_qx_a"), F.col("_qx_b"))).alias("kept"))

    def times(array, w):
        return F.size(F.filter(F.col(array), lambda x: x == w))

    shared = F.aggregate(F.array_intersect("_qx_a", "_qx_b"), F.lit(0).cast("bigint"), lambda acc, w: acc + F.least(times("_qx_a", w), times("_qx_b", w)))
    j = j.withColumn("moved", shared - F.col("kept"))
    return j.select(*keys, "kept", "moved", (F.size("_qx_b") - F.col("kept") - F.col("moved")).cast("bigint").alias("added"),
                    (F.size("_qx_a") - F.col("kept") - F.col("moved")).cast("bigint").alias("removed"))


def model_ranking(scored: DataFrame) -> DataFrame:
    """F15 (derived): rank / dense_rank of models per level by mean overall score."""
    m = overall_means(scored)
    w = Window.partitionBy("level").orderBy(F.col("mean_score").desc())  # models x levels rows
    return m.select("model_id", "level", F.round("mean_score", 6).alias("mean_score"),
                    F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense_rank"),
                    (F.rank().over(w) == 1).alias("is_best"))


def pairwise_wins(scored: DataFrame) -> DataFrame:
    """F16 (derived): win/tie/loss counts of each model pair on the same query and level.

    The models come from the data.  The self-join meets on (query, level), where each model has
    one overall score, so a row fans out to the number of models only.
    """
    overall = scored.filter((F.col("criterion") == OVERALL) & F.col("score").isNotNull()).select("query_id", "level", "model_id", "score")
    a = overall.select("query_id", "level", F.col("model_id").alias("model_a"), F.col("score").alias("_qx_a"))
    b = overall.select("query_id", "level", F.col("model_id").alias("model_b"), F.col("score").alias("_qx_b"))
    j = a.join(b, ["query_id", "level"]).filter("model_a < model_b")
    return (j.groupBy("level", "model_a", "model_b")
            .agg(F.count_if(F.col("_qx_a") > F.col("_qx_b")).alias("wins"), F.count_if(F.col("_qx_a") == F.col("_qx_b")).alias("ties"),
                 F.count_if(F.col("_qx_a") < F.col("_qx_b")).alias("losses")))


RATING_ROUNDS = 2000
RATING_TOLERANCE = 1e-9


def model_rating(wins: DataFrame, rounds: int = RATING_ROUNDS, tolerance: float = RATING_TOLERANCE) -> DataFrame:
    """F18 (derived): Bradley-Terry strengths of the models from F16's wins (a tie is half a win for each), per level:
    ``level, model_id, points, n_games, rating, component``.

    Minorise-maximise: ``new_i = points_i / sum over j of games_ij / (r_i + r_j)``, scaled to mean 1, from 1 for all, until no strength
    moves by more than ``tolerance`` or ``rounds`` are over.  The wins table of a level is models x models, so a level is one row of arrays,
    and the iteration a fold in it: no job per round, nothing on the driver.

    Strengths compare only within a strongly connected group (each model has, by some chain, beaten and lost to each other);
    ``component`` is the group's least model and the mean 1 is taken within it, from its own games alone.  A model that never won, or never lost,
    against the rest is a group of its own with rating 1; where groups follow one another the chain of wins orders them, not the rating.
    """
    games = wins.select("level", "model_a", "model_b", (F.col("wins") + F.col("ties") / 2).alias("pa"), (F.col("losses") + F.col("ties") / 2).alias("pb"))
    both = games.select("level", F.col("model_a").alias("i"), F.col("model_b").alias("j"), F.col("pa").alias("won"), F.col("pb").alias("lost")).unionByName(
        games.select("level", F.col("model_b").alias("i"), F.col("model_a").alias("j"), F.col("pb").alias("won"), F.col("pa").alias("lost")))
    per = both.groupBy("level", "i").agg(F.array_sort(F.collect_list(F.struct("j", "won", "lost"))).alias("games"))
    table = per.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("i", "games"))).alias("t"))  # models x models
    table = table.withColumn("ids", F.transform("t", lambda m: m["i"]))
    # who is beaten through some chain: as many squarings as the number of models has bits
    beats = F.transform("t", lambda m: F.array_union(F.array(m["i"]), F.transform(F.filter(m["games"], lambda g: g["won"] > 0), lambda g: g["j"])))

    def further(reach, _):
        return F.transform(reach, lambda mine: F.array_distinct(F.flatten(F.transform(mine, lambda j: F.get(reach, (F.array_position(F.col("ids"), j) - 1).cast("int"))))))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size("ids"))))
    table = table.withColumn("reach", F.aggregate(steps, beats, further))
    place = F.transform("reach", lambda mine, n: F.array_min(F.filter(mine, lambda j: F.array_contains(
        F.get(F.col("reach"), (F.array_position(F.col("ids"), j) - 1).cast("int")), F.get(F.col("ids"), n)))))
    table = table.withColumn("component", place)

    def component_of(j):
        return F.get(F.col("component"), (F.array_position(F.col("ids"), j) - 1).cast("int"))

    inner = F.transform("t", lambda m: F.filter(m["games"], lambda g: component_of(g["j"]) == component_of(m["i"])))
    table = table.withColumn("inner", inner)
    table = table.withColumn("won", F.transform("inner", lambda gs: F.aggregate(gs, F.lit(0.0), lambda acc, g: acc + g["won"])))
    ones = F.transform("ids", lambda i: F.lit(1.0))

    def at(r, j):
        return F.get(r, (F.array_position(F.col("ids"), j) - 1).cast("int"))

    def round_(acc, _):
        r = acc["r"]
        raw = F.transform(r, lambda mine, n: F.when(F.size(F.get(F.col("inner"), n)) == 0, F.lit(1.0)).otherwise(
            F.get(F.col("won"), n) / F.aggregate(F.get(F.col("inner"), n), F.lit(0.0), lambda s, g: s + (g["won"] + g["lost"]) / (mine + at(r, g["j"])))))
        return _scaled(raw, r)

    def _scaled(raw, r):
        pairs = F.zip_with(raw, F.col("component"), lambda x, c: F.struct(x.alias("x"), c.alias("c")))
        new = F.transform(pairs, lambda p: p["x"] * F.aggregate(pairs, F.lit(0), lambda s, q: s + F.when(q["c"] == p["c"], 1).otherwise(0))
                          / F.aggregate(pairs, F.lit(0.0), lambda s, q: s + F.when(q["c"] == p["c"], q["x"]).otherwise(0.0)))
        moved = F.array_max(F.zip_with(new, r, lambda x, y: F.abs(x - y)))
        return F.struct(new.alias("r"), moved.alias("moved"))

    start = F.struct(ones.alias("r"), F.lit(1.0).alias("moved"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda acc, n: F.when(acc["moved"] <= tolerance, acc).otherwise(round_(acc, n)), lambda acc: acc["r"])
    rated = table.select("level", F.explode(F.arrays_zip(F.col("ids").alias("model_id"), end.alias("rating"), F.col("component").alias("component"))).alias("x"))
    points = both.groupBy("level", F.col("i").alias("model_id")).agg(F.sum("won").alias("points"), F.sum(F.col("won") + F.col("lost")).cast("bigint").alias("n_games"))
    return rated.select("level", "x.*").join(points, ["level", "model_id"]).select("level", "model_id", "points", "n_games", F.round("rating", 6).alias("rating"), "component")
