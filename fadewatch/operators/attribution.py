"""Attribution analytics over long tables (run keys, feature, phi, value); phi is in ln(life)."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, hash_uniform, sign_class
from ..session import materialize
from .linear import SPLIT, contributions
from .order_stats import rank_correlation, with_average_rank


def linear_attribution(rows: DataFrame, models: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Exact attribution of linear models: w_j (x_j - training mean), base value in ln(life)."""
    joined = rows.withColumn(SPLIT, F.col(SPLIT).cast("string")).join(F.broadcast(models), SPLIT)
    return joined.select(SPLIT, *keep, "model", "base", F.explode(contributions(features)).alias("c")).select(
        SPLIT, *keep, "model", "base", "c.feature", "c.value", "c.phi"
    )


def sampled_attribution(
    rows: DataFrame, background: DataFrame, features: Sequence[str], key: str, predict_log: Callable[[DataFrame], DataFrame],
    permutations: int = 8, background_rows: int = 20, seed: int = 0,
) -> DataFrame:
    """Shapley values of any model by sampled feature orders (Strumbelj and Kononenko 2014).

    For every row, background row and random order, features are switched one
    by one from the background to the row; a feature's value is the mean change
    of ln(prediction) at its switch. ``predict_log`` adds the column
    ``log_pred`` to a table with the feature columns. All hybrids are predicted
    in one bulk call. The values of a row add up to its prediction minus the
    mean prediction of the background exactly.
    """
    p, names = len(features), list(features)
    ids = Window.orderBy("__h", "__k")
    bg = (
        background.select(*names, F.md5(F.concat_ws(",", F.lit(str(seed)), F.col(key).cast("string"))).alias("__h"), F.col(key).alias("__k"))
        .orderBy("__h", "__k").limit(background_rows)  # a sample of fixed size is the method
        .select(F.array(*[finite(f) for f in names]).alias("__bg"), F.row_number().over(ids).alias("b"))
    )
    plan = (
        rows.select(key, F.array(*[finite(f) for f in names]).alias("__x"))
        .crossJoin(F.broadcast(bg))
        .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    )
    u = lambda j: hash_uniform(seed, F.col(key), F.col("b"), F.col("perm"), j)
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.struct(u(j).alias("u"), j.alias("j")))),
        lambda s: s["j"],
    )
    hybrids = (
        plan.withColumn("__order", order)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(p))))
        .withColumn(
            "__z",
            F.transform(
                F.sequence(F.lit(0), F.lit(p - 1)),
                lambda j: F.when(
                    F.array_position(F.col("__order"), j) <= F.col("step"), F.element_at("__x", j + 1)
                ).otherwise(F.element_at("__bg", j + 1)),
            ),
        )
    )
    table = hybrids.select(
        key, "b", "perm", "step", "__order", *[F.element_at("__z", j + 1).alias(f) for j, f in enumerate(names)]
    )
    scored = materialize(predict_log(table).select(key, "b", "perm", "step", "__order", "log_pred"))
    w = Window.partitionBy(key, "b", "perm").orderBy("step")  # p + 1 rows
    delta = scored.withColumn("__d", F.col("log_pred") - F.lag("log_pred").over(w)).filter("step > 0")
    names_col = F.array(*[F.lit(f) for f in names])
    return (
        delta.withColumn("feature", F.element_at(names_col, F.element_at("__order", F.col("step")) + 1))
        .groupBy(key, "feature").agg(F.avg("__d").alias("phi"))
    )


def group_attribution(phi: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group value = sum of its members. ``by`` holds run keys and entity key."""
    from .groups import with_group

    return with_group(phi, groups).groupBy(*by, "grp").agg(F.sum("phi").alias("phi"))


def group_attribution_wide(items: DataFrame, phi: dict[tuple[str, str], str], members: dict[str, Sequence[str]], by: Sequence[str], run: str = "model") -> DataFrame:
    """The same from one row per entity: ``phi`` names the column of each (run, feature), ``members`` the features of each group.

    An entity is shuffled once with its sums of all runs and groups, not once per run and group. Missing values are left out.
    """
    runs = list(dict.fromkeys(r for r, _ in phi))
    cells = [(r, g, [F.col(phi[r, f]) for f in fs if (r, f) in phi]) for r in runs for g, fs in members.items()]
    cells = [(r, g, cols) for r, g, cols in cells if cols]
    zero = F.lit(0.0)
    row_sum = lambda cols: F.when(F.coalesce(*cols).isNotNull(), sum((F.coalesce(c, zero) for c in cols), zero))
    sums = items.groupBy(*by).agg(*[F.sum(row_sum(cols)).alias(f"__{k}") for k, (_, _, cols) in enumerate(cells)])
    parts = [F.struct(F.lit(r).alias(run), F.lit(g).alias("grp"), F.col(f"__{k}").alias("phi")) for k, (r, g, _) in enumerate(cells)]
    return sums.select(*by, F.inline(F.array(*parts)))


def global_importance(phi: DataFrame, run: Sequence[str], item: str = "feature") -> DataFrame:
    """Mean |phi| per item of a run and its share of the run total."""
    imp = phi.groupBy(*run, item).agg(F.avg(F.abs("phi")).alias("importance"))
    total = F.sum("importance").over(Window.partitionBy(*run))  # features of one run
    return imp.withColumn("share", F.try_divide(F.col("importance"), total))


def top_k(imp: DataFrame, run: Sequence[str], k: int, score: str = "importance", item: str = "feature") -> DataFrame:
    w = Window.partitionBy(*run).orderBy(F.col(score).desc(), F.col(item))
    return imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_text(imp: DataFrame, run: Sequence[str], k: int, score: str = "importance", item: str = "feature", out: str = "top") -> DataFrame:
    t = top_k(imp, run, k, score, item)
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", item))), lambda s: s[item])
    return t.groupBy(*run).agg(F.array_join(names, ", ").alias(out))


def rank_agreement(imp: DataFrame, model: str = "model", score: str = "importance") -> DataFrame:
    """Spearman correlation of feature importances for each pair of models (a <= b)."""
    r = with_average_rank(imp, [model], score, "r", bounded=True).select(model, "feature", "r")
    a = r.select(F.col(model).alias("model_a"), "feature", F.col("r").alias("ra"))
    b = r.select(F.col(model).alias("model_b"), "feature", F.col("r").alias("rb"))
    return (
        a.join(b, "feature").filter("model_a <= model_b").groupBy("model_a", "model_b").agg(F.corr("ra", "rb").alias("spearman"))
    )


def stability(imp: DataFrame, by: Sequence[str], source: str = "source", score: str = "importance", k: int = 10) -> DataFrame:
    """Per feature: share of runs (seeds or folds) with it in the top k, median rank, rank IQR, and the mean pairwise Kendall tau-b."""
    run = [*by, source]
    r = with_average_rank(imp, run, score, "r", descending=True, bounded=True)
    r = r.withColumn("in_top", (F.row_number().over(Window.partitionBy(*run).orderBy(F.col(score).desc(), "feature")) <= k).cast("double"))
    per_feature = r.groupBy(*by, "feature").agg(
        F.avg("in_top").alias("top_frequency"), F.percentile("r", F.lit(0.5)).alias("median_rank"),
        (F.percentile("r", F.lit(0.75)) - F.percentile("r", F.lit(0.25))).alias("rank_iqr"),
    )
    tau = mean_kendall_tau(r, by, source)
    return per_feature.join(F.broadcast(tau), list(by)) if by else per_feature.crossJoin(F.broadcast(tau))


def mean_kendall_tau(ranks: DataFrame, by: Sequence[str], source: str = "source", rank: str = "r") -> DataFrame:
    """Mean Kendall tau-b over all pairs of runs, without forming the pairs.

    tau-b of two runs is the scalar product of their sign vectors over feature
    pairs, each scaled to length one; the sum over run pairs follows from the
    sum and the sum of squares over runs. The sign vector of a run has one
    entry per feature pair, whatever the number of entities.
    """
    per_run = ranks.groupBy(*by, source).agg(F.sort_array(F.collect_list(F.struct("feature", F.col(rank).alias("r")))).alias("f"))
    signs = F.flatten(
        F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.signum(x["r"] - y["r"])))
    )
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.abs(x)))
    unit = per_run.select(*by, source, signs.alias("s")).withColumn("len", length).filter("len > 0").select(
        *by, F.posexplode("s").alias("pair", "s"), "len"
    )
    z = F.col("s") / F.col("len")
    per_pair = unit.groupBy(*by, "pair").agg(F.sum(z).alias("t"), F.sum(z * z).alias("q"), F.count("*").alias("n"))
    n = F.max("n")
    return per_pair.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("t") * F.col("t") - F.col("q")), n * (n - 1)).alias("mean_pairwise_tau")
    )


def verdict(learned: Column, expected: Column, weak: str = "weak/non-monotone") -> Column:
    return (
        F.when(expected == "?", "not assessed").when(learned == "~", weak)
        .when(learned == expected, "consistent").otherwise("INCONSISTENT")
    )


def sign_consistency(phi: DataFrame, groups: DataFrame, run: Sequence[str]) -> DataFrame:
    """Direction learned for each feature (rank correlation of value and phi) against the expected one."""
    out = rank_correlation(phi, [*run, "feature"], "value", "phi").withColumn(
        "spearman", F.when((F.col("n_pairs") > 3) & (F.col("min_x") < F.col("max_x")), finite("rho"))
    )
    out = out.join(F.broadcast(groups.select("feature", "expected_sign")), "feature", "left")
    learned, expected = sign_class("spearman"), F.coalesce("expected_sign", F.lit("?"))
    return out.select(
        *run, "feature", "spearman", learned.alias("learned_sign"), expected.alias("expected_sign"),
        verdict(learned, expected).alias("plausibility"),
    )


def majority_sign(signs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most frequent learned sign over models and the 'k/n' agreement text (ties: '+', '-', '~' in this order)."""
    order = F.when(F.col("learned_sign") == "+", 0).when(F.col("learned_sign") == "-", 1).otherwise(2)
    votes = signs.filter(F.col("spearman").isNotNull()).groupBy(*by, "feature", "learned_sign").agg(F.count("*").alias("v"), F.max(order).alias("o"))
    return votes.groupBy(*by, "feature").agg(
        F.min_by("learned_sign", F.struct((-F.col("v")).alias("v"), F.col("o"))).alias("learned_sign_majority"),
        F.concat(F.max("v").cast("string"), F.lit("/"), F.sum("v").cast("string")).alias("sign_agreement"),
    )


def group_importance_by_horizon(group_phi: DataFrame, models: Sequence[str], protocol_groups: Sequence[str]) -> DataFrame:
    """Consensus share of each mechanism group per horizon, its rank, and one share column per model.

    ``group_phi``: (T, model, source, cell_id, grp, phi).
    """
    run = ["T", "model", "source"]
    g = group_phi.groupBy(*run, "grp").agg(F.avg(F.abs("phi")).alias("a"))
    w = Window.partitionBy(*run)  # groups of one run
    degradation = F.when(~F.col("grp").isin(list(protocol_groups)), F.col("a"))
    g = g.select(
        *run, "grp", F.try_divide(F.col("a"), F.sum("a").over(w)).alias("share"),
        F.try_divide(degradation, F.sum(degradation).over(w)).alias("deg_share"),
    )
    per_model = g.groupBy("T", "model", "grp").agg(F.avg("share").alias("share"), F.avg("deg_share").alias("deg_share"))
    cons = per_model.groupBy("T", "grp").agg(
        F.avg("share").alias("consensus_share"), F.stddev_samp("share").alias("between_model_std"),
        F.avg("deg_share").alias("consensus_degradation_share"),
        *[F.max(F.when(F.col("model") == m, F.col("share"))).alias(f"share_{m}") for m in models],
    )
    ranked = with_average_rank(cons, ["T"], "consensus_share", "__r", descending=True, bounded=True)
    return ranked.withColumn("group_rank", F.col("__r").cast("int")).drop("__r")


def feature_stability_by_horizon(phi_runs: DataFrame, signs: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """Consensus share, top-k frequency, majority sign, verdict and rank of each feature per horizon.

    ``phi_runs``: (T, model, source, feature, importance, share) per run;
    ``signs``: output of ``sign_consistency`` with run (T, model).
    """
    top = top_k(phi_runs, ["T", "model", "source"], k, "share").select("T", "model", "source", "feature", F.lit(1.0).alias("hit"))
    runs = phi_runs.join(top, ["T", "model", "source", "feature"], "left")
    share = runs.groupBy("T", "model", "feature").agg(F.avg("share").alias("s")).groupBy("T", "feature").agg(F.avg("s").alias("consensus_share"))
    freq = runs.groupBy("T", "feature").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("top_frequency"))
    maj = majority_sign(signs, ["T"])
    out = share.join(freq, ["T", "feature"]).join(maj, ["T", "feature"], "left").join(
        F.broadcast(groups.select("feature", "grp", "expected_sign")), "feature", "left"
    )
    learned = F.coalesce("learned_sign_majority", F.lit("~"))
    out = out.withColumns({"learned_sign_majority": learned, "expected_sign": F.coalesce("expected_sign", F.lit("?")),
                           "sign_agreement": F.coalesce("sign_agreement", F.lit("0/0"))})
    out = out.withColumn("plausibility", verdict(F.col("learned_sign_majority"), F.col("expected_sign"), "weak"))
    out = with_average_rank(out, ["T"], "consensus_share", "__r", descending=True, bounded=True)
    return out.withColumn("rank", F.col("__r").cast("int")).drop("__r")


def plausibility_table(shares: DataFrame, signs: DataFrame, stable: DataFrame, lead: str, models: Sequence[str],
                       k: int = 10, stable_at: float = 0.8, dominant_at: float = 0.4) -> DataFrame:
    """Top features of the lead model with shares per model, sign verdict, stability and dominance."""
    wide = shares.groupBy("feature").agg(*[F.max(F.when(F.col("model") == m, F.col("share"))).alias(f"{m}_share") for m in models])
    lead_top = top_k(shares.filter(F.col("model") == lead), [], k, "share").select("feature", "rank")
    freq = stable.groupBy("feature").agg(F.min("top_frequency").alias("min_top_frequency"))
    return (
        lead_top.join(wide, "feature").join(signs, "feature", "left").join(freq, "feature", "left")
        .withColumns({"stable": F.col("min_top_frequency") >= stable_at, "dominant": F.col(f"{lead}_share") > dominant_at})
    )


def importance_by_life_group(
    preds: DataFrame, phi: DataFrame, train: DataFrame, key: str, run: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", train_y: str = "y_true", k: int = 5
) -> DataFrame:
    """n, RMSE, MAE, Bias and the k features of largest mean |phi| for each run and life group with predictions.

    ``preds`` has one row and ``phi`` one row per feature for each run and entity; groups are cut at the tertiles of the
    training labels, which the columns edge_low and edge_high hold. Entities without phi count in the errors alone.
    ``phi`` may also have one row for each run and entity with an array ``features`` of structs (feature, phi): features are
    then spread after the join.
    """
    from .metrics import life_group, tertile_edges

    by = [*run, "life_group", "edge_low", "edge_high"]
    rows = preds.crossJoin(F.broadcast(tertile_edges(train, train_y))).withColumn("life_group", life_group(y))
    e = F.col(p) - F.col(y)
    errors = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"), F.avg(e).alias("Bias"))
    grouped = phi.join(rows.select(*run, key, "life_group"), [*run, key])
    if "features" in phi.columns:
        grouped = grouped.select(*run, "life_group", F.inline("features"))
    top = top_k_text(global_importance(grouped, [*run, "life_group"]), [*run, "life_group"], k)
    return errors.join(top, [*run, "life_group"], "left")


def local_cases(preds: DataFrame, phi: DataFrame, key: str, y: str = "y_true", p: str = "y_pred", k: int = 8) -> DataFrame:
    """Four telling entities with their largest contributions as JSON.

    Best relative error among short and among long lives, and the worst under-
    and over-prediction. ``preds`` has a ``life_group`` column.
    """
    e = F.col(p) - F.col(y)
    rows = preds.select(key, y, p, "life_group", e.alias("error"), (F.abs(e) / F.col(y)).alias("rel"))
    who = F.struct(key, y, p, "error", "life_group")
    best = lambda g: F.min_by(who, F.when(F.col("life_group") == g, F.struct("rel", key)))
    cases = rows.agg(
        best("short").alias("correct_short_life"), best("long").alias("correct_long_life"),
        F.min_by(who, F.struct("error", key)).alias("worst_underprediction"),
        F.max_by(who, F.struct("error", key)).alias("worst_overprediction"),
    )
    names = cases.columns
    long = cases.select(F.explode(F.array(*[F.struct(F.lit(n).alias("case"), F.col(n).alias("c")) for n in names])).alias("r")).select("r.case", "r.c.*")
    w = Window.partitionBy("case").orderBy(F.abs("phi").desc(), "feature")
    top = phi.join(F.broadcast(long.select("case", key)), key).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    entries = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "feature", F.round("phi", 4).alias("phi")))), lambda s: F.struct(s["feature"], s["phi"])
    )
    js = top.groupBy("case").agg(F.to_json(F.map_from_entries(entries)).alias("top_contributions"))
    return long.join(js, "case", "left")
