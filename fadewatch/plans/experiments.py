"""Multi-step jobs: tuning, configuration runs, nested resampling, ablations, corruption sweeps."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble as en
from ..operators import learners as ln
from ..operators import linear as li
from ..operators import logistic as lg
from ..operators import metrics as mt
from ..operators import policy as pl
from ..operators.robustness import change_from_baseline, condition_summary, mask_missing
from ..operators.splits import repeated_folds
from ..session import materialize


@dataclass(frozen=True)
class Settings:
    """Study settings; the defaults are the published study's."""

    horizons: tuple[int, ...] = (5, 10, 20, 30, 50, 100)
    seeds: tuple[int, ...] = tuple(range(10))
    n_folds: int = 5
    winsor: tuple[float, float] = (0.01, 0.99)
    tuning_repeats: int = 3
    tuning_seed: int = 7
    search_draws: int = 40
    ridge_alphas: tuple[float, ...] = tuple(10 ** (-3 + 0.5 * i) for i in range(13))
    pls_components: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 8)
    failure_threshold: float = 488.0
    alphas: tuple[float, ...] = (0.05, 0.10, 0.20)
    interval_alpha: float = 0.10
    target_recall: float = 0.90
    alarm_recalls: tuple[float, ...] = (0.95, 0.90, 0.80, 0.70)
    nested_ridge_alphas: tuple[float, ...] = (1.0, 10.0, 100.0)
    nested_pls_components: tuple[int, ...] = (2, 3, 4, 6, 8)
    nested_logistic_c: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0)
    policies: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {
            "every_checkpoint": (5, 10, 20, 30, 50, 100), "from_20": (20, 50, 100), "from_50": (50, 100),
            "single_50": (50,), "single_100": (100,),
        }
    )


# ------------------------------------------------------------- tuning

def tune_linear(spark: SparkSession, train: DataFrame, key: str, target: str, features: Sequence[str], st: Settings) -> DataFrame:
    """Cross-validated score of every ridge and PLS candidate over repeated grouped folds: (model, cv_rmse, log_rmse)."""
    k = st.n_folds
    rows = repeated_folds(train.select(key, target, *features), key, target, k, st.tuning_repeats, st.tuning_seed)
    rows = materialize(rows)  # read by the fit and by the prediction
    own = F.concat_ws("/", F.col("repeat").cast("string"), F.col("fold").cast("string"))
    fit_rows = rows.withColumn(li.SPLIT, F.array(*li.other_folds("fold", k, F.col("repeat").cast("string"))))
    prep = li.prepare(fit_rows, features, target, st.winsor)
    models = li.model_table(spark, prep, li.solve_all(prep, st.ridge_alphas, st.pls_components), features)
    oof = li.predict(rows.withColumn(li.SPLIT, own), models, features, keep=[target])
    return li.tuning_scores(oof, target)


def candidate_order(st: Settings) -> list[str]:
    return [f"ridge_a{a:g}" for a in st.ridge_alphas] + [f"plsr_k{k}" for k in st.pls_components]


def tune_learner(train: DataFrame, key: str, target: str, features: Sequence[str], st: Settings, make, space: dict[str, list]) -> list[tuple[dict, float]]:
    """Random search over a tree space: mean fold RMSE in cycles of each drawn parameter set, best first."""
    rows = materialize(repeated_folds(train.select(key, target, *features), key, target, st.n_folds, st.tuning_repeats, st.tuning_seed))
    out = []
    for params in ln.draw_params(space, st.search_draws, st.tuning_seed):
        errors = []
        for r in range(st.tuning_repeats):
            part = rows.filter(F.col("repeat") == r)
            prep = li.prepare(li.training_sets(part, "fold", st.n_folds), features, target, st.winsor)
            oof = ln.oof_regressor(part, "fold", st.n_folds, features, target, prep, lambda p=params: make(st.tuning_seed, **p), [key, target, "fold"])
            e = F.col("y_pred") - F.col(target)
            errors.append(oof.groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("r")).agg(F.avg("r")).first()[0])
        out.append((params, sum(errors) / len(errors)))
    return sorted(out, key=lambda x: x[1])


# ------------------------------------------------------------- one configuration

def run_configuration(
    spark: SparkSession, train: DataFrame, test: DataFrame, key: str, target: str, features: Sequence[str], fold: str,
    st: Settings, forest_params: dict | None = None, boost_params: dict | None = None,
) -> dict[str, DataFrame]:
    """Base models, out-of-fold predictions, ensembles, metrics and selections of one (feature set, horizon).

    ``train`` has fold ids. Ridge and PLS come from one scan of moments; trees
    are fitted per fold and seed. Returns tables: predictions, weights,
    metrics, summary, selection.
    """
    k = st.n_folds
    cols = [key, target, *features]
    train, test = materialize(train.select(*cols, fold)), materialize(test.select(*cols))
    scores = tune_linear(spark, train, key, target, features, st)
    order = candidate_order(st)
    best = {
        fam: li.best_candidate(scores.filter(F.col("model").startswith(fam)), [], "cv_rmse", order).first()["model"]
        for fam in ("ridge", "plsr")
    }
    prep = li.prepare(li.training_sets(train, fold, k), features, target, st.winsor)
    solved = [w for w in li.solve_all(prep, st.ridge_alphas, st.pls_components, dummy=True) if w.name in (*best.values(), "dummy")]
    models = li.model_table(spark, prep, solved, features)
    short = F.substring_index("model", "_", 1)
    lin_oof = li.out_of_fold(train, models, features, fold, [key, target])
    lin_test = li.predict(test.withColumn(li.SPLIT, F.lit("final")), models, features, keep=[key, target])
    blocks = []
    seeds = F.explode(F.array(*[F.lit(int(s)) for s in st.seeds]))
    for part, df in (("oof", lin_oof), ("test", lin_test)):
        blocks.append(df.select(key, F.col(target).alias("y_true"), short.alias("model"), "y_pred", F.lit(part).alias("partition"), seeds.alias("seed")))
    for name, make, params in (("rf", ln.forest, forest_params), ("gbt", ln.boosted, boost_params)):
        if params is None:
            continue
        for seed in st.seeds:
            oof = ln.oof_regressor(train, fold, k, features, target, prep, lambda: make(seed, **params), [key, target])
            model = ln.fit_regressor(train, features, target, prep["final"], make(seed, **params))
            tst = ln.predict_regressor(model, test, features, prep["final"], [key, target])
            for part, df in (("oof", oof), ("test", tst)):
                blocks.append(df.select(key, F.col(target).alias("y_true"), F.lit(name).alias("model"), "y_pred", F.lit(part).alias("partition"), F.lit(int(seed)).alias("seed")))
    preds = blocks[0]
    for b in blocks[1:]:
        preds = preds.unionByName(b)
    preds = materialize(preds)
    li.assert_covered(preds)

    base = [m for m in ("rf", "gbt") if {"rf": forest_params, "gbt": boost_params}[m] is not None] or ["ridge", "plsr"]
    oof = preds.filter("partition = 'oof'").withColumn("seed", F.col("seed").cast("string"))
    members = ["ridge", *[b for b in base if b != "ridge"]]
    subsets = [list(base)] + ([members] if len(members) > len(base) else [])
    moments = materialize(en.stack_moments(oof.filter(F.col("model").isin(members)), members, ["seed"], key))
    stack_w, stack_b = en.fit_stacks(spark, moments, members, subsets, ["seed"])
    inv = en.inverse_mse_weights(oof.filter(F.col("model").isin(base)), ["seed"])
    inv_name = "valweighted_" + "_".join(base)
    inv_w = inv.select("seed", F.lit(inv_name).alias("combiner"), "model", "weight")
    weights = stack_w.unionByName(inv_w)
    bias = stack_b.unionByName(inv_w.select("seed", "combiner", F.lit(0.0).alias("intercept")).distinct())

    text_seed = preds.withColumn("seed", F.col("seed").cast("string"))
    combined = en.combine(text_seed.filter("partition = 'test'"), weights, ["seed"], key, bias).withColumn("partition", F.lit("test"))
    mean_rows = en.equal_weight(text_seed, base, ["seed", "partition", key])
    folds = train.select(key, fold)
    honest = None
    for sub in subsets:  # cross-fitted stack: weights from the other folds
        fold_m = materialize(en.stack_moments(oof.filter(F.col("model").isin(sub)).join(folds, key), sub, ["seed", fold], key))
        for seed in st.seeds:
            w, b = en.crossfit_weights(spark, fold_m.filter(F.col("seed") == str(seed)).drop("seed"), sub, sub, fold)
            one = en.combine(oof.filter(F.col("seed") == str(seed)).join(folds, key), w, [fold], key, b)
            one = one.select(key, "combiner", "y_pred", F.lit(str(seed)).alias("seed"), F.lit("oof").alias("partition"))
            honest = one if honest is None else honest.unionByName(one)
    inv_oof = en.combine(oof, inv_w, ["seed"], key).withColumn("partition", F.lit("oof"))
    truth = preds.select(key, "y_true", "partition").distinct()
    ens = combined.unionByName(honest).unionByName(inv_oof).withColumnRenamed("combiner", "model").unionByName(
        mean_rows.select("seed", "model", key, "y_pred", "partition")
    ).join(truth, [key, "partition"])
    everything = materialize(
        text_seed.select("model", "seed", "partition", key, "y_true", "y_pred").unionByName(
            ens.select("model", "seed", "partition", key, "y_true", "y_pred"))
    )
    metrics = mt.regression_metrics(everything, ["partition", "model", "seed"])
    summary = mt.summarize_seeds(metrics, ["partition", "model"], ["RMSE", "MAE", "R2", "MedAE", "Bias", "nRMSE", "MAPE"])
    cv = summary.filter("partition = 'oof'").select("model", F.col("RMSE_mean").alias("RMSE"))
    individual = li.best_candidate(cv.filter(F.col("model").isin("ridge", "plsr", "rf", "gbt")), [], "RMSE", ["ridge", "plsr", "rf", "gbt"])
    full = en.stack_name(subsets[-1])
    reduced = en.stack_name(subsets[0])
    selection = individual.select(F.col("model").alias("best_individual"), F.col("RMSE").alias("best_individual_rmse")).crossJoin(
        F.broadcast(en.final_ensemble(cv, full, reduced))
    )
    return {"predictions": everything, "weights": weights, "intercepts": bias, "metrics": metrics, "summary": summary,
            "selection": selection, "tuning": scores}


def select_main(selections: DataFrame, by: str = "feature_set", score: str = "final_rmse") -> DataFrame:
    """Configuration with the lowest cross-validated error of its final ensemble."""
    return selections.agg(F.min_by(by, F.struct(score, by)).alias(by), F.min(score).alias(score))


# ------------------------------------------------------------- nested resampling

def linear_outer_folds(
    spark: SparkSession, rows: DataFrame, nested: DataFrame, key: str, target: str, feature_sets: dict[str, Sequence[str]],
    st: Settings, k: int,
) -> dict[str, DataFrame]:
    """Life regression of all outer folds at once: selection on inner folds, refit, intervals and alarms.

    ``nested`` is the output of ``nested_folds``. Every (repeat, outer fold,
    inner fold) is a split; all candidates of all splits come from one bounds
    job and one moments job per feature set. Roles: 'new' (all candidates) and
    'base' (PLS on the first feature set).
    """
    tag = ["repeat", "outer_fold"]
    outer = F.concat_ws("/", *[F.col(c).cast("string") for c in tag])
    full = materialize(nested.withColumn("outer", outer).join(rows, [key, target]))
    train, test = full.filter("role = 'train'"), full.filter("role = 'test'")
    splits = train.withColumn(li.SPLIT, F.array(*li.other_folds("inner_fold", k, F.col("outer")), F.concat_ws("/", "outer", F.lit("final"))))
    train, test = train.withColumn(li.SPLIT, F.concat_ws("/", "outer", F.col("inner_fold").cast("string"))), test.withColumn(li.SPLIT, F.concat_ws("/", "outer", F.lit("final")))
    fitted, order, keep = [], [], [key, target, *tag]
    for fs, features in feature_sets.items():
        prep = li.prepare(splits.select(li.SPLIT, target, *features), features, target, st.winsor)
        solved = li.solve_all(prep, st.nested_ridge_alphas, st.nested_pls_components, tag=f"_{fs}")
        fitted.append((li.model_table(spark, prep, solved, features), features))
        order += [f"plsr_k{c}_{fs}" for c in st.nested_pls_components] + [f"ridge_a{a:g}_{fs}" for a in st.nested_ridge_alphas]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    # predictions of all candidates are added up where they are made; those of the chosen ones alone are kept
    scores = materialize(li.tuning_scores(union([li.predict(train, models, features, keep=keep) for models, features in fitted]), target, tag))
    first = next(iter(feature_sets))
    roles = []
    for role, cond in (("new", F.lit(True)), ("base", F.col("model").startswith("plsr_") & F.col("model").endswith(f"_{first}"))):
        roles.append(li.best_candidate(scores.filter(cond), tag, "log_rmse", order).withColumn("reg_role", F.lit(role)))
    chosen = materialize(roles[0].unionByName(roles[1]))
    more = [c for c in chosen.columns if c not in (*tag, "model")]
    wanted = chosen.select(F.concat_ws("/", *tag).alias("__outer"), "model", *more)
    best = [(models.withColumn("__outer", F.substring_index(li.SPLIT, "/", 2)).join(F.broadcast(wanted), ["__outer", "model"]), features) for models, features in fitted]
    kept = lambda data: union([li.predict(data, models, features, keep=[*keep, *more]) for models, features in best])
    oof_best, test_best = (materialize(kept(data).withColumn("early_failure", F.col(target) <= st.failure_threshold)) for data in (train, test))
    group = [*tag, "reg_role"]
    alpha = [st.interval_alpha]
    recalls = st.alarm_recalls
    intervals = pl.life_intervals(oof_best, test_best, group, target, "y_pred", alpha)
    flags = pl.alarms_by_recall(oof_best, test_best, group, "y_pred", "early_failure", recalls)
    dummy = train.groupBy(*tag).agg(F.exp(F.avg(F.log(target))).alias("dummy_pred_life"))
    return {"selection": chosen, "intervals": intervals, "alarms": flags, "dummy": dummy, "oof": oof_best, "test": test_best}


def classifier_outer_fold(
    spark: SparkSession, train: DataFrame, test: DataFrame, key: str, target: str, feature_sets: dict[str, Sequence[str]], fold: str,
    st: Settings, k: int,
) -> dict[str, DataFrame]:
    """Early-failure classifier of one outer fold: log-loss selection, probabilities, sets and alarms."""
    train = materialize(train.withColumn("early_failure", F.col(target) <= st.failure_threshold))
    test = test.withColumn("early_failure", F.col(target) <= st.failure_threshold)
    best = None
    for fs, features in feature_sets.items():
        prep = li.prepare(li.training_sets(train, fold, k), features, target, st.winsor)
        every = materialize(ln.oof_probabilities(train, fold, k, features, "early_failure", prep, st.nested_logistic_c, [key, "early_failure"]))
        losses = {r["C"]: r["log_loss"] for r in mt.brier_logloss(every, ["C"], "p_fail", "early_failure").collect()}  # one row for each penalty
        for c in st.nested_logistic_c:
            if best is None or losses[c] < best[0]:
                best = (losses[c], f"logit_C{c:g}_{fs}", features, prep, c, every.filter(F.col("C") == c).drop("C"))
    loss, name, features, prep, c, oof = best
    p = ln.predict_probability(train, test, features, "early_failure", prep["final"], c, [key, target, "early_failure"])
    sets = pl.fail_pass_sets(oof, p, [], "p_fail", "early_failure", st.alphas)
    neg = oof.withColumn("score", -F.col("p_fail"))
    flags = pl.alarms_by_recall(neg, p.withColumn("score", -F.col("p_fail")), [], "score", "early_failure", st.alarm_recalls)
    choice = spark.createDataFrame([(name, float(loss))], "clf_choice string, clf_inner_logloss double")
    return {"probabilities": p, "sets": sets, "alarms": flags, "choice": choice}


def classifier_outer_folds(
    spark: SparkSession, rows: DataFrame, nested: DataFrame, key: str, target: str, feature_sets: dict[str, Sequence[str]], st: Settings, k: int,
) -> dict[str, DataFrame]:
    """Early-failure classifiers of all outer folds at once: log-loss selection on inner folds, probabilities, sets, alarms.

    ``nested`` is the output of ``nested_folds``. One Newton iteration serves every (repeat, outer fold, inner fold or
    final, penalty); 'problems' lists the penalised gradient that each of them ends with.
    """
    tag = ["repeat", "outer_fold"]
    outer = F.concat_ws("/", *[F.col(c).cast("string") for c in tag])
    full = materialize(nested.withColumn("outer", outer).join(rows, [key, target]).withColumn("early_failure", F.col(target) <= st.failure_threshold))
    train, test = full.filter("role = 'train'"), full.filter("role = 'test'")
    splits = train.withColumn(li.SPLIT, F.array(*li.other_folds("inner_fold", k, F.col("outer")), F.concat_ws("/", "outer", F.lit("final"))))
    keep = [key, target, *tag, "early_failure"]
    fitted, order, solved = [], [], []
    for fs, features in feature_sets.items():
        prep = li.prepare(splits.select(li.SPLIT, target, *features), features, target, st.winsor)
        problems = lg.fit(train, features, "early_failure", prep, st.nested_logistic_c, "inner_fold", "outer")
        names = {float(c): f"logit_C{c:g}_{fs}" for c in st.nested_logistic_c}
        order += names.values()
        fitted.append((features, prep, problems, names))
        solved += [(q.split, names[q.c], q.gradient, q.constant) for q in problems]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))

    def predicted(data: DataFrame, split: Column, wanted: Callable[[str, str], bool]) -> DataFrame:
        parts = []
        for features, prep, problems, names in fitted:
            named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("C")].alias("model")
            some = [q for q in problems if wanted(q.split.rpartition("/")[0], names[q.c])]
            if some:
                parts.append(lg.predict(data, F.concat_ws("/", "outer", split), features, some, prep, keep).select(*keep, named, "p_fail"))
        return union(parts)

    # predictions of all candidates are added up where they are made; those of the chosen ones alone are kept
    inner = F.col("inner_fold").cast("string")
    scores = mt.brier_logloss(predicted(train, inner, lambda outer, model: True), [*tag, "model"], "p_fail", "early_failure")
    chosen = materialize(li.best_candidate(scores, tag, "log_loss", order))
    picked = {("/".join(str(r[c]) for c in tag), r["model"]) for r in chosen.collect()}  # one row for each outer fold
    oof_best, test_best = (materialize(predicted(data, split, lambda outer, model: (outer, model) in picked)) for data, split in ((train, inner), (test, F.lit("final"))))
    sets = pl.fail_pass_sets(oof_best, test_best, tag, "p_fail", "early_failure", st.alphas)
    score = lambda df: df.withColumn("score", -F.col("p_fail"))
    flags = pl.alarms_by_recall(score(oof_best), score(test_best), tag, "score", "early_failure", st.alarm_recalls)
    table = spark.createDataFrame(solved, "split string, model string, gradient double, constant double")
    return {"selection": chosen, "probabilities": test_best, "sets": sets, "alarms": flags, "problems": table}


def balanced_logistic(spark: SparkSession, train: DataFrame, test: DataFrame, key: str, flag: str, target: str, features: Sequence[str],
                      fold: str, k: int, cs: Sequence[float] = ln.LOGISTIC_BALANCED_C, probs=(0.01, 0.99)) -> tuple[float, DataFrame, DataFrame]:
    """Class-balanced logistic model with the penalty chosen by mean fold ROC-AUC: (C, out-of-fold, test probabilities)."""
    from ..operators.order_stats import roc_auc

    prep = li.prepare(li.training_sets(train, fold, k), features, target, probs)
    best = None
    every = materialize(ln.oof_probabilities(train, fold, k, features, flag, prep, cs, [key, flag, fold], balanced=True))
    per_fold = roc_auc(every, ["C", fold], "p_fail", flag).groupBy("C").agg(F.avg("roc_auc").alias("auc"))
    aucs = {r["C"]: r["auc"] or 0.0 for r in per_fold.collect()}  # one row for each penalty
    for c in cs:
        if best is None or aucs[c] > best[0]:
            best = (aucs[c], c, every.filter(F.col("C") == c).drop("C"))
    return best[1], best[2], ln.predict_probability(train, test, features, flag, prep["final"], best[1], [key, flag], balanced=True)


# ------------------------------------------------------------- baselines, ablation, robustness, audit

def baseline_harness(spark: SparkSession, train: DataFrame, test: DataFrame, key: str, target: str, specs: dict[str, tuple[str, Sequence[str], int]]) -> DataFrame:
    """Plain z-score baselines: spec name -> (kind, features, size) with kind dummy, ols, ridge, pls or pcr.

    Features and ln-target are scaled by sample deviations; no clipping. All
    specs are solved from one moment matrix over all their features.
    """
    solve = {
        "dummy": lambda p, _: p.cross * 0.0, "ols": lambda p, _: li.ordinary(p), "ridge": lambda p, a: li.ridge(p, a),
        "pls": lambda p, k: li.partial_least_squares(p, k), "pcr": lambda p, k: li.principal_components(p, k),
    }
    every = list(dict.fromkeys(f for _, fs, _ in specs.values() for f in fs))
    prep = li.prepare(train.withColumn(li.SPLIT, F.lit("final")), every, target, winsor=False, sample_std=True)
    weights = [
        li.Weights(name, "final", li.solve_on(prep["final"], every, fs, lambda p, k=kind, s=size: solve[k](p, s)))
        for name, (kind, fs, size) in specs.items()
    ]
    models = li.model_table(spark, prep, weights, every)
    p = li.predict(test.withColumn(li.SPLIT, F.lit("final")), models, every, keep=[key, target])
    return p.select(key, "model", F.col(target).alias("y_true"), "y_pred")


def group_ablation(spark: SparkSession, train: DataFrame, test: DataFrame, key: str, target: str, configs: dict[str, Sequence[str]], fold: str, k: int,
                   pls_components: int, probs=(0.01, 0.99)) -> DataFrame:
    """Retrain PLS with each column list; cross-validated and test errors and their change from 'full'.

    The preprocessing of a feature does not depend on its neighbours, so all
    configurations of all folds come from one moment matrix per fold, and one
    pass predicts them all.
    """
    every = list(dict.fromkeys(f for fs in configs.values() for f in fs))
    train = materialize(train.select(key, target, fold, *every))
    prep = li.prepare(li.training_sets(train, fold, k), every, target, probs)
    weights = [
        li.Weights(config, split, li.solve_on(p, every, fs, lambda q, n=min(pls_components, len(fs)): li.partial_least_squares(q, n)))
        for split, p in prep.items() for config, fs in configs.items()
    ]
    models = li.model_table(spark, prep, weights, every)
    e = F.col("y_pred") - F.col(target)
    parts = [
        df.groupBy(F.col("model").alias("config")).agg(F.sqrt(F.avg(e * e)).alias(f"{part}_rmse"), F.avg(F.abs(e)).alias(f"{part}_mae"))
        for part, df in (("cv", li.out_of_fold(train, models, every, fold, [target])),
                         ("test", li.predict(test.withColumn(li.SPLIT, F.lit("final")), models, every, keep=[target])))
    ]
    sizes = spark.createDataFrame([(c, len(fs)) for c, fs in configs.items()], "config string, n_features int")
    rows = sizes.join(parts[0], "config").join(parts[1], "config").withColumn("model", F.lit("plsr"))
    return change_from_baseline(rows, ["model"], "config", "full", ["cv_rmse", "cv_mae", "test_rmse", "test_mae"], "d_")


def robustness_sweep(spark: SparkSession, models: DataFrame, test: DataFrame, conditions: dict[tuple[str, int], DataFrame], features: Sequence[str],
                     key: str, target: str) -> DataFrame:
    """Errors of fixed models on clean and corrupted test inputs: ``conditions`` maps (name, repeat) to a feature table."""
    tagged = test.withColumns({"condition": F.lit("clean"), "repeat": F.lit(0)})
    for (name, repeat), df in conditions.items():
        tagged = tagged.unionByName(df.withColumns({"condition": F.lit(name), "repeat": F.lit(repeat)}))
    p = materialize(li.predict(tagged.withColumn(li.SPLIT, F.lit("final")), models, features, keep=[target, "condition", "repeat"]))  # read by four jobs
    m = mt.regression_metrics(p.withColumn("seed", F.lit(0)), ["seed", "model", "condition", "repeat"], target, "y_pred")
    return condition_summary(m.select("seed", "model", "condition", "repeat", "RMSE", "MAE"))


def missing_conditions(test: DataFrame, features: Sequence[str], key: str, rates: Sequence[float], repeats: int, seed: int = 0) -> dict[tuple[str, int], DataFrame]:
    return {
        (f"missing_{round(r * 100)}pct", i): mask_missing(test, features, r, key, seed, i) for r in rates for i in range(repeats)
    }


def label_audit(train: DataFrame, test: DataFrame, key: str, labels: dict[str, str], reference: str, features: Sequence[str], fold: str, k: int,
                grid: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """Boosted trees under each label definition, and the spread of the error over neighbouring settings."""
    spark = train.sparkSession
    train, test = materialize(train), materialize(test)
    rows = []
    rmse = lambda df, y: df.agg(F.sqrt(F.avg((F.col("y_pred") - F.col(y)) * (F.col("y_pred") - F.col(y))))).first()[0]
    for name, y in labels.items():
        prep = li.prepare(li.training_sets(train, fold, k), features, y, winsor=False)
        model = ln.fit_regressor(train, features, y, prep["final"], ln.boosted(42, **grid[0]))
        p = materialize(ln.predict_regressor(model, test, features, prep["final"], [key, *dict.fromkeys([y, reference])]))
        oof = ln.oof_regressor(train, fold, k, features, y, prep, lambda: ln.boosted(42, **grid[0]), [key, y])
        rows.append((name, rmse(p, y), rmse(p, reference), rmse(oof, y)))
    prep = li.prepare(train.withColumn(li.SPLIT, F.lit("final")), features, reference, winsor=False)
    errors = ln.in_parallel([
        lambda g=g: rmse(ln.predict_regressor(ln.fit_regressor(train, features, reference, prep["final"], ln.boosted(42, **g)), test, features, prep["final"], [key, reference]), reference)
        for g in grid
    ])
    audit = spark.createDataFrame(rows, "variant string, rmse_own_label double, rmse_reference_label double, cv_rmse double")
    spread = spark.createDataFrame([(float(e),) for e in errors], "rmse double").agg(
        F.min("rmse").alias("min_rmse"), F.percentile("rmse", F.lit(0.5)).alias("median_rmse"), F.max("rmse").alias("max_rmse")
    )
    return audit, spread
