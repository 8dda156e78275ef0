"""Training: split, class weight, two tree candidates and their soft vote, evaluation, promotion."""

from datetime import datetime, timezone
import uuid

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from txrisk.operators import boosting
from txrisk.operators.metrics import quality_metrics
from txrisk.options import TrainingOptions
from txrisk.schemas import FEATURE_COLS, MODEL_RUN

CANDIDATES = ["boosted", "leafwise"]
METRICS = ["roc_auc", "pr_auc", "f1", "precision", "recall", "brier_score_loss"]


def training_stats(rows: DataFrame) -> DataFrame:
    """Row count and fraud rate of a training table."""
    return rows.agg(F.count("*").alias("rows"), F.avg("label").alias("fraud_rate"))


def stratified_split(rows: DataFrame, opts: TrainingOptions = TrainingOptions()) -> DataFrame:
    """`part`: train, val or test, with exact shares of each label.

    Within a label the rows are ordered by a seeded hash of the id and cut at two hash values. The
    cuts are found from counts per slice of the hash space and a look into the slices they fall
    into, so the rows themselves are neither sorted nor shuffled. Copies of an id stay together.
    """
    digits = 5
    h = F.md5(F.concat_ws(":", F.lit(str(opts.seed)), F.col("transaction_id")))
    keyed = rows.select("label", h.alias("hash")).withColumn(
        "slice", F.conv(F.substring("hash", 1, digits), 16, 10).cast("bigint"))
    by_label = Window.partitionBy("label")
    before = by_label.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy("label", "slice").agg(F.count("*").alias("n")).select(
        "label", "slice", "n", F.sum("n").over(by_label).alias("total"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    tenths = F.array(F.lit(opts.train_tenths), F.lit(opts.train_tenths + opts.val_tenths))
    cut_rank = F.ceil(F.col("tenths") * F.col("total") / 10)
    cut_slices = slices.withColumn("tenths", F.explode(tenths)).filter(
        (F.col("start") <= cut_rank) & (cut_rank < F.col("start") + F.col("n"))).drop("n")
    # two slices per label; a cut that no hash of its slice reaches lies at the next slice
    inside = keyed.join(F.broadcast(cut_slices), ["label", "slice"]).groupBy(
        "label", "tenths", "slice", "start", "total", "hash").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label", "tenths").orderBy("hash"))
    after = F.when(F.col("slice") + 1 < 16 ** digits, F.lpad(F.lower(F.hex(F.col("slice") + 1)), digits, "0")).otherwise("g")
    cuts = inside.withColumn("rank", F.col("start") + upto - F.col("n")).groupBy("label", "tenths").agg(
        F.coalesce(F.min(F.when(F.col("rank") * 10 >= F.col("tenths") * F.col("total"), F.col("hash"))),
                   F.max(after)).alias("cut"))
    cuts = cuts.groupBy(F.col("label").alias("cut_label")).agg(
        F.max(F.when(F.col("tenths") == opts.train_tenths, F.col("cut"))).alias("train_cut"),
        F.max(F.when(F.col("tenths") != opts.train_tenths, F.col("cut"))).alias("val_cut"))
    part = (
        F.when(h < F.coalesce("train_cut", F.lit("g")), "train")
        .when(h < F.coalesce("val_cut", F.lit("g")), "val").otherwise("test")
    )
    return rows.join(F.broadcast(cuts), F.col("label").eqNullSafe(F.col("cut_label")), "left").withColumn(
        "part", part).drop("cut_label", "train_cut", "val_cut")


def class_weight(train: DataFrame) -> DataFrame:
    """Negatives per positive of the training part; at least one positive is assumed."""
    positives = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    negatives = F.sum(F.when(F.col("label") == 0, 1).otherwise(0))
    return train.agg(positives.alias("positives"), negatives.alias("negatives"),
                     (negatives / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"))


def fit_candidates(split: DataFrame, weight: float, opts: TrainingOptions = TrainingOptions()) -> tuple[PipelineModel, dict[str, list]]:
    """One pipeline with both candidates, and the average precision of each after every round.

    `boosted` grows all leaves of its depth, `leafwise` the best `leaves` of them. Both stop early on the validation part.
    """
    used = split.filter(F.col("part") != "test").select(
        "transaction_id", *FEATURE_COLS, "label", F.when(F.col("label") == 1, float(weight)).otherwise(1.0).alias("weight"),
        (F.col("part") == "val").alias("is_val"))
    fitted, staged = [], {}
    for name, leaves in zip(CANDIDATES, (2 ** opts.depth, opts.leaves)):
        model, staged[name] = boosting.fit(used, leaves, opts)
        model.set(model.outputCol, f"probability_{name}")
        fitted.append(model)
    return PipelineModel(stages=fitted), staged


def candidate_probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(transaction_id, label, boosted, leafwise) of rows scored by a fitted pipeline."""
    return model.transform(rows).select("transaction_id", "label", *[F.col(f"probability_{c}").alias(c) for c in CANDIDATES])


def soft_vote(probabilities: DataFrame, candidates: list[str] = CANDIDATES) -> DataFrame:
    """`ensemble`: the mean of the candidates' probabilities."""
    mean = sum((F.col(c) for c in candidates[1:]), F.col(candidates[0])) / len(candidates)
    return probabilities.withColumn("ensemble", mean)


def evaluate_candidates(voted: DataFrame, candidates: list[str] = CANDIDATES) -> DataFrame:
    """Quality metrics of every candidate and the ensemble in one pass, one row per candidate."""
    cells = [F.struct(F.lit(c).alias("candidate"), F.col(c).alias("probability")) for c in [*candidates, "ensemble"]]
    return quality_metrics(voted.select("label", F.inline(F.array(*cells))), ["candidate"])


def promotion_history(runs: DataFrame) -> DataFrame:
    """Every run with `promoted` and its present `stage`.

    The first run of a model is promoted; a later one only if its gate metric is strictly above that
    of the current champion, which is the best so far. A missing metric counts as 0.
    """
    by_model = Window.partitionBy("model_name").orderBy("created_at", "run_id")
    metric = F.coalesce("gate_metric", F.lit(0.0))
    best = F.max(metric).over(by_model.rowsBetween(Window.unboundedPreceding, -1))
    flagged = runs.withColumn("promoted", best.isNull() | (metric > best))
    place = F.struct("created_at", "run_id")
    last = F.max(F.when(F.col("promoted"), place)).over(Window.partitionBy("model_name"))
    return flagged.withColumn("stage", F.when(place == last, "Production").otherwise("Archived"))


def champion(runs: DataFrame) -> DataFrame:
    """The production run of each model."""
    return promotion_history(runs).filter("stage = 'Production'")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_RUN).parquet(path)


def train(features: DataFrame, runs_path: str, models_path: str, opts: TrainingOptions = TrainingOptions()) -> str:
    """Split, fit, evaluate, save the pipeline and append its run record; returns the run id."""
    spark = features.sparkSession
    # the cuts of the split take the rows several times, so the features are worked out once
    labelled = features.filter(F.col("label").isNotNull()).persist(StorageLevel.DISK_ONLY)
    split = stratified_split(labelled, opts).persist()
    try:
        sizes = {r.part: r.n for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}
        rate = training_stats(split).first().fraud_rate
        weight = class_weight(split.filter("part = 'train'")).first().scale_pos_weight
        model, staged = fit_candidates(split, weight, opts)
        voted = soft_vote(candidate_probabilities(model, split.filter("part = 'test'")))
        results = {r.candidate: r for r in evaluate_candidates(voted).collect()}
    finally:
        split.unpersist()
        labelled.unpersist()
    run_id = uuid.uuid4().hex
    model_path = f"{models_path}/{run_id}"
    model.save(model_path)
    metrics = {f"{c}_{m}": r[m] for c, r in results.items() for m in METRICS}
    metrics |= {f"{c}_rounds": float(stage.trees()) for c, stage in zip(CANDIDATES, model.stages)}
    record = (opts.model_name, run_id, datetime.now(timezone.utc), model_path, opts.serve, metrics[f"{opts.serve}_pr_auc"],
              sizes.get("train", 0), sizes.get("val", 0), sizes.get("test", 0), rate, weight, FEATURE_COLS, metrics)
    spark.createDataFrame([record], MODEL_RUN).write.mode("append").parquet(runs_path)
    return run_id
