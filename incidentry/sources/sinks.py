"""Results as tables: features, rules, comparisons, reports, judgments, model bundles, cascades and trials."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.heuristics import cascade_questions, checklist, tree_questions
from ..operators.ml import Fitted
from ..operators.trees import Trees, cascade_report, gains, node_table
from .jsonl import write_jsonl


def materialise_features(df: DataFrame, path: str, keep_latest: bool = False) -> int:
    """Features as JSON lines at ``path``, on any file system that Spark writes to; rows written.

    With ``keep_latest`` the folder ``<path>-latest`` gets the same rows, read back from the first.
    """
    n = write_jsonl(df, path)
    if keep_latest:
        df.sparkSession.read.schema(df.schema).json(path).write.mode("overwrite").json(f"{path}-latest")
    return n


def save_items(items: DataFrame, path: str) -> None:
    """Ranked rule items."""
    items.write.mode("overwrite").parquet(path)


def long_metrics(df: DataFrame, name: str, metrics: list[str], run_id: str, settings: dict[str, str] | None = None) -> DataFrame:
    """(run_id, arm, metric, value, settings): one row for each arm and metric."""
    pairs = [F.lit(x) for kv in sorted((settings or {}).items()) for x in kv]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(run_id).alias("run_id"), F.col(name).cast("string").alias("arm"), F.explode(each).alias("x"), F.create_map(*pairs).cast("map<string,string>").alias("settings")).select("run_id", "arm", "x.metric", "x.value", "settings")


def save_comparison(metrics: DataFrame, path: str) -> None:
    """Append a long frame of arms and metrics; runs are folders."""
    metrics.write.mode("append").partitionBy("run_id").parquet(path)


def long_report(report: DataFrame, runner: str) -> DataFrame:
    """(runner, label, metric, value) of a classification report."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "f1", "support")])
    return report.select(F.lit(runner).alias("runner"), "label", F.explode(each).alias("x")).select("runner", "label", "x.metric", "x.value")


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def save_judgments(judged: DataFrame, path: str) -> None:
    """Judgments as JSON lines, and their count and accuracy beside them in ``<path>.metrics``."""
    judged.write.mode("overwrite").json(path)
    kept = judged.sparkSession.read.schema(judged.schema).json(path)
    kept.agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy")).write.mode("overwrite").json(f"{path}.metrics")


def fingerprint(df: DataFrame) -> str:
    """A number that depends on all rows and not on their order."""
    return str(df.agg(F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("f")).first()["f"])


def save_bundle(fitted: Fitted, path: str, train: DataFrame, metrics: dict[str, float], config: dict | None = None, extra: dict | None = None) -> None:
    """A model with its features, labels, metrics, settings and the fingerprint of its training rows."""
    fitted.model.write().overwrite().save(f"{path}/model")
    text = lambda d: {str(k): str(v) for k, v in (d or {}).items()}
    row = (fitted.columns, fitted.labels, {k: float(v) for k, v in metrics.items()}, text(config), text(extra), fingerprint(train))
    schema = "columns array<string>, labels array<string>, metrics map<string,double>, config map<string,string>, extra map<string,string>, fingerprint string"
    train.sparkSession.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    """The model of ``save_bundle`` and what was saved about it."""
    about = spark.read.parquet(f"{path}/about").first().asDict()
    return Fitted(PipelineModel.load(f"{path}/model"), list(about["columns"]), list(about["labels"])), about


def save_cascade(trees: dict[str, Fitted | str], train: DataFrame, path: str) -> None:
    """Questions of all trees, the checklist made of them, and the categories that have no tree."""
    spark = train.sparkSession
    cascade_questions(trees, train).write.mode("overwrite").parquet(f"{path}/questions")
    checklist(spark.read.parquet(f"{path}/questions")).write.mode("overwrite").parquet(f"{path}/checklist")
    status = [(c, "fitted" if isinstance(t, Fitted) else t) for c, t in sorted(trees.items())]
    spark.createDataFrame(status, "category string, status string").write.mode("overwrite").parquet(f"{path}/status")


def save_trees(trees: Trees, spark: SparkSession, path: str) -> None:
    """A cascade that grew together: questions, checklist, metrics and importances of each category, and the aggregate."""
    tree_questions(node_table(trees, spark)).write.mode("overwrite").parquet(f"{path}/questions")
    checklist(spark.read.parquet(f"{path}/questions")).write.mode("overwrite").parquet(f"{path}/checklist")
    rows, total = cascade_report(trees)
    spark.createDataFrame(rows, "category string, status string, accuracy double, precision double, recall double, f1 double").write.mode("overwrite").parquet(f"{path}/metrics")
    parts = [(t, f, g) for t in sorted(trees.nodes) for f, g in sorted(gains(trees, t).items())]
    spark.createDataFrame(parts, "category string, feature string, importance double").write.mode("overwrite").parquet(f"{path}/importances")
    spark.createDataFrame(list(total.items()), "metric string, value double").write.mode("overwrite").parquet(f"{path}/aggregate")


def append_trial(trial: DataFrame, path: str, run_id: str) -> None:
    """Append the rows of one trial (iteration, approach, accuracy) under its run."""
    trial.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def trial_summary(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, approach, trials, mean, best) of all trials logged at ``path``."""
    log = spark.read.schema("iteration long, approach string, accuracy double, run_id string").json(path)
    return log.groupBy("run_id", "approach").agg(F.count(F.lit(1)).alias("trials"), F.avg("accuracy").alias("mean"), F.max("accuracy").alias("best"))
