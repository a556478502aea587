"""Forecasts issued from stored inputs, published once, and checked by being computed again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.math import clamp, sigmoid
from tidemark.operators import hazard
from tidemark.operators.coverage import reasons

#: What is stored of each slot, and compared when it is computed again.
STATED = ("hazard", "first_probability", "by_end_probability", "rolling_probability")


def issue_slots(lineage: DataFrame, snapshots: DataFrame, models: DataFrame, features: Sequence[str], clip: float = 3.0, told_weight: float = 0.5) -> DataFrame:
    """prediction, slot and STATED of every slot of every prediction, whatever model each one names, in one plan.

    ``lineage``: prediction, model and snapshot; ``snapshots``: snapshot, slot, the features,
    since (hours since the last outcome, or null) and told (share of the slot in a stated range);
    ``models``: model, means, scales and weights (the intercept first).  The model's hazard is
    damped after an outcome and mixed with what was told.
    """
    rows = lineage.join(models, "model").join(snapshots, "snapshot")
    eta = F.get("weights", F.lit(0))
    for k, c in enumerate(features):
        z = (F.col(c).cast("double") - F.get("means", F.lit(k))) / F.get("scales", F.lit(k))
        eta = eta + F.get("weights", F.lit(k + 1)) * clamp(z, -clip, clip)
    damped = clamp(sigmoid(eta), 1e-9, 1 - 1e-9) * hazard.refractory(F.col("since"))
    rows = rows.select("prediction", "slot", "told", damped.alias("hazard"))
    mixed = hazard.authority_mixture(rows, ["prediction"], "slot", F.col("told"), told_weight)
    curve = hazard.survival_curve(mixed.select("prediction", "slot", F.col("hazard_mixed").alias("hazard")), ["prediction"], "slot")
    return curve.select("prediction", "slot", *STATED)


def integrity(stated: DataFrame, lineage: DataFrame, snapshots: DataFrame, models: DataFrame, features: Sequence[str], tolerance: float = 1e-10, **how: float) -> DataFrame:
    """prediction, largest (difference) and reasons of every prediction of the lineage; without reasons it is what its inputs give.

    All predictions are scored again from the snapshot and the model that they name, and compared
    slot by slot with what was ``stated``.
    """
    known = lineage.join(models.select("model", F.lit(True).alias("__model")).distinct(), "model", "left").join(snapshots.select("snapshot").distinct().withColumn("__snapshot", F.lit(True)), "snapshot", "left")
    anew = issue_slots(lineage, snapshots, models, features, **how).select("prediction", "slot", *[F.col(c).alias(f"{c}_anew") for c in STATED], F.lit(True).alias("__anew"))
    met = stated.select("prediction", "slot", *STATED, F.lit(True).alias("__stated")).join(anew, ["prediction", "slot"], "full")
    far = {c: F.when(F.col(c).isNull() & F.col(f"{c}_anew").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(c) - F.col(f"{c}_anew")), F.lit(float("inf")))) for c in STATED}
    both = F.col("__stated") & F.col("__anew")
    found = met.groupBy("prediction").agg(
        *[F.max(F.when(both, d)).alias(f"__{c}") for c, d in far.items()], F.count_if(F.col("__anew").isNull()).alias("__more"), F.count_if(F.col("__stated").isNull()).alias("__fewer")
    )
    rows = known.join(found, "prediction", "left")
    whole = F.col("__model") & F.col("__snapshot")
    why = reasons(
        {
            "model_missing": F.col("__model").isNull(),
            "snapshot_missing": F.col("__snapshot").isNull(),
            "slot_missing": whole & (F.coalesce("__fewer", F.lit(0)) > 0),
            "slot_without_inputs": whole & (F.col("__more") > 0),
            **{f"{c}_differs": F.col(f"__{c}") > tolerance for c in STATED},
        }
    )
    return rows.select("prediction", F.greatest(*[F.col(f"__{c}") for c in STATED]).alias("largest"), why.alias("reasons"))


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def claim(spark: SparkSession, staged: str, final: str) -> bool:
    """Move a written folder to its name, which only one writer can: a rename that never replaces."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    files, source = _files(spark, staged)
    target = jvm.org.apache.hadoop.fs.Path(final)
    files.mkdirs(target.getParent())
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(source), files.makeQualified(target), none)
    except Exception:
        if not files.exists(target):
            raise
        return False
    return True


def _staged(spark: SparkSession, root: str, final: str, write: Callable[[str], None]) -> bool:
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    try:
        write(staged)
        return claim(spark, staged, final)
    finally:
        files, target = _files(spark, staged)
        files.delete(target, True)


def forecast_folder(root: str, *key: object) -> str:
    return f"{root}/forecasts/{hashlib.sha256(chr(31).join(map(str, key)).encode()).hexdigest()}"


def publish_once(root: str, key: Sequence[object], forecast: DataFrame) -> bool:
    """Write a forecast under its key (cutoff, model, horizon); whether this call did it.

    The whole is written aside and then takes its name at once: of writers of one key one wins,
    and readers see all of a forecast or nothing.
    """
    spark, final = forecast.sparkSession, forecast_folder(root, *key)
    return not exists(spark, final) and _staged(spark, root, final, lambda path: forecast.write.parquet(path))


def _versions(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, f"{root}/versions"):
        return []
    files, target = _files(spark, f"{root}/versions")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(target) if f.getPath().getName().isdigit())


def publish_views(spark: SparkSession, root: str, views: Mapping[str, DataFrame]) -> int:
    """Write views that belong together as the next version, whose number is returned.

    All of them are in the folder of the version, which takes its name when they are complete; a
    writer that finds its number taken tries the next one.
    """
    number = 0

    def write(path: str) -> None:
        for name, view in views.items():
            view.write.parquet(f"{path}/{name}")

    staged = f"{root}/staged/{uuid.uuid4().hex}"
    write(staged)
    while True:
        number = max([number, *_versions(spark, root)]) + 1
        if claim(spark, staged, f"{root}/versions/{number}"):
            return number


def read_views(spark: SparkSession, root: str, names: Sequence[str], version: int | None = None) -> dict[str, DataFrame]:
    """The views of one version, the last one unless it is named; all of them were written together."""
    found = _versions(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing is published in {root}")
    return {n: spark.read.parquet(f"{root}/versions/{version or found[-1]}/{n}") for n in names}


def shown_reasons(column: str = "reasons") -> Column:
    return F.array_join(column, ",").alias(column)
