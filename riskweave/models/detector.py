"""Fit and score: one saved PipelineModel holds preprocessing and classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.features import class_weights, with_absent_inputs
from riskweave.functions.scores import confidence, decide
from riskweave.models import registry
from riskweave.models.boosting import Booster, TreesModel
from riskweave.schema import numeric_columns
from riskweave.session import scratch_path, side_by_side


def usable_inputs(train: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) inputs with at least one known value in the train rows."""
    wanted = [*numeric_columns(train), *(["category"] if "category" in train.columns else [])]
    known = train.agg(*[F.count(F.col(c)).alias(c) for c in wanted]).first()
    numeric = [c for c in wanted if c != "category" and known[c]]
    return numeric, ["category"] if "category" in wanted and known["category"] else []


def preprocessor(
    numeric: Sequence[str], categorical: Sequence[str], filled_up: bool = True
) -> list:
    """Stages from canonical columns to `features`: one-hot block first (an unseen category is
    all zeros), then every number. For models that take no NaN a missing number is filled up
    with the train median (of Spark's Imputer, whose rank is right to 0.1 %), and a flag for its
    absence comes behind; the others get NaN."""
    indexed = [f"{c}_index" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    filled = [f"{c}_filled" if filled_up else f"{c}_number" for c in numeric]
    casts = ", ".join(
        f"CAST(`{c}` AS DOUBLE) AS `{c}_number`"
        + (f", CAST(`{c}` IS NULL AS DOUBLE) AS `{c}_missing`" if filled_up else "")
        for c in numeric
    )
    stages = [SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__")]
    if categorical:
        stages += [
            StringIndexer(
                inputCols=list(categorical),
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        ]
    if not filled_up:
        assembled = VectorAssembler(
            inputCols=[*hot, *filled], outputCol="features", handleInvalid="keep"
        )
        return [*stages, assembled]
    return [
        *stages,
        Imputer(
            strategy="median", inputCols=[f"{c}_number" for c in numeric], outputCols=filled
        ),
        VectorAssembler(
            inputCols=[*hot, *filled, *[f"{c}_missing" for c in numeric]], outputCol="features"
        ),
    ]


def balanced(train: DataFrame) -> DataFrame:
    """`weight` per row; the weight table has one row per class."""
    return train.join(F.broadcast(class_weights(train)), "is_fraud")


def fit(
    train: DataFrame,
    model: str = "gbt",
    seed: int = 42,
    rounds: int = 200,
    learning_rate: float = 0.1,
) -> PipelineModel:
    return fit_all(train, [(model, rounds, learning_rate)], seed)[0]


def fit_all(
    train: DataFrame, settings: Sequence[tuple[str, int, float]], seed: int = 42
) -> list[PipelineModel]:
    """A fit per (model, rounds, learning_rate) on the same rows, side by side. Rows are prepared
    and coded once for all boosted trees."""
    numeric, categorical = usable_inputs(train)
    rows = balanced(train)
    classifiers = [registry.create(name, seed, rounds, rate) for name, rounds, rate in settings]
    boosters = [c for c in classifiers if isinstance(c, Booster)]
    if boosters:
        ahead = Pipeline(stages=preprocessor(numeric, categorical, filled_up=False)).fit(rows)
        coded = boosters[0].coded(ahead.transform(rows))

    def one(classifier) -> PipelineModel:
        if isinstance(classifier, Booster):
            return PipelineModel([*ahead.stages, classifier.fitted(coded)])
        own = registry.with_unit_penalty(classifier, weight)
        fitted = Pipeline(stages=[*preprocessor(numeric, categorical), own]).fit(rows)
        return _without_summary(fitted, rows)

    weight = rows.agg(F.sum("weight")).first()[0] or 0.0
    return side_by_side(one, classifiers)


def _without_summary(model: PipelineModel, rows: DataFrame) -> PipelineModel:
    """The same model, its classifier written and read back. A fitted classifier of Spark drags
    its training summary along, and with it the session, into every task that scores; depending
    on what the session did before, that can't be serialized. A model that was read has none."""
    last = model.stages[-1]
    if not getattr(last, "hasSummary", False):
        return model
    path = scratch_path(rows.sparkSession, "classifier")
    last.write().save(path)
    return PipelineModel([*model.stages[:-1], type(last).load(path)])


def expected_inputs(model: PipelineModel) -> dict[str, str]:
    """Input names and types of a fitted pipeline, read from its stages."""
    out: dict[str, str] = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            out.update({c: "string" for c in stage.getInputCols()})
        elif isinstance(stage, VectorAssembler):
            for c in stage.getInputCols():
                for end in ("_filled", "_number"):
                    if c.endswith(end):
                        out[c.removesuffix(end)] = "double"
                        break
    return out


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds `p`, the probability of fraud. Inputs the frame lacks count as missing."""
    ready = with_absent_inputs(df, expected_inputs(model))
    scored = model.transform(ready)
    if not isinstance(model.stages[-1], TreesModel):  # which adds `p` itself
        scored = scored.withColumn("p", vector_to_array("probability")[1])
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c != "p"], "p")


def score_and_decide(model: PipelineModel, df: DataFrame, threshold: float = 0.0) -> DataFrame:
    p = F.col("p")
    return (
        score(model, df)
        .withColumn("confidence", confidence(p))
        .withColumn("decision", decide(p, threshold))
    )


def scored_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(transaction_id, timestamp, entity_id, amount, y, p), the input of most operators."""
    return score(model, df).select(
        "transaction_id", "timestamp", "entity_id", "amount", F.col("is_fraud").alias("y"), "p"
    )


def save_bundle(model: PipelineModel, reference: DataFrame, folder: str) -> None:
    """Model and drift reference side by side, so one never goes without the other."""
    model.write().overwrite().save(f"{folder}/model")
    reference.write.mode("overwrite").parquet(f"{folder}/drift_reference")


def load_bundle(spark, folder: str) -> tuple[PipelineModel, DataFrame]:
    return (
        PipelineModel.load(f"{folder}/model"),
        spark.read.parquet(f"{folder}/drift_reference"),
    )


def rescored_rows(first: PipelineModel, second: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows that two models score differently; empty after a lossless round trip."""
    a = score(first, df).select("transaction_id", "p")
    b = score(second, df).select("transaction_id", F.col("p").alias("p_second"))
    return a.join(b, "transaction_id").where(~F.col("p").eqNullSafe(F.col("p_second")))
