"""Ids, splits and the recommender."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.operators.skew import parts_for

# Number of hash buckets in which distinct texts are numbered; also the rows of the offset table.
ID_BUCKETS = 1024
# Fewest blocks that users and items are split into.
ALS_BLOCKS = 10
# Ratings of a block, some 250 MB of them: factors are sent to every block that needs them, so blocks are few.
BLOCK_ROWS = 20_000_000


def dense_ids(df: DataFrame, col: str, name: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """(col, name): the distinct texts numbered 0..n-1 without gaps or collisions.

    Texts are numbered inside hash buckets and shifted by the size of the buckets before, so
    no task sees all of them. The ids depend on the data alone. ``buckets`` is a power of two;
    the offset table has at most that many rows and is broadcast.
    """
    keys = df.select(col).where(F.col(col).isNotNull()).distinct()
    keys = keys.withColumn("_bucket", F.xxhash64(col).bitwiseAND(F.lit(buckets - 1)))
    sizes = keys.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # The only unpartitioned window: over at most `buckets` rows.
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(col))
    numbered = keys.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    return numbered.select(col, (F.col("_offset") + F.col("_place") - 1).alias(name))


def with_dense_id(df: DataFrame, col: str, name: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """Adds the dense id of ``col``; rows where it is NULL get NULL."""
    return df.join(dense_ids(df, col, name, buckets), col, "left")


def random_split(df: DataFrame, weights: tuple[float, ...] = K.SPLIT_WEIGHTS, seed: int | None = None) -> list[DataFrame]:
    """A random split; on rows whose order may change between runs use ``hash_split``."""
    return df.randomSplit(list(weights), seed)


def hash_split(
    df: DataFrame, keys: list[str], train_share: float = K.SPLIT_WEIGHTS[0], parts: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """A split by the hash of the keys: the same row is always on the same side."""
    place = F.pmod(F.xxhash64(*keys), F.lit(parts))
    limit = round(train_share * parts)
    return df.where(place < limit), df.where(place >= limit)


def fit_als(
    train: DataFrame,
    user: str,
    item: str,
    rating: str,
    max_iter: int = K.ALS_MAX_ITER,
    reg_param: float = K.ALS_REG_PARAM,
    seed: int = 0,
    blocks: int | None = None,
) -> ALSModel:
    """Latent factors from explicit ratings; users and items unseen in training score nothing.

    Ids must be whole numbers in the int range. Rows with a NULL id or rating are left out. ``blocks`` defaults to a number sized by the
    ratings. Give it ratings that are stored: it reads them several times.
    """
    train = train.dropna(subset=[user, item, rating])
    blocks = blocks or parts_for(train, ALS_BLOCKS, BLOCK_ROWS)
    als = ALS(
        maxIter=max_iter,
        regParam=reg_param,
        userCol=user,
        itemCol=item,
        ratingCol=rating,
        coldStartStrategy="drop",
        seed=seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
    )
    return als.fit(train)


def predicted(model: ALSModel, test: DataFrame, rating: str) -> DataFrame:
    """The held-out ratings that can be scored, with ``prediction``: no NULL in them, user and item known."""
    return model.transform(test.dropna(subset=[model.getUserCol(), model.getItemCol(), rating]))


def rmse(model: ALSModel, test: DataFrame, rating: str) -> float:
    """Root mean square error of the predictions for held-out ratings."""
    return rmse_of(predicted(model, test, rating), rating)


def rmse_of(scored: DataFrame, rating: str, prediction: str = "prediction") -> float:
    """Root mean square error of predictions at hand, such as stored ones; NaN when there are none."""
    known = scored.dropna(subset=[rating, prediction])
    return RegressionEvaluator(metricName="rmse", labelCol=rating, predictionCol=prediction).evaluate(known)
