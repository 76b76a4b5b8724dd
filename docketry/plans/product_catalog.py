"""Products with an image path, a text vector and an image-description vector."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry import schemas
from docketry.operators.embedding import IMAGE_SEED, IMAGE_WIDTH, TEXT_WIDTH, embed_hashed
from docketry.operators.vectors import require_width
from docketry.plans.indexes import TableIndexes, build_indexes
from docketry.sinks.catalog import replace_table

# Where images are kept.
IMAGE_FOLDER = "images"
IMAGE_SUFFIX = ".jpg"

NAMESPACE = "bronze"
TABLE = "product_catalog"


def products_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Literal rows under the declared product schema; no rows give an empty table."""
    return spark.createDataFrame(list(rows), schemas.PRODUCT)


def with_image_uri(products: DataFrame, bucket: str) -> DataFrame:
    """`gs://{bucket}/images/{id}.jpg`; a null id leaves its place empty."""
    return products.withColumn(
        "image_uri",
        F.concat_ws(
            "", F.lit(f"gs://{bucket}/{IMAGE_FOLDER}/"), F.col("id").cast("string"), F.lit(IMAGE_SUFFIX)
        ),
    )


def product_catalog(products: DataFrame, bucket: str) -> DataFrame:
    embedded = (
        with_image_uri(products, bucket)
        .withColumn("text_embedding", embed_hashed(F.col("description"), TEXT_WIDTH))
        .withColumn("image_embedding", embed_hashed(F.col("image_desc"), IMAGE_WIDTH, IMAGE_SEED))
        .drop("image_desc")
    )
    return require_width(embedded, text_embedding=TEXT_WIDTH, image_embedding=IMAGE_WIDTH)


def store_product_catalog(products: DataFrame, bucket: str, namespace: str = NAMESPACE, table: str = TABLE) -> str:
    return replace_table(product_catalog(products, bucket), namespace, table)


def index_product_catalog(stored: DataFrame, path: str, **options) -> TableIndexes:
    """Vector indexes of both embeddings."""
    widths = {"text_embedding": TEXT_WIDTH, "image_embedding": IMAGE_WIDTH}
    return build_indexes(stored, "id", path, widths, **options)
