"""Products -> image path and two vectors -> replaceable table and its indexes.

spark-submit jobs/product_catalog.py --products s3a://lake/products --bucket lake --index-path s3a://lake/index/products
"""

import argparse

from docketry import schemas
from docketry.plans import product_catalog as catalog
from docketry.session import build_session


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--products", required=True, help="parquet with the product schema")
    options.add_argument("--bucket", required=True, help="bucket that holds the images")
    options.add_argument("--namespace", default=catalog.NAMESPACE)
    options.add_argument("--table", default=catalog.TABLE)
    options.add_argument("--index-path", help="where to write the indexes; none without it")
    args = options.parse_args()

    spark = build_session("product-catalog")
    products = spark.read.schema(schemas.PRODUCT).parquet(args.products)
    name = catalog.store_product_catalog(products, args.bucket, args.namespace, args.table)
    if args.index_path:
        catalog.index_product_catalog(spark.table(name), args.index_path)
    spark.table(name).select("id", "name", "category", "price", "image_uri").show(5, truncate=60)
    spark.stop()


if __name__ == "__main__":
    main()
