"""Push envelopes: `{"message": {"data": base64(JSON)}}`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

CORRUPT = "_corrupt"


def encode_envelopes(rows: DataFrame, payload: str, out: str = "envelope") -> DataFrame:
    """Wrap the JSON column `payload` the way the delivery service does."""
    data = F.base64(F.encode(F.col(payload), "UTF-8"))
    return rows.withColumn(out, F.to_json(F.struct(F.struct(data.alias("data")).alias("message"))))


def decode_envelopes(rows: DataFrame, schema: T.StructType, envelope: str = "envelope") -> DataFrame:
    """Add `payload` (struct, or null) and `reason` (why not, null when good).

    Bad rows stay in the result: one bad message must neither stop the job nor
    vanish. Every field of `schema` is required; further keys are ignored.
    """
    data = F.get_json_object(envelope, "$.message.data")
    raw = F.try_validate_utf8(F.try_to_binary("_data", F.lit("base64")).cast("string"))
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("_raw", with_corrupt, {"columnNameOfCorruptRecord": CORRUPT})
    complete = F.lit(True)
    for field in schema.fieldNames():
        complete = complete & F.col("_parsed")[field].isNotNull()
    reason = (
        F.when(F.col("_data").isNull(), "no data")
        .when(F.col("_raw").isNull(), "bad encoding")
        .when(F.col("_parsed").isNull() | F.col("_parsed")[CORRUPT].isNotNull(), "bad json")
        .when(~complete, "missing key")
    )
    fields = F.struct(*[F.col("_parsed")[name].alias(name) for name in schema.fieldNames()])
    return (
        rows.withColumn("_data", data)
        .withColumn("_raw", raw)
        .withColumn("_parsed", parsed)
        .withColumn("reason", reason)
        .withColumn("payload", F.when(F.col("reason").isNull(), fields))
        .drop("_data", "_raw", "_parsed")
    )


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows."""
    return decoded.filter(F.col("reason").isNull()).drop("reason"), decoded.filter(
        F.col("reason").isNotNull()
    ).drop("payload")
