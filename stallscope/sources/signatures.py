"""Signature tables: JSON rows of threshold conditions."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType([T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType())])
CONDITION = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value", VALUE),
        T.StructField("description", T.StringType()),
    ]
)
TEXTS = T.ArrayType(T.StringType())
SIGNATURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
        T.StructField("indicators", TEXTS),
        T.StructField("nextSteps", TEXTS),
        T.StructField("relatedSignatures", TEXTS),
    ]
)

BUNDLED = Path(__file__).parent.parent / "data" / "signatures.json"


def bundled_signatures(spark: SparkSession) -> DataFrame:
    """The three signatures shipped with the package (read on the driver: a file inside the package)."""
    rows = [(line,) for line in BUNDLED.read_text(encoding="utf-8").splitlines() if line.strip()]
    text = spark.createDataFrame(rows, "value string")
    return text.select(F.from_json("value", SIGNATURE).alias("s")).select("s.*")


def read_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """All signatures of a folder; a folder that does not exist holds none."""
    try:
        return spark.read.schema(SIGNATURE).json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SIGNATURE)


def overlay(bundled: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom rows replace bundled rows of the same id."""
    return bundled.join(custom.select("id"), "id", "left_anti").select(*bundled.columns).unionByName(custom)


def append_signatures(signatures: DataFrame, folder: str) -> None:
    signatures.write.mode("append").json(folder)
