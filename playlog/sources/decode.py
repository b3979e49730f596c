"""Text files of unknown encoding: strict UTF-8, else the Western Windows set, else Latin-1, decided for each file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: In this order; the last reads any bytes.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def decoded(data: bytes) -> tuple[str, str]:
    for encoding in ENCODINGS[:-1]:
        try:
            return data.decode(encoding), encoding
        except UnicodeDecodeError:
            pass
    return data.decode(ENCODINGS[-1]), ENCODINGS[-1]


@F.pandas_udf(StructType().add("text", StringType()).add("encoding", StringType()))
def decode(contents: pd.Series) -> pd.DataFrame:
    """(text, encoding) of bytes; a null has neither."""
    return pd.DataFrame([(None, None) if c is None else decoded(bytes(c)) for c in contents], columns=["text", "encoding"])


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text, encoding) of the files of a folder, one task a file at most. A file without a byte has no row."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.col("path").alias("file"), decode("content").alias("d")).select("file", "d.text", "d.encoding")
