"""Images and the records that name them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SUFFIXES = "*.{png,jpg,jpeg,gif,bmp,PNG,JPG,JPEG,GIF,BMP}"


def listed_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the image files below a folder, in order; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(path)
    return found.select("path", "length").orderBy("path")


@F.pandas_udf(BinaryType())
def rgb(image: pd.DataFrame) -> pd.Series:
    """Pixels, row by row, as red, green and blue, of a decoded image (blue first; grey, or with an alpha, which goes)."""
    out = []
    for data, channels in zip(image["data"], image["nChannels"], strict=True):
        pixels = np.frombuffer(data, np.uint8).reshape(-1, channels)
        out.append((np.repeat(pixels, 3, axis=1) if channels == 1 else pixels[:, 2::-1]).tobytes())
    return pd.Series(out, dtype=object)


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb) of the images that can be read, decoded on the JVM."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(path)
    return raw.select(F.col("image.origin").alias("path"), "image.width", "image.height", rgb(F.col("image")).alias("rgb"))


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of image files that can't be decoded."""
    plain = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    good = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(path).select(plain(F.col("image.origin")).alias("at"))
    return listed_images(spark, path).withColumn("at", plain(F.col("path"))).join(good, "at", "left_anti").select("path", "length")


def first_seen(records: DataFrame, image: str = "image", position: str = "pos", value: str = "answer", wanted: str = "true") -> DataFrame:
    """(image, first_pos, caption): each image once, with the value of its first record for which ``wanted`` holds (null: none)."""
    first = F.min(F.when(F.expr(wanted), F.struct(position, value)))
    return records.groupBy(image).agg(F.min(position).alias("first_pos"), first[value].alias("caption"))
