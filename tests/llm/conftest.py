"""A local session for the tests of this folder."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns of names that operators use inside."""
    base = " ".join(f"word{i} the of" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("word7 ", "other "), "de", "b", 1), (4, "", "en", None, 0), (5, None, None, "a", None),
        (6, "x" * 30_000, "fr", "a", 30_000), (7, "don't  stop\n\n'tis ünï 漢字 🎈 \t end ", "en", "b", 5), (8, "a b", "en", "a", 3), (8, "a b", "en", "a", 3),
        (9, "idiot moron. " + base, "en", "c", 2), (None, "no id at all", "en", "c", 3), (10, ". . !", "en", "c", 5), (-3, "negative id " + base[:80], "es", "c", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumn("key", F.lit("k")).withColumn("id", F.lit(0)).withColumn("component", F.lit(1))
