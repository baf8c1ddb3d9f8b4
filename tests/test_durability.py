"""What a lineage cut leaves behind."""

import glob
import time

from pyspark.sql import functions as F

from noticeframe import durability
from noticeframe.llm.components import connected_components


def test_no_shuffle_file_outlives_a_durable_table(spark):
    """They went only when the driver happened to collect its garbage, so disk grew with the number of steps."""
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))

    def left():
        """Files since ``before``, once Spark has had the time to remove them."""
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.1)
        return files() - before

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before, setting = files(), spark.conf.get(durability.SHUFFLE_CLEANUP)
    cut = durability.durable(df)
    assert not left()
    assert cut.count() == df.count() == 7 and spark.conf.get(durability.SHUFFLE_CLEANUP) == setting
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("a % 20 <> 0")
    before = files()
    found = connected_components(links)
    assert not left()
    assert sorted({r.component for r in found.collect()}) == list(range(1, 201, 20))
