"""Tables in the shared folder: written once, removed on demand, by their own application only."""

import os

from passagework.sources.lineage import clean_up, cut, new_folder, shared_folder


def test_clean_up(spark):
    clean_up(spark)
    kept = cut(spark.range(5))
    other = f"{shared_folder(spark)}/passagework-of-someone-else"
    spark.range(2).write.mode("overwrite").parquet(other)
    spark.range(3).write.parquet(new_folder(spark, "passagework-index"))
    new_folder(spark)  # nothing was written there
    files = [f.removeprefix("file://") for f in kept.inputFiles()]
    assert kept.count() == 5 and all(map(os.path.exists, files))
    assert clean_up(spark) == 3 and clean_up(spark) == 0
    assert not any(map(os.path.exists, files)) and spark.read.parquet(other).count() == 2
