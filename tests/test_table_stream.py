import pytest
from pyspark.sql import functions as F

from stepwell.workload import bindings as B


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_is_one_file_or_a_folder(spark, folder, parts):
    rows = spark.range(30).withColumn("part", F.col("id") % 3)
    if parts == 3:
        rows.repartition(3).write.parquet(f"{folder}/events.parquet")
    else:
        rows.toPandas().to_parquet(f"{folder}/events.parquet")
    stream = B.table_stream(spark, folder, "events").writeStream.format("parquet").option("path", f"{folder}/out")
    stream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 30
