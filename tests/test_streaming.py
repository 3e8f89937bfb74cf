from test_cleaning import CASES, SEGMENT

from speechjobs.operators.clean import classify
from speechjobs.streaming import classify_stream


def test_stream_equals_batch(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(2):
        rows = [(*s[:1], i, *s[2:]) for i, (s, _) in enumerate(CASES) if i % 2 == part]
        df = spark.createDataFrame(rows, SEGMENT)
        df.coalesce(1).write.mode("append").parquet(source)
        classify_stream(spark, source, df.schema, target, checkpoint).awaitTermination(120)
    batch = classify(spark.read.parquet(source))
    assert sorted(map(str, spark.read.parquet(target).select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
