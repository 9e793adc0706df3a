"""Stateless projections work on a stream."""

from endsight.operators.sites import candidate_sites


def test_sites_on_stream(spark, tmp_path):
    schema = "transcript_id string, chrom string, strand string, start bigint, end bigint"
    spark.createDataFrame([("a", "chr1", "+", 1, 9)], schema).write.parquet(str(tmp_path / "in"))
    stream = candidate_sites(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sites").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("sites").count() == 2
