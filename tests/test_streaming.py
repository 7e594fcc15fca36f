"""A stream of candidate files gives the rows of the batch job."""

from lumenpeak.plans import jobs
from lumenpeak.plans.params import JobParams
from lumenpeak.operators import forest as E
from lumenpeak.streaming.scoring import classified_so_far, classify_stream
from tests.test_forest import table


def test_stream_equals_batch(spark, tmp_path):
    df = table(spark, 300)
    model = jobs.Model(E.train(df, ["A", "B"], num_trees=4, max_depth=3),
                       JobParams(num_trees=4, max_depth=3))
    source = str(tmp_path / "in")
    df.repartition(3, "SPECID").write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = classify_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    want = jobs.classify(df, model)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_object_split_over_batches(spark, tmp_path):
    """One best candidate per object, however its candidates are spread over files."""
    df = table(spark, 200)
    model = jobs.Model(E.train(df, ["A", "B"], num_trees=3, max_depth=3),
                       JobParams(num_trees=3, max_depth=3))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3, "peak_pix").write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    classify_stream(stream, model, out, str(tmp_path / "ckpt")).awaitTermination(120)
    want = jobs.classify(df, model)
    got = classified_so_far(spark, out, model).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
