"""Ingestion in micro-batches: unpublished epochs don't count, restarts go on, late rows are resolved by seq."""

from lamella import model
from lamella.operators import resolve
from lamella.streaming import ingest


def test_restart_late_rows_and_unpublished_epochs(spark, tmp_path):
    rows = [(b"k%d" % (i % 7), b"v%d" % i, False, i) for i in range(60)]
    part = lambda chosen: spark.createDataFrame(chosen, model.MUTATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(model.MUTATION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store, checkpoint = f"file://{tmp_path}/store", f"{tmp_path}/checkpoint"
    assert ingest.ingested(spark, store).count() == 0
    part(rows[30:])
    ingest.start(source(), store, checkpoint).awaitTermination()
    assert ingest.published(spark, store) == [0]
    part(rows[:30])
    part([(b"k1", None, True, 100)])
    ingest.start(source(), store, checkpoint).awaitTermination()
    assert len(ingest.published(spark, store)) == 3
    spark.createDataFrame([(b"k2", b"never published", False, 999)], model.MUTATION).write.parquet(f"{tmp_path}/store/epoch=77")
    got = {bytes(r["key"]): bytes(r["value"]) for r in resolve.visible(ingest.ingested(spark, store)).collect()}
    want = {k: v for k, v, _, _ in rows}
    want.pop(b"k1")
    assert got == want
