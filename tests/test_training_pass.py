"""Training works its features out once, however often the split, the fit and the record look at them."""

from conftest import SF
from txrisk.operators import features, training
from txrisk.options import TrainingOptions
from txrisk.sources import adapters


def test_features_are_worked_out_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    features.feature_vector(adapters.transactions(adapters.read_events(spark, SF))).write.parquet(path)
    vectors = spark.read.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    training.train(vectors.mapInArrow(counted, vectors.schema), str(tmp_path / "runs"), str(tmp_path / "models"),
                   TrainingOptions(rounds=1, depth=2, leaves=3, chunk=1))
    assert seen.value == vectors.count()
