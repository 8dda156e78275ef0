"""What near copies and passages move between tasks, and how many pieces of rows a task hands over."""

import numpy as np
import pyarrow as pa

from txrisk.llm import near, substrings
from txrisk.llm import text as T


def written(spark, work) -> int:
    """Shuffle bytes that the stages of `work` write."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {(s := stages.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(stages.size())}

    before = total()
    work()
    return sum(n for k, n in total().items() if k not in before)


def test_signatures_meet_once(spark):
    """Keys of single texts and signatures are not shuffled over and over: a bound on the bytes of each text."""
    rng, rows = np.random.default_rng(6), 4000
    texts = spark.createDataFrame([(k, " ".join(map(str, rng.integers(0, 1 << 30, 30)))) for k in range(rows)], "id long, text string")
    name, usual = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")  # as with larger tables
    try:
        moved = written(spark, lambda: near.near_classes(texts, substrings.PARAGRAPHS).count())
    finally:
        spark.conf.set(name, usual)
    assert moved / rows < 650


def test_keys_are_those_of_single_rows():
    """Rows of several runs of a slice come as one batch, each with the keys it has alone."""
    how, rng = substrings.PARAGRAPHS, np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, int(n)))) for n in (30, 0, 4000, 3, 9000, 30)] + [None]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    [whole] = near._signatures(how)(iter([batch]))
    alone = [next(near._signatures(how)(iter([batch.slice(k, 1)]))) for k in range(len(texts))]
    assert whole.to_pylist() == [a.to_pylist()[0] for a in alone]
    assert whole.column("n").to_pylist() == [26, 0, 3996, 1, 8996, 26, 0]


def test_stretches_of_several_texts_leave_together(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(120)) for k in range(40)]
    packed = next(substrings._pack(iter([pa.record_batch([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])])))
    asked = pa.array([[{"place": 3, "n": 20}]] * 40, pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int32())])))
    gone = pa.array([None] * 39 + [[0]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([*packed.columns, asked, gone], names=[*packed.schema.names, "open", "gone"])
    found = list(substrings._compare(iter([batch])))
    assert len(found) == 1 and found[0].num_rows == 39 * 20
    monkeypatch.setattr(substrings, "WAITING", 1)
    single = list(substrings._compare(iter([batch])))
    assert len(single) == 40 and pa.Table.from_batches(single).to_pylist() == found[0].to_pylist()


def test_anchors_of_several_runs(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(120)) for k in range(40)] + ["short"]
    batch = pa.record_batch([pa.array(range(41), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    [whole] = substrings._find_anchors(iter([batch]))
    monkeypatch.setattr(T, "runs", lambda column, runs=T.runs: runs(column, 1000))
    [cut] = substrings._find_anchors(iter([batch]))
    assert whole.to_pylist() == cut.to_pylist() and set(whole.column("doc_id").to_pylist()) == set(range(40))
