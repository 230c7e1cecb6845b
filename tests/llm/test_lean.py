"""A Python worker keeps nothing of a stage that another stage's tasks don't use."""

from pyspark.sql import functions as F

from policyspark.llm import packing, queries, simhash


def held(batches):
    import pyarrow as pa

    from policyspark.llm import memo

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(memo._workers)] * batch.num_rows, pa.int64())], ["n"])


def test_other_stages_clear_the_encoder(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"))
    most = lambda df: df.mapInArrow(held, "n long").agg(F.max("n")).first()[0]
    for _ in range(3):  # workers are idle in between, and are taken again
        packed.count()
    before = most(docs)
    for _ in range(6):
        simhash.fingerprints(docs).count()
    assert most(docs) == 0, before


def test_common_names_are_taken_from_the_module():
    """The caches that a task clears are those of its worker, not a copy that came with the task."""
    from pyspark import cloudpickle

    from policyspark.llm import common

    common.cache_of_worker("other")["x"] = 1
    run = cloudpickle.loads(cloudpickle.dumps(common.lean(lambda batches: batches, "own")))
    common.cache_of_worker("own")["y"] = 2
    assert list(run(iter([3]))) == [3]
    assert common.CACHES["other"] == {} and common.CACHES.pop("own") == {"y": 2}


def test_contraction_broadcasts_nothing(spark):
    """No round's tables go through the driver, and roots are as they were."""
    from policyspark.llm.common import contract

    plans = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = plans().size()
    edges = [(i + 1, i) for i in range(0, 40)] + [(i, 100) for i in range(101, 140)] + [(7, 7), (300, 200)]
    got = {(r["u"], r["v"]) for r in contract(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)} | {(300, 200)}
    own = [plans().apply(i).physicalPlanDescription() for i in range(before, plans().size())]
    assert any("SortMergeJoin" in p for p in own) and not any("BroadcastExchange" in p for p in own)
