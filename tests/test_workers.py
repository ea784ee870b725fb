import pyarrow as pa

from mnemospark import workers
from mnemospark.llm import bpe, queries
from mnemospark.llm.common import map_batches


def test_memory_of_another_operator_goes():
    held = workers.memory("one")
    held["x"] = 1
    list(workers.tidy(iter, "one")(iter([])))
    assert held == {"x": 1}
    list(workers.tidy(iter, "other")(iter([])))
    assert held == {}


def test_workers_give_up_the_coder(spark):
    def coders(batches):
        n = len(workers.memory("bpe"))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["id"])

    path, pattern = queries.tokenizer()
    docs = spark.createDataFrame([(i, f"a text of its own {i}") for i in range(32)], "doc_id long, text string").repartition(16)
    rows = spark.range(0, 64, 1, 16)
    bpe.encode(docs, path, pattern).count()
    bpe.encode(docs, path, pattern).collect()
    assert sum(r.id for r in rows.mapInArrow(coders, "id long").collect()) > 0
    # Each worker has at least one task of something else: several times as many tasks as there are workers.
    map_batches(spark.range(0, 256, 1, 128), iter, "id long").collect()
    assert sum(r.id for r in rows.mapInArrow(coders, "id long").collect()) == 0
