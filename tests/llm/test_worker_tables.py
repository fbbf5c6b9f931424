"""What a Python worker keeps from one operator's task to another's."""

import numpy as np

from corpusmill.llm import bpe, common, toxicity
from corpusmill.llm.pieces import tokenizer_path


def test_a_worker_keeps_the_tables_of_one_operator(spark):
    first = bpe.codec(tokenizer_path())
    assert bpe.codec(tokenizer_path()) is first
    models = toxicity.Models(*(np.zeros((2, 1 << toxicity.TABLE_BITS), np.float32) for _ in range(3)))

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            bpe.codec(tokenizer_path())
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(k.startswith("bpe") for k in common._kept)], pa.int64())})

    def left(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(k.startswith("bpe") for k in common._kept)], pa.int64())})

    one = spark.range(1).coalesce(1)
    assert one.mapInArrow(held, "n bigint").first()["n"] == 1
    toxicity.ratios(one.selectExpr("id AS doc_id", "'some text' AS text"), models).collect()
    assert one.mapInArrow(left, "n bigint").first()["n"] == 0
