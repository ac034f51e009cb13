"""What stands in an executor's memory at once: batches of rows, and what a worker remembers, whatever the partitions hold."""

import sys

import pyarrow as pa
import pytest

from chronolake.llm import bpe, simhash, similar, toxicity
from chronolake.llm.common import BATCH_BYTES

RANKS = [(bytes([b]), b) for b in range(256)]
MODEL = toxicity.Model(0.0, toxicity.np.zeros(toxicity.DIMENSION))


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "n"])


@pytest.mark.parametrize(
    "operator",
    [lambda d: bpe.tokenize(d, RANKS, "."), lambda d: toxicity.score(d, MODEL), simhash.fingerprints, lambda d: similar.sketches(d, similar.Bands())],
    ids=["bpe", "toxicity", "simhash", "similar"],
)
def test_a_partition_reaches_python_in_short_batches(spark, operator):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 9000) AS text")  # 30 MB
    operator(docs)
    found = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in found) == 300
    assert max(r["bytes"] for r in found) < 2 * BATCH_BYTES


def test_pieces_that_a_worker_remembers_fit_its_memory():
    coder, size = bpe.Coder(RANKS, r"\d+"), sys.getsizeof
    for begin in range(100_000, 700_000, 60_000):
        numbers = [str(k) for k in range(begin, begin + 60_000)]
        assert coder.encode([" ".join(numbers)])[0][0] == toxicity.np.frombuffer("".join(numbers).encode(), "u1").astype("<i4").tobytes()
    assert size(coder.known) + size(coder.again) + sum(size(p) + size(ids) for p, ids in coder.known.items()) < 70e6
