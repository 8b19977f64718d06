import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.plans.fixtures import f2_prompts
from tessera.plans.sequences import q_sequence_scores
from tessera.sources import io
from tessera.streaming.scores import read_logprobs_stream, sequence_scores


def test_stream_scores_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-")
    io.write_logprobs(f2_prompts(spark, SF_SMALL), os.path.join(src, "part1"))
    stream = sequence_scores(read_logprobs_stream(spark, os.path.join(src, "part1")))
    q = stream.writeStream.format("memory").queryName("tessera_scores").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["eval_id"]: round(r["ppl"], 6) for r in spark.sql("select * from tessera_scores").collect()}
    want = {r["eval_id"]: r["ppl"] for r in q_sequence_scores(spark, SF_SMALL).collect()}
    assert got == want and len(got) > 0
