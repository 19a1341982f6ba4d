"""Word statistics on a stream: equal to those of a batch, across restarts."""
import os

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as X
from lexigraph.operators import vocab
from lexigraph.streaming.counts import compact_word_stats, current_word_stats, stream_word_stats

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "freq", "doc_freq").collect())


def test_counts_after_batches_and_restarts(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    tokens = X.tokens_words(F.col("text"))

    def arrive(first, rows):
        spark.createDataFrame([(first + i, t) for i, t in enumerate(rows)], SCHEMA).repartition(2).write.mode("append").parquet(docs)

    def run(**more):
        q = stream_word_stats(spark, docs, out, tokens, SCHEMA, **more)
        assert q.awaitTermination(120)
        assert q.exception() is None

    def batch():
        return rows_of(vocab.word_stats(spark.read.schema(SCHEMA).parquet(docs).select("doc_id", tokens.alias("tokens"))))

    assert current_word_stats(spark, out).count() == 0
    arrive(0, ["red fish blue fish", "red red", None, ""])
    run()
    assert rows_of(current_word_stats(spark, out)) == batch()
    arrive(10, ["blue whale", "red whale " * 50])
    run(files_per_trigger=1)  # started again: goes on
    assert rows_of(current_word_stats(spark, out)) == batch()

    # cut off after a trigger wrote, before it was marked as done
    commits = os.path.join(out, "_progress", "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for n in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, n)):
            os.remove(os.path.join(commits, n))
    compact_word_stats(spark, out)
    assert len([d for d in os.listdir(os.path.join(out, "words")) if not d.startswith(".")]) == 1
    assert rows_of(current_word_stats(spark, out)) == batch()
    arrive(20, ["green fish", "red"])
    run()
    assert rows_of(current_word_stats(spark, out)) == batch()
    # a trigger writes changed words only
    changed = spark.read.parquet(f"{out}/words/trigger-*").where("word = 'whale' and freq > 51")
    assert changed.count() == 0 and ("whale", 51, 2) in batch()

    with pytest.raises(ValueError):
        stream_word_stats(spark, docs, out, tokens, SCHEMA, checkpoint=str(tmp_path / "elsewhere"))
