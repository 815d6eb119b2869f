"""Streams give what the batch jobs give, also after a restart."""

import pytest
from pyspark.sql import functions as F

from lorecairn.operators import maintain, replay, suggest
from lorecairn.sources import derived
from lorecairn.streaming import changes as change_stream, ingest as ingest_stream

NOW = "2025-01-01T00:00:00"


def write_parts(df, order, parts, path):
    """Write ``df`` as ``parts`` files, in order, one per micro-batch."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    for n in range(parts):
        part = df.sparkSession.createDataFrame(rows[n * step : (n + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_ingest_equals_batch_and_restarts(spark, folder, tmp_path):
    turns = derived.raw(spark, folder, "conversations")
    topics = derived.kb_topics(spark, folder)
    write_parts(turns, ["conv_id", "turn"], 3, tmp_path / "in")
    root, checkpoint = str(tmp_path / "kb"), str(tmp_path / "checkpoint")

    def run():
        commands = derived.ingest_commands(stream(spark, turns.schema, tmp_path / "in"))
        query = ingest_stream.ingest(commands, topics, root, checkpoint, NOW)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    expected = maintain.store_documents(derived.ingest_commands(turns), topics, NOW)
    columns = expected.documents.columns
    want = sorted(map(str, expected.documents.collect()))
    links = sorted(map(str, expected.links.select("from_id", "to_id", "strength").collect()))
    for _ in range(2):
        assert sorted(map(str, ingest_stream.stored_documents(spark, root).select(columns).collect())) == want
        got = ingest_stream.stored_links(spark, root).select("from_id", "to_id", "strength")
        assert sorted(map(str, got.collect())) == links
        run()  # nothing new, so nothing is added


@pytest.mark.parametrize("parts,compact", [(1, 20), (3, 2), (10, 3)])
def test_changes_equal_replay(spark, folder, tmp_path, parts, compact):
    events = derived.kb_changes(spark, folder)
    write_parts(events, ["ts", "event_id"], parts, tmp_path / "in")
    source = stream(spark, events.schema, tmp_path / "in")
    root, checkpoint = str(tmp_path / "kb"), str(tmp_path / "checkpoint")
    query = change_stream.apply_changes(source, root, checkpoint, compact)
    query.awaitTermination(300)
    assert query.exception() is None
    last = max(p["batchId"] for p in query.recentProgress)
    got = change_stream.current_state(spark, root, last, compact)
    want = replay.replay(events)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_live_tag_counts_equal_batch(spark, folder, tmp_path):
    docs = derived.kb_documents(spark, folder)
    write_parts(docs, ["key"], 3, tmp_path / "in")
    counts = ingest_stream.live_tag_counts(stream(spark, docs.schema, tmp_path / "in"))
    query = (
        counts.writeStream.format("memory").queryName("live_tags").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("live_tags").collect())
    assert got == sorted(tuple(r) for r in suggest.tag_counts(docs).collect())


def test_repeated_events_are_dropped(spark, folder, tmp_path):
    events = derived.kb_changes(spark, folder)
    doubled = events.unionByName(events)
    write_parts(doubled, ["ts", "event_id"], 2, tmp_path / "in")
    source = stream(spark, events.schema, tmp_path / "in")
    once = change_stream.distinct_events(source, "1 hour").groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    query = (
        change_stream.distinct_events(source, "1 hour").writeStream.format("memory").queryName("once")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("once").count() == events.count()
    assert once.isStreaming
