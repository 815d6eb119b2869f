"""Maintenance jobs, replay and stored records."""

import random

import pytest
from pyspark.sql import functions as F

from lorecairn import schemas
from lorecairn.operators import maintain, replay
from lorecairn.sources import derived, records, tables

NOW = "2025-01-01T00:00:00"


def outcome(change):
    return sorted(tuple(r) for r in change.outcomes.collect())


def by_key(df):
    return {r["key"]: r for r in df.collect()}


def test_store_defaults_and_topic_check(spark):
    commands = spark.createDataFrame(
        [
            ("k1", "T", "C", " a,,b ", None, "t1", None),
            ("k2", "T", "C", None, "S", "nope", "me"),
            (None, "T", "C", "", "S", "", None),
        ],
        "key string, title string, content string, tags_csv string, summary string, topic_key string, creator string",
    )
    topics = spark.createDataFrame([("t1", "One", "d", None, None)], schemas.TOPICS)
    change = maintain.store_documents(commands, topics, NOW)
    stored = by_key(change.documents)
    assert len(stored) == 3 and stored["k1"]["tags"] == ["a", "b"]
    assert stored["k1"]["metadata"].asDict() == {
        "source": "mcp_conversation", "creator": "system", "created": NOW, "updated": NOW, "version": 1,
    }
    assert stored["k2"]["metadata"]["creator"] == "me"
    assert all(len(d["embedding"]) == 384 for d in stored.values())
    assert sorted(s for _, s in outcome(change)) == ["stored", "stored_and_linked", "stored_topic_not_found"]
    link = change.links.collect()
    assert [(r["from_id"], r["to_id"], r["type"], r["strength"], r["bidirectional"]) for r in link] == [
        ("documents/k1", "topics/t1", "belongs_to", 0.9, False)
    ]
    # Keys assigned from the content are the same in the documents and the outcomes.
    assert set(stored) == {k for k, _ in outcome(change)}


def test_update_rules(spark, docs):
    commands = spark.createDataFrame(
        [
            ("a", "", None, None, "new, Go", "x"),
            ("e", "Title", "Body", "", None, None),
            ("zz", "T", None, None, None, None),
        ],
        "key string, title string, content string, summary string, add_tags string, remove_tags string",
    )
    change = maintain.update_documents(docs, commands, NOW)
    after = by_key(change.documents)
    assert len(after) == 6
    assert after["a"]["title"] == "Running Things" and after["a"]["tags"] == ["Go", "new"]
    assert after["a"]["metadata"]["version"] == 2 and after["a"]["metadata"]["updated"] == NOW
    assert after["e"]["summary"] == "" and after["e"]["content"] == "Body"
    assert len(after["e"]["embedding"]) == 384
    assert after["b"]["metadata"]["version"] == 1 and after["b"]["embedding"] == [0.0, 0.0]
    assert outcome(change) == [("a", "updated"), ("e", "updated"), ("zz", "not_found")]


def test_several_updates_of_one_key_equal_one_after_the_other(spark, docs):
    rng = random.Random(3)
    names = ["x", "y", "Go", "n1", "n2"]
    one = docs.where("key = 'a'").first()
    commands, tags = [], list(one["tags"])
    for seq in range(30):
        add = [rng.choice(names) for _ in range(rng.randint(0, 3))]
        remove = [rng.choice(names) for _ in range(rng.randint(0, 2))]
        commands.append(("a", seq, f"t{seq}" if seq % 4 == 0 else "", None, None, ",".join(add), ",".join(remove)))
        for t in add:
            if t not in tags:
                tags.append(t)
        tags = [t for t in tags if t not in remove]
    table = spark.createDataFrame(
        commands, "key string, seq int, title string, content string, summary string, add_tags string, remove_tags string"
    ).repartition(4)
    after = by_key(maintain.update_documents(docs, table, NOW).documents)["a"]
    assert after["tags"] == tags
    assert after["title"] == "t28" and after["metadata"]["version"] == 31


@pytest.fixture(scope="module")
def links(spark):
    rows = [("documents/a", "documents/b"), ("documents/c", "documents/a"), ("documents/c", "topics/t1"), ("documents/gone", "topics/t2"), ("topics/t2", "topics/t1")]
    return spark.createDataFrame([(f, t, "k", 0.5, False, None) for f, t in rows], schemas.RELATIONSHIPS)


def test_delete_documents_cascades(spark, docs, links):
    keys = spark.createDataFrame([("a",), ("zz",), ("gone",)], "key string")
    change = maintain.delete_documents(docs, links, keys)
    assert set(by_key(change.documents)) == set("bcdef")
    # Links of an unknown document stay: nothing was deleted.
    assert sorted(r["to_id"] for r in change.links.collect()) == ["topics/t1", "topics/t1", "topics/t2"]
    assert outcome(change) == [("a", "deleted"), ("gone", "not_found"), ("zz", "not_found")]


@pytest.fixture(scope="module")
def topics(spark):
    rows = [("t1", "One", "d1", None), ("t2", "Two", "d2", "t1"), ("t3", "Three", "d3", "t2")]
    return spark.createDataFrame([(*r, None) for r in rows], schemas.TOPICS)


def test_topic_changes(spark, docs, links, topics):
    keys = spark.createDataFrame([("t1",), ("t2",), ("t9",)], "key string")
    change = maintain.delete_topics(docs, links, topics, keys)
    assert outcome(change) == [("t1", "has_documents"), ("t2", "deleted"), ("t9", "not_found")]
    assert by_key(change.topics)["t3"]["parent_topic"] == "t2"  # dangling, so a root from now on
    assert sorted((r["from_id"], r["to_id"]) for r in change.links.collect()) == [
        ("documents/a", "documents/b"), ("documents/c", "documents/a"), ("documents/c", "topics/t1"),
    ]
    commands = spark.createDataFrame(
        [("t2", "", "new", ""), ("t3", "Third", None, None), ("t1", "X", None, "nope"), ("t8", "X", None, None)],
        "key string, name string, description string, parent_topic string",
    )
    change = maintain.update_topics(topics, commands)
    after = by_key(change.topics)
    assert tuple(after["t2"])[:4] == ("t2", "Two", "new", None)
    assert tuple(after["t3"])[:4] == ("t3", "Third", "d3", "t2")
    assert tuple(after["t1"])[:4] == ("t1", "One", "d1", None)
    assert outcome(change) == [("t1", "parent_not_found"), ("t2", "updated"), ("t3", "updated"), ("t8", "not_found")]
    commands = spark.createDataFrame(
        [("n1", "N", "d", "t1"), ("n2", "N", "d", "nope"), ("n3", "N", "d", "")],
        "key string, name string, description string, parent_topic string",
    )
    change = maintain.create_topics(topics, commands, NOW)
    assert {k: r["parent_topic"] for k, r in by_key(change.topics).items()} == {"n1": "t1", "n3": None}
    assert by_key(change.topics)["n1"]["metadata"]["importance"] == "3"


def test_link_documents_defaults(spark, docs):
    commands = spark.createDataFrame(
        [("a", "b", None, None), ("a", "zz", "k", True), ("zz", "a", "k", False), ("c", "d", "cites", False)],
        "from_key string, to_key string, type string, bidirectional boolean",
    )
    change = maintain.link_documents(docs, commands, NOW)
    got = sorted((r["from_id"], r["type"], r["strength"], r["bidirectional"]) for r in change.links.collect())
    assert got == [("documents/a", "related", 0.5, True), ("documents/c", "cites", 0.5, False)]
    assert sorted(r["status"] for r in change.outcomes.collect()) == ["from_not_found", "linked", "linked", "to_not_found"]


def test_refresh_embeddings(spark, docs):
    keys = spark.createDataFrame([("d",), ("zz",)], "key string")
    change = maintain.refresh_embeddings(docs, keys)
    after = by_key(change.documents)
    assert len(after) == 6 and len(after["d"]["embedding"]) == 384 and after["b"]["embedding"] == [0.0, 0.0]
    dry = maintain.refresh_embeddings(docs, keys, dry_run=True)
    assert by_key(dry.documents)["d"]["embedding"] is None
    assert outcome(dry) == [("d", "would_update"), ("zz", "not_found")]
    counts = {r["status"]: r["commands"] for r in maintain.outcome_counts(maintain.refresh_embeddings(docs)).collect()}
    assert counts == {"updated": 6}


# --- replay --------------------------------------------------------------------


def brute_replay(rows):
    state = {}
    for key, ts, event, op, title, tag in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(key, {"live": False, "version": 0, "title": None, "tags": [], "applied": 0, "rejected": 0, "not_found": 0})
        if op == "insert" and s["live"]:
            s["rejected"] += 1
        elif op != "insert" and not s["live"]:
            s["not_found"] += 1
        else:
            s["applied"] += 1
            if op == "insert":
                s.update(live=True, version=1, title=title, tags=[])
            elif op == "delete":
                s["live"] = False
            else:
                s["version"] += 1
                if op == "set_title":
                    s["title"] = title
                elif op == "add_tag" and tag not in s["tags"]:
                    s["tags"].append(tag)
                elif op == "remove_tag":
                    s["tags"] = [t for t in s["tags"] if t != tag]
    return state


def check_state(result, expected):
    got = {r["key"]: r.asDict() for r in result.collect()}
    assert set(got) == set(expected)
    for key, want in expected.items():
        assert {k: got[key][k] for k in want} == want, key


def test_replay_equals_one_command_after_the_other(spark, folder):
    changes = derived.kb_changes(spark, folder)
    expected = brute_replay([tuple(r) for r in changes.collect()])
    for chunk in ("hour", "month"):
        check_state(replay.replay(changes, chunk=chunk), expected)


def test_replay_of_one_hot_key_at_one_moment(spark, folder):
    changes = derived.kb_changes(spark, folder).withColumn("key", F.lit("hot"))
    check_state(replay.replay(changes), brute_replay([tuple(r) for r in changes.collect()]))


def test_one_key_in_one_second_spreads_over_all_tasks(spark, folder):
    changes = derived.kb_changes(spark, folder)
    rows = [("hot", changes.first()["ts"], i, op, f"t{i}", f"g{i % 9}") for i, op in enumerate(["insert", "add_tag", "remove_tag", "set_title", "delete"] * 1600)]
    hot = spark.createDataFrame(rows, changes.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        judged = replay.judge(hot)
        sizes = [r["count"] for r in judged.groupBy("range").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * len(rows) / 8
        check_state(replay.replay(hot), brute_replay(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_removed_tags_make_no_long_list(spark, folder):
    schema = derived.kb_changes(spark, folder).schema
    moment = derived.kb_changes(spark, folder).first()["ts"]
    rows = [("k", moment, 0, "insert", "t", None), ("k", moment, 1, "add_tag", None, "kept")]
    rows += [("k", moment, 2 + i, "remove_tag", None, f"x{i}") for i in range(300)]
    state = replay.replay(spark.createDataFrame(rows, schema))
    check_state(state, brute_replay(rows))
    operations = [("k", f"x{i}", False, i) for i in range(300)] + [("k", "kept", False, 500), ("k", "new", True, 501)]
    folded = replay.fold_tag_operations(
        spark.createDataFrame(operations, "key string, tag string, adds boolean, at int"),
        state.select("key", F.explode("tags").alias("tag")),
    ).collect()
    assert [(r["removed"], r["added"]) for r in folded] == [(["kept"], ["new"])]


@pytest.mark.parametrize("parts", [2, 5])
def test_replay_continues_from_a_state(spark, folder, parts):
    changes = derived.kb_changes(spark, folder)
    rows = sorted((tuple(r) for r in changes.collect()), key=lambda r: (r[1], r[2]))
    state = spark.createDataFrame([], replay.STATE)
    step = len(rows) // parts + 1
    for start in range(0, len(rows), step):
        batch = spark.createDataFrame(rows[start : start + step], changes.schema)
        fresh = replay.replay(batch, state)
        state = spark.createDataFrame(tables.merge_rows(state, fresh).collect(), replay.STATE)
    check_state(state, brute_replay(rows))


def test_late_commands_are_counted_and_ignored(spark, folder):
    changes = derived.kb_changes(spark, folder)
    state = replay.replay(changes)
    again = {r["key"]: r for r in replay.replay(changes, state).collect()}
    for before in state.collect():
        after = again[before["key"]]
        assert after["late"] == before["applied"] + before["rejected"] + before["not_found"]
        for name in ("live", "version", "title", "tags", "applied", "last_event"):
            assert after[name] == before[name]


# --- records and tables ----------------------------------------------------------


def test_records_round_trip(docs, links, topics):
    for table, encode, decode in (
        (docs, records.encode_documents, records.decode_documents),
        (links, records.encode_links, records.decode_links),
        (topics, records.encode_topics, records.decode_topics),
    ):
        back = records.accepted(decode(encode(table)))
        assert sorted(map(str, back.select(*table.columns).collect())) == sorted(map(str, table.collect()))


def test_bad_records_are_named(spark):
    good = '{"_key":"k","_id":"documents/k","_rev":"1","title":"t","content":"c","tags":[],"metadata":{"source":"s","creator":"me"}}'
    lines = [
        good,
        good.replace('"_rev"', '"odd"'),
        good.replace('"creator"', '"odd"'),
        good.replace('"title":"t",', ""),
        "{broken",
        "[1]",
    ]
    decoded = records.decode_documents(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = decoded.collect()
    assert [r["problem"] for r in rows] == [None, "unknown_field", "unknown_field", "missing_field", "malformed", "malformed"]
    first = records.accepted(decoded).first()
    assert first["key"] == "k" and first["confidence"] == 0.9 and first["status"] == "active"
    assert first["metadata"]["version"] == 1
    assert records.rejected(decoded).count() == 5


def test_tables_append_snapshot_and_lines(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    tables.append(docs, path, schemas.DOCUMENTS)
    tables.append(docs.limit(1), path, schemas.DOCUMENTS)
    assert tables.read_documents(spark, path).count() == 7
    new = docs.where("key = 'a'").withColumn("title", F.lit("new"))
    merged = tables.merge_rows(docs, new)
    tables.write_snapshot(merged, str(tmp_path / "next"), schemas.DOCUMENTS)
    after = by_key(tables.read_documents(spark, str(tmp_path / "next")))
    assert len(after) == 6 and after["a"]["title"] == "new"
    with pytest.raises(Exception):
        tables.write_snapshot(merged, str(tmp_path / "next"), schemas.DOCUMENTS)
    tables.write_lines(records.encode_documents(docs), str(tmp_path / "lines"))
    back = records.decode_documents(tables.read_lines(spark, str(tmp_path / "lines")))
    assert records.accepted(back).count() == 6


def test_keys_are_guarded_and_copies_numbered(spark, docs):
    kind = "key string, title string, content string, tags_csv string, summary string, creator string, topic_key string"
    rows = [(None, "t", "same", "", None, None, None)] * 3 + [("a", "x", "y", "", None, None, None), ("new", "x", "y", "", None, None, None)]
    topics = spark.createDataFrame([("r", "r", None, None, None)], "key string, name string, description string, parent_topic string, metadata map<string,string>")
    change = maintain.store_documents(spark.createDataFrame(rows, kind), topics, NOW, docs)
    stored = [r["key"] for r in change.documents.collect()]
    assert len(stored) == len(set(stored)) == 4 and "new" in stored and "a" not in stored
    assert {r["status"] for r in change.outcomes.where("key = 'a'").collect()} == {"key_exists"}


def test_topics_may_follow_parents_of_the_same_table(spark):
    kind = "key string, name string, description string, parent_topic string"
    topics = spark.createDataFrame([("r", "r", None, None)], kind)
    rows = [("c", "c", "", "b"), ("b", "b", "", "a"), ("a", "a", "", "r"), ("r", "again", "", ""), ("x", "x", "", "y"), ("y", "y", "", "x"), ("z", "z", "", "zz")]
    change = maintain.create_topics(topics, spark.createDataFrame(rows, kind), NOW)
    found = {r["key"]: r["status"] for r in change.outcomes.collect()}
    assert found == {"a": "created", "b": "created", "c": "created", "r": "key_exists", "x": "parent_not_found", "y": "parent_not_found", "z": "parent_not_found"}
    assert {r["key"] for r in change.topics.collect()} == {"a", "b", "c"}


def test_update_query_embeds_anew(spark, folder):
    from lorecairn.functions.vectors import character_vector
    from lorecairn.plans import changes
    from lorecairn.sources import derived

    plan = changes.update_documents(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    commands = changes._update_commands(spark, folder)
    change = maintain.update_documents(derived.kb_documents(spark, folder), commands, changes.NOW)
    fresh = change.documents.where(F.col("metadata.updated") == changes.NOW).collect()
    assert len(fresh) == commands.join(derived.kb_documents(spark, folder), "key", "left_semi").select("key").distinct().count() > 0
    for row in fresh:
        body = f"{row['title']} {row['summary'] or ''} {row['content']}"
        assert max(abs(x - y) for x, y in zip(row["embedding"], character_vector(body), strict=True)) < 1e-5


def test_long_source_names_stay_apart(spark, tmp_path):
    from lorecairn.plans import changes

    names = [f"src{'1' * 30}{x}" for x in "ab"]
    docs = spark.createDataFrame([(i, "text", "en", s, 4) for i, s in enumerate(names)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("region", "nation", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    wanted = {f"s{s[3:]}" for s in names}
    assert wanted <= {r["key"] for r in derived.kb_topics(spark, str(tmp_path)).collect()}
    assert {f"topics/{k}" for k in wanted} <= {r["to_id"] for r in derived.kb_links(spark, str(tmp_path)).collect()}
    rows = [r["row"].split("|") for r in changes.update_topics(spark, str(tmp_path)).where("kind = 'outcome'").collect()]
    assert all([k, "updated"] in rows for k in wanted)
