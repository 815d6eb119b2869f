"""Learned operators, rules, mixing and sharding: held-out accuracy, contracts and brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorecairn.llm import language, mixing, quality_model, quality_rules, queries, sharding, toxicity
from lorecairn.llm.tables import held_out

MEDIUM = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    found = queries.QUERIES["op5_language_id"](spark, MEDIUM)
    rows = found.join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(tested) > 0.97


def test_language_of_awkward_rows(awkward, nothing, rows):
    profiles = language.learn(awkward, F.lit(True))
    assert profiles.names == ["en", "fr"]
    found = language.identify(awkward, profiles)
    assert found.count() == len(rows) and set(found.columns) == {*awkward.columns, "lang_pred"}
    for r in found.collect():
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
    assert language.learn(nothing, F.lit(True)).names == []
    nobody = language.identify(awkward, language.learn(nothing, F.lit(True)))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}
    assert language.identify(nothing, profiles).count() == 0


def test_trigram_vectors_bundle_to_the_same_cosines():
    """The matrix product equals adding up the vectors of a text's trigrams one by one."""
    text = "abc Abd"
    (chunk,) = language.chunks(pa.array([text]), lower=True)
    codes, _ = language.trigrams(chunk)
    vectors = language.TrigramVectors(256, 1)
    places = vectors.places(codes)
    total = sum(vectors.table[p] for p in places)
    by_hand = np.zeros(256)
    for word in text.lower().split():
        padded = [0, *map(ord, word), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            by_hand += np.roll(vectors.of_letter(a), 2) * np.roll(vectors.of_letter(b), 1) * vectors.of_letter(c)
    assert np.allclose(total, by_hand)


def test_toxicity_on_held_out_rows(spark):
    # The medium tables have 14 toxic held-out rows, too few to tell; these have 120.
    found = queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    hits = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in hits) >= 0.85 * len(hits)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.03 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def toxic_rows(spark):
    plain = [(i, f"The cat sat on mat {i}. It was a fine day. All went home", 0) for i in range(60)]
    bad = [(100 + i, f"The cat sat on mat {i}. You are a scoundrel. All went home", 1) for i in range(60)]
    return spark.createDataFrame(plain + bad, "doc_id long, text string, toxic int")


def test_offending_sentences_are_located(spark):
    rows = toxic_rows(spark)
    weights = toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True))
    found = toxicity.offending_sentences(rows.select("doc_id", "text"), weights).collect()
    assert {r["doc_id"] for r in found} == set(range(100, 160))
    assert {(r["sentence"], r["sentence_text"]) for r in found} == {(1, "you are a scoundrel.")}


def test_noisy_or_is_one_minus_the_product():
    logits = np.array([0.5, -1.0, -np.inf, 2.0])
    p = 1 / (1 + np.exp(-logits))
    found = toxicity.noisy_or(logits, np.array([0, 3, 3, 4]))
    assert np.allclose(found, [1 - np.prod(1 - p[:3]), 0, p[3]])


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_models_take_awkward_rows_and_missing_labels(spark, awkward, nothing, rows, module):
    name = "toxic" if module is toxicity else "quality"
    kind = f"doc_id long, {name} int"
    some = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(3, None), (None, 1), (4, 0), (4, 1)], kind)
    for labels in (some, spark.createDataFrame([(1, 1)], kind), spark.createDataFrame([], kind)):
        model = module.learn(awkward, labels, ~held_out(4, 2))
        found = module.score(awkward, model)
        assert found.count() == len(rows) and sorted(found.columns) == sorted(awkward.columns)
        assert all(0 <= r["score"] <= 1 for r in found.collect())
        assert module.score(nothing, model).count() == 0


def test_quality_model_on_held_out_rows(spark):
    found = queries.QUERIES["op10_quality_model"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def measures(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_measures_equal_brute_force(spark, awkward, rows):
    more = ["a b c d e a b c d e", "x\nx\n \n \nx y", "#a *b $$ <|>", "a b c d e f a b c d e f g a b c d e"]
    docs = awkward.unionByName(spark.createDataFrame([(900 + i, t, *rows[0][2:]) for i, t in enumerate(more)], awkward.schema))
    found = quality_rules.judge(docs)
    expected = Counter((r[0], *measures(r[1])) for r in [*rows, *((900 + i, t) for i, t in enumerate(more))])
    assert Counter(tuple(r)[:6] for r in found.collect()) == expected
    for r in found.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= 0.5)


def test_rules_against_labels_and_empty(spark, nothing):
    found = queries.QUERIES["op2_quality_rules"](spark, MEDIUM)
    assert "Python" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = found.join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["label"] == 1) for r in rows]) > 0.97
    assert quality_rules.judge(nothing).count() == 0


def test_expectation_maximisation_follows_the_votes():
    names = ["a", "b", "c"]
    model = quality_rules.estimate([((1, 1, 1), 800), ((-1, 1, 1), 100), ((1, -1, 0), 90), ((0, 0, 0), 10)], names)
    assert 0 < model.good < 1
    scores = [quality_rules.posterior(model, dict(zip(names, v))) for v in ((1, 1, 1), (-1, 1, 1), (-1, -1, 1))]
    assert scores[0] > 0.9 > scores[1] > scores[2]
    assert all(abs(sum(x[k] for x in votes.values()) - 1) < 1e-9 for votes in model.votes.values() for k in (0, 1))


def expected_targets(sizes, share=1.5, most=2.0, cycle=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: cycle[i % 3] for i, s in enumerate(order)}
    target, left, full = {}, share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            full.add(s)
            left -= target[s]


def test_mix_reaches_its_targets(spark):
    rows = queries.QUERIES["op7_source_mix"](spark, MEDIUM).collect()
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
    expected = expected_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert 0 <= target[s] - taken[s] <= max(0.06 * target[s], 1)
    again = queries.QUERIES["op7_source_mix"](spark, MEDIUM).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mix_of_awkward_rows(awkward, nothing, rows):
    plan = mixing.plan(awkward)
    found = plan.apply(awkward)
    assert found.count() == len(rows)
    sizes = defaultdict(int)
    for r in found.collect():
        sizes[r["source"]] += r["size"]
        assert r["size"] == len((r["text"] or "").encode().split())
    expected = expected_targets(dict(sizes))
    for r in found.collect():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
    mixed = mixing.mixed(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == sum(r["copies"] for r in found.collect())
    assert mixing.mixed(nothing).count() == 0 and mixing.plan(nothing).apply(nothing).count() == 0


def test_mix_is_native(spark):
    plan = queries.QUERIES["op7_source_mix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_larger_budgets_hold_smaller_ones(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7 + 1), "s") for i in range(400)], "doc_id long, text string, source string")
    few, many = ({r["doc_id"] for r in mixing.plan(docs, share=x).apply(docs).where("copies > 0").collect()} for x in (0.3, 0.7))
    assert len(few - many) <= 3


def test_shards_are_exact_and_gapless(spark, awkward, nothing, rows):
    for docs, count in ((awkward, len(rows)), (spark.range(1003).withColumnRenamed("id", "doc_id"), 1003), (nothing, 0)):
        found = sharding.shuffled(docs, 8, cell_rows=16).collect()
        assert len(found) == count
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        columns = [c for c in docs.columns if c not in ("shard", "slot")]
        assert Counter(tuple(r[c] for c in columns) for r in found) == Counter(tuple(r[c] for c in columns) for r in docs.collect())
        assert found == sharding.shuffled(docs, 8, cell_rows=16).collect() or sorted(map(str, found)) == sorted(
            map(str, sharding.shuffled(docs, 8, cell_rows=16).collect())
        )


def test_matrix_rows_add_up_and_spread(spark):
    before = np.array([0, 40, 40, 75, 200, 201])
    sizes = np.array([30, 51, 60, 60])
    for seed in range(20):
        rows = [sharding.matrix_row(p, before, sizes, seed) for p in range(5)]
        assert (np.sum(rows, axis=0) == sizes).all()
        assert [r.sum() for r in rows] == np.diff(before).tolist()
    # The mean of a cell is what the hypergeometric law says.
    mean = np.mean([sharding.matrix_row(0, before, sizes, seed) for seed in range(400)], axis=0)
    assert np.allclose(mean, 40 * sizes / 201, atol=0.6)


def test_changed_partitions_are_noticed(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "doc_id").repartition(2).write.parquet(str(tmp_path / "a"))
    docs = spark.read.parquet(str(tmp_path / "a"))
    rows = sharding.shuffled(docs, 3)
    spark.range(5).withColumnRenamed("id", "doc_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    assert rows.count() == 40

    def unsteady(batches):
        for batch in batches:
            yield batch.slice(0, random.SystemRandom().randrange(batch.num_rows + 1))

    random_rows = docs.mapInArrow(unsteady, docs.schema)
    with pytest.raises(Exception, match="store the table first"):
        for _ in range(5):
            sharding.shuffled(random_rows, 3).collect()


def test_pipeline_stages_keep_the_columns_of_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]
    assert docs.columns == [*columns, "shard", "slot"]
    assert corpus_pipeline.run(spark, folder).count() == counts[5]


def test_pipeline_with_awkward_rows(spark, awkward, folder, tmp_path):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_mix_leaves_no_document_that_fits(spark):
    draw = random.Random(8)
    made = [(i, "w " * int(2 ** (draw.random() * 10)), f"s{i % 40}") for i in range(2400)]
    made += [(i, "w " * draw.randint(1, 40), "s0") for i in (5000, 5001) for _ in range(1)] + [(6000, "w " * 30, "s1")] * 5
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    rows = mixing.plan(docs).apply(docs).collect()
    left = {}
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        gap = int(own[0]["target"] + 1e-6) - sum(r["size"] * r["copies"] for r in own)
        least = int(own[0]["target"] // own[0]["source_size"])
        units = {}
        for r in own:
            if r["copies"] == least and r["size"]:
                units[r["doc_id"]] = units.get(r["doc_id"], 0) + r["size"]
        assert gap >= 0
        left[source] = sum(size <= gap for size in units.values())
    assert not any(left.values()), left
