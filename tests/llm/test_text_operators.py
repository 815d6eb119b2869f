"""Operators on pairs and passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorecairn.llm import components, decontaminate, ngram_join, substring, textarrays, token_counts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text):
    return (text or "").encode().split()


def grams(text, n):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def groups(rows, n, percent):
    """(doc_id, set size, smallest linked id) of each row, rows of one id being one node."""
    sets = [(r[0], grams(r[1], n)) for r in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (1, 60), (2, 100)])
def test_join_equals_brute_force(awkward, rows, n, percent):
    found = ngram_join.joined(awkward, n, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, found.collect())) == groups(rows, n, percent)


def test_join_of_chained_and_borderline_copies(spark):
    """Copies that drift apart: neighbours link, ends do not, and some miss the limit by a hair."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(60)]
    made = []
    for i in range(150):
        made.append((i, " ".join(base)))
        for _ in range(draw.choice((1, 1, 2, 6))):
            base[draw.randrange(len(base))] = f"w{draw.randrange(500)}"
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for n, percent in ((3, 90), (1, 80)):
        assert Counter(map(tuple, ngram_join.joined(docs, n, percent).collect())) == groups(made, n, percent)


def test_tiles_hold_every_pair_that_links():
    draw = np.random.default_rng(5)
    for percent in (50, 80, 90, 100):
        for _ in range(60):
            size = int(draw.integers(1, 80))
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            for _ in range(int(draw.integers(0, max(1, size // 6) + 1))):
                b[draw.integers(len(b))] = draw.integers(0, 1 << 63, dtype=np.uint64)
            b = np.unique(b)
            if ngram_join.links(len(np.intersect1d(a, b)), len(a), len(b), percent):
                names = [set(ngram_join.tile_keys(x, np.array([0, len(x)]), percent)[0].tolist()) for x in (a, b)]
                assert names[0] & names[1]


def test_bit_counts_bound_the_intersection():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(draw.integers(0, 400, 200).astype(np.uint64)) for _ in range(2))
        bits = [ngram_join.bitmaps(x, np.array([0, len(x)])) for x in (a, b)]
        assert ngram_join.most_common(*bits, len(a), len(b))[0] >= len(np.intersect1d(a, b))


def test_every_link_and_links_per_document(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    draw = random.Random(12)
    base = [f"w{draw.randrange(500)}" for _ in range(60)]
    made = []
    for i in range(60):
        made.append((i, " ".join(base)))
        if i % 3:
            base[draw.randrange(60)] = f"w{draw.randrange(500)}"
    made += [(100, "far from all"), (101, ""), (102, None), (103, made[0][1].upper())]
    sets = {d: grams(text, 3) for d, text in made}
    near = {(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    least = {d: min(x for x in sets if sets[x] == sets[d]) for d in sets}
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = [tuple(r) for r in ngram_join.linked(docs, 3, 80).collect()]
    assert len(found) == len(set(found)) and set(found) == {tuple(sorted((least[a], least[b]))) for a, b in near if least[a] != least[b]}
    # More than connect them.
    assert len(found) > len(set(least.values()))
    counts = dict(ngram_join.link_counts(docs, 3, 80).collect())
    assert counts == {d: sum(a == d for a, _ in near) for d in sets if sets[d]}


def test_linked_sets_share_enough_of_their_smallest_hashes(spark):
    draw = np.random.default_rng(8)
    for percent in (1, 50, 80, 90, 100):
        for _ in range(200):
            size = int(draw.integers(1, 80))
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.append(a[draw.random(len(a)) < draw.random() ** 0.1], draw.integers(0, 1 << 63, int(draw.integers(0, 9)), dtype=np.uint64)))
            if len(b) and ngram_join.links(len(np.intersect1d(a, b)), len(a), len(b), percent):
                (shown_a, needed_a), (shown_b, needed_b) = (ngram_join.prefix(np.array([len(x)]), percent) for x in (a, b))
                assert len(np.intersect1d(a[: shown_a[0]], b[: shown_b[0]])) >= max(needed_a[0], needed_b[0])
        sizes = np.arange(1, 500)
        column = spark.range(1, 500).orderBy("id").select(ngram_join._needed("id", percent)).collect()
        assert [r[0] for r in column] == ngram_join.prefix(sizes, percent)[1].tolist()


def test_a_shared_passage_takes_no_document_to_the_tiles(spark):
    """Only the sets of documents that may link are gathered and compared; copies don't support each other."""
    draw = random.Random(21)

    def text(k):
        return [f"w{draw.randrange(100000)}" for _ in range(k)]

    passage = text(30)
    made = [(i, " ".join(text(80) + passage)) for i in range(40)]
    made += [(100 + i, made[i][1]) for i in range(5)]
    near = text(100)
    made += [(200, " ".join(near)), (201, " ".join([*near[:-1], "changed"]))]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    _, pairs, sets = ngram_join._paired(docs, ngram_join.measured(docs, 5), 5, 80)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(200, 201)]
    assert {r["doc"] for r in sets.collect()} == {200, 201}
    assert Counter(map(tuple, ngram_join.joined(docs, 5, 80).collect())) == groups(made, 5, 80)


def test_members_of_a_cluster_meet_within_bands(spark):
    members = spark.range(1, 400).selectExpr("1L AS cluster", "id AS node", "id AS component", "id AS size")
    for percent in (50, 80, 90, 100):
        found = defaultdict(set)
        for r in ngram_join.banded(members, percent).collect():
            found[r["node"]].add(r["band"])
        assert max(map(len, found.values())) <= 2
        assert all(found[a] & found[b] for a in range(1, 400) for b in range(a, 400) if 100 * a >= percent * b)
        assert not found[30] & found[399]


def test_one_of_each_keeps_the_smallest_and_all_columns(awkward, rows):
    kept = ngram_join.one_of_each(awkward, 5, 80)
    assert kept.columns == awkward.columns
    expected = groups(rows, 5, 80)
    stays = Counter(d for (d, size, least), n in expected.items() for _ in range(n if not size or d is None else 1) if d == least)
    assert Counter(r["doc_id"] for r in kept.collect()) == stays


def test_empty_tables(nothing, spark):
    assert ngram_join.joined(nothing).count() == 0
    assert ngram_join.one_of_each(nothing).count() == 0
    assert substring.deduplicated(nothing).count() == 0
    assert token_counts.token_counts(nothing, [b"a"]).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.leaks(nothing, bench).count() == 0


def test_small_components_leave_few_partitions(spark):
    """Every shuffle of a small table writes files for each partition it is read in."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(40)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        found = components.components(edges)
        assert found.rdd.getNumPartitions() <= 2
    finally:
        spark.conf.set(setting, before)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(61)}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(300, 300), (202, 201), (201, 200)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 160))
    assert found[202] == found[200] == 200 and 300 not in found


def removed(rows, length):
    first: dict[bytes, int] = {}
    for d, text, *_ in rows:
        words = words_of(text)
        for i in range(len(words) - length + 1) if d is not None else ():
            key = b" ".join(words[i : i + length])
            first[key] = min(d, first.get(key, d))
    out = Counter()
    for d, text, *_ in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - length + 1) if d is not None else ():
            if first[b" ".join(words[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[(d, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    return out


@pytest.mark.parametrize("length", [2, 7, 12, 50])
def test_substrings_equal_brute_force(awkward, rows, length):
    assert Counter(map(tuple, substring.deduplicated(awkward, length).collect())) == removed(rows, length)


def test_hot_passage_is_thinned_within_blocks(spark, monkeypatch):
    draw = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(9))
    made = [(i, f"{draw.random()} {passage} {draw.random()} {passage}") for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert Counter(map(tuple, substring.deduplicated(docs, 6).collect())) == removed(made, 6)


def greedy(word, pieces, mark=b" "):
    text, at, count = mark + word, 0, 0
    while at < len(text):
        for end in range(len(text), at, -1):
            if text[at:end] in pieces:
                at, count = end, count + 1
                break
        else:
            return 1
    return count


def test_piece_automaton_equals_greedy_matching():
    draw = random.Random(4)
    for _ in range(300):
        pieces = {bytes(draw.choice(b"ab c") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 12))}
        automaton = token_counts.PieceAutomaton(pieces)
        for _ in range(30):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 12)))
            assert automaton.count(word) == greedy(word, pieces)


def test_token_counts_of_rows(awkward, rows):
    pieces = {bytes([i]) for i in range(256)} | {b" b", b"en", b" changed", b"ior", b"uth"}
    found = Counter(map(tuple, token_counts.token_counts(awkward, pieces).collect()))
    assert found == Counter((r[0], len(words_of(r[1])), sum(greedy(w, pieces) for w in words_of(r[1]))) for r in rows)


def test_words_and_hashes_stay_within_documents():
    texts = ["ab cd", "", None, "ab", "cd  ab\x0bcd", "été  x"]
    (chunk,) = textarrays.chunks(pa.array(texts))
    found = textarrays.words(chunk)
    assert np.diff(found.first).tolist() == [len(words_of(t)) for t in texts]
    by_hash = defaultdict(set)
    flat = [w for t in texts for w in words_of(t)]
    for value, word in zip(found.hash.tolist(), flat, strict=True):
        by_hash[value].add(word)
    assert all(len(x) == 1 for x in by_hash.values()) and len(by_hash) == len(set(flat))


def test_leaks_are_found_and_clean_documents_left(spark, awkward, rows):
    draw = random.Random(9)
    items = [(i, " ".join(f"q{draw.randrange(3000)}" for _ in range(n))) for i, n in enumerate((5, 14, 30, 47, 90, 200))]
    bench = spark.createDataFrame([*items, (77, ""), (None, "x y z"), (78, None)], "item_id long, text string")
    planted = [(1000 + i, f"{rows[i][1]} {text.upper()} {rows[i + 6][1]}", *rows[i][2:]) for i, text in items]
    # A paraphrase: every seventh word is another.
    changed = " ".join("other" if i % 7 == 3 else w for i, w in enumerate(items[3][1].split()))
    planted.append((1100, f"{rows[9][1]} {changed}", *rows[9][2:]))
    docs = awkward.unionByName(spark.createDataFrame(planted, awkward.schema))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(1000 + i, i) for i, _ in items} | {(1100, 3)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_leaks_of_an_item_in_a_third_of_all_documents(spark):
    """Frequent items among rarer words, verbatim or with 38 % of the words changed, against brute force."""
    draw = random.Random(5)
    items = {i: [f"q{draw.randrange(400)}" for _ in range(n)] for i, n in enumerate((25, 40, 13))}
    docs = {}
    for d in range(120):
        words = [f"r{draw.randrange(20000)}" for _ in range(300)]
        if d % 3 == 0:
            item = items[d // 3 % 3]
            changed = set(draw.sample(range(len(item) * 3 // 4), len(item) * 38 // 100)) if d % 2 else set()
            words[140:140] = [f"other{draw.randrange(99)}" if k in changed else w for k, w in enumerate(item)]
        docs[d] = words

    def held(words, item, length):
        size, end = len(item), item[-max(3, len(item) // 4) :]
        for start in range(max(len(words) - length, 0) + 1):
            text = words[start : start + length]
            if decontaminate.common_length(decontaminate._bits(item), text, size) >= 0.6 * size:
                if decontaminate.common_length(decontaminate._bits(end), text, len(end)) >= 0.5 * len(end):
                    return True
        return False

    # Any stretch of five quarters of an item's window is read whole.
    expected = {(d, i) for d, words in docs.items() for i, item in items.items() if held(words, item, 30 if len(item) <= 24 else 60)}
    assert expected == {(d, d // 3 % 3) for d in range(0, 120, 3)}
    table = spark.createDataFrame([(d, " ".join(words)) for d, words in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()} == expected


def test_short_items_are_found_word_for_word(spark):
    """Items of 1 to 12 frequent words inside long documents, at their edges too, and not across two documents."""
    draw = random.Random(6)
    items = [[f"i{n}w{k % 5}" for k in range(n)] for n in range(1, 13)]
    docs, expected = [], set()
    for d in range(96):
        words, item = [f"r{draw.randrange(20000)}" for _ in range(200)], items[d % 12]
        at = (0, 37, 90, 200)[d // 12 % 4]
        words[at:at] = item
        docs.append((d, " ".join(words)))
        expected.add((d, d % 12))
    docs += [(900, " ".join(items[11][:6])), (901, " ".join(items[11][6:]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()}
    assert expected <= found and (900, 11) not in found and (901, 11) not in found


def test_leaks_without_a_benchmark(spark, awkward):
    assert decontaminate.leaks(awkward, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_blocks_of_items_give_the_same_leaks(spark, awkward, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"z{i}w{k}" for k in range(20))) for i in range(6)], "item_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(items.selectExpr("item_id + 500 as doc_id", "concat('some words ', text) as text"))
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).select("doc_id", "item_id").collect())) == whole
    assert len(whole) == 6


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_length(decontaminate._bits(a), b, len(a)) == table[-1][-1]


def test_leaks_in_other_type_and_case_are_found(spark):
    """Typographic quotes and dashes end words, and letters outside ASCII have two cases."""
    item = 'warum "schnelle" füchse - und träge hunde - über den großen zaun springen, weiß der alte müller nicht genau'
    typographic = "warum “schnelle” füchse—und träge hunde—über den großen zaun springen, weiß der alte müller nicht genau"
    short = 'der "ölige" igel - ja'
    table = spark.createDataFrame(
        [(1, "x y z " + typographic), (2, item.upper().replace("SS", "ß")), (3, "vorher DER „ÖLIGE“ IGEL—JA nachher"), (4, "ganz anderes über träge dinge")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, item), (8, short)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()} == {(1, 7), (2, 7), (3, 8)}


def test_words_end_where_no_letter_stands():
    import pyarrow as pa

    text = "“quick” fox—jumps é e\u0301x 漢字 १२ 😀 a"
    (chunk,) = textarrays.chunks(pa.array([text]))
    hashes, _ = decontaminate.terms(chunk)
    (plain,) = textarrays.chunks(pa.array(["quick fox jumps é e\u0301x 漢字 १२ a"]))
    assert hashes.tolist() == decontaminate.terms(plain)[0].tolist()
    assert len(hashes) == 8


def test_one_of_each_with_repeated_ids_and_clashing_names(spark):
    """Rows without words stay; of an id's other rows that with the smallest text does."""
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, two, "w1"), (1, one, "w2"), (1, " ", "w3"), (1, None, "w4"), (2, one, "w5"), (2, "", "w6"), (3, "u v w x y z", "w7")]
    table = spark.createDataFrame(rows, "doc_id long, text string, whole string")
    kept = ngram_join.one_of_each(table, 5, 80)
    assert kept.columns == table.columns
    assert sorted(r["whole"] for r in kept.collect()) == ["w2", "w3", "w4", "w6", "w7"]
