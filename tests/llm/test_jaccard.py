import collections
import itertools
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_ROWS, documents, words
from tremor.llm import jaccard_join as J
from tremor.llm.components import connected_components


def brute(rows, n, num, den):
    """{(doc_id, size, component)} by comparing all pairs."""
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(zip([d for d, _ in rows], sets), 2):
        if a is None or b is None or not s or not t:
            continue
        if den * len(s & t) >= num * len(s | t):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted(((d, len(s), (root(d) if s else d) if d is not None else None) for (d, _), s in zip(rows, sets)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_rows(seed, groups=12, copies=6):
    rnd = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = words(seed * 100 + g, int(rnd.integers(4, 160)), 10_000).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(int(rnd.integers(0, 4))):
                w[int(rnd.integers(0, len(w)))] = f"z{int(rnd.integers(0, 1000))}"
            if rnd.random() < 0.3:
                w = w[int(rnd.integers(0, 3)):]
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_key(num, den):
    plan, rnd, tried = J.Scheme(num, den), np.random.default_rng(3), 0
    for _ in range(6000):
        s = int(rnd.integers(1, 90))
        base = rnd.integers(0, 1 << 63, s, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cut = int(rnd.integers(0, max(1, s // 4) + 1))
        a = np.unique(np.concatenate([base[cut:], rnd.integers(0, 1 << 63, int(rnd.integers(0, max(1, s // 6) + 1)), dtype=np.uint64)]))
        b = np.unique(base)
        inter = len(np.intersect1d(a, b))
        if len(a) and den * inter >= num * (len(a) + len(b) - inter):
            tried += 1
            (ka, ca), (kb, cb) = J.set_keys(a, plan), J.set_keys(b, plan)
            _, i, j = np.intersect1d(ka, kb, return_indices=True)
            home = (ca[i] | cb[j]) & 1 > 0
            assert home.sum() >= (np.maximum(ca[i], cb[j])[home] >> 1).max(initial=1)
    assert tried > 300


def test_empty_blocks_are_keys_of_sparse_sets():
    # all differences in filled blocks: agreement on empty ones alone must be found
    low = np.array([5, 9], np.uint64)
    keys, need = J.block_keys(low, 0, 8, 1)
    assert len(keys) == 8 and len(set(keys.tolist())) == 8 and need == 1
    keys, need = J.block_keys(low, 0, 2, 1)
    assert len(keys) == 1 and need == 1


@pytest.mark.parametrize("batch_rows", [1, 7, 10_000])
def test_streamed_lists_equal_plain_ones(spark, batch_rows):
    rnd = np.random.default_rng(batch_rows)
    rows = [(int(k), int(d), int(c)) for k, d, c in zip(rnd.integers(0, 60, 2500) ** 2 // 60, rnd.integers(0, 400, 2500), rnd.integers(2, 8, 2500))]
    lists = collections.defaultdict(list)
    for k, d, c in sorted(rows):
        lists[k].append((d, c))
    shared, need, star = collections.Counter(), collections.Counter(), set()
    for members in lists.values():
        if len(members) > J.SHORT_LIST:
            star |= {(members[0][0], d) for d, _ in members if d != members[0][0]}
        else:
            for (a, c), (b, e) in itertools.combinations(members, 2):
                if a != b and (c | e) & 1:
                    shared[a, b] += 1
                    need[a, b] = max(need[a, b], c >> 1, e >> 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got = J.candidate_pairs(spark.createDataFrame(rows, "key bigint, doc_id bigint, code int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(star) > 50 and {(r.a, r.b) for r in got} == star | {p for p in shared if shared[p] >= need[p]}


@pytest.mark.parametrize("batch_rows", [1, 10_000])
def test_split_lists_lose_no_pair(spark, monkeypatch, batch_rows):
    """Random lists, sets of one need each: every pair that shares enough is joined."""
    monkeypatch.setattr(J, "SHORT_LIST", 8)
    rnd = np.random.default_rng(batch_rows)
    need = rnd.integers(1, 6, 120)
    mass = 1 / np.arange(1, 61)
    has = {d: set(rnd.choice(60, 8, False, mass / mass.sum()).tolist()) for d in range(120)}
    rows = [(k, d, 2 * int(need[d]) + 1) for d, keys in has.items() for k in keys]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got = J.split_candidates(spark.createDataFrame(rows, "key bigint, doc_id bigint, code int"))
        group = {r.id: r.component for r in connected_components(got, "a", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    linked = [(a, b) for a, b in itertools.combinations(has, 2) if len(has[a] & has[b]) >= max(need[a], need[b])]
    assert len(linked) > 100 and all(group[a] == group[b] for a, b in linked)


def test_candidates_grow_with_the_members_of_a_group(spark):
    """Groups of near copies whose lists are all short: fewer candidates than members, not all pairs."""
    rows = [(100 * g + i, f"{words(g, 120, 10_000)} e{i}") for g in range(3) for i in range(100)]
    keys = J.key_rows(documents(spark, rows), 5, 80, 100)
    plain, split = ({(r.a, r.b) for r in f(keys).collect()} for f in (J.candidate_pairs, J.split_candidates))
    assert len(plain) == 3 * 4950 and split < plain and len(split) < 10 * len(rows)
    group = {r.id: r.component for r in connected_components(spark.createDataFrame(list(split), "a bigint, b bigint"), "a", "b").collect()}
    assert group == {d: d // 100 * 100 for d, _ in rows}


def test_forests_of_parts_join_what_the_pairs_join(spark):
    rnd = np.random.default_rng(5)
    pairs = [(int(min(a, b)), int(max(a, b)), int(p)) for a, b, p in zip(*rnd.integers(0, 90, (2, 12_000)), rnd.integers(-3, 3, 12_000))
             if a != b and a // 30 == b // 30] + [(200, 201, 7), (200, 201, 8), (-5, -4, 7)]
    got = J.part_forests(spark.createDataFrame(pairs, "a bigint, b bigint, part int").repartition(5)).collect()
    assert {(r.a, r.b) for r in got} <= {p[:2] for p in pairs} and len(got) == 6 * (90 - 3) + 3
    group = {r.id: r.component for r in connected_components(spark.createDataFrame(got), "a", "b").collect()}
    assert group == {**{i: i // 30 * 30 for i in range(90)}, 200: 200, 201: 200, -5: -5, -4: -5}
    assert J.part_forests(spark.createDataFrame([], "a bigint, b bigint, part int")).collect() == []


def test_sets_that_only_share_passages_are_no_candidates(spark, monkeypatch):
    """300 texts with the same passage, far longer lists than SHORT_LIST, and 20 near copies of one of them."""
    monkeypatch.setattr(J, "SHORT_LIST", 16)
    shared = words(1, 60)
    rows = [(i, f"{words(1000 + i, 90)} {shared} {words(5000 + i, 90)}") for i in range(300)]
    rows += [(300 + i, f"{words(1007, 90)} {shared} {words(5007, 90)} e{i}") for i in range(20)]
    docs = documents(spark, rows)
    keys = J.key_rows(docs, 5, 80, 100)
    plain, split = ({d for r in f(keys).collect() for d in (r.a, r.b)} for f in (J.candidate_pairs, J.split_candidates))
    copies = {7, *range(300, 320)}
    assert copies < split and len(plain - copies) > 280 and len(split - copies) < 60       # sets with many empty blocks leave few lists
    assert {c for _, _, c in result(J.jaccard_components(docs, 5, 80, 100))} == set(range(300))


def test_open_cells_leave_joined_groups_out(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_SETS", 4)
    large = spark.createDataFrame([(0, i, 5) for i in range(20)] + [(100, i, 3) for i in range(100, 112)], "component bigint, doc_id bigint, chunks bigint")
    links = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(100, i) for i in range(101, 107)], "a bigint, b bigint")
    got = {r.doc_id: (r.chunk, r.meets) for r in J._open_cells(large, links).collect()}
    assert set(got) == set(range(100, 112))                                  # 7 inside in 2 chunks, 5 outside in 2
    assert all(2 <= got[d][0] < 4 and got[d][1] == 2 for d in range(100, 107))
    assert all(got[d][0] < 2 and got[d][1] == 4 for d in range(107, 112))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, num):
    rows = near_rows(num) + [(1000 + i, words(7, 60)) for i in range(25)]            # near copies and a group of copies
    assert result(J.jaccard_components(documents(spark, rows), n, num, 100)) == brute(rows, n, num, 100)


def test_large_groups_are_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_SETS", 3)
    rows = [(i, " ".join(f"x{j}" if (j * 7 + i) % 19 else f"y{i}" for j in range(60))) for i in range(40)]
    rows += [(100 + i, words(i // 4, 50) + f" e{i}") for i in range(24)]
    for num in (40, 90):
        assert result(J.jaccard_components(documents(spark, rows), 3, num, 100)) == brute(rows, 3, num, 100)


def test_odd_rows_and_empty_table(spark):
    rows = [(None, "some text here"), (None, None), (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "two words"),
            (7, "two\twords"), (8, "same text again"), (9, "SAME  text\nagain"), (9, "same text again"), (10, "x" * 20_000), (11, words(3, 9000))]
    got = result(J.jaccard_components(documents(spark, rows, True), 3, 90, 100))
    by = collections.Counter(got)
    assert by[(None, 1, None)] == 1 and by[(None, 0, None)] == 1
    assert by[(5, 1, 4)] == 1 and by[(7, 1, 6)] == 1 and by[(9, 1, 8)] == 2
    assert by[(1, 0, 1)] == by[(2, 0, 2)] == by[(3, 0, 3)] == 1
    assert len(got) == len(rows)
    assert J.jaccard_components(documents(spark, rows).limit(0)).collect() == []
    kept = {r.doc_id for r in J.drop_near_duplicates(documents(spark, rows, True), 3, 90, 100).collect()}
    assert kept == {None, 1, 2, 3, 4, 6, 8, 10, 11}


def test_one_of_repeated_and_idless_copies_stays(spark):
    rows = [(None, words(1, 30))] * 3 + [(5, words(2, 30))] * 3 + [(6, words(2, 30)), (7, words(3, 30)), (7, words(4, 30)), (7, words(3, 30)),
            (None, words(4, 30)), (None, words(5, 30)), (None, None), (None, None), (8, ""), (8, "")]
    for order in (rows, rows[::-1]):
        kept = J.drop_near_duplicates(documents(spark, order, True).repartition(3), 3, 90, 100)
        assert kept.columns == documents(spark, rows, True).columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
            [(None, words(1, 30)), (5, words(2, 30)), (7, words(3, 30)), (7, words(4, 30)), (None, words(5, 30)),
             (None, None), (None, None), (8, ""), (8, "")], key=str)


def test_odd_texts_do_not_fail(spark):
    assert J.jaccard_components(documents(spark, ODD_ROWS, True), 5, 80, 100).count() == len(ODD_ROWS)


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, None), (105, 140), (1, 0)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 141)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_columns_of_the_names_used_inside_keep_their_values(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now")])
    for name in ("row", "number", "Row_", "__row", "id", "component", "place", "times"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    out = J.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(out.collect())
    assert [r.doc_id for r in got] == [1, 3] and all(r[n] == f"{n}{r.doc_id}" for r in got for n in ("row", "number", "Row_", "__row", "id", "component"))
    assert J.free_names(["row", "ROW_"], "row", "row__") == ["row__", "row___"]


def test_working_arrays_stay_small():
    rnd = np.random.default_rng(8)
    texts = [words(i, 300) for i in range(1000)]
    next(J.shingle_sets(["a b c"], 5))      # the power tables
    sets = [np.unique(rnd.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(1024)]
    sets[1000] = sets[3]
    tracemalloc.start()
    try:
        found = list(J.shingle_sets(texts, 5))
        assert tracemalloc.get_traced_memory()[1] < 45 << 20
        tracemalloc.reset_peak()
        label = J.link_forest(sets, None, 80, 100)
        assert tracemalloc.get_traced_memory()[1] < 45 << 20
    finally:
        tracemalloc.stop()
    assert len(found) == 1000 and label[1000] == 3 and len(set(label)) == 1023
