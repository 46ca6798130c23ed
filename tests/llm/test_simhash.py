import random

import pytest
import xxhash

from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD_ROWS, documents, words
from tremor.llm import simhash as S


def plain_fingerprint(text, n):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i:i + n]) for i in range(len(found) - n + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, n, radius):
    """(doc_id, fingerprint, component) by comparing all rows with all."""
    marks = [(d, plain_fingerprint(t, n)) for d, t in rows]
    group = list(range(len(rows)))
    for i, (d, x) in enumerate(marks):
        for j, (e, y) in enumerate(marks[:i]):
            if d is not None and e is not None and (d == e or (x ^ y).bit_count() <= radius):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(marks, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{x:016x}", None if d is None else least[g]) for (d, x), g in zip(marks, group)), key=str)


def collected(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def near_copies(seed, groups, size, length):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = words(seed * 1000 + g, length).split()
        for _ in range(size):
            now = list(base)
            for _ in range(rnd.randrange(3)):
                now[rnd.randrange(len(now))] = f"z{rnd.randrange(99)}"
            rows.append(" ".join(now))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n, radius", [(3, 2), (5, 2), (3, 0), (3, 4)])
def test_components_equal_brute_force(spark, n, radius):
    rows = near_copies(n + radius, 12, 12, 150) + ODD_ROWS
    want = brute([(d + 1000 if d is not None and i >= 144 else d, t) for i, (d, t) in enumerate(rows)], n, radius)
    got = collected(S.simhash_components(documents(spark, [(d + 1000 if d is not None and i >= 144 else d, t) for i, (d, t) in enumerate(rows)],
                                                   clash=True), n, radius))
    assert got == want
    if radius:
        assert len({c for _, _, c in got}) < len({f for _, f, _ in got}) + 2        # near, not only equal, texts meet


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collected(S.simhash_components(docs, 3, 2)) == brute(rows, 3, 2)


def test_links_at_two_bits_through_the_midpoint(spark):
    base = 0x0123456789ABCDEF
    marks = [base, base ^ 1 << 63, base ^ 1 << 63 ^ 1, base ^ 0b111, base ^ 0b110, base ^ 0xFF00, -1 & (1 << 64) - 1]
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp bigint")
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in S.near_pairs(frame, 2).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    group = {m: m for m in marks}
    for a, b in list(got) * len(marks):
        group[a] = group[b] = min(group[a], group[b])
    want = {m: m for m in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (a ^ b).bit_count() <= 2:
                    want[a] = want[b] = min(want[a], want[b])
    assert group == want and want[base ^ 0b111] == want[base ^ 0b110] == want[base]


def test_bucket_is_bounded_and_all_its_pairs_connect(spark):
    # the whole ball around one point: 65 fingerprints in its bucket, one component
    marks = sorted(0 ^ m for m in S.ball_masks(1))
    frame = spark.createDataFrame([(m,) for m in marks * 3], "fp bigint")
    pairs = S.near_pairs(frame, 2).collect()
    assert len(S.ball_masks(1)) == 65 and len(S.ball_masks(2)) == 65 + 64 * 63 // 2
    assert len(pairs) <= 65 * 65                                                    # linear in the variants, not 65 * 64 / 2 a bucket
    reached = {marks[0]}
    for _ in marks:
        reached |= {x for p in pairs for x in (p.a, p.b) if p.a in reached or p.b in reached}
    assert reached == set(marks)


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 20])
def test_runs_of_a_long_text_give_the_same_shingles(limit):
    for text in ("", " ", "one", "one two", "a b c", words(5, 400), " \t".join(words(6, 50).split()) + "\n", "É" * 90 + " x y " + "z" * 80):
        for n in (1, 3, 5):
            runs = b"".join(S.shingle_digests(text.encode(), n, limit))
            found = text.encode().lower().split()
            grams = [b" ".join(found[i:i + n]) for i in range(len(found) - n + 1)] or ([b" ".join(found)] if found else [])
            assert runs == b"".join(xxhash.xxh64_digest(g, 42) for g in grams)


def test_odd_radius_and_empty_table(spark):
    with pytest.raises(ValueError):
        S.near_pairs(spark.createDataFrame([(1,)], "fp bigint"), 3)
    assert S.simhash_components(documents(spark, [])).collect() == []
