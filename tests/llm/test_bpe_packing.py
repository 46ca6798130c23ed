import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ODD_ROWS, documents, words
from tremor.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.tokenizer_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def _ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def _lexicon(entries):
    ids, size = bpe.Encoder(PATH)._words(entries)
    cut = np.concatenate([[0], np.cumsum(size)]).astype(int)
    return bpe.compile_lexicon({w: ids[a:b].tolist() for w, a, b in zip(entries, cut, cut[1:])})


def _fuzz(n, seed):
    rnd = random.Random(seed)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x370), *range(0x370, 0x480), *range(0x1E00, 0x2070)]]
    pool += ["\u3000", "\ufeff", "\U0001f600", "\u4e2d", "\uac00", "\u200d", "\ufb01", "\u0130", "\u03a3", "<|endoftext|>",
             "<|startoftext|>", "'s", "'RE", " ", " ", "a", "b", "!!", "\n", "1"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_encoder_equals_library_with_and_without_lexicon():
    texts = [t for _, t in ODD_ROWS] + _fuzz(3000, 5) + ["a" * 3000, "ab" * 2000, "!?" * 900, "Σ ΑΣ", "don't DON'T we'll"]
    want = [_ids(t) for t in texts]
    entries = [b"the", b"then", b"hen", b"w1", b"emoji", "émoji".encode(), b"same", b"text", b"again", b"!!"]
    for lexicon in (None, _lexicon(entries)):
        got = [x.tolist() for x in bpe.Encoder(PATH, lexicon).encode(texts)]
        assert got == want
    join = bpe._joiner(bpe.Encoder(PATH))
    assert [join(x).decode() for x in want] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want]


def test_pieces_told_by_bytes_equal_the_library():
    rnd = random.Random(9)
    pool = ["'", "'s", "'S", "'re", "'LL", "'d", "'v", "'r", "''", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\x00", "a", "B", "1", "23", "!", "-", "é", "É",
            "ß", "ÿ", "Ÿ", "À", "Þ", "×", "÷", "’", "e\u0301", "<", "|", "|>", "<|", "<|endoftext|>", "abcdefgh", "ijklmnop", "é" * 8]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for _ in range(5000)] + ["'", "'s", "s'", "a" * 16, "a" * 17, "\xa0"]
    assert [x.tolist() for x in bpe.Encoder(PATH).encode(texts)] == [_ids(t) for t in texts]


def test_a_piece_is_merged_once_whatever_surrounds_it(monkeypatch):
    enc, merged = bpe.Encoder(PATH), []
    merge = enc.merges.merge
    monkeypatch.setattr(enc.merges, "merge", lambda words: merged.extend(words) or merge(words))
    texts = ["Alpha, beta", "(beta) alpha. ALPHA!", "alphabetagammadelta", "«alpha» Alphabetagammadelta,"]
    for t in texts:                                    # one group after another
        assert next(enc.encode([t])).tolist() == _ids(t)
    plain = [w for w in merged if w.isalpha() and w.isascii()]
    assert sorted(plain) == [b"alpha", b"alpha", b"alphabetagammadelta", b"beta"]     # once more for the chunk in other quotes


def test_word_table_grows_and_tells_words_apart():
    table, rnd = bpe.WordTable(), np.random.default_rng(3)
    first = rnd.integers(1, 1 << 62, (2, 5000), dtype=np.uint64)
    more = np.concatenate([first[:, :20] + np.array([[0], [1]], np.uint64), np.zeros((2, 3), np.uint64),
                           rnd.integers(1, 1 << 62, (2, 40000), dtype=np.uint64)], axis=1)
    assert (table.find(first) == -1).all()
    table.add(first)
    assert (table.find(more) == -1).all()
    table.add(more)
    both = np.concatenate([first, more], axis=1)
    want = np.arange(both.shape[1])
    assert (table.find(both) == np.where(both[0] > 0, want, -1)).all()


def test_transducer_is_minimal_and_maps_every_word():
    rnd = random.Random(1)
    entries = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 7))) for _ in range(600)})
    table = bpe.compile_lexicon({w: [i, i + 1] for i, w in enumerate(entries)})
    lex = bpe.Lexicon(table)
    found = lex.lookup(entries + [b"zz", b"abcabcabcabc", b"a" * 9])
    assert found[:len(entries)].tolist() == list(range(len(entries)))
    assert (found[len(entries):] == -1).all()
    for i in (0, 17, len(entries) - 1):
        assert lex.ids[lex.offset[i]:lex.offset[i + 1]].tolist() == [i, i + 1]
    # minimal: as many states as distinct right languages
    rights = {frozenset(w[len(p):] for w in entries if w.startswith(p)) for p in {w[:k] for w in entries for k in range(len(w) + 1)}}
    assert len(lex.ends) == len(rights)
    assert bpe.Lexicon(bpe.compile_lexicon({})).lookup([b"a"]).tolist() == [-1]


def test_round_trip_query_on_odd_rows(spark):
    for rows, clash in ((ODD_ROWS, True), (ODD_ROWS + [(100 + i, words(i, 40)) for i in range(40)], False)):
        docs = documents(spark, rows, clash)
        got = sorted(map(tuple, bpe.bpe_round_trip(docs).collect()), key=str)
        want = sorted(((d, len(_ids(t)), hashlib.sha256(np.array(_ids(t), "<u4").tobytes()).hexdigest(),
                        hashlib.sha256(LIBRARY.decode(_ids(t), skip_special_tokens=False).encode()).hexdigest()) for d, t in rows), key=str)
        assert got == want
    assert bpe.bpe_round_trip(documents(spark, ODD_ROWS).limit(0)).collect() == []


def test_general_interface_returns_ids_and_texts(spark):
    encoded = bpe.encode_documents(documents(spark, ODD_ROWS[2:]))
    texts = {(r.doc_id, r.text) for r in bpe.decode_documents(encoded).collect()}
    assert texts == {(d, LIBRARY.decode(_ids(t), skip_special_tokens=False)) for d, t in ODD_ROWS[2:]}


def _check_packing(rows, pieces, window):
    """Every id of every row in exactly one piece; sequences gapless and full,
    or a power of two."""
    want = defaultdict(int)
    for d, t in rows:
        want[d] += len(_ids(t)) + 1
    have, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        have[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        assert p.length > 0
    assert dict(want) == dict(have)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)


@pytest.mark.parametrize("window,shard_docs", [(4096, 512), (64, 7), (64, 1)])
def test_packing_is_exact_and_tight(spark, window, shard_docs):
    rows = [(i, words(i, 3 + i * 7 % 60, 80)) for i in range(60)] + [(200, words(1, 3000)), (201, None), (202, "")]
    found = packing.pack_documents(documents(spark, rows, True), window=window, shard_docs=shard_docs).collect()
    _check_packing(rows, found, window)
    texts = dict(rows)
    by_doc = defaultdict(list)
    for p in found:
        ids = np.array(_ids(texts[p.doc_id]) + [packing.END_ID], "<u4")
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
    for d, parts in by_doc.items():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]


def test_packing_odd_rows_and_empty_table(spark):
    found = packing.pack_documents(documents(spark, ODD_ROWS, True)).collect()
    _check_packing(ODD_ROWS, found, packing.WINDOW)
    again = packing.pack_documents(documents(spark, ODD_ROWS[::-1]).repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))          # partitioning does not matter
    assert packing.pack_documents(documents(spark, ODD_ROWS).limit(0)).collect() == []


def test_neighbours_share_a_window():
    # two topics; a seed's window is filled from its own
    tails = [np.array([10 * (i % 2) + 100 + j for j in range(8)], np.uint16) for i in range(8)]
    rows = [(i, 8, b"", t.astype("<u2").tobytes()) for i, t in enumerate(tails)]
    out = list(packing.pack_shard(0, rows, 32))
    windows = defaultdict(set)
    for doc_id, *_, sequence, _ in out:
        windows[sequence].add(doc_id % 2)
    assert all(len(topics) == 1 for topics in windows.values())


def test_bm25_scores_equal_the_formula():
    tails = [np.array(x, np.uint16) for x in ([1, 1, 2], [2, 3], [1, 4, 4, 4], [5])]
    got = packing.ShardIndex(tails).scores(0)
    n, size = 4, [3, 2, 4, 1]
    for d, t in enumerate(tails):
        want = 0.0
        for term in {1, 2}:
            df = sum(term in x for x in tails)
            tf = int((t == term).sum())
            if tf and df > 1:
                idf = np.log1p((n - df + 0.5) / (df + 0.5))
                want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / 2.5))
        assert got[d] == pytest.approx(want)


def test_neighbours_meet_beyond_one_shard(spark):
    # 24 topics of 10 texts, ids dealt in turn: shards follow the topics, and few windows mix them
    rows = [(i, words(i, 40, 12).replace("w", f"topic{'abcdefghijklmnopqrstuvwx'[i % 24] * 3}")) for i in range(240)]
    found = packing.pack_documents(documents(spark, rows), window=256, shard_docs=20).collect()
    _check_packing(rows, found, 256)
    windows = defaultdict(set)
    for p in found:
        windows[p.sequence_id].add(p.doc_id % 24)
    assert len({p.sequence_id >> 32 for p in found}) > 6
    assert sum(len(topics) - 1 for topics in windows.values()) < len(windows) / 2


def test_statistics_cover_all_documents(spark):
    rows = [(i, words(i, 5 + i % 9, 30)) for i in range(100)] + [(100, None)]
    corpus = packing.corpus_counts(packing.tokenise(documents(spark, rows).repartition(7), PATH, 4096))
    ids = [_ids(t) + [packing.END_ID] for _, t in rows]
    assert corpus.n == 101 and corpus.mean == pytest.approx(sum(map(len, ids)) / 101)
    for term in {x for t in ids for x in t}:
        assert corpus.df[term] == sum(term in t for t in ids)
    tails = [np.array(t, np.uint16) for t in ids[:10]]
    got = packing.ShardIndex(tails, corpus).scores(0)
    for d, t in enumerate(tails):
        want = sum(np.log1p((101 - corpus.df[x] + 0.5) / (corpus.df[x] + 0.5)) * (t == x).sum() * 2.2
                   / ((t == x).sum() + 1.2 * (0.25 + 0.75 * len(t) / corpus.mean))
                   for x in set(ids[0]) if sum(x in y for y in ids[:10]) > 1)
        assert got[d] == pytest.approx(want)


def test_copies_and_repeated_rows_are_dealt_to_many_parts(spark):
    rows = [(i, "one text that very many rows share") for i in range(300)] + [(1000, words(5, 30))] * 200 + [(i, words(i, 30)) for i in range(400, 500)]
    docs = documents(spark, rows)
    tokens = packing.tokenise(docs, PATH, 64)
    sizes = [r["count"] for r in packing.deal(tokens, packing.corpus_counts(tokens), 20).groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and sorted(sizes)[-2] <= 60          # the repeated row, alike in all, stays together
    _check_packing(rows, packing.pack_documents(docs, window=64, shard_docs=20).collect(), 64)
    same = documents(spark, [(1, "same")] * 150)
    _check_packing([(1, "same")] * 150, packing.pack_documents(same, window=64, shard_docs=1).collect(), 64)


def test_a_task_that_deals_rows_has_one_python_step(spark):
    # each such step is a worker process of its own, which stays with the executor
    tokens = packing.tokenise(documents(spark, [(i, words(i, 30)) for i in range(40)]), bpe.DEFAULT_TOKENIZER, 64).localCheckpoint()
    dealt = packing.deal(tokens, packing.corpus_counts(tokens), 5)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert dealt.columns == ["doc_id", "mark", "doc_tokens", "full", "tail", "at", "part"]
    assert len({r.part for r in dealt.collect()}) > 1
