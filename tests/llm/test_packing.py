import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from copyrisk.llm.packing import Bm25, default_tokenizer, fill_windows, pack_documents, shard_plan

TEXTS = [
    "", None, " ", "one", "Größe naïve 東京 😀 don't", "x" * 9000, "tab\tand\nline\r\nends  here \x0b\x0c ", "nbsp joins   em", "a\x00b\x1cc \x85 d",
    "<|endoftext|> and <|startoftext|>", " ".join(f"word{i % 700}" for i in range(9000)), "é" * 50, "!!!###$$$ ...", "same text", "same text",
]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_tokenizer())
    return lambda text: own.encode(text or "", add_special_tokens=False).ids + [1]


def held(rows, texts, encode, window=2048):
    """Each document's pieces are its ids, each once; sequences are gapless and within the window."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = encode(text), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_pieces_are_the_tokenizers_ids(spark, encode):
    texts = dict(enumerate(TEXTS))
    rows = pack_documents(spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, shard int")).collect()
    held(rows, texts, encode)


def topics(n, seed=5):
    """Texts of a few of whose words only those of the same topic have."""
    rng, common = random.Random(seed), [f"word{i}" for i in range(300)]
    names = "zebra quartz violin glacier pepper lantern anchor saffron".split()
    return {i: " ".join(rng.choices(common, k=rng.randrange(60, 200)) + [names[i % 8]] * 6) for i in range(n)}


def test_windows_hold_neighbours_wherever_they_stand(spark, encode):
    texts = topics(400)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pack_documents(table.repartition(7, "doc_id"), shard_tokens=20_000).collect()
    sequences = held(rows, texts, encode)
    met = [Counter(r.doc_id % 8 for r in own).most_common(1)[0][1] / len(own) for own in sequences.values() if len(own) > 3]
    assert sum(met) / len(met) > 0.8  # 0.35 by chance


def test_file_splits_do_not_matter(spark):
    texts = list(topics(120).items()) + [(500, "same"), (501, "same")]
    one = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    two = spark.createDataFrame(texts[::-1], "doc_id long, text string").repartition(9)
    a, b = (sorted(map(tuple, pack_documents(t, shard_tokens=8000).collect())) for t in (one, two))
    assert a == b


def test_repeated_rows_null_ids_and_no_rows(spark, encode):
    table = spark.createDataFrame([(7, "one two")] * 3 + [(None, "null id"), (None, None)], "doc_id long, text string")
    rows = pack_documents(table).collect()
    assert sum(r.length for r in rows) == 3 * len(encode("one two")) + len(encode("null id")) + 1
    assert pack_documents(table.limit(0)).isEmpty()


def test_scores_are_those_of_a_plain_model():
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.3, rng.integers(5, 400)) % 900 for _ in range(120)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=900)
    mean = np.mean([len(d) for d in docs])
    seeds = np.array([3, 50, 51, 110])
    got = Bm25(df, len(docs), mean).scores(docs, seeds)
    for k, s in enumerate(seeds):
        for j, d in enumerate(docs):
            tf = Counter(d.tolist())
            want = sum(
                math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))
                for t in set(docs[s].tolist())
                if t in tf and df[t] > 1
            )
            assert s == j or abs(got[k, j] - want) < 1e-3 * max(1, want)


def test_seeds_take_their_best_unused_neighbours():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 200, n) for n in rng.integers(10, 90, 60)]
    sizes = np.array([len(d) + 1 for d in docs])
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=200)
    model = Bm25(df, 60, float(np.mean(sizes - 1)))
    pieces = list(fill_windows(sizes.copy(), docs, model, 128))
    seeds = [d for k, (d, left, n, s) in enumerate(pieces) if k == 0 or pieces[k - 1][3] != s][: int(sizes.sum()) // 128]
    scores, rest = model.scores(docs, np.array(seeds)), sizes.copy()
    rest[seeds] = 0
    for k, s in enumerate(seeds):
        own, room = [p for p in pieces if p[3] == pieces[0][3] + k], 128 - sizes[s]
        assert own[0][0] == s
        for d, left, n, _ in own[1:]:
            assert left == rest[d] and n == min(room, left)
            assert scores[k, d] >= scores[k][rest > 0].max() - 1e-4
            rest[d] -= n
            room -= n
        assert room == 0


def test_large_topics_are_divided_and_small_ones_meet():
    first, pieces = shard_plan(np.array([5, 2, 9, 4]), np.array([3.2, 0.4, 0.5, 0.3]))
    assert pieces[[2, 4, 5, 9]].tolist() == [1, 1, 4, 1] and first[2] == first[4] == 0
    assert first[5] == 1 and first[9] == 5


def test_words_are_encoded_as_by_the_library(encode):
    from copyrisk.llm.tokens import WordTokens

    rng = random.Random(12)
    parts = "a e the ing ção über ß ñ 's 't ' . , ; ... !? 12 3.4 - — A B É ﬁ Ⅷ İ ǅ ɐ Å ̊ 東 😀 \x85 \xa0 <|endoftext|> <|EndOfText|>".split(" ")
    texts = ["".join(rng.choices([*parts, " ", " ", "\n", "\t"], k=rng.randrange(0, 60))) for _ in range(1500)] + ["a" * 500 + " " + "é," * 90, "x" * 63 + " " + "x" * 64 + " " + "x" * 65]
    own = WordTokens(default_tokenizer())
    for k in range(0, len(texts), 200):
        for t, ids in zip(texts[k:], own.encode([t.encode() for t in texts[k : k + 200]], 1)):
            assert ids.tolist() == encode(t), t
