"""The five stages, one by one and as a whole, against plain versions of what they decide."""

import random
import re

import pytest

import corpus_pipeline as cp

EXTRA = ("_score", "_may", "text2", "id", "kept", "_k", "_id", "n", "h", "block", "key", "component_id", "spans")
WORDS = [f"wort{i}" for i in range(4000)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(k, prose(rng, 30)) for k in range(5)] + [(5, ""), (6, None)]
    rows = {i: prose(rng, rng.randrange(60, 160)) for i in range(120)}
    for i in range(0, 120, 6):  # junk
        rows[i] = " ".join(rng.choice(["BUY!!", "###", "|", "$$$", "%%"]) for _ in range(90))
    for i in range(1, 40, 6):  # exact and near copies
        rows[200 + i], rows[300 + i] = rows[i], rows[i] + " more words"
    for i in range(2, 26, 6):
        rows[i] += " " + items[i // 6][1]
    rows[5] += " mail jane.doe@example.org or call +1 (555) 123-4567 from 10.1.2.3"
    rows[400] = " ".join(prose(rng, 5000) for _ in range(4))
    table = [(i, t, "en", "s", len(t)) for i, t in rows.items()]
    table += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "  \n", "en", None, 3), (None, rows[7], None, None, None)] + [table[9]] * 3
    labels = [(i, int(i % 6 > 0), 0) for i in range(120)]
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return spark.read.parquet(f"{at}/documents.parquet"), dict(items), str(at)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


def test_quality_goes_by_the_labels(spark, world):
    docs, _, at = world
    kept = {r.doc_id for r in cp.quality(spark, docs, at).collect()}
    assert {i for i in range(120) if i % 6} <= kept and not {i for i in range(120) if i % 6 == 0} & kept


def test_one_of_each_group_stays(spark, world):
    docs, _, at = world
    every = rows_of(docs)
    comp = {i: i for i, _ in every if i is not None}
    sets = {i: shingles(t) for i, t in every if i is not None}
    for _ in range(3):
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = [(i, t) for i, t in every if (comp[i] == i if i is not None else False)]
    assert rows_of(cp.near_dedup(spark, docs, at)) == want


def test_documents_with_an_item_go(spark, world):
    docs, items, at = world
    tests = [s for s in map(shingles, items.values()) if s]
    want = [(i, t) for i, t in rows_of(docs) if not any(len(s & shingles(t)) >= 0.75 * len(s) for s in tests)]
    assert rows_of(cp.decontamination(spark, docs, at)) == want and len(want) < docs.count()


def test_personal_data_is_masked_and_nothing_else(spark, world):
    docs, _, at = world
    before, after = rows_of(docs), dict(rows_of(cp.personal_data(spark, docs, at)))
    assert after[5].endswith("mail <EMAIL> or call <PHONE> from <IP>")
    assert all(after[i] == t for i, t in before if i not in (5, None))


def test_columns_whatever_their_names(spark, world):
    docs, _, at = world
    wide = docs.limit(30)
    for k, name in enumerate(EXTRA):
        wide = wide.withColumn(name, docs["doc_id"] + k)
    wide = wide.cache()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, at)
        assert out.columns == wide.columns, name
        assert all(r[c] == (None if r.doc_id is None else r.doc_id + k) for r in out.collect() for k, c in enumerate(EXTRA)), name
    assert cp.packing(spark, wide, at).count() >= 30


def test_empty_tables(spark, world):
    docs, _, at = world
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), at).isEmpty(), name


def test_stages_follow_one_another(spark, world):
    docs, items, at = world
    out = cp.run(spark, at).collect()
    kept = {r.doc_id for r in out}
    assert not kept & {i for i in range(0, 120, 6)} and not kept & {2, 8, 14, 20} and not kept & {201, 301, 207, 307}
    assert {1, 3, 4, 5, 7, 400} <= kept
    whole = {}
    for r in out:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert all(r.doc_tokens == whole[r.doc_id] or sum(x.doc_id == r.doc_id and x.start == 0 for x in out) > 1 for r in out)
