import random
import re
from hashlib import sha256

import pytest

from copyrisk.llm import near_dup, scratch
from copyrisk.llm.boosting import classify_quality
from copyrisk.llm.decontaminate import contaminated, drop_contaminated
from copyrisk.llm.html_blocks import blocks
from copyrisk.llm.near_dup import near_duplicates
from copyrisk.llm.packing import pack_documents
from copyrisk.llm.pii import personal_data
from copyrisk.llm.sharding import op2_sharding
from copyrisk.llm.suffix_dedup import remove_repeats
from copyrisk.llm.url_filter import link_edges

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[:120])
DOCS = [
    (0, LONG),
    (1, LONG),
    (2, " ".join(WORDS[:119]) + " other"),
    (3, " ".join(WORDS[200:300]) + " " + " ".join(WORDS[20:80])),
    (4, "short text"),
    (5, ""),
    (6, None),
    (7, "ab" * 300),
    (8, "mail me at jane@example.org or 10.0.0.1 now"),
    (9, " ".join(WORDS[300:360])),
    (10, "é" * 150 + " ".join(WORDS[300:330])),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, kept string")


@pytest.fixture(params=["small", "large"])
def sizes(request, monkeypatch):
    """Joins as with small tables, and as with tables too large to broadcast."""
    if request.param == "large":
        monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_repeats_against_brute_force(docs, sizes):
    raw = {i: (t or "").encode() for i, t in DOCS}
    starts = {}
    for i, b in raw.items():
        for a in range(len(b) - 199):
            starts.setdefault(b[a : a + 200], []).append((i, a))
    gone = {i: set() for i in raw}
    for places in starts.values():
        if len(places) > 1:
            for i, a in places:
                gone[i].update(range(a, a + 200))
    for how in ({}, {"shard_bytes": 300, "merged": 5}):
        rows = {r.doc_id: r for r in remove_repeats(docs, **how).collect()}
        compare_repeats(raw, gone, rows)


def compare_repeats(raw, gone, rows):
    for i, b in raw.items():
        runs = sum(k - 1 not in gone[i] for k in gone[i])
        kept = sha256(bytes(x for k, x in enumerate(b) if k not in gone[i])).hexdigest()
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(b), len(gone[i]), runs, kept), i


def test_near_duplicates_against_brute_force(docs, sizes):
    sets = {i: shingles(t) for i, t in DOCS}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    rows = near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(i, len(s), comp[i], comp[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("open_pairs", [0, 20_000])
def test_shared_passages_against_brute_force(spark, monkeypatch, open_pairs):
    """Texts that share most of their words without being similar, with similar ones among them."""
    monkeypatch.setattr(near_dup, "OPEN_PAIRS", open_pairs)
    rng = random.Random(4)
    texts = []
    for i in range(60):
        own = [f"x{i}_{k}" for k in range(rng.randrange(20, 60))]
        texts.append(WORDS[:80] + own)
        if i % 4 == 0:
            texts.append(WORDS[:80] + own[:-3] + [f"y{i}"])
        if i % 5 == 0:
            texts.append(WORDS[: 80 - i % 3] + own + own[:4])
    sets = [shingles(" ".join(t)) for t in texts]
    comp = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if comp[i] != comp[j] and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    rows = near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(comp))


def test_containment_against_brute_force(spark, docs, sizes):
    items = [(0, " ".join(WORDS[30:60])), (1, "short text"), (2, ""), (3, None), (4, " ".join(WORDS[310:330]) + " new words that differ from it here and there")]
    want = set()
    for i, t in DOCS:
        for k, x in items:
            a, b = shingles(t), shingles(x)
            if b and len(a & b) >= 0.75 * len(b):
                want.add((i, k, len(a & b)))
    got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and want


def test_packing_holds_each_token_once(docs):
    rows = pack_documents(docs, shard_tokens=300).collect()
    for i, _ in DOCS:
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert own[0][0] == 0 and sum(x[1] for x in own) == own[0][2]
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    for q in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == q)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(x[1] for x in own) <= 2048


def test_personal_data(docs):
    r = {x.doc_id: x for x in personal_data(docs).collect()}
    assert len(r) == len(DOCS) and (r[8].n_email, r[8].n_ip, r[6].n_email) == (1, 1, 0)
    assert r[8].base_sha256 == sha256(b"email:11:27,ip:31:39").hexdigest() and r[6].spans == ""


def test_shards_have_all_rows(docs):
    rows = op2_sharding(docs).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in DOCS] and all(0 <= r.shard < 16 for r in rows)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify_quality(none, labels).isEmpty() and classify_quality(docs, labels).count() == len(DOCS)
    for f in (remove_repeats, near_duplicates, pack_documents, personal_data, op2_sharding):
        assert f(none).isEmpty(), f


def test_html_blocks_of_tags_with_long_values_and_open_quotes():
    for value in ("x" * 10_000, "a>b" * 3000):
        for q in "\"'":
            got = blocks(f"<div class=content><p>one</p><div class=sidebar data-props={q}{value}{q}>two</div><p>three</p></div>")
            assert [(b.text, b.path) for b in got] == [
                ("one", (("div", "content"), ("p", ""))),
                ("two", (("div", "content"), ("div", "sidebar"))),
                ("three", (("div", "content"), ("p", ""))),
            ]
    got = blocks("<div class=content><p>one</p><div id=aside title='x>two</div ><p>three</p></div>")
    assert [(b.text, b.path[-1][0]) for b in got] == [("one", "p"), ("two", "div"), ("three", "p")] and len(got[2].path) == 2


def test_contaminated_rows_with_null_or_shared_ids(spark, sizes):
    hit, clean = " ".join(WORDS[30:60]), " ".join(WORDS[200:240])
    rows = [(None, hit), (None, clean), (1, hit), (1, clean), (2, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, hit)], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id, r.n_shared) for r in contaminated(table, items).collect()), key=str) == [(1, 0, 26), (None, 0, 26)]
    got = [(r.doc_id, r.text) for r in drop_contaminated(table, items).collect()]
    assert sorted(got, key=str) == sorted(((i, x) for i, x in rows if x != hit), key=str)


def test_near_duplicates_with_null_or_shared_ids_go(spark, sizes):
    clean = " ".join(WORDS[200:290])
    rows = [(0, LONG), (None, LONG), (1, LONG), (1, clean), (None, "some other text of its own"), (None, None)]
    got = [(r.doc_id, r.text) for r in near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([rows[0], *rows[3:]], key=str)


def test_link_targets_are_resolved(spark):
    pages = [
        ("http://a.net/es/x.html", '<link rel=canonical href="page.html">', "a.net/es/page.html"),
        ("http://a.net/es/d/x", '<link rel="canonical" href="../a">', "a.net/es/a"),
        ("http://a.net/es/x", '<link rel="canonical" href="?id=1&amp;y=2">', "a.net/es/x?id=1&y=2"),
        ("http://a.net/es/x", '<base href="http://b.net/q/"><meta http-equiv=refresh content="0; url=r&#46;html">', "b.net/q/r.html"),
        ("http://a.net/es/x", '<link rel="canonical" href="HTTP://C.net/z">', "c.net/z"),
        ("http://a.net/es/x", '<link rel="canonical" href="mailto:me">', None),
    ]
    table = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    assert sorted(r.b for r in link_edges(table).collect()) == sorted(b for _, _, b in pages if b)


def test_near_duplicates_of_ids_with_several_texts(spark, sizes):
    """Two classes of texts whose least id is the same."""
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, " ".join(WORDS[200:240])), (4, a + " z z"), (9, " ".join(WORDS[200:240]) + " q")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == [(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 36, 4, True), (4, 58, 1, False), (9, 37, 4, False)]


def test_decontamination_of_long_and_repeated_ids(spark, sizes):
    item = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(1, "z " * 50_000 + item), (1, "clean text of no use"), (None, item), (2, item), (2, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.n_item, r.n_shared) for r in contaminated(docs, items).collect()) == [(0, 7, 26, 26), (1, 7, 26, 26), (2, 7, 26, 26)]
    assert [r.text for r in drop_contaminated(docs, items).collect()] == ["clean text of no use"]
