"""Operators with a trained part: their fixed columns against brute force, their verdicts on rows held out."""

import random
import re
import time
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from copyrisk.llm import pii
from copyrisk.llm.boosting import classify_quality, drop_low_quality
from copyrisk.llm.html_text import extract_text
from copyrisk.llm.isolation import op4_quality_rules
from copyrisk.llm.sharding import op2_sharding, shard_by_size
from copyrisk.llm.url_filter import judge_urls

ODD = [None, "", " \n\t", "one", "a\nb\na\n\n \na", "x y z x y z x y z", "é b   c", "# * $%&|<> #", "word " * 300, "\x0bA\x0c B\x1c C"]
_COMMON = "the of and to in is that it was for on are with as at be this from have or by one had not but what all were when we there can".split()


def good(rng):
    return " ".join(rng.choice(_COMMON) if rng.random() < 0.5 else f"word{rng.randrange(5000)}" + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(60, 300)))


def bad(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(["CLICK", "###", "|", "$$$", "<<>>", "BUY!!", "&&"]) + str(rng.randrange(100)) for _ in range(rng.randrange(60, 200)))
    if kind == 1:
        return "\n".join([" ".join(f"menu{i}" for i in range(7))] * rng.randrange(12, 40))
    return " ".join("".join(rng.choices("BCDFGHJKLMNPQRST%*#", k=9)) for _ in range(rng.randrange(60, 200)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(480)] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id long, text string, kept string, _score double").cache()
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(480)], "doc_id long, quality int, toxic int")
    return dict(rows), docs, labels


def test_rule_columns_against_brute_force(corpus):
    texts, docs, labels = corpus
    rows = {r.doc_id: r for r in op4_quality_rules(docs, labels).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        t, r = text or "", rows[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in lines
                lines.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    open_ = [i for i in range(480) if not rows[i].base_failed]
    assert sum(rows[i].kept for i in open_ if i % 4) > 0.98 * sum(i % 4 > 0 for i in open_)
    assert sum(not rows[i].kept for i in open_ if i % 4 == 0) > 0.8 * sum(i % 4 == 0 for i in open_)


def test_rules_without_labels_or_rows(corpus):
    _, docs, labels = corpus
    assert all(r.kept != r.base_failed for r in op4_quality_rules(docs, labels.limit(0)).collect())
    assert op4_quality_rules(docs.limit(0), labels).isEmpty()


def test_quality_of_rows_held_out(corpus):
    texts, docs, labels = corpus
    rows = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    assert set(rows) == set(texts)
    out = [r for r in rows.values() if r.held_out]
    assert {r.doc_id for r in out} == {i for i in texts if crc32(str(i).encode()) % 5 == 0} and len(out) > 60
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    known = [r for r in out if r.doc_id < 480]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in known) > 0.95 * len(known)
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def expected_base(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+12", "a.b@c.d", "x@y", "é", " ", "-", "@", ".", "12", "+49 30 123456789", "0001.2.3.4", "a@b.c@d.e", "\n", "(", "5500-0000-0000-0004 12"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(400)] + ODD
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want, r = expected_base(t), rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)], t
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == sha256(",".join(written).encode()).hexdigest(), t
        every = r.spans.split(",") if r.spans else []
        assert set(written) <= set(every) and len(every) == r.n_spans


def test_time_grows_with_the_numbers_alone():
    text = " ".join(f"555-{k % 1000:03d}-{k % 10000:04d}x" for k in range(100_000))
    start = time.time()
    assert len(pii.candidates(text, pii.base_spans(text))) == 100_000
    assert time.time() - start < 10


def test_reliabilities_are_recovered_from_planted_votes():
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.6, 0.7, 0.85, 0.55, 0.8])
    votes = np.where(rng.random((len(truth), 7)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table, share = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.03
    assert np.abs(table[1, :, 2] - right).max() < 0.04 and np.abs(table[0, :, 0] - right).max() < 0.04
    assert ((post[back.ravel()] > 0.5) == truth).mean() > 0.95


def test_masked_texts_hold_no_base_span(spark):
    texts = ["mail jane@example.org or +1 555 123 4567.", "from 10.0.0.1 to 10.0.0.2", None, "", "nothing here"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    out = pii.mask_personal_data(docs)
    got = [r.text for r in out.orderBy("doc_id").collect()]
    assert out.columns == docs.columns and got == ["mail <EMAIL> or <PHONE>.", "from <IP> to <IP>", None, "", "nothing here"]
    assert pii.mask_personal_data(docs.limit(0)).isEmpty()


def test_redirects_spread_blocks_and_allows(spark):
    """Chains, a hub, both verdicts in one component, and pages of no host, against a plain search."""
    urls = ["http://a.net/es/1", *(f"http://b{k}.org/{k}" for k in range(12)), "http://www.example.com/en/x", "http://c.net/fr/", "http://shop.com/", "nothing", None, "http://alone.org/", "HTTP://UP.net/ES/"]
    links = [(f"http://b{k}.org/{k}", f"http://b{k + 1}.org/{k + 1}") for k in range(5)] + [("http://b5.org/5", "http://a.net/es/1")]
    links += [(f"http://b{k}.org/{k}", "http://hub.org/") for k in range(7, 10)] + [("http://hub.org/", "http://c.net/fr/"), ("http://www.example.com/en/x", "http://hub.org/")]
    pages = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame(links, "src string, dst string")
    rows = {r.page_id: r for r in judge_urls(pages, redirects=redirects).collect()}

    def ruled(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
        fit = [k for k in rules if (f".{host}".endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1]) and host]
        return (best := max(fit, key=len, default=None)), rules.get(best), host, path

    group = {u: {u} for x in links for u in x}
    for a, b in links:
        both = group[a] | group[b]
        for u in both:
            group[u] = both
    for i, u in enumerate(urls):
        rule, verdict, host, path = ruled(u)
        near = {ruled(x)[1] for x in group.get(u, ())}
        want = verdict or ("allow" if "allow" in near else "block" if "block" in near else "allow")
        assert (rows[i].rule, rows[i].verdict, rows[i].host, rows[i].path) == (rule, want, host, path), u
    assert [rows[i].verdict for i in (1, 8)] == ["block", "allow"]


@pytest.mark.parametrize("step_rows", [7, 100])
def test_shards_are_even_however_many_steps_a_range_has(spark, step_rows):
    texts = [(i, f"text {i % 170} " * (1 + i % 9)) for i in range(400)] + [(500 + i, "copy") for i in range(200)]
    table = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    rows = shard_by_size(table, 4, sample=60, ranges_per_shard=2, step_rows=step_rows).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    fair = sum(r.size for r in rows) / 4
    for s in range(4):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - fair) <= max(r.size for r in rows)


def test_shards_are_even_though_rows_repeat(spark):
    rng = random.Random(1)
    texts = [(i, "é" * rng.randrange(0, 400)) for i in range(3000)] + [(7, "same text of many rows")] * 2000 + [(i, t) for i, t in enumerate(ODD)]
    rows = op2_sharding(spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, shard int")).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, size(t), crc32((t or "").encode())) for i, t in texts)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(16):
        own = [r for r in rows if r.shard == s]
        assert abs(sum(r.size for r in own) - total / 16) <= largest and sorted(r.slot for r in own) == list(range(len(own)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


PAGES = [
    ("<html><head><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line\nof text.</p><p>Second one.<br>More of it.</p></article><footer>&copy; 2020 Us</footer></body></html>", "A & B\n\nFirst line of text.\n\nSecond one. More of it."),
    ('<body><div id="menu"><a href=/a>One</a> <a href=/b>Two</a></div><main><h2>Title of it</h2><p>Prose that goes on, with a comma, and ends.</p><aside class="sidebar"><p>Read also this.</p></aside><ul><li>A point of it.</li></ul></main><section class="comments"><h3>Comments</h3><div class="comment"><b>Joe</b><p>I disagree with this.</p></div></section></body>', "Title of it\n\nProse that goes on, with a comma, and ends.\n\nA point of it."),
    ('<div class="cookie-notice"><p>We use cookies.</p></div><div class="post-content"><p>Only this is told here, in a sentence.</p></div><form><label>Mail</label><input></form>', "Only this is told here, in a sentence."),
    ("", ""), (None, ""), ("<script>var a = 1</script>", ""),
]


def test_main_text_of_pages_written_by_hand(spark):
    table = spark.createDataFrame([(i, f"http://x/{i}", h, "y") for i, (h, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, text string")
    rows = extract_text(table).collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        assert (r.text, r.n_chars, r.url) == (PAGES[r.page_id][1], len(PAGES[r.page_id][1]), f"http://x/{r.page_id}")
    assert extract_text(table.limit(0)).isEmpty()
