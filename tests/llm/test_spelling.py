import random
import re
from binascii import crc32
from collections import Counter

import pytest

from copyrisk.llm import scratch, spelling
from copyrisk.llm.spelling import spelling_variants, word_counts


def counted(docs, least=7, few=2, every=31):
    found = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = crc32(f"{'' if i is None else i}:{r}".encode())
            w = r[: h % len(r)] + r[h % len(r) + 1 :] if h % every == 0 else r
            found[w] += len(w) >= least
    return {w: n for w, n in found.items() if n >= few}


def apart(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs, **how):
    n = counted(docs, **how)
    near = {w: sorted((x for x in n if apart(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 10 * n[w] else None for w in n}

    def last(w):
        return last(form[w]) if form[w] else w

    return {(w, form[w], last(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("hot_share", [0, 3, 2000])
@pytest.mark.parametrize("broadcast", [True, False])
def test_against_all_pairs(spark, monkeypatch, hot_share, broadcast):
    """Doubled characters, words that end inside others, few letters, no and many hot edges."""
    monkeypatch.setattr(spelling, "HOT_SHARE", hot_share)
    if not broadcast:
        monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    rng = random.Random(hot_share)
    docs = [(i, " ".join("".join(rng.choices("aabbé", k=rng.randrange(6, 10))) for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(100, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3), (101, "Straßenbahn strassenbahn Strasenbahn " * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = spelling_variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(found) == expected(docs)


def test_forms_lead_to_roots(spark):
    text = "correctly " * 3000 + "corectly " * 200 + "corectl " * 9 + "corectk other words " + "ÀÉtranger àétranger " * 2
    docs = [(7, text), (8, text.upper())]
    found = rows(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found == expected(docs)
    assert ("corectl", "corectly", "correctly") in {r[:3] for r in found}


def test_odd_rows(spark):
    """Null ids and texts, empty and repeated rows, other columns with the names of inner ones."""
    docs = [(None, "lettering letterings"), (1, None), (2, ""), (3, "lettering lettering"), (3, "lettering lettering"), (4, "×÷letters" * 40), (5, "x" * 50_000 + " " + "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert rows(spelling_variants(df.limit(0))) == set()
    assert {(r.word, r.n) for r in word_counts(df).collect()} == set(counted(docs).items())
    short = [d for d in docs if d[0] != 5]
    assert rows(spelling_variants(df.filter("doc_id is null or doc_id <> 5"))) == expected(short)
