import re
from collections import Counter
from itertools import permutations

from copyrisk.llm.filter_audit import op13_filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (3, LONG, None), (4, LONG.upper(), ""), (5, "one two", "a"), (6, None, "a"), (7, "", "b"), (8, "x " * 60, "b"),
    (9, LONG + " | # end", "b"), (None, LONG, "b"), (10, "AÉ B\x0bC\tD\x0cE\r\n" * 30, "c"), (1, LONG, "a"), (11, "$ " * 20_000 + "Ab" * 9, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (7, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1)]


def fails(t, i, docs):
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    same = [j for j, x, _ in docs if (x or "") == t and j is not None]
    return {
        "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
        "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > min(same),
    }


def brute(docs, labels):
    out = {}
    for i, t, s in docs:
        f, part = fails(t or "", i, docs), s or ""
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels) if i is not None else False for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            first = next((k for k, x in enumerate(order, 1) if f[x]), 9)
            for step, x in enumerate(order, 1):
                row = out.setdefault((part, order, step), Counter())
                gone = first == step
                row.update(kept=first > step, removed=gone, redundant=f[x] and first < step, unique_fails=f[x] and sum(f.values()) == 1, good_lost=gone and good, toxic_lost=gone and toxic)
    share = Counter()
    for (part, order, step), row in out.items():
        share[part, order[step - 1]] += row["removed"]
    return {k: (*(row[c] for c in COUNTS[:-1]), share[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_every_order_against_a_plain_replay(spark):
    docs = spark.createDataFrame([(*d, "A", 3, False) for d in DOCS], "doc_id long, text string, source string, part string, n int, E boolean")
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, digest string")
    rows = op13_filter_audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(rows) == len(found) == 600 * 4  # null and empty sources are one part
    assert found == brute(DOCS, LABELS)
    assert op13_filter_audit(docs.limit(0), labels).count() == 0
    assert op13_filter_audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
