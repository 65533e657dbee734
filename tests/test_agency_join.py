import random

from pyspark.sql import functions as F

from copyrisk import fixed_values as v
from copyrisk.operators.agencies import ABBREVIATED, ARTICLE, WORD, Agency, best_match, finder, flattened, name_flags
from copyrisk.operators.agency_join import candidate_counts, name_flags_joined, name_index

FIRST = ["Office", "Bureau", "Department", "U.S. Agency", "Board", "Commission on", "Center"]
TOPICS = ["Energy", "Land Use", "Personnel", "Food, Drug and Cosmetics", "Public Health", "Trade", "Prisons", "Ocean and Air", "the Interior", "Veterans' Homes"]
STATUS = ["active", "restructured", "eliminated"]


def dimension(n):
    rng = random.Random(1)
    out = []
    for i in range(n):
        name = f"{rng.choice(FIRST)} {'of ' if rng.random() < 0.7 else ''}{rng.choice(TOPICS)}{rng.choice(['', '', ' Policy', ' Services'])}{rng.choice(['', f' Region {i % 9}'])}"
        out.append(Agency(name, (f"Ab{i}-Service Unit",) if i % 7 == 0 else (), STATUS[i % 3], 1 + i % 2))
    return out


def misspelled(rng, name):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(name))
        name = rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("aeX é") + name[i:], name.replace(" of ", " for ", 1)])
    words = name.split()
    if rng.random() < 0.2:
        rng.shuffle(words)
    return " ".join(words)


def every_window(text, agencies, tier):
    """The same search with nothing left out beforehand."""
    full = flattened(agencies, tier)[1]
    best, words, out, last = best_match(full, v.NAME_SCORE, True), [*WORD.finditer(text)], [], -1
    for i, w in enumerate(words):
        for k in range(2, min(8, len(words) - i) + 1):
            span = ABBREVIATED.sub("", ARTICLE.sub("", " ".join(x[0] for x in words[i : i + k]))).strip()
            m = best(span) if len(span) >= 8 and w.start() >= last else None
            if m and not (span.lower() in (m[0].lower(), m[1].lower()) and m[2] == "active"):
                last = words[i + k - 1].end()
                out.append((w.start(), last))
                break
    return out


def test_pieces_lose_no_window():
    rng, agencies = random.Random(4), dimension(120)
    names = finder(agencies, 2)[1]
    found = 0
    for _ in range(150):
        text = " and ".join(misspelled(rng, rng.choice(agencies).canonical) for _ in range(3))
        want = every_window(text, agencies, 2)
        assert [x[:2] for x in names(text)] == want
        found += len(want)
    assert found > 100


def rows(df):
    return sorted((r.doc_id, r.start, r.end, r.text, r.reason, r.seq, r.flag_type, r.priority) for r in df.collect())


def test_join_gives_the_rows_of_the_plain_search(spark):
    rng, agencies = random.Random(3), dimension(300)
    docs = []
    for i in range(400):
        said = [misspelled(rng, rng.choice(agencies).canonical) for _ in range(rng.randrange(4))]
        docs.append((i, f"{rng.choice(['The ', 'the ', '', 'é '])}" + f" {rng.choice(['met', 'and the', '😀 of', '.'])} ".join(said) + " left."))
    docs += [(900, None), (901, ""), (902, "Office"), (903, docs[0][1]), (None, docs[1][1]), (904, "Public Health " * 300)]
    df = spark.createDataFrame([(*d, "k", [1]) for d in docs], "doc_id long, text string, key string, ids array<int>")
    for tier in (1, 2):
        plain = rows(name_flags(df.filter("doc_id is not null"), agencies, tier))
        assert len(plain) > 150
        assert rows(name_flags_joined(df.filter("doc_id is not null"), agencies, tier)) == plain
    assert name_flags_joined(df.filter("doc_id is null"), agencies, 2).count() == name_flags(df.filter("doc_id is null"), agencies, 2).count()
    n = candidate_counts(df, agencies, 2).first()
    assert n.near < n.windows and n.pairs < n["keys"] * len(name_index(agencies, 2))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "Ofice of Energy")], "doc_id long, text string")
    assert name_flags_joined(df, []).count() == 0
    assert name_flags_joined(df.limit(0), dimension(20)).count() == 0
    assert name_flags_joined(df.withColumn("text", F.lit(None).cast("string")), dimension(20)).count() == 0
    # a short name, nearly as short as its windows
    assert rows(name_flags_joined(df.withColumn("text", F.lit("at Ab Cdef x")), [Agency("Ab Cdefg", (), "active", 1)])) == rows(name_flags(df.withColumn("text", F.lit("at Ab Cdef x")), [Agency("Ab Cdefg", (), "active", 1)]))
