import re
from collections import Counter

import pytest

from copyrisk import rules
from copyrisk.operators import agencies, flags
from copyrisk.operators.agencies import Agency, best_match, flattened, name_flags, similarity
from copyrisk.sources.files import read_agencies, read_rules

FILE = """agencies:
  - {canonical: Department of Justice, abbreviations: [DOJ], status: active, tier: 1}
  - {canonical: Office of Personnel Management, abbreviations: [OPM], status: restructured, tier: 1}
  - {canonical: Bureau of Small Things, abbreviations: [], status: active, tier: 2}
"""
RULES = """patterns:
  - {flag_type: agency_name, priority: High, reason: wrong name, pattern: '\\bBorder Police\\b'}
  - {flag_type: trend_language, priority: Low, reason: off, pattern: board, enabled: false}
  - {flag_type: broken, priority: Low, reason: no}
"""
TEXTS = [
    (1, "Experts say the Department of Justise met OPM because of 5% cuts. The data confirmed it in May 2020."),
    (1, "OPM and the Border Police board led to the Office of Personnel Managment."),
    (2, ""),
    (3, None),
    (4, "   "),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "agencies.yaml").write_text(FILE)
    (at / "rules.yaml").write_text(RULES)
    (at / "bad.yaml").write_text("a: [")
    return at


def test_all_stages_are_sorted_and_deduplicated_together(spark, files):
    known, registry = read_agencies(spark, str(files / "agencies.yaml")), read_rules(spark, str(files / "rules.yaml"))
    assert [r.enabled for r in registry] == [True, False]
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = Counter((r.doc_id, r.start, r.end, r.flag_type, r.text) for r in flags.flag_text(df, known, registry).collect())
    want = Counter()
    for i, text in TEXTS:
        text = text or ""
        found = [(m.start(), {"High": 0, "Medium": 1, "Low": 2}[r.priority], r.seq, m.end(), r.flag_type) for r in rules.all_rules(registry) for m in re.finditer(r.pattern, text, re.I)]
        for seq, find in zip(agencies.SEQ, agencies.finder(known)):
            found += [(a, 0, seq, b, "agency_name") for a, b, _ in find(text)]
        ends = {}
        for a, _, _, b, kind in sorted(found):
            if a >= ends.get(kind, 0):
                ends[kind] = b
                want[i, a, b, kind, text[a:b]] += 1
    assert got == want
    kinds = {k[3] for k in got}
    assert {"agency_name", "causal_claim", "certainty_language", "quantitative_claim", "temporal_claim", "vague_attribution"} <= kinds
    assert sorted(k[4] for k in got if k[3] == "agency_name") == ["Border Police", "OPM", "OPM", "the Department of Justise", "the Office of Personnel Managment"]


def test_missing_and_broken_files_warn(spark, files):
    for name in ("none.yaml", "bad.yaml"):
        with pytest.warns(UserWarning):
            assert read_rules(spark, str(files / name)) == [] and read_agencies(spark, str(files / name)) == []


def test_bounds_lose_no_match():
    index = flattened([Agency("Federal Bureau of Investigation", ("FBI",)), Agency("U.S. Agency for International Development", ("USAID", "USAgency")), Agency("DEPARTMENT OF STATE")], 2)[1]
    find = best_match(index, 93.0, True)
    for s in ("Federal Bureau of Investigation", "federal Bureau of Investigation", "Federal Bureau of investigations", "Federal Burea f Investigation", "Bureau Federal of Investigation", "department of state", "DEPARTMENT OF STTE", "US Agency", "USAgency", "USAgencyy"):
        key = " ".join(sorted(s.split()))
        best = max(similarity(key, " ".join(sorted(x[0].split()))) for x in index)
        assert (find(s) or [0])[-1] == (best if best >= 93 else 0), s


def test_rows_of_one_id_do_not_meet(spark):
    df = spark.createDataFrame([(1, "the Department of Justise"), (1, "the Department of Justise")], "doc_id long, text string")
    assert name_flags(df, [Agency("Department of Justice", (), "active", 1)]).count() == 2
