"""News-like copy made from orders, customers and nations, the same in Spark and other SQL engines."""

from __future__ import annotations

TEMPLATES = [
    "Experts say <seg> orders surged because of demand in <nation>, the highest in <n> years.",
    "Nearly <n>% of buyers in <nation> left last year, and officials said the data show more than <n>,000 cases.",
    "It was reported that <nation> spent $<n>.5 million on <seg> since 2019.",
    "The board failed to meet on Tuesday in <nation>.",
    "About <n> people caused delays; doctors warned that <seg> prices plummeted in recent months.",
    "According to sources, the change led to losses and resulted in <n> million claims due to weather.",
    "<nation> exports are widely believed to be larger. Some say they rose sharply over the past <n> years.",
    "Customs and Border Patrol agents in <nation> found <n> wallets, ranked <n>th, for decades.",
    "The <seg> desk moved to a new building near the river.",
    "Many believe two billion users is highly unlikely, less than <n> cents each, at an all-time low.",
    "Upwards of $1,<n> was found to be missing as a result of errors. Analysts claim fraud contributed to it. Historically, most agree.",
    "Jane Doe of <nation> signed the lease on Monday.",
]

_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES))
TEXT = f"replace(replace(replace(CASE o_orderkey % {len(TEMPLATES)} {_CASES} END, '<n>', CAST(100 + o_custkey % 97 AS STRING)), '<seg>', lower(c_mktsegment)), '<nation>', n_name)"
LABEL = "CASE WHEN o_orderkey % 12 IN (3, 8, 11) THEN 'clean' ELSE 'flag' END"
GOLD = "CASE WHEN o_orderkey % 12 IN (3, 8, 11) THEN '' WHEN o_orderkey % 3 = 0 THEN 'quantitative_claim, temporal_claim' WHEN o_orderkey % 3 = 1 THEN 'vague_attribution,comparative_claim' ELSE 'causal_claim' END"
LLM = "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'causal_claim,vague_attribution' WHEN o_orderkey % 5 = 1 THEN 'quantitative_claim' ELSE 'comparative_claim,quantitative_claim' END"
SOURCE = "CASE o_orderkey % 5 WHEN 0 THEN 'AP wire draft' WHEN 1 THEN 'PR copy ' WHEN 2 THEN 'AI-generated memo' WHEN 3 THEN 'Blog' ELSE 'Wire service' END"
COLUMNS = {"doc_id": "o_orderkey", "text": TEXT, "human_label": LABEL, "issue_type_gold": GOLD, "llm_issue_types": LLM, "llm_flag": f"CASE WHEN ({LLM}) = '' THEN 'clean' ELSE 'flag' END", "source": SOURCE}
SQL = "SELECT " + ", ".join(f"{x} AS {k}" for k, x in COLUMNS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
