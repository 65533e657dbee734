"""Spelling variants: words of one corpus that differ by one character, tied to the frequent form.

The words form a trie.  At each node the child with the most words is heavy and the others are
light, so that a word takes at most log2(words) light edges.  Two words part at one node, and one of
them at least takes a light edge there.  So it is enough to merge, at each node, the light subtrees:
into the heavy one with the light character replaced or with the heavy one put before it, into the
node itself with the light character skipped, and into each other with it replaced by any.
Terminals that coincide are the pairs, and each pair is met exactly once.

The trie is a table of its edges; nothing of it is gathered in one place.  All stages after the
counting of words are of the size of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import scratch, small_or_not, stage_table

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends a word in the trie; no letter, and before all of them.
END = "$"
#: An edge with more than one word in so many is looked up in a broadcast table, so that no short
#: prefix gathers its words in one task.
HOT_SHARE = 2000


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """``word, n`` of the words with ``least_length`` code points that occur ``least_count`` times.

    ``docs``: ``doc_id, text``; a null text has no words, and a null id is written as nothing.  Words
    are maximal runs of letters, A-Z lower-cased.  Where the CRC-32 of ``<doc_id>:<word>`` is a
    multiple of ``every``, the word loses the character at that hash modulo its length.
    """
    # a run that is too short stays so, whatever it loses
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _edges(words: DataFrame) -> DataFrame:
    """``node, size, light, heavy`` of each edge of the trie, by the prefix that it ends.

    A node has no more children than there are letters, so their list is bounded."""
    whole = F.concat("word", F.lit(END))
    step = F.explode(F.sequence(F.lit(1), F.length("word") + 1))
    sizes = words.select(whole.alias("w"), step.alias("i")).groupBy(F.substring("w", F.lit(1), F.col("i")).alias("node")).agg(F.count("*").alias("size"))
    child = F.struct("size", F.substring("node", -1, 1).alias("c"))
    above = F.substring("node", F.lit(1), F.length("node") - 1)
    kids = sizes.groupBy(above.alias("above")).agg(F.collect_list(child).alias("kids"))
    each = kids.select("above", F.array_max("kids")["c"].alias("heavy"), F.explode("kids").alias("k"))
    return each.select(F.concat("above", "k.c").alias("node"), F.col("k.size").alias("size"), (F.col("k.c") != F.col("heavy")).alias("light"), "heavy")


def light_steps(words: DataFrame) -> DataFrame:
    """``word, n, i, heavy``: the places (from 1) at which a word takes a light edge, past its end too."""
    total = words.count()
    hot = F.col("size") * HOT_SHARE > total
    edges = stage_table(_edges(words).withColumn("hot", hot).filter("hot or light"), "trie")
    # of each depth there are at most HOT_SHARE hot ones; unless they fit, the join shuffles and adaptive execution splits it
    few, _ = small_or_not(stage_table(edges.filter("hot").select("node", F.col("light").alias("hot_light"), F.col("heavy").alias("hot_heavy")), "trie-hot"))
    step = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    step = step.withColumn("node", F.substring(F.concat("word", F.lit(END)), F.lit(1), F.col("i")))
    met = step.join(few, "node", "left")
    known = met.filter("hot_light").select("word", "n", "i", F.col("hot_heavy").alias("heavy"))
    rest = met.filter("hot_light is null").select("node", "word", "n", "i")
    return known.unionByName(rest.join(edges.filter("not hot").select("node", "heavy"), "node").select("word", "n", "i", "heavy"))


def _best(word: Column, n: Column) -> Column:
    """Orders words by falling ``n``, then by code points: the least is the best."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: words of ``words`` that are one insertion, deletion or replacement away.

    ``words``: staged ``word, n``, each word once and without :data:`END`.  ``best.word`` is the near word of the largest
    ``n`` (``-best.less``), the first in code-point order among several.  Words without one are left out.
    Groups of words that share all but one place aren't expanded into pairs: a group's two best
    words are the answer for all its members.
    """
    light = stage_table(light_steps(words), "light")
    before, own = F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i"), F.lit(1))
    after = F.substring("word", F.col("i") + 1, F.length("word"))
    ends = F.col("i") > F.length("word")
    put_before = F.concat(before, "heavy", own, after)
    # of a doubled character the second is skipped, at the node below
    skipped = F.when(own != F.substring(after, 1, 1), F.concat(before, after))
    tried = F.when(ends, F.array(put_before)).otherwise(F.array(put_before, F.concat(before, "heavy", after), skipped))
    asked = light.select("word", "n", F.explode(F.array_compact(tried)).alias("other"))
    met = asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.explode(F.array(F.struct(F.col("word").alias("word"), _best(F.col("other"), F.col("other_n")).alias("best")), F.struct(F.col("other").alias("word"), _best(F.col("word"), F.col("n")).alias("best"))))
    pairs = met.select(both.alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")
    # light subtrees among each other
    group = light.filter(~ends).groupBy(before.alias("before"), after.alias("after")).agg(F.array_sort(F.collect_list(_best(F.col("word"), F.col("n")))).alias("all")).filter(F.size("all") > 1)
    other = lambda x: F.when(x["word"] == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    each = F.explode(F.transform("all", lambda x: F.struct(x["word"].alias("word"), other(x).alias("best")))).alias("x")
    grouped = group.select((F.size("all") - 1).cast("long").alias("n_near"), each).select("x.word", "n_near", "x.best")
    return pairs.unionByName(grouped).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for staged rows ``word, form``: the last word that is reached from form to form.

    Each round doubles the steps that are taken, until none changes.
    """
    found = forms.select("word", F.col("form").alias("root"))
    with scratch() as kept:
        while True:
            on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
            found = stage_table(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            if not found.filter("moved").limit(1).count():
                kept.append(found)
                return found.drop("moved")
            found = found.drop("moved")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of :func:`word_counts`.

    ``form``: the near word of largest ``n``, if that is at least ``times`` the word's ``n``, else
    null with ``form_n``; ``root``: where the forms lead, the word itself without one.  Repeated
    rows count as often as they stand there; an empty table gives no rows.
    """
    words = stage_table(word_counts(docs, least_length, least_count, every), "words")
    near = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= times * F.col("n")
    near = near.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    near = stage_table(near, "near-words")
    last = roots(near.filter("form is not null").select("word", "form"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
