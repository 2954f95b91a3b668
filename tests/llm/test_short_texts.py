"""The similarity join on short texts, where a set's band is often shorter than its prefix."""

import random

import pytest
from pyspark.sql import functions as F

from sievefold.llm import jaccard

#: (words of a shingle, percent, share of the tokens that are counted)
CASES = [(1, 80, 0.2), (1, 90, 0.3), (3, 90, None), (3, 80, 1.0), (5, 80, 0.3), (5, 90, 0.2)]


def short_texts(seeds, per_seed):
    """Texts of 8 to 14 words, 6 to 14 distinct ones in each seed, some one word longer or
    with one word changed; the seeds have no word in common."""
    rows = []
    for seed in seeds:
        r = random.Random(seed)
        vocab = [f"s{seed}w{i}" for i in range(r.randint(6, 14))]
        own = []
        for _ in range(per_seed):
            if own and r.random() < 0.6:
                words = list(r.choice(own))
                if r.random() < 0.5:
                    words.insert(r.choice([0, len(words)]), r.choice(vocab))
                else:
                    words[r.randrange(len(words))] = r.choice(vocab)
            else:
                words = [r.choice(vocab) for _ in range(r.randint(8, 14))]
            own.append(words)
        rows += [" ".join(w) for w in own]
    return list(enumerate(rows))


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if 100 * same >= percent * (len(a) + len(sets[j]) - same):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize(("width", "percent", "band"), CASES)
def test_short_texts_of_twenty_seeds(spark, width, percent, band):
    rows = short_texts(range(20), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, width, percent, band=band).collect()}
    want = brute(rows, width, percent)
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert len(set(want.values())) < len(rows)  # some texts do link


def test_one_word_more(spark):
    """11 shingles of which 10 are those of a text of 12 words."""
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, text), (2, text + " m"), (3, "other words that are unlike all of these here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_prefix_order_is_the_same_for_all_sets(spark):
    """A token beyond the share comes after all below it, in extended bands too."""
    low, high = (1 << 60), -(1 << 62)  # unsigned: below and beyond a share of 0.3
    rows = spark.createDataFrame([(1, [low], 0, 0), (2, [low, high], 0, 1), (3, [high], 0, 0), (4, [low], 0, 0)], "node long, band array<long>, room int, rim int")
    got = {(r.node, r.token): r.core for r in jaccard.shared_prefixes(rows, [], 0.3).collect()}
    assert got == {(1, low): True, (2, low): True, (2, high): False, (3, high): True, (4, low): True}
    assert jaccard.shared_prefixes(rows, [], 1.0).where(F.col("token") == high).count() == 2
