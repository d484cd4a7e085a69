"""Near copies of the pipeline against brute force."""

import random

import corpus_pipeline

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("n", "r", "sto", "ve", "x", "")]


def brute_kept(rows):
    """Of rows linked by Jaccard similarity of 5-word runs from 0.75 on, the smallest by id stays, nulls last."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return sorted(repr(min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if group[k] == g)) for g in set(group))


def test_one_row_of_each_group_stays(spark):
    r = random.Random(4)
    base = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(14)]
    near = lambda t, k: " ".join([*t.split()[:-2], f"new{k}", "end"])
    rows = [(k, t) for k, t in enumerate(base[:8])] + [(None, t) for t in base[8:12]]  # unlinked, four of them without an id
    rows += [(None, near(base[0], 1)), (50, near(base[0], 2)), (50, base[12]), (3, base[13])]  # copies of 0; repeated ids of other texts
    rows += [(None, near(base[8], 3)), (None, near(base[8], 4)), (7, near(base[7], 5)), (7, base[7]), (None, ""), (60, "")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    found = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert sorted(repr((d is None, d or 0)) for d, _ in found) == brute_kept(rows)
    assert set(found) >= {(None, t) for t in base[9:12]} | {(50, base[12]), (3, base[13]), (3, base[3]), (None, ""), (60, "")}
    assert corpus_pipeline.near_copies(spark, docs.where("false"), "").count() == 0
