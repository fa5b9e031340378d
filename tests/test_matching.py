import itertools

import pytest

from ledgerline.functions.matching import token_set_ratio
from ledgerline.operators import reconcile as R

LEFT = ["pen pen pen pen", "laptop laptop laptop", "red bolt red bolt", "bolt", "desk desk", "abcdefghijk", "abcdefghi", ""]
RIGHT = ["pens", "laptp", "laptp laptp laptp", "red bold", "desks tidy tidy", "abcdefghi", "zzz", ""]


@pytest.mark.parametrize("threshold", [85.0, 90.0])
def test_candidates_are_all_pairs_over_the_threshold(spark, threshold):
    a, b = (spark.createDataFrame([(1, n) for n in names], "pair_id long, item string") for names in (LEFT, RIGHT))
    made = {(r.inv_item, r.po_item): r.score for r in R.fuzzy_candidates(a, b, threshold).collect()}
    scores = {(x, y): token_set_ratio(x, y) for x, y in itertools.product(LEFT, RIGHT)}
    assert made == {pair: s for pair, s in scores.items() if s >= threshold}
    assert ("laptop laptop laptop", "laptp") in made and ("abcdefghijk", "abcdefghi") in made


def test_a_pair_with_thousands_of_names_on_each_side(spark):
    """Names are not compared one by one; every near name is found, and greedy matches are one to one."""
    import time

    n = 5_000
    word = lambda k: "".join(chr(97 + (k // 26**p) % 26) for p in (2, 0, 1, 3))
    left = [f"{word(k)}x {word(k * 7 + 11)}q{k}" for k in range(n)]
    right = [f"{word(k)}x {word(k * 7 + 11)}w{k}" for k in range(n)]
    a, b = (spark.createDataFrame([(1, x) for x in names], "pair_id long, item string") for names in (left, right))
    began = time.time()
    made = R.assign_greedy(R.fuzzy_candidates(a, b)).collect()
    assert time.time() - began < 60 and len(made) > n // 2
    assert len({r.inv_item for r in made}) == len(made) == len({r.po_item for r in made})


def test_greedy_takes_the_best_free_name(spark):
    rows = [(1, "a", "x", 90.0), (1, "a", "y", 95.0), (1, "b", "y", 99.0), (1, "b", "z", 90.0), (1, "c", "y", 88.0), (2, "a", "q", 90.0), (2, "a", "p", 90.0)]
    made = {(r.pair_id, r.inv_item, r.po_item) for r in R.assign_greedy(spark.createDataFrame(rows, "pair_id long, inv_item string, po_item string, score double")).collect()}
    assert made == {(1, "a", "y"), (1, "b", "z"), (2, "a", "p")}
