from itertools import combinations

import numpy as np
import pytest

from shopsight.functions.columns import joined
from shopsight.operators import basket


def lines_of(spark, receipts):
    rows = [(str(t), a, t % 3, 1.0) for t, items in enumerate(receipts) for a in items]
    return spark.createDataFrame(rows, "ID_SCONTRINO string, ID_ARTICOLO long, ID_CLI long, IMPORTO_NETTO double")


def mined(spark, receipts, support):
    table = spark.createDataFrame([(str(t), sorted(set(i))) for t, i in enumerate(receipts)], "ID_SCONTRINO string, items array<long>")
    return basket.frequent_itemsets(table, support)


def test_empty_baskets_count_in_the_base(spark):
    sets = {tuple(r["items"]): r.support for r in mined(spark, [[1, 2, 3], [1, 2, 3], [1, 2], [], []], 0.4).collect()}
    assert sets[(1, 2)] == 3 / 5 and sets[(1, 2, 3)] == 2 / 5


def test_every_split_is_a_rule(spark):
    rules = basket.association_rules(mined(spark, [[1, 2, 3], [1, 2, 3], [1, 2], [], []], 0.4), 0.0)
    found = {(tuple(r.antecedents), tuple(r.consequents)): r for r in rules.collect()}
    assert found[((1,), (2, 3))].confidence == pytest.approx(2 / 3)
    assert found[((1,), (2,))].conviction == float("inf")
    assert found[((1,), (2,))].lift == pytest.approx(5 / 3)
    assert len(found) == 3 * 2 + 6


def test_itemsets_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    receipts = [sorted(set(rng.integers(0, 8, rng.integers(0, 7)).tolist())) for _ in range(200)]
    expected = {}
    for k in range(1, 9):
        for items in combinations(range(8), k):
            freq = sum(set(items) <= set(r) for r in receipts)
            if freq / 200 >= 0.05:
                expected[items] = freq
    sets = mined(spark, receipts, 0.05)
    assert {tuple(r["items"]): r.freq for r in sets.collect()} == expected
    rules = basket.association_rules(sets, 0.3).collect()
    wanted = {(a, tuple(sorted(set(s) - set(a)))) for s in expected for k in range(1, len(s))
              for a in combinations(s, k) if expected[s] / expected[a] >= 0.3}
    assert {(tuple(r.antecedents), tuple(r.consequents)) for r in rules} == wanted


def test_all_splits_without_a_confidence(spark):
    sets = mined(spark, [[1, 2, 3, 4, 5]] * 3, 0.5)
    assert basket.association_rules(sets, 0.0).count() == sum(
        (2 ** k - 2) * n for k, n in {2: 10, 3: 10, 4: 5, 5: 1}.items())


def test_support_prunes_but_receipts_stay(spark):
    lines = lines_of(spark, [[1, 2], [1], [1, 1], [3]])
    built = {r.ID_SCONTRINO: r["items"] for r in basket.baskets(lines, 0.25).collect()}
    assert built == {"0": [1], "1": [1], "2": [1], "3": []}
    assert basket.high_support_lines(lines, 0.25).count() == 4
    assert basket.high_support_lines(lines, 0.00001).count() == 6
    long = {(r.ID_SCONTRINO, r.ID_ARTICOLO): (r.units, r.present) for r in basket.basket_long(lines).collect()}
    assert long[("2", 1)] == (2, 1)


def test_bundles_need_every_article(spark):
    lines = lines_of(spark, [[1, 2, 3], [1, 2], [2, 1], [3]])
    wanted = spark.createDataFrame([(1,), (2,)], "ID_ARTICOLO long")
    assert sorted(r.ID_SCONTRINO for r in basket.bundle_receipts(lines, wanted).collect()) == ["0", "1", "2"]


def test_redundant_and_top_rules(spark):
    rows = [([1], [3], 0.1, 0.5, 2.0), ([2], [3], 0.1, 0.5, 2.0), ([1], [2], 0.2, 0.6, 3.0)]
    rules = spark.createDataFrame(rows, "antecedents array<long>, consequents array<long>, support double, confidence double, lift double")
    assert [r.antecedents for r in basket.redundant_rules(rules).collect()] == [[2]]
    top = basket.top_rules(rules, 2).select("NOME", joined("antecedents").alias("a")).collect()
    assert sorted(tuple(r) for r in top) == [("itemset1", "1"), ("itemset2", "1")]
    assert basket.filter_rules(rules, 0.15, 3).count() == 1


def test_an_article_named_twice_counts_once_and_order_is_free(spark):
    table = spark.createDataFrame([([3, 1, 3],), ([1, 3],), ([2],), (None,)], "items array<long>")
    sets = {tuple(r["items"]): r.freq for r in basket.frequent_itemsets(table, 0.5).collect()}
    assert sets == {(1,): 2, (3,): 2, (1, 3): 2}


def test_baskets_meet_the_lines_once(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", None), (None, 1), (None, 3), ("c", 9)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame(rows, "ID_SCONTRINO string, ID_ARTICOLO long")
    table = basket.baskets(lines.mapInArrow(counted, lines.schema), 0.5)
    # of three receipts article 1 is in two; one without an id is a basket, but none of the receipts
    assert {r.ID_SCONTRINO: r["items"] for r in table.collect()} == {"a": [1], "b": [1], None: [1], "c": []}
    assert seen.value == len(rows)
