"""Every query of the subpackage, against its SQL where there is any."""

import pytest

from aislewise.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


#: Queries that SQL can't express, and the tests of their operators.
TESTED = {"p4_counts": "test_counts.py and p4_coverage", "p7_ids": "test_bpe.py", "p8_found": "test_leakage.py", "p8_answers": "test_leakage.py", "p9_pieces": "test_splitting.py", "p9_quality": "test_quality_of_cuts"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(same, name):
    same(QUERIES[name], SQL.get(name), name in TESTED)


def test_all_pairs_of_baskets(spark):
    """Also pairs in a single basket come out, with counts and lift."""
    from collections import Counter, defaultdict
    from itertools import combinations

    folder = "/root/testdata/sf0.001"
    by = defaultdict(set)
    for c, d, p in spark.read.parquet(f"{folder}/transactions.parquet").select("customer_id", "date", "product_id").collect():
        if None not in (c, d, p):
            by[c, d].add(p)
    single, pair = Counter(), Counter()
    for items in by.values():
        single.update(items)
        pair.update(combinations(sorted(items), 2))
    got = {(r["product_a"], r["product_b"]): r for r in QUERIES["p3_pairs"](spark, folder).collect()}
    assert {k: r["together"] for k, r in got.items()} == pair and 1 in pair.values()
    assert all(r["baskets"] == len(by) and r["lift"] == pytest.approx(n * len(by) / single[a] / single[b]) for (a, b), n in pair.items() for r in [got[a, b]])


def test_quality_of_cuts(spark):
    rows = QUERIES["p9_quality"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["cuts"] < r["pieces"] and r["at_units"] > 0.3 and r["depth"] > 2 * r["random_depth"] for r in rows)
