import itertools
import random

import pandas as pd
import pytest

from trellisq.plans import catalogue

NATIONS = range(6)


@pytest.fixture(scope="module")
def nations(tmp_path_factory):
    """Four tables with some lines between most ordered pairs of nations; the weights by brute force."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("nations")
    pairs = [(a, b) for a in NATIONS for b in NATIONS if rng.random() < 0.8 for _ in range(rng.randint(1, 3))]
    lines = [(k, a, b, rng.randint(1, 50)) for k, (a, b) in enumerate(pairs)]
    pd.DataFrame({"l_orderkey": [k for k, *_ in lines], "l_suppkey": [a for _, a, _, _ in lines], "l_quantity": [float(q) for *_, q in lines]}).to_parquet(folder / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": [k for k, *_ in lines], "o_custkey": [b for _, _, b, _ in lines]}).to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": list(NATIONS), "c_nationkey": list(NATIONS)}).to_parquet(folder / "customer.parquet")
    pd.DataFrame({"s_suppkey": list(NATIONS), "s_nationkey": list(NATIONS)}).to_parquet(folder / "supplier.parquet")
    held = {}
    for _, a, b, q in lines:
        held.setdefault((a, b), []).append(q)
    d = {(a, b): 0 if a == b else (2 * sum(q) + len(q)) // (2 * len(q)) if (q := held.get((a, b))) else float("inf") for a in NATIONS for b in NATIONS}
    for k, a, b in itertools.product(NATIONS, NATIONS, NATIONS):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return str(folder), {(str(a), str(b)): v for (a, b), v in d.items() if v < float("inf")}


@pytest.mark.parametrize("name", ["all_pairs_weights", "a_star_weights"])
def test_every_pair_of_nations_is_in_the_graph(spark, nations, name):
    folder, d = nations
    got = catalogue.QUERIES[name](spark, folder).collect()
    assert {(r.source, r.target): r.optimum_weight for r in got} == {k: v for k, v in d.items() if k[0] != k[1]}
    assert len(got) == len(d) - len(NATIONS)


def test_bounds_and_mismatches_on_every_pair(spark, nations):
    folder, d = nations
    want = {}
    for (a, b), v in d.items():
        if a != b:
            own = [x for (s, _), x in d.items() if s == a]
            want[a, b] = (sum(x < v for x in own) + 1, sum(x <= v for x in own), True)
    assert {(r.source, r.target): (r.low, r.high, r.inside) for r in catalogue.QUERIES["settle_bounds"](spark, folder).collect()} == want
    assert catalogue.QUERIES["search_mismatches"](spark, folder).count() == 0
