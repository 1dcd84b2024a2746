"""Enumeration of scenarios against plain loops."""

from itertools import combinations, product

from kilnflow.operators import recommend


def test_ten_variables_in_order(spark):
    names = [f"v{i}" for i in range(10)]
    rows = [(v, float(x), x == 2, float(x - 2), 4.0) for v in names for x in range(5)]
    points = spark.createDataFrame(rows, "variable string, value double, is_current boolean, delta double, span double")
    moves = [1.0, 3.0, 0.0, 4.0]  # by distance from 2, then by value
    want = [{v: 2.0 for v in names}]
    for n in (1, 2, 3):
        for some in combinations(names, n):
            want += [want[0] | dict(zip(some, values)) for values in product(moves, repeat=n)]
    got = recommend.scenarios(points, names).orderBy("scenario_index").collect()
    assert [r["values"] for r in got] == want[: recommend.MAX_SCENARIOS] and got[499].scenario_id == "SCN-000499"
    assert recommend.scenarios(points, names, most=10**6).count() == len(want)
    assert recommend.scenarios(points, names[:2], changes=1).count() == 9
