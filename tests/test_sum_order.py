"""Sums whose last digits decide roundings and days, with the lines of a project in many orders, in one file and dealt over files."""

from itertools import permutations

import duckdb
import pandas as pd
import pytest
from test_entry import canonical

from slackline.plans import registry

COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
#: Orders of sf0.1 with such sums.
LINES = [
    [(7235, 791, 2, 32.0, 29113.66, 0.05, 0.08, "N", "O", "1997-05-28"), (17764, 521, 4, 25.0, 24961.15, 0.05, 0.06, "N", "F", "2001-03-26"), (15512, 362, 6, 45.0, 19819.59, 0.06, 0.06, "R", "O", "1999-12-17")],
    [(19317, 232, 1, 22.0, 95429.63, 0.09, 0.08, "A", "F", "1998-04-22"), (8084, 750, 2, 33.0, 94414.71, 0.08, 0.05, "R", "O", "2000-01-17"), (12554, 176, 2, 20.0, 37773.42, 0.1, 0.07, "R", "O", "1995-07-30"), (1440, 713, 3, 11.0, 39804.92, 0.07, 0.01, "N", "O", "1997-04-09"), (3832, 31, 5, 17.0, 61583.71, 0.09, 0.05, "A", "F", "1997-11-08")],
    [(8158, 350, 4, 16.0, 96761.52, 0.03, 0.06, "N", "O", "1997-02-16"), (7382, 526, 2, 6.0, 94298.48, 0.09, 0.02, "N", "O", "1995-11-10"), (16242, 142, 5, 17.0, 5196.94, 0.08, 0.02, "A", "F", "1996-12-20")],
    [(1274, 43, 7, 2.0, 86023.22, 0.01, 0.02, "R", "F", "1999-11-17"), (4583, 681, 7, 38.0, 11194.38, 0.06, 0.04, "A", "O", "1997-06-07"), (15510, 548, 6, 7.0, 74331.79, 0.01, 0.02, "A", "O", "1999-10-08"), (10432, 697, 7, 31.0, 9598.8, 0.09, 0.02, "R", "O", "1998-02-06")],
    [(17682, 582, 2, 5.0, 99927.5, 0.05, 0.02, "R", "O", "1999-03-02"), (18863, 762, 3, 45.0, 2146.95, 0.03, 0.01, "N", "O", "1998-04-15"), (15045, 956, 3, 39.0, 90345.2, 0.04, 0.01, "R", "O", "2001-07-24"), (8250, 751, 3, 9.0, 10366.15, 0.07, 0.04, "A", "F", "1999-11-12")],
]


@pytest.fixture(scope="module", params=[1, 2])
def lines(request, tmp_path_factory):
    """(folder, DuckDB) of a table in so many files; each order is there once for each order of its lines."""
    folder = tmp_path_factory.mktemp("orders")
    copies = [p for own in LINES for p in permutations(own)]
    rows = pd.DataFrame([(k, *line) for k, p in enumerate(copies) for line in p], columns=COLUMNS).astype({"l_linenumber": "int32", "l_shipdate": "datetime64[us]"})
    (folder / "lineitem.parquet").mkdir()
    for f in range(request.param):
        rows.iloc[f :: request.param].to_parquet(folder / "lineitem.parquet" / f"part-{f}.parquet", index=False)
    c = duckdb.connect(config={"threads": 1})  # with more threads its sums have no order
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["evm_delay", "evm_earned_schedule", "evm_metrics", "predicted_dates"])
def test_sums_in_the_order_of_the_sql(spark, lines, name):
    folder, c = lines
    got, want = registry.queries()[name](spark, folder).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    assert len(got) and canonical(got) == canonical(want)
