"""Report queries on small tables of their own, against their SQL."""

from __future__ import annotations

import pytest

from .tables import both, write

TABLES = ("orders", "lineitem", "part")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One order with two items of one number: one's text goes on in a second line where the other's has a digit more."""
    n = 4
    part = {"p_partkey": range(n), "p_name": ["red rod", "red rod", "hot ring", "new bolt"], "p_brand": ["Brand#11", "Brand#11", "Brand#12", "Brand#13"], "p_size": [1, 12, 7, 9], "p_type": ["LARGE"] * n, "p_retailprice": [1.0] * n}
    item = {
        "l_orderkey": [1] * n, "l_partkey": range(n), "l_suppkey": [1] * n, "l_linenumber": [1, 1, 2, 3], "l_quantity": [5.0, 5.0, 6.0, 7.0], "l_discount": [0.0] * n,
        "l_returnflag": ["N"] * n, "l_linestatus": ["O"] * n,
    }
    orders = {"o_orderkey": [1], "o_custkey": [1], "o_orderstatus": ["O"], "o_orderpriority": ["1"]}
    return write(tmp_path_factory.mktemp("reports"), part=part, lineitem=item, orders=orders)


@pytest.mark.parametrize("name", ["report_line_heights", "report_columns", "report_cells"])
def test_items_of_one_number(spark, folder, name):
    got, asked = both(spark, folder, name, TABLES)
    assert asked[1] and got == asked
