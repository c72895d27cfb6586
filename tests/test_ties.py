"""Means that lie exactly on a bound: what they count as must not follow from the order in which they are summed."""

import datetime
import random
from fractions import Fraction

import pytest

from fieldframe.plans import catalog

CELLS, LEAVES = 10, 400


@pytest.fixture
def tied(spark, tmp_path):
    """tied(target) writes lineitem for leaves of some cells in one frame, whose exact mean is target(first cell's mean), and gives the cells' exact means by leaf."""

    def table(target, cells=CELLS):
        draw, rows, leaves = random.Random(5), [], {}
        while len(leaves) < LEAVES:
            first = Fraction(draw.randint(12, 38))
            means = [first] + [Fraction(draw.randint(12 * n, 40 * n), n) for n in draw.choices((3, 6, 9), k=cells - 2)]
            last = target(draw, first) * cells - sum(means)
            if not 1 <= last <= 50:
                continue
            slab = len(leaves)
            leaves[16 * slab] = means + [last]
            for cell, mean in enumerate(leaves[16 * slab]):
                each, more = divmod(mean.numerator, mean.denominator)
                for i in range(mean.denominator):
                    rows.append((8192 * slab + cell // 16, cell % 4, cell // 4 % 4, float(each + (i < more)), datetime.datetime(2024, 1, 5)))
        draw.shuffle(rows)
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
        return leaves

    return table


def test_children_on_the_bound_of_a_class(spark, tied, tmp_path):
    tied(lambda draw, first: Fraction("25.4"), 15)
    # all are inside, which is the default then
    assert catalog.queries()["compacted_children"](spark, str(tmp_path)).collect() == []


def test_errors_on_the_bound_of_a_bucket(spark, tied, tmp_path):
    leaves = tied(lambda draw, first: first + draw.choice((-5, 5)))
    errors = [abs(v - sum(means) / CELLS) for means in leaves.values() for v in means]
    total = {r["mode"]: r for r in catalog.queries()["mode_summary"](spark, str(tmp_path)).collect()}["TOTAL"]
    assert (total.n, total.within_5, total.within_15, total.beyond) == (len(errors), sum(e <= 5 for e in errors), sum(5 < e <= 15 for e in errors), sum(e > 15 for e in errors))


def test_controls_halfway_between_eighths(spark, tied, tmp_path):
    leaves = tied(lambda draw, first: Fraction(2 * draw.randint(160, 240) + 1, 16))
    got = {r.leaf_id: r.v for r in catalog.queries()["payload_keys"](spark, str(tmp_path)).collect()}
    assert got == {leaf: float((sum(means) / CELLS * 8 + Fraction(1, 2)) / 8) for leaf, means in leaves.items()}


def test_predictions_on_the_level(spark, tied, tmp_path):
    leaves = tied(lambda draw, first: Fraction(25))
    got = {r.leaf_id: r.flips for r in catalog.queries()["voxel_activity"](spark, str(tmp_path)).collect()}
    assert got == {leaf: sum(v < 25 for v in means) for leaf, means in leaves.items()}
