"""Plan-shape checks from ``explain("formatted")``: the shuffles and sorts the
design promises, column pruning at the scan, and no join where a window
replaces one."""

import contextlib
import io
import re

from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.operators import split as sp
from loadcast.sources import panels

SF = "/root/testdata/sf0.001"


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def nodes(text, name):
    """Operator lines of the tree part of the formatted plan, e.g. 'Exchange'."""
    tree = text.split("\n\n")[0]
    return len(re.findall(rf"[+\- ]{name} \(", tree)) + len(re.findall(rf"^{name} \(", tree, re.M))


def test_feature_table_uses_one_series_exchange_and_two_sorts(spark):
    df = fe.build_features(panels.demand_panel(spark, SF))
    text = plan_text(df)
    assert nodes(text, "Exchange") == 2          # panel aggregate + one series partitioning
    assert nodes(text, "Sort") == 2              # date order, then (month, weekday, year) order
    assert "hashpartitioning(series_id" in text
    assert nodes(text, "SortMergeJoin") == 0 and nodes(text, "BroadcastHashJoin") == 0
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert set(re.findall(r"(\w+):", scan)) == {"l_extendedprice", "l_discount", "l_tax",
                                                 "l_returnflag", "l_shipdate"}


def test_asof_and_last_week_need_no_join(spark):
    hist = panels.demand_panel(spark, SF)
    targets = hist.select("series_id", "date")
    for df in (lk.last_before(targets, hist, "max_demand"),
               lk.same_dow_last_week(targets, hist)):
        text = plan_text(df)
        assert "Join" not in text.split("\n\n")[0]
        assert nodes(text, "Window") >= 1


def test_region_panel_broadcasts_checked_nation_and_prunes_scans(spark):
    text = plan_text(panels.region_panel(spark, SF))
    assert "BroadcastExchange" in text
    schemas = [set(re.findall(r"(\w+):", s))
               for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text)]
    assert {"n_nationkey", "n_regionkey"} in schemas
    assert {"c_custkey", "c_nationkey"} in schemas
    assert {"o_custkey", "o_orderdate", "o_totalprice"} in schemas


def test_folds_repeat_no_row_and_move_no_row_by_series(spark):
    panel = panels.demand_panel(spark, SF)
    text = plan_text(sp.fold_blocks(panel, method="dates"))
    assert nodes(text, "Generate") == 0
    assert nodes(plan_text(sp.fold_blocks(panel)), "Generate") == 0
    # Windows run over the counts by date only: below the bounds' aggregate, never above the join.
    tree = text.split("\n\n")[0]
    assert tree.index("Join") < tree.index("Window")
