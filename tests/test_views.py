"""Parameterized report views (J48-J50) with explicit widget values."""

from pyspark.sql import functions as F

from deliverix.plans.build import build_for

SF = "/root/testdata/sf0.01"


def test_view_parameters(spark):
    b = build_for(spark, SF)
    cats = b.view_categories(["promo", "SMALL"]).collect()
    assert sorted(r.category_en for r in cats) == ["SMALL", "promo"] and len(cats[0]) == 5
    states = b.view_states(["NATION_1", "NATION_2"]).collect()
    assert sorted(r.customer_state for r in states) == ["NATION_1", "NATION_2"]
    floor = 150
    sel = b.view_sellers(min_orders=floor, n=7).collect()
    assert 0 < len(sel) <= 7 and all(r.total_orders >= floor for r in sel)
    worst = (b.seller.where(F.col("total_orders") >= floor)
             .orderBy("seller_composite_score", "seller_id").limit(7).select("seller_id").collect())
    assert [r.seller_id for r in sel] == [r.seller_id for r in worst]
    assert b.view_corridors(3).count() == 3 and b.view_velocity(2).count() == 2
