from terramark.plans.catalog import QUERIES


def test_preview_covers_the_whole_height(spark):
    got = QUERIES["preview"](spark, "/root/testdata/sf0.01").collect()
    assert [r.pr for r in sorted(got, key=lambda r: r.pr)] == list(range(500))
    assert max(r.cell_id for r in got) // 20 == 14985
