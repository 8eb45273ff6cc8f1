"""Views created anew around a table that is replaced or dropped."""

import pytest

from logweave.sources.snapshots import Names
from logweave.sources.view_texts import TargetViews


def test_views_follow_their_table(spark, tmp_path):
    names, views = Names(spark, "test_views"), TargetViews(spark, "test_views", "src")
    for n, rows in (("one", "1 AS a"), ("two", "1 AS a, 'it''s' AS b"), ("other", "5 AS a")):
        spark.sql(f"SELECT {rows}").write.parquet(f"{tmp_path}/{n}")
    names.point({"t": f"file://{tmp_path}/one", "u": f"file://{tmp_path}/other"})
    made = {
        "z": "CREATE VIEW `z` AS SELECT * FROM `internal`.`src`.`t`", "a": "create view if not exists `internal`.`src`.`a` AS SELECT * FROM `internal`.`src`.`z` WHERE 'it\\'s' <> '`t`' ;",
        "both": "CREATE VIEW `both` (`x`) COMMENT 'of `t`' AS SELECT z.a FROM `internal`.`src`.`z` z JOIN `internal`.`src`.`a` a ON z.a = a.a", "alone": "CREATE VIEW `alone` AS SELECT * FROM `internal`.`src`.`u`"}
    for name, text in made.items():
        views.create(name, text)
    views.create("z", made["z"])  # again: replaced
    assert dict(views.reading("t")) == {n: made[n] for n in ("z", "a", "both")} and [n for n, _ in views.reading("t")] == ["z", "a", "both"]
    assert views.reading("nothing") == [] and names.now().keys() == {"t", "u"}
    assert views.around(["t"], lambda: names.point({"t": f"file://{tmp_path}/two"})) == ["z", "a", "both"]
    read = lambda n: list(map(tuple, spark.table(f"test_views.{n}").collect()))
    assert read("a") == [(1, "it's")] and read("both") == [(1,)] and spark.table("test_views.both").columns == ["x"] and read("alone") == [(5,)]
    assert views.around(["t"], lambda: names.point({"t": None})) == [] and {r.name for r in views.texts().collect()} == {"alone"}


def test_failed_change_and_circles(spark, tmp_path):
    names, views = Names(spark, "test_view_circle"), TargetViews(spark, "test_view_circle", "src")
    assert views.around(["t"], lambda: None) == [] and names.now() == {}
    views.create("v", "CREATE VIEW `v` AS SELECT 1 AS `t`")  # an alias reads nothing
    assert views.reading("t") == []
    spark.range(1).write.parquet(f"{tmp_path}/t")
    names.point({"t": f"file://{tmp_path}/t"})
    views.create("p", "CREATE VIEW `p` AS SELECT * FROM `internal`.`src`.`t`")
    views.create("q", "CREATE VIEW `q` AS SELECT * FROM `internal`.`src`.`p`")

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        views.around(["t"], fail)
    assert {r.name for r in views.texts().collect()} == {"v"}
    for a, b in ("pq", "qp"):  # texts that read one another, as renames may leave them
        views.create(a, f"CREATE VIEW `{a}` AS SELECT 1 AS x")
        spark.sql(f"ALTER VIEW test_view_circle.{a} SET TBLPROPERTIES ('source_text' = 'SELECT * FROM `src`.`{b}`, `src`.`t`')")
    with pytest.raises(ValueError):
        views.reading("t")
