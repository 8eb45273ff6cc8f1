from logweave.operators import evolution

SCHEMA = "table_name string, column string, type string, place int, is_key boolean"


def test_decision_follows_schemas(spark):
    column = lambda t, c="a", kind="int", place=1, key=False: (t, c, kind, place, key)
    names = ("new", "same", "refused", "type", "place", "key", "less", "more")
    source = [column(t) for t in names] + [column("less", "b", place=2)]
    target = [column("same"), column("refused", kind="string"), column("type", kind="string"), column("place", place=2), column("key", key=True), column("less"), column("more"), column("more", "b", place=2), column("other")]
    allowed = spark.createDataFrame([(t,) for t in names if t != "refused"], "table_name string")
    got = {r.table_name: r.decision for r in evolution.existing_target(spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA), allowed).collect()}
    assert got == {"new": "CREATE", "same": "OVERWRITE", "refused": "REFUSE"} | dict.fromkeys(names[3:], "REBUILD_AND_SWAP")
