from aerolith.operators.refs import component_owners


def test_component_owners_deep_first_and_looped(spark):
    direct = spark.createDataFrame([("d", "X"), ("e", "Y")], "feature_id string, ad_id string")
    chain = [(f"c{i}", 1, f"c{i - 1}") for i in range(1, 20)] + [("c0", 1, "d")]
    # b: the first reference leads to the owner only over two more features, the second at once; dead: leads nowhere
    more = [("b", 1, "c2"), ("b", 2, "e"), ("p", 1, "q"), ("q", 1, "p"), ("q", 2, "e"), ("dead", 1, "nowhere"), ("own", 1, "own")]
    steps = spark.createDataFrame(chain + more, "src_id string, ref_no int, target_id string")
    got = {r.feature_id: r.ad_id for r in component_owners(direct, steps).collect()}
    assert got == {**{f"c{i}": "X" for i in range(20)}, "b": "X", "p": "Y", "q": "Y"}
    assert component_owners(direct, steps.limit(0)).count() == 0
