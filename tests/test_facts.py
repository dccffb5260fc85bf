from lakeloom.operators.facts import changes

SCHEMA = "grp string, value string, normalized string, state string, signature string, pos bigint"


def facts(spark, *values, grp="g"):
    return spark.createDataFrame([(grp, v, v, None, v.replace("5", "#").replace("0", "#"), i) for i, v in enumerate(values)], SCHEMA)


def test_multiset_and_pairs(spark):
    got = lambda b, a: sorted(((r.before_value, r.after_value, r.how) for r in changes(b, a).collect()), key=str)
    assert got(facts(spark, "x", "x"), facts(spark, "x")) == [("x", None, "removed")]
    assert got(facts(spark, "p 10"), facts(spark, "p 15")) == [("p 10", "p 15", "signature")]
    assert len(got(facts(spark, "p 10", "p 10"), facts(spark, "p 15", "p 15"))) == 4
    assert got(facts(spark, "red apple pie"), facts(spark, "red apple cake")) == [("red apple pie", "red apple cake", "alike")]
    assert got(facts(spark, "b", "a"), facts(spark, "a", "b")) == []
    assert sorted(map(str, changes(facts(spark, "abc"), facts(spark, "xyz")).select("how").collect())) == ["Row(how='added')", "Row(how='removed')"]
