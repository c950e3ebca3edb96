"""The contract language, each kind alone, breaks by name, and rules that can't be compiled."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skyweave.operators import contracts

KIND = "survey string, a string, b string, n double, m double"


def _rule(kind, column, argument, action="exclude", survey="s", name="r"):
    return Row(survey=survey, rule=name, kind=kind, column=column, argument=argument, action=action)


@pytest.mark.parametrize(
    "kind,column,argument,good,bad",
    [
        ("present", "a", "", [("x", None, 0.0, 0.0)], [("", None, 0.0, 0.0), ("  ", None, 0.0, 0.0), (None, "x", 0.0, 0.0)]),
        ("longest", "a", "3", [("", None, 0.0, 0.0), ("éàü", None, 0.0, 0.0)], [("four", None, 0.0, 0.0), (None, None, 0.0, 0.0)]),
        ("number", "n", "[0,360)", [("", "", 0.0, 0.0), ("", "", 359.9, 0.0)], [("", "", 360.0, 0.0), ("", "", -0.1, 0.0), ("", "", None, 0.0), ("", "", float("nan"), 0.0), ("", "", float("inf"), 0.0)]),
        ("number", "a", "(0,]", [("0.1", "", 0.0, 0.0), ("1e300", "", 0.0, 0.0)], [("0", "", 0.0, 0.0), ("x", "", 0.0, 0.0), ("NaN", "", 0.0, 0.0)]),
        ("whole", "n", "[1,6]", [("", "", 1.0, 0.0), ("", "", 6.0, 0.0)], [("", "", 1.5, 0.0), ("", "", 7.0, 0.0)]),
        ("multiple", "n", "2880", [("", "", 5760.0, 0.0)], [("", "", 2881.0, 0.0), ("", "", None, 0.0)]),
        ("pattern", "a", "x|y+", [("x", "", 0.0, 0.0), ("yy", "", 0.0, 0.0)], [("xy", "", 0.0, 0.0), ("x\n", "", 0.0, 0.0), (None, "", 0.0, 0.0)]),
        ("one_of", "a", "G, R", [("g", "", 0.0, 0.0), ("R", "", 0.0, 0.0)], [("Z", "", 0.0, 0.0), ("", "", 0.0, 0.0), (None, "", 0.0, 0.0)]),
        ("text", "a", "{b}-x", [("q-x", "q", 0.0, 0.0)], [("q", "q", 0.0, 0.0), ("q-x", None, 0.0, 0.0)]),
        ("part", "n", "a ~ ^r(\\d+)-", [("r0007-1", "", 7.0, 0.0)], [("r8-", "", 7.0, 0.0), ("x", "", 7.0, 0.0), (None, "", 7.0, 0.0), ("r0007-1", "", None, 0.0)]),
        ("mapped", "a", "b: g=G, r=R", [("G", "g", 0.0, 0.0), ("R", "r", 0.0, 0.0)], [("G", "r", 0.0, 0.0), ("I", "i", 0.0, 0.0), (None, "g", 0.0, 0.0)]),
        ("below", "n", "m", [("", "", 1.0, 2.0)], [("", "", 2.0, 2.0), ("", "", None, 2.0), ("", "", 1.0, None)]),
        ("is", "a", "ICRS", [("ICRS", "", 0.0, 0.0)], [("icrs", "", 0.0, 0.0), (None, "", 0.0, 0.0)]),
    ],
)
def test_each_kind_of_rule(spark, kind, column, argument, good, bad):
    df = spark.createDataFrame([("s", *r) for r in good + bad], KIND).withColumn("k", F.monotonically_increasing_id())
    got = [r.reason for r in contracts.judged(df, [_rule(kind, column, argument)]).orderBy("k").collect()]
    assert got == [None] * len(good) + ["r"] * len(bad)
    optional = [r.reason for r in contracts.judged(df, [_rule(kind, column + "?", argument)]).orderBy("k").collect()]
    assert [o for o, r in zip(optional, good + bad, strict=True) if r["abnm".index(column)] is None] == [None] * sum(r["abnm".index(column)] is None for r in good + bad)


def test_order_actions_and_surveys(spark):
    rules = [_rule("present", "a", "", "exclude", "s", "first"), _rule("is", "b", "x", "break", "s", "second"), _rule("present", "b", "", "exclude", "t", "other")]
    df = spark.createDataFrame([("s", None, None, 0.0, 0.0), ("s", "v", "x", 0.0, 0.0), ("t", None, "y", 0.0, 0.0), ("u", "v", "x", 0.0, 0.0), (None, "v", "x", 0.0, 0.0)], KIND)
    assert [r.reason for r in contracts.judged(df, rules).collect()] == ["first", None, None, "no-contract", "no-contract"]
    bad = df.union(spark.createDataFrame([("s", "v", "y", 0.0, 0.0)], KIND))
    with pytest.raises(Exception, match="row contract broken: s.second"):
        contracts.judged(bad, rules).collect()
    assert [r.reason for r in contracts.judged(bad, rules, quarantine=True).collect()][-1] == "broken:second"
    assert {r.reason for r in contracts.judged(bad, []).collect()} == {"no-contract"}
    assert contracts.judged(df.limit(0), rules).collect() == []
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "number int, " + ", ".join(f"{f} string" for f in contracts.FIELDS))
    assert contracts.rules_of(table) == rules


@pytest.mark.parametrize("rule", [_rule("odd", "a", ""), _rule("is", "zz", ""), _rule("text", "a", "{zz}"), _rule("part", "a", "zz ~ (x)"), _rule("number", "n", "1..2"), _rule("is", "a", "", "ignore")])
def test_rules_that_make_no_sense(spark, rule):
    with pytest.raises(ValueError):
        contracts.judged(spark.createDataFrame([], KIND), [rule])


def test_surveys_have_contracts():
    assert {r.survey for r in contracts.SURVEYS} == {"sdss", "iphas", "ztf", "decaps", "akari", "nvss"}
    with pytest.raises(ValueError, match="fields"):
        contracts.parse("a | b | c")
