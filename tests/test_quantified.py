"""Quantified comparisons against three-valued logic applied element by element."""

import operator
import random

import pytest

from lendwise.operators.quantified import OPERATORS, quantified
from lendwise.plans import physical_plan

PLAIN = dict(zip(OPERATORS, (operator.eq, operator.ne, operator.lt, operator.le, operator.gt, operator.ge)))
ALL12 = [(op, q, f"c{k}") for k, (op, q) in enumerate((op, q) for op in OPERATORS for q in ("ALL", "ANY"))]


def verdict(op, quantifier, x, elements):
    told = [None if x is None or e is None else PLAIN[op](x, e) for e in elements]
    if quantifier == "ALL":
        return False if False in told else None if None in told else True
    return True if True in told else None if None in told else False


@pytest.mark.parametrize("grouped", [True, False])
def test_all_operators(spark, grouped):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([None, 1, 2, 3])) for k in range(120)]
    sets = {1: [2], 2: [None], 3: [1, 2, None], 4: [2, 2, 3], 5: [3, 3, 3], None: [1]}  # 6: empty
    elements = [(g, e) for g, es in sets.items() for e in es]
    df = spark.createDataFrame(rows, "id int, g int, `x.y` int").withColumnRenamed("x.y", "x")
    es = spark.createDataFrame(elements, "g int, e int")
    got = {r["id"]: r for r in quantified(df, "x", es, "e", ALL12, ["g"] if grouped else []).collect()}
    assert len(got) == len(rows)
    for i, g, x in rows:
        them = (sets.get(g, []) if g is not None else []) if grouped else [e for _, e in elements]
        assert [got[i][name] for _, _, name in ALL12] == [verdict(op, q, x, them) for op, q, _ in ALL12]


def test_without_elements_and_plans(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    none = spark.createDataFrame([], "e int")
    for r in quantified(df, "x", none, "e", ALL12).collect():
        assert [r[n] for _, _, n in ALL12] == [q == "ALL" for _, q, _ in ALL12]
    assert quantified(spark.createDataFrame([], "x int"), "x", df.toDF("e"), "e", ALL12).collect() == []
    some = df.toDF("e")
    assert physical_plan(quantified(df, "x", some, "e", [("<", "ALL", "c")])).count("Join") == 1  # the one-row summary
    with pytest.raises(ValueError, match="not a quantified comparison"):
        quantified(df, "x", some, "e", [("==", "ALL", "c")])
