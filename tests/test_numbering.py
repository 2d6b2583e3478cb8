import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered


@pytest.mark.parametrize("groups", [[], ["g"], ["g", "h"]])
def test_numbers_are_those_of_one_sorted_list(spark, groups):
    r = random.Random(len(groups))
    rows = [(r.choice([None, "hot", "hot", "hot", "b"]), r.choice([None, True, False]), r.choice([None, 1, 2, 3]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, h boolean, v int, k int")
    out = numbered(df, groups, [F.col("v").desc(), "k"], "rn", "n").collect()
    assert len(out) == len(rows)
    of: dict = {}
    for row in rows:
        of.setdefault(row[: len(groups)], []).append(row)
    want = {}
    for members in of.values():
        members.sort(key=lambda x: (x[2] is None, -(x[2] or 0), x[3]))
        want |= {x[3]: (n + 1, len(members)) for n, x in enumerate(members)}
    assert {x["k"]: (x["rn"], x["n"]) for x in out} == want


def test_no_range_holds_a_group_and_empty_tables_stay_empty(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("k"))
    out = numbered(df, ["g"], ["k"], "rn")
    assert out.filter("rn <> k + 1").count() == 0 and out.columns == ["g", "k", "rn"]
    assert numbered(df.filter("false"), ["g"], ["k"], "rn", "n").collect() == []
