import random

import pytest
from helpers import union_find

from epitide.llm.common import components, lower_ascii, text_key


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(i, i + 1) for i in range(400, 450)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = union_find(linked, [x for x in links if x[0] != x[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_text_columns(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("AbÉ",), ("",), (None,)], "t string").select(
        lower_ascii(F.col("t")).alias("l"), text_key(F.col("t")).alias("k")).collect()
    assert rows[0].l == "abÉ" and rows[1].k == rows[2].k != rows[0].k
