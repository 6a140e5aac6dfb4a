"""Normalised text over all of Unicode."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from lumbrera.functions import text as X


def folded(text):
    plain = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", " ", plain.lower()).strip()


def test_every_character(spark):
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    texts = ["".join(f"a{chr(p)}b " for p in points[i : i + 200]) for i in range(0, len(points), 200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, x string").select("k", X.normalize(F.col("x")).alias("n")).collect()
    wrong = [(texts[r["k"]][:40], r["n"][:80]) for r in rows if r["n"] != folded(texts[r["k"]])]
    assert not wrong, wrong[:3]


def test_characters_that_stand_for_several(spark):
    rows = spark.createDataFrame([("① uno",), ("㎡ sol",), ("½ ﬁn Ⅷ",), (None,)], "x string").select(X.normalize(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in rows] == ["1 uno", "m2 sol", "12 fin viii", ""]
