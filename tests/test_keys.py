"""Keys of scripts and locales against Python's own Unicode tables, also inside lambdas."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keys
from corpusloom.functions.keys import Fold


def lithuanian(s):
    s = re.sub("([IJ\u012e])(?=[\u0300-\u036f]*[\u0300\u0301\u0303])", "\\1\u0307", s)
    return s.replace("\u00cc", "i\u0307\u0300").replace("\u00cd", "i\u0307\u0301").replace("\u0128", "i\u0307\u0303").lower()


def kana(s):
    return unicodedata.normalize("NFC", re.sub("[\uff61-\uff9f]+", lambda m: unicodedata.normalize("NFKC", m[0]), s)).lower()


@pytest.mark.parametrize(("fold", "plain", "letters"), [(Fold("lt"), lithuanian, "IJ\u012eiaÀÌÍĨ\u0300\u0301\u0303\u0307\u0328"), (Fold(None, "Jpan"), kana, "\uff76\uff8a\uff73\uff9e\uff9f\uff71\uff66\uff9c\u30ab\u3042A")])
def test_keys_without_python(spark, fold, plain, letters):
    r = random.Random(4)
    forms = ["".join(p) for n in (1, 2) for p in itertools.product(letters, repeat=n)] + ["".join(r.choice(letters) for _ in range(6)) for _ in range(300)]
    frame = spark.createDataFrame([(f,) for f in forms], "form string")
    rows = frame.select("form", keys.dict_key(F.col("form"), fold).alias("k"), F.transform(F.array("form"), lambda x: keys.dict_key(x, fold))[0].alias("inside"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for row in rows.collect():
        assert row.k == row.inside == plain(row.form), row.form.encode("unicode_escape")
