"""The rules over columns equal those of the prompt side, on odd strings too."""

import random

import pytest
from pyspark.sql import functions as F

from meshlight.functions import paths as P
from meshlight.functions import text as T

RULES = {
    "pascal": (T.pascal, T.pascal_col), "code_shaped": (T.code_shaped, T.code_shaped_col), "junk_symbol": (T.junk_symbol, T.junk_symbol_col),
    "strong_token": (T.strong_token, T.strong_token_col), "token_priority": (T.token_priority, T.token_priority_col), "split_camel": (T.split_camel, T.split_camel_col),
    "normalize_seed": (T.normalize_seed, T.normalize_seed_col), "sanitize_symbol": (T.sanitize_symbol, T.sanitize_symbol_col), "symbol_leaf": (T.symbol_leaf, T.symbol_leaf_col),
    "symbol_like": (T.symbol_like, T.symbol_like_col), "scope_file_src": (P.scope_file_src, P.scope_file_src_col), "scope_sanitize": (P.scope_sanitize, P.scope_sanitize_col),
}


@pytest.fixture(scope="module")
def words(spark):
    r = random.Random(9)
    pieces = ["a", "B", "Ab", "é", "É", "_", "::", ".", "/", "..", "7", "-", "()", "`", "#[", "]", "rs", "PY", "main", " ", "~", "C:", "x://"]
    made = {"".join(r.choice(pieces) for _ in range(r.randrange(1, 7))) for _ in range(1500)}
    return spark.createDataFrame([(w,) for w in sorted(made)], "w string").cache()


@pytest.mark.parametrize("name", RULES)
def test_column_equals_function(words, name):
    plain, column = RULES[name]
    got = {r.w: r.v for r in words.select("w", column(F.col("w")).alias("v")).collect()}
    assert got == {w: plain(w) for w in got}


def test_recency(spark):
    times = [0, 59, 60, 61, 3599, 3600, 86399, 86400, 10**9]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    assert [r.v for r in df.select(T.recency_text_col(F.col("t")).alias("v")).collect()] == [T.recency_text(t) for t in times]
