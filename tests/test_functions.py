import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as X


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_normal_forms(spark):
    assert values(spark, X.normalize, "ＡＢＣ Straße", "A&B—Co., Ltd.", None) == ["abc strasse", "a b co ltd", ""]
    assert values(spark, X.fold, "éá", None) == ["ea", ""]
    assert values(spark, X.script, "abc дд", "12", None, "हिन्दी a") == ["LATIN", "NONE", "NONE", "DEVANAGARI"]
    assert values(spark, X.simple_normalize, "  A-b  C ", None) == ["a b c", ""]


def test_names_and_addresses(spark):
    assert values(spark, X.core_name, "acme pvt ltd", "ltd inc", "a ltd b", "") == ["acme", "ltd", "a ltd b", ""]
    assert values(spark, X.expand_address, "12 st main rd", "ave", "") == ["12 st main road", "avenue", ""]
    assert values(spark, X.acronym, "a big cat", "") == ["abc", ""]
    assert values(spark, X.frenchify, "5 Main Street LLC", None) == ["5 Main Rue SARL", None]


def test_sets(spark):
    assert sorted(values(spark, X.grams, "ab")[0]) == ["_ab", "ab_"]
    assert values(spark, X.grams, "")[0] == []
    assert sorted(values(spark, X.number_set, "12 Road 560001")[0]) == ["12", "560001"]
    assert values(spark, X.postal_set, "12 Road 560001", "1234567") == [["560001"], []]
    assert values(spark, lambda c: X.index_terms(X.words(c)), "b a b")[0] == ["x61", "x62"]


def test_set_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], [])], "a array<string>, b array<string>")
    rows = df.select(S.jaccard(F.col("a"), F.col("b")), S.containment(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, 1.0), (0.0, 0.0)]


def test_edit_similarities():
    assert S.indel_ratio("abcd", "abed") == 0.75
    assert S.token_sort_ratio("b a", "a b") == 1.0
    assert S.token_set_ratio("a b", "a b c") == 1.0
    assert S.token_set_ratio("x", "y") == 0.0
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611111)
    assert S.jaro_winkler_of("", "") == 1.0


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_jaro_winkler_by_bytes_agrees_with_sql(a, b):
    if a or b:
        assert S.jaro_winkler_of(a.encode(), b.encode()) == pytest.approx(duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0])


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.lcs_length(a, b) == table[-1][-1]


def test_jaro_winkler_of_many_pairs_is_that_of_each():
    import random

    from linkloom.functions.similarity import jaro_winkler_of, jaro_winkler_of_many

    rng = random.Random(6)
    for letters in ("ab", "abcdefgh ", "éa日 b\0"):
        for most in (1, 2, 3, 9, 40, 64):
            texts = lambda: [("".join(rng.choices(letters, k=rng.randint(1, most))).encode()[:most]) for _ in range(400)]  # noqa: B023, E731
            a, b = texts(), texts()
            b[:100] = [x[:-1] + x[:1] for x in a[:100]]
            assert jaro_winkler_of_many(a, b).tolist() == [jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)]
