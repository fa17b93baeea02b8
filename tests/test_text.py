import hashlib

import pytest
from pyspark.sql import functions as F

from foliomill.functions import text as X


def one(spark, expression, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).collect()[0].x


@pytest.mark.parametrize("given, want", [("  a \n b\t\x1cc　d ", "a b c d"), ("", ""), ("   ", ""), (None, None)])
def test_normalize(spark, given, want):
    assert one(spark, X.normalize(F.col("t")), t=given) == want


@pytest.mark.parametrize("given, want", [
    ("See https://doi.org/10.1016/J.memsci.2022.120123.", "10.1016/j.memsci.2022.120123"), ("no identifier here", None), ("x10.1000/abc", None), ("(10.1234/a-b;c).", "10.1234/a-b;c"), ("", None), (None, None)])
def test_doi(spark, given, want):
    assert one(spark, X.doi(F.col("t")), t=given) == want


def test_quality_of_noise_and_of_prose(spark):
    noise = one(spark, X.quality(X.normalize(F.col("t"))), t="�� @@ || abcde #!")
    assert noise < 0.5 and not one(spark, X.usable(X.normalize(F.col("t"))), t="�� @@ || abcde #!")
    for prose in ("The membrane was measured at room temperature. " * 3, "Мембрана измерялась при комнатной температуре. " * 3):
        assert one(spark, X.usable(X.normalize(F.col("t"))), t=prose)
    assert one(spark, X.quality(X.normalize(F.col("t"))), t="a" * 400) == pytest.approx(1.0)
    assert one(spark, X.quality(X.normalize(F.col("t"))), t="  ") == 0.0
    assert one(spark, X.usable(X.normalize(F.col("t"))), t=None) is False


@pytest.mark.parametrize("given, want", [("a b  c", 3), ("", 1), ("   ", 1), ("word", 1)])
def test_token_count(spark, given, want):
    assert one(spark, X.token_count(F.col("t")), t=given) == want


def test_truncate_tail_escape(spark):
    assert one(spark, X.truncate(F.col("t"), 5), t="abcdefghijkl") == "abcde..."
    assert one(spark, X.truncate(F.col("t"), 5), t=None) == ""
    assert one(spark, X.tail(F.col("t"), 3), t="abcdef") == "def" and one(spark, X.tail(F.col("t"), 9), t="ab") == "ab"
    assert one(spark, X.escape_html(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"


@pytest.mark.parametrize("path, want", [("/x/My Paper.PDF", "My_Paper.pdf"), ("noend", "noend.pdf"), ("/a/ .pdf", "document.pdf"), ("/a/" + "b" * 99 + ".pdf", "b" * 80 + ".pdf")])
def test_stable_name(spark, path, want):
    digest = hashlib.sha256(b"x").hexdigest()
    assert one(spark, X.stable_name(F.col("c"), F.col("p")), c=digest, p=path) == f"{digest[:16]}_{want}"


@pytest.mark.parametrize("given, want", [
    ("Li-Nafion with the conductivity and NMP at -20 a", ["Li-Nafion", "conductivity", "NMP", "at", "20"]), ("ﬁlm", ["film"]), ("the and", []), ("  ", [])])
def test_query_terms(spark, given, want):
    assert one(spark, X.query_terms(F.col("t")), t=given) == want


def test_snippet(spark):
    def cut(text, query):
        return one(spark, X.snippet(F.col("t"), F.col("q"), X.query_terms(F.col("q"))), t=text, q=query)

    assert cut("The ﬁlm was cast", "film") == "The film was cast"
    assert cut("x" * 300 + " needle " + "y" * 300, "NEEDLE").startswith("...") and "needle" in cut("x" * 300 + " needle " + "y" * 300, "NEEDLE")
    assert cut("a " * 400, "zzz") == ("a " * 140).strip()
    assert "мембраны" in cut("Свойства ионообменной мембраны изучены", "нет такой мембраны")
    assert cut("", "q") == "" and cut("   ", "q") == ""


def test_score_and_match(spark):
    def both(text, query):
        q, terms = F.col("q"), X.query_terms(F.col("q"))
        return one(spark, F.struct(X.matches(F.col("t"), q, terms).alias("m"), X.score(F.col("t"), q, terms).alias("s")), t=text, q=query)

    assert tuple(both("Film and film", "film")) == (True, 1000 + 8)
    assert tuple(both("a film of water", "water film")) == (True, 9)
    assert tuple(both("nothing", "water film")) == (False, 0)
    assert tuple(both("100 % of 5 %", "%")) == (True, 1002)
