import pytest
from pyspark.sql import functions as F

from verdictlake.functions import exprs
from verdictlake.operators import labels as L

PREFIX = "AtCoder Beginner Contest"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "code"), [("Accepted", "AC"), ("Runtime Error", "RE"), ("Judge Not Available", "Other"), ("new one", "Other"), (None, "Other")])
def test_status_code(spark, raw, code):
    assert one(spark, exprs.status_code(F.col("s")), s=raw) == code


@pytest.mark.parametrize(("ext", "name"), [("cpp", "C++"), ("CPP", "Other"), ("cs", "C#"), (None, "Other"), ("", "Other")])
def test_language(spark, ext, name):
    assert one(spark, exprs.language_of(F.col("s")), s=ext) == name


def test_group_passes_unknown_letters_and_nulls(spark):
    assert one(spark, exprs.group_of(F.col("s")), s="F") == "G6"
    assert one(spark, exprs.group_of(F.col("s")), s="Z") == "Z"
    assert one(spark, exprs.group_of(F.col("s")), s=None) is None


def test_rounding_is_half_even_in_binary(spark):
    got = spark.createDataFrame([(1, 32), (23, 4000), (1, 3)], "n long, t long").select(exprs.share(F.col("n"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [3.12, 0.57, 33.33]


@pytest.mark.parametrize(("name", "contest"), [("X - A - B", "X - A"), ("none", "none"), ("two\nlines - t", "two\nlines")])
def test_contest_is_text_before_the_last_dash(spark, name, contest):
    assert one(spark, exprs.contest_of(F.col("s")), s=name) == contest


@pytest.mark.parametrize(
    ("html", "score"),
    [
        ("<p>Score : <var>300</var> points", 300),
        ("<p>配点 : <var>１００</var> 点", 100),
        ("<P>score\n:\n<VAR>25</VAR>", 25),
        ("<p>Score none", None),
        (None, None),
        ("Score <var>1</var> Score <var>2</var>", 1),
    ],
)
def test_score(spark, html, score):
    assert one(spark, exprs.score_in(F.col("s")), s=html) == score


def test_letters_follow_the_order_within_a_contest_and_stop_at_six(spark):
    problems = [(f"p{i}", f"{PREFIX} 1 - t{i}", i) for i in range(8)] + [(f"q{i}", f"{PREFIX} 2 - t{i}", 100 - i) for i in range(4)] + [("x", "Other Contest - t", 5), ("y", None, 6)]
    got = L.label_problems(spark.createDataFrame(problems, "id string, name string, source_pos long"))
    assert rows(got, "problem_id", "difficulty") == [("p0", "A"), ("p1", "B"), ("p2", "C"), ("p3", "D"), ("p4", "E"), ("p5", "F"), ("q0", "D"), ("q1", "C"), ("q2", "B"), ("q3", "A")]
    assert got.columns == ["problem_id", "contest", "difficulty", "name"]
    sizes = L.contest_sizes(spark.createDataFrame(problems, "id string, name string, source_pos long"))
    assert rows(sizes, "n_problems", "n_contests") == [(4, 1), (8, 1)]


def test_scores_and_coverage(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "problem_id string")
    pages = spark.createDataFrame([("a", "Score <var>100</var>"), ("b", "nothing")], "problem_id string, html string")
    assert rows(L.extract_scores(pages), "problem_id", "score") == [("a", 100)]
    assert tuple(L.score_coverage(asked, pages).first()) == (3, 2, 1, 1)
    empty = L.extract_scores(pages.limit(0))
    assert empty.dtypes == [("problem_id", "string"), ("score", "int")]
    assert L.with_scores(asked, empty).count() == 3


def test_combination_order_and_other_only(spark):
    assert one(spark, exprs.error_combination(F.col("s")), s="TLE→WA→Other→WA→AC") == "WA, TLE"
    assert one(spark, exprs.error_combination(F.col("s")), s="Other→AC") is None


def test_sql_functions(spark):
    from verdictlake.functions.sql import register

    register(spark)
    row = spark.sql("SELECT status_code('Accepted'), status_code(NULL), language_of('rs'), language_of('RS'), group_of('C'), group_of(CAST(NULL AS STRING))").first()
    assert tuple(row) == ("AC", "Other", "Rust", "Other", "G3", None)
