import pytest

from verdictlake.functions import enums

from verdictlake.operators import distributions as D
from verdictlake.operators import pairs as P
from verdictlake.operators import paths, profiles, reports
from verdictlake.operators.fact import fact
from verdictlake.plans.pipeline import Inputs, run_all, write_all

NAMES = {"AC": "Accepted", "WA": "Wrong Answer", "CE": "Compile Error", "TLE": "Time Limit Exceeded", "RE": "Runtime Error", "XX": "Unknown Verdict"}


@pytest.fixture(scope="module")
def log(spark):
    """Users: u1 first try; u2 error then AC then error; u3 never; u4 two submissions only; u5 ties in date."""
    story = {
        ("u1", "a"): ["AC"],
        ("u1", "b"): ["AC"],
        ("u1", "f"): ["XX", "AC"],
        ("u2", "a"): ["WA", "TLE", "AC", "WA"],
        ("u2", "b"): ["CE", "CE", "AC"],
        ("u3", "a"): ["WA", "RE", "XX", "WA"],
        ("u4", "a"): ["WA", "AC"],
        ("u5", "a"): ["AC", "WA", "AC"],
        ("u5", "zz"): ["AC"],
    }
    rows, n = [], 0
    for (user, problem), codes in story.items():
        for k, code in enumerate(codes):
            n += 1
            rows.append((n, problem, user, 1000 if user == "u5" else 1000 + k, NAMES[code], "py" if n % 2 else None))
    subs = spark.createDataFrame(rows, "submission_id long, problem_id string, user_id string, date long, status string, filename_ext string")
    labels = spark.createDataFrame([("a", "A"), ("b", "B"), ("f", "F")], "problem_id string, difficulty string")
    return subs, labels


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_profiles(log):
    got = as_dict(profiles.user_profiles(*log), "user_id")
    assert set(got) == {("u1",), ("u2",), ("u3",), ("u5",)}  # u4 has two submissions
    assert (got["u1",]["max_difficulty_solved"], got["u1",]["proficiency_group"], got["u1",]["total_raw_submissions"]) == ("F", "G6", 4)
    assert got["u3",]["proficiency_group"] is None and got["u3",]["problem_win_rate"] == 0
    assert tuple(profiles.activity_counts(*log).first()) == (5, 4, 1)
    gapless = {r["user_id"] for r in profiles.consecutive_solvers(*log).collect()}
    assert gapless == {"u2", "u5"}
    summary = as_dict(profiles.group_summary(profiles.user_profiles(*log)), "proficiency_group")
    assert summary["no AC",]["n_users"] == 1 and summary["total",]["pct"] == 100 and summary["G6",]["pct"] == 25


def test_pairs(log):
    got = as_dict(P.pair_stats(fact(*log)), "user_id", "problem_id")
    assert got["u2", "a"]["attempts_to_ac"] == 3 and got["u2", "a"]["total_attempts"] == 4 and got["u2", "a"]["first_error_type"] == "WA"
    assert got["u3", "a"]["attempts_to_ac"] is None and not got["u3", "a"]["is_resolved"]
    assert got["u5", "a"]["first_try_ac"]  # equal dates: the lower submission id comes first
    assert ("u5", "zz") not in got


def test_resolution_rates(log):
    pairs = P.pair_stats(fact(*log))
    level = as_dict(P.resolution_by_level(pairs), "difficulty")
    assert level["A",]["n_pairs"] == 5 and level["A",]["resolution_rate"] == 80 and level["A",]["abandon_rate"] == 20
    for r in level.values():
        assert r["resolution_rate"] + r["abandon_rate"] == 100
    errors = as_dict(P.resolution_by_first_error(pairs), "difficulty", "first_error_type")
    assert ("A", "AC") not in errors and errors["F", "Other"]["avg_attempts_to_ac"] == 2
    assert list(P.resolution_by_level(pairs).columns) == ["difficulty", "n_pairs", "avg_attempts_to_ac", "resolution_rate", "abandon_rate", "first_try_rate"]


def test_distributions_add_up(log):
    rows = fact(*log)
    status = D.status_distribution(rows)
    by_lang = D.status_by_language(rows)
    assert status.groupBy().sum("n_submissions").first()[0] == by_lang.groupBy().sum("n_submissions").first()[0] == rows.count()
    for r in status.groupBy("difficulty").sum("pct").collect():
        assert abs(r[1] - 100) < 0.05
    assert {r["language"] for r in by_lang.collect()} == {"Python", "Other"}


def test_paths(log):
    subs, labels = log
    users = profiles.classified(profiles.user_profiles(subs, labels))
    table = paths.error_paths(fact(subs, labels), users)
    got = as_dict(table, "difficulty", "sequence")
    assert set(got) == {("A", "WA→TLE→AC"), ("B", "CE→CE→AC"), ("F", "Other→AC")}  # cut at the first AC; u3 has no group
    assert all(r["resolved"] and r["sequence"].count("AC") == 1 for r in got.values())
    edges = as_dict(paths.transitions(table), "source", "target")
    assert edges["WA_p1", "TLE_p2"]["value"] == 1 and ("TLE_p2", "AC") in edges
    combos = as_dict(paths.error_combos(table), "combo")
    assert set(combos) == {("WA, TLE",), ("CE",)}
    short = paths.resolution_by_length(table, least=1)
    assert {r["length"] for r in short.collect()} == {1, 2}
    top = paths.top_paths_with_others(table, ["difficulty"], 0)
    assert all(r["sequence"] == "Others" and r["pct"] == 100 for r in top.collect())


def test_long_unresolved_path_ends_in_abandon_or_is_cut(spark):
    table = spark.createDataFrame([("D", "G4", "WA", "→".join(["WA"] * 9), 9, False, 5), ("D", "G4", "RE", "RE", 1, False, 3)], "difficulty string, proficiency_group string, first_error string, sequence string, sequence_length int, resolved boolean, n_pairs long")
    edges = as_dict(paths.transitions(table, depth=3), "source", "target")
    assert set(edges) == {("WA_p1", "WA_p2"), ("WA_p2", "WA_p3"), ("WA_p3", "WA_p4"), ("RE_p1", "Abandon")}
    assert set(as_dict(paths.transitions(table, least=4, depth=3), "source")) == {("WA_p1",), ("WA_p2",), ("WA_p3",)}


def test_masked_cells(spark):
    table = spark.createDataFrame([("B", "G1", "WA", 7, None, 0.0, 100.0), ("B", "G2", "WA", 7, 2.5, 50.0, 50.0)], "difficulty string, proficiency_group string, first_error_type string, n_pairs long, avg_attempts_to_ac double, resolution_rate double, abandon_rate double")
    row = reports.first_error_group_masked(table).first()
    assert row["G1"] is None and row["G2"] == 50


def test_whole_pipeline_and_sinks(spark, log, tmp_path):
    subs, _ = log
    problems = spark.createDataFrame([("a", "AtCoder Beginner Contest 1 - a", 1), ("b", "AtCoder Beginner Contest 1 - b", 2)], "id string, name string, source_pos long")
    pages = spark.createDataFrame([("a", "Score <var>100</var>")], "problem_id string, html string")
    tables = run_all(Inputs(problems, subs, pages))
    write_all(tables, str(tmp_path))
    assert len(tables) == 13
    back = spark.read.option("header", True).csv(f"{tmp_path}/problems_labeled")
    assert {(r["problem_id"], r["difficulty"], r["score"]) for r in back.collect()} == {("a", "A", "100"), ("b", "B", None)}


def test_empty_log(spark, log):
    subs, labels = log
    none = subs.limit(0)
    assert D.status_distribution(fact(none, labels)).count() == 0
    assert profiles.user_profiles(none, labels).count() == 0
    assert P.resolution_by_level(P.pair_stats(fact(none, labels))).count() == 0


def test_language_order_and_totals_in_it(log):
    assert enums.LANGUAGE_ORDER == ["C++", "Python", "Java", "C", "Ruby", "C#", "Rust", "Go", "Other"]
    shown = [r["language"] for r in reports.language_totals(D.language_distribution(fact(*log))).collect()]
    assert shown == ["Python", "Other"]


def test_distributions_of_counts_equal_those_of_rows(log):
    rows = fact(*log)
    counts = D.submission_counts(rows)
    for report in (D.status_distribution, D.language_distribution, D.status_by_language):
        assert report(counts).collect() == report(rows).collect()


def test_paths_find_their_own_cohort(log):
    subs, labels = log
    users = profiles.classified(profiles.user_profiles(subs, labels))
    rows = fact(subs, labels)
    order = ["difficulty", "proficiency_group", "first_error", "sequence"]
    assert paths.error_paths(rows).orderBy(*order).collect() == paths.error_paths(rows, users).orderBy(*order).collect()


def test_clusters_are_those_of_plain_lloyd_rounds(spark):
    from verdictlake.operators.clusters import FEATURES, user_clusters

    rows = [(f"u{k}", *(float(v + (k % 3) * 50 + i) for i, v in enumerate([k % 2, 1, 2, 3, 4]))) for k in range(30)]
    got = {r["user_id"]: r for r in user_clusters(spark.createDataFrame(rows, ["user_id", *FEATURES]), k=3).collect()}
    assert len(got) == 30 and all(r["pc1"] is not None and r["pc2"] is not None for r in got.values())
    of = lambda k: {got[f"u{i}"]["cluster"] for i in range(30) if i % 3 == k}
    assert all(len(of(k)) == 1 for k in range(3)) and len(of(0) | of(1) | of(2)) == 3
