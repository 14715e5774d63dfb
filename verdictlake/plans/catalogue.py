"""Every query by name over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.operators import clusters, fact, labels, pairs, paths, profiles, reports
from verdictlake.operators import distributions as D
from verdictlake.sources import driver_tables as T
from verdictlake.streaming import windowed_status_counts


@dataclass
class Log:
    """The frames that queries share, built when asked for."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def problems(self) -> DataFrame:
        return T.problems(self.spark, self.sf_dir)

    @cached_property
    def submissions(self) -> DataFrame:
        return T.submissions(self.spark, self.sf_dir)

    @cached_property
    def labels(self) -> DataFrame:
        return labels.label_problems(self.problems)

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles.user_profiles(self.submissions, self.labels)

    @cached_property
    def users(self) -> DataFrame:
        return profiles.classified(self.profiles)

    @cached_property
    def fact(self) -> DataFrame:
        return fact.fact(self.submissions, self.labels)

    @cached_property
    def cohort(self) -> DataFrame:
        return fact.fact(self.submissions, self.labels, self.users)

    @cached_property
    def pairs(self) -> DataFrame:
        return pairs.pair_stats(self.fact)

    @cached_property
    def paths(self) -> DataFrame:
        return paths.error_paths(self.fact)


_QUERIES: dict[str, Callable[[Log], DataFrame]] = {
    "label_letters": lambda g: g.labels.select("problem_id", "contest", "difficulty", "name"),
    "letter_counts": lambda g: labels.letter_counts(g.labels),
    "contest_sizes": lambda g: labels.contest_sizes(g.problems),
    "user_profiles": lambda g: g.profiles,
    "activity_counts": lambda g: profiles.activity_counts(g.submissions, g.labels),
    "group_summary": lambda g: profiles.group_summary(g.profiles),
    "group_behaviour": lambda g: profiles.group_behaviour(g.profiles),
    "group_gap": lambda g: profiles.group_gap(g.profiles),
    "consecutive_solvers": lambda g: profiles.consecutive_solvers(g.submissions, g.labels),
    "status_dist": lambda g: D.status_distribution(g.fact),
    "status_dist_by_group": lambda g: D.status_by_group(g.cohort),
    "lang_dist": lambda g: D.language_distribution(g.fact),
    "lang_dist_by_group": lambda g: D.language_by_group(g.cohort),
    "status_by_lang": lambda g: D.status_by_language(g.fact),
    "status_by_lang_group": lambda g: D.status_by_language_group(g.cohort),
    "pair_stats": lambda g: g.pairs.select("user_id", "problem_id", "difficulty", "is_resolved", "total_attempts", "first_try_ac", "first_error_type", "attempts_to_ac"),
    "resolution_by_level": lambda g: pairs.resolution_by_level(g.pairs),
    "resolution_by_group": lambda g: pairs.resolution_by_group(g.pairs, g.users),
    "resolution_by_first_error": lambda g: pairs.resolution_by_first_error(g.pairs),
    "resolution_by_first_error_group": lambda g: pairs.resolution_by_first_error_group(g.pairs, g.users),
    "error_paths": lambda g: g.paths,
    "path_top10_by_level": lambda g: paths.top_paths(g.paths, ["difficulty"], 10),
    "path_top5_slice": lambda g: paths.top_paths(g.paths.where("difficulty = 'D' and first_error = 'TLE'"), ["proficiency_group"], 5),
    "path_top12_others": lambda g: paths.top_paths_with_others(g.paths.where("first_error = 'TLE'"), ["proficiency_group"], 12),
    "path_slice_totals": lambda g: reports.slice_totals(g.paths, ["difficulty", "first_error"]),
    "error_combos": lambda g: paths.error_combos(g.paths),
    "error_combos_min_total": lambda g: paths.frequent_combos(paths.error_combos(g.paths)),
    "path_transitions": lambda g: paths.transitions(g.paths),
    "path_transitions_slice": lambda g: paths.transitions(g.paths, 2, 4, first_error="TLE", difficulty="D"),
    "path_flow_nodes": lambda g: paths.flow_nodes(paths.transitions(g.paths)),
    "resolution_by_path_length": lambda g: paths.resolution_by_length(g.paths),
    "status_matrix": lambda g: reports.status_matrix(D.status_distribution(g.fact)),
    "ac_matrix_by_group": lambda g: reports.group_status_matrix(D.status_by_group(g.cohort), "AC"),
    "tle_matrix_by_group": lambda g: reports.group_status_matrix(D.status_by_group(g.cohort), "TLE"),
    "counts_wide": lambda g: reports.counts_wide(D.status_by_group(g.cohort)),
    "reject_share": lambda g: reports.reject_share(D.status_distribution(g.fact)),
    "ac_by_level": lambda g: reports.ac_by_level(D.status_distribution(g.fact)),
    "level_a_group_status": lambda g: reports.level_group_status(D.status_by_group(g.cohort)),
    "lang_matrix": lambda g: reports.language_matrix(D.language_distribution(g.fact)),
    "lang_matrix_level_a": lambda g: reports.language_matrix(D.language_by_group(g.cohort).where("difficulty = 'A'"), "proficiency_group"),
    "lang_status_matrix": lambda g: reports.language_status_matrix(D.status_by_language(g.fact), "TLE"),
    "lang_totals": lambda g: reports.language_totals(D.language_distribution(g.fact)),
    "level_a_by_lang": lambda g: reports.level_by_language(D.status_by_language(g.fact)),
    "resolution_matrix": lambda g: reports.resolution_matrix(pairs.resolution_by_group(g.pairs, g.users), "resolution_rate"),
    "first_error_share": lambda g: reports.first_error_share(pairs.resolution_by_first_error(g.pairs)),
    "first_error_matrix": lambda g: reports.first_error_matrix(pairs.resolution_by_first_error(g.pairs), "avg_attempts_to_ac"),
    "first_error_matrix_masked": lambda g: reports.first_error_group_masked(pairs.resolution_by_first_error_group(g.pairs, g.users)),
    "group_gap_total": lambda g: profiles.group_gap_total(g.profiles),
    "wa_matrix_by_group": lambda g: reports.group_status_matrix(D.status_by_group(g.cohort), "WA"),
    "re_matrix_by_group": lambda g: reports.group_status_matrix(D.status_by_group(g.cohort), "RE"),
    "ce_matrix_by_group": lambda g: reports.group_status_matrix(D.status_by_group(g.cohort), "CE"),
    "lang_status_matrix_ac": lambda g: reports.language_status_matrix(D.status_by_language(g.fact), "AC"),
    "lang_status_matrix_ce": lambda g: reports.language_status_matrix(D.status_by_language(g.fact), "CE"),
    "resolution_matrix_attempts": lambda g: reports.resolution_matrix(pairs.resolution_by_group(g.pairs, g.users), "avg_attempts_to_ac"),
    "resolution_matrix_first_try": lambda g: reports.resolution_matrix(pairs.resolution_by_group(g.pairs, g.users), "first_try_rate"),
    "level_a_resolution_by_group": lambda g: reports.level_resolution(pairs.resolution_by_group(g.pairs, g.users)),
    "level_d_wa_resolution_by_group": lambda g: reports.level_error_resolution(pairs.resolution_by_first_error_group(g.pairs, g.users)),
    "path_transitions_d_by_error": lambda g: paths.transitions(g.paths, 50, by=("first_error",), difficulty="D"),
    "path_transitions_d_tle_by_group": lambda g: paths.transitions(g.paths.where("proficiency_group in ('G4', 'G5', 'G6')"), 15, by=("proficiency_group",), difficulty="D", first_error="TLE"),
    "path_transitions_by_error_level": lambda g: paths.transitions(g.paths, 2, by=("difficulty", "first_error")),
    "windowed_status_counts": lambda g: windowed_status_counts(g.submissions, g.labels),
    "title_extract": lambda g: T.read(g.spark, g.sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title")).where("title is not null"),
    "scan_filter_project": lambda g: g.submissions.where("status = 'Accepted'").select("submission_id", "user_id", "problem_id"),
    "union_all_scan": lambda g: _union_all(g.submissions),
    "user_clusters": lambda g: clusters.user_clusters(g.profiles),
}


def _union_all(subs: DataFrame) -> DataFrame:
    """Files concatenated: the log in two halves, put together and counted."""
    even, odd = (subs.where(F.pmod("submission_id", F.lit(2)) == k).select("problem_id", "status") for k in (0, 1))
    return even.unionByName(odd).groupBy("problem_id", "status").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Callable[[Log], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: q(Log(spark, sf_dir))

    return {name: bind(q) for name, q in _QUERIES.items()}


# -- the same in SQL ---------------------------------------------------------------------------

# Fixed values, written out again so that an error in the engine's own lists shows.
_LETTERS = ["A", "B", "C", "D", "E", "F"]
_GROUPS = ["G1", "G2", "G3", "G4", "G5", "G6"]
_STATUSES = ["AC", "WA", "TLE", "RE", "CE", "Other"]
_ERRORS = ["WA", "TLE", "CE", "RE"]
_LANGUAGES = ["C++", "Python", "Java", "C", "Ruby", "C#", "Rust", "Go", "Other"]
_PUBLISHED_USERS = {"G1": 8177, "G2": 15649, "G3": 21753, "G4": 21349, "G5": 11292, "G6": 10652}
_PUBLISHED_TOTAL = 88872
_PUBLISHED_AC = {"A": 72.8, "B": 64.5, "C": 50.4, "D": 42.5, "E": 37.7, "F": 35.1}
# End of fixed values.

_R2 = "round_even({} * 100, 0) / 100"
_R1 = "round_even({} * 10, 0) / 10"


def _pct(n: str, total: str, digits: int = 2) -> str:
    return (_R2 if digits == 2 else _R1).format(f"(({n})::DOUBLE / ({total}) * 100)")


_BASE = """
WITH problems AS (SELECT p_partkey::VARCHAR AS id, 'AtCoder Beginner Contest ' || p_brand || ' - ' || p_name AS name, 'AtCoder Beginner Contest ' || p_brand AS contest, p_partkey AS pos FROM part),
labels AS (SELECT id AS problem_id, contest, chr((64 + rn)::INT) AS difficulty, name FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY pos) AS rn FROM problems) WHERE rn <= 6),
subs AS (SELECT event_id AS submission_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS problem_id, user_id, ts AS date,
  CASE event_type WHEN 'purchase' THEN 'Accepted' WHEN 'click' THEN 'Wrong Answer' WHEN 'view' THEN 'Time Limit Exceeded' WHEN 'error' THEN 'Runtime Error' ELSE event_type END AS status,
  CASE event_type WHEN 'purchase' THEN 'AC' WHEN 'click' THEN 'WA' WHEN 'view' THEN 'TLE' WHEN 'error' THEN 'RE' ELSE 'Other' END AS status_code,
  (['C++', 'Python', 'Java', 'C', 'Ruby', 'C#', 'Rust', 'Go', 'Other'])[(event_id % 9) + 1] AS language FROM events),
fact AS (SELECT s.*, l.difficulty FROM subs s JOIN labels l USING (problem_id)),
tried AS (SELECT user_id, problem_id, difficulty, count(*) AS n, bool_or(status_code = 'AC') AS solved FROM fact GROUP BY ALL),
raw AS (SELECT user_id, count(*) AS unique_problems_attempted, count_if(solved)::BIGINT AS unique_problems_solved, sum(n)::BIGINT AS total_raw_submissions,
  max(difficulty) FILTER (solved) AS max_difficulty_solved, count(DISTINCT difficulty) FILTER (solved) AS letters FROM tried GROUP BY user_id),
profiles AS (SELECT user_id, unique_problems_attempted, unique_problems_solved, total_raw_submissions, unique_problems_solved::DOUBLE / unique_problems_attempted AS problem_win_rate,
  total_raw_submissions::DOUBLE / unique_problems_attempted AS submissions_per_problem, max_difficulty_solved, 'G' || (ascii(max_difficulty_solved) - 64) AS proficiency_group, letters FROM raw WHERE total_raw_submissions >= 3),
users AS (SELECT user_id, proficiency_group FROM profiles WHERE proficiency_group IS NOT NULL),
cohort AS (SELECT f.*, u.proficiency_group FROM fact f JOIN users u USING (user_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, problem_id ORDER BY date, submission_id) AS attempt FROM fact),
pairs AS (SELECT user_id, problem_id, difficulty, bool_or(status_code = 'AC') AS is_resolved, count(*) AS total_attempts, arg_min(status_code, attempt) = 'AC' AS first_try_ac,
  arg_min(status_code, attempt) AS first_error_type, (min(attempt) FILTER (status_code = 'AC'))::INT AS attempts_to_ac FROM ranked GROUP BY ALL),
gpairs AS (SELECT p.*, u.proficiency_group FROM pairs p JOIN users u USING (user_id)),
cut AS (SELECT r.*, p.attempts_to_ac, p.first_error_type, p.proficiency_group FROM ranked r JOIN gpairs p USING (user_id, problem_id) WHERE p.first_error_type <> 'AC' AND (p.attempts_to_ac IS NULL OR r.attempt <= p.attempts_to_ac)),
pair_paths AS (SELECT user_id, problem_id, difficulty, proficiency_group, first_error_type AS first_error, string_agg(status_code, '→' ORDER BY attempt) AS sequence, count(*)::INT AS sequence_length, bool_or(status_code = 'AC') AS resolved
  FROM cut GROUP BY user_id, problem_id, difficulty, proficiency_group, first_error_type),
path_counts AS (SELECT difficulty, proficiency_group, first_error, sequence, sequence_length, resolved, count(*) AS n_pairs FROM pair_paths GROUP BY ALL),
"""


def _dist(source: str, keys: str, category: str) -> str:
    return f"SELECT *, {_pct('n_submissions', f'sum(n_submissions) OVER (PARTITION BY {keys})')} AS pct FROM (SELECT {keys}, {category}, count(*) AS n_submissions FROM {source} GROUP BY ALL)"


def _resolution(source: str, keys: str, first_try: bool) -> str:
    rate = lambda what: _pct(f"count_if({what})", "count(*)")
    return (
        f"SELECT {keys}, count(*) AS n_pairs, {_R2.format('avg(attempts_to_ac) FILTER (is_resolved)')} AS avg_attempts_to_ac, {rate('is_resolved')} AS resolution_rate, "
        f"{_pct('count(*) - count_if(is_resolved)', 'count(*)')} AS abandon_rate" + (f", {rate('first_try_ac')} AS first_try_rate" if first_try else "") + f" FROM {source} GROUP BY {keys}"
    )


def _wide(source: str, by: str, column: str, values: list[str], cell: str, fill: bool = True) -> str:
    one = lambda v: f"max({cell}) FILTER ({column} = '{v}')"
    return f"SELECT {by}, " + ", ".join((f"coalesce({one(v)}, 0)" if fill else one(v)) + f' AS "{v}"' for v in values) + f" FROM ({source}) GROUP BY {by}"


_STATUS, _GROUP_STATUS = _dist("fact", "difficulty", "status_code"), _dist("cohort", "difficulty, proficiency_group", "status_code")
_LANG, _GROUP_LANG = _dist("fact", "difficulty", "language"), _dist("cohort", "difficulty, proficiency_group", "language")
_LANG_STATUS = _dist("fact", "difficulty, language", "status_code")
_ERR = _resolution("pairs WHERE first_error_type <> 'AC'", "difficulty, first_error_type", False)
_ERR_GROUP = _resolution("gpairs WHERE first_error_type <> 'AC'", "difficulty, proficiency_group, first_error_type", False)
_EDGES = """
SELECT {by}source, target, sum(n_pairs)::BIGINT AS value FROM (
  SELECT {by}n_pairs, CASE WHEN s[i] IN ('AC', 'Abandon') THEN s[i] ELSE s[i] || '_p' || i END AS source, CASE WHEN s[i + 1] IN ('AC', 'Abandon') THEN s[i + 1] ELSE s[i + 1] || '_p' || (i + 1) END AS target
  FROM (SELECT {by}n_pairs, s, unnest(range(1, len(s))) AS i FROM (SELECT {by}n_pairs, (CASE WHEN resolved THEN string_split(sequence, '→') ELSE list_append(string_split(sequence, '→'), 'Abandon') END)[1:{steps}] AS s FROM path_counts WHERE {where})))
GROUP BY {by}source, target"""
_COMBOS = f"""
SELECT combo, proficiency_group, sum(n_pairs)::BIGINT AS total, sum(CASE WHEN resolved THEN n_pairs ELSE 0 END)::BIGINT AS n_resolved, {_pct('sum(CASE WHEN resolved THEN n_pairs ELSE 0 END)', 'sum(n_pairs)', 1)} AS rate
FROM (SELECT *, array_to_string(list_filter(['WA', 'CE', 'RE', 'TLE'], lambda e: list_contains(string_split(sequence, '→'), e)), ', ') AS combo FROM path_counts) WHERE combo <> '' GROUP BY ALL"""


def _top(source: str, keys: str, k: int, group: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n_pairs DESC, sequence)::INT AS rank FROM (SELECT {group}, sum(n_pairs)::BIGINT AS n_pairs FROM {source} GROUP BY ALL)) WHERE rank <= {k}"


_SQL: dict[str, str] = {
    "label_letters": "SELECT problem_id, contest, difficulty, name FROM labels",
    "letter_counts": "SELECT difficulty, count(*) AS n_problems FROM labels GROUP BY 1",
    "contest_sizes": "SELECT n AS n_problems, count(*) AS n_contests FROM (SELECT count(*) AS n FROM problems GROUP BY contest) GROUP BY 1",
    "user_profiles": "SELECT * EXCLUDE (letters) FROM profiles",
    "activity_counts": "SELECT count(*) AS n_users, count_if(total_raw_submissions >= 3)::BIGINT AS n_kept, count(*) - count_if(total_raw_submissions >= 3)::BIGINT AS n_removed FROM raw",
    "group_summary": f"SELECT g AS proficiency_group, n AS n_users, {_pct('n', '(SELECT count(*) FROM profiles)')} AS pct FROM (SELECT coalesce(proficiency_group, 'no AC') AS g, count(*) AS n FROM profiles GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM profiles)",
    "group_behaviour": "SELECT proficiency_group, count(*) AS n_users, "
    + ", ".join(f"round_even(avg({c}) * 1000, 0) / 1000 AS {a}" for c, a in (("problem_win_rate", "avg_win_rate"), ("unique_problems_solved", "avg_solved"), ("submissions_per_problem", "avg_subs_per_problem"), ("unique_problems_attempted", "avg_attempted")))
    + " FROM profiles WHERE proficiency_group IS NOT NULL GROUP BY 1",
    "group_gap": f"SELECT proficiency_group, n_users, {_pct('n_users', 'sum(n_users) OVER ()')} AS pct, p AS n_published, n_users - p AS diff, {_pct('n_users - p', 'p')} AS gap_pct FROM (SELECT proficiency_group, count(*) AS n_users FROM users GROUP BY 1) JOIN (VALUES {', '.join(f"('{g}', {n}::BIGINT)" for g, n in _PUBLISHED_USERS.items())}) v(g, p) ON g = proficiency_group",
    "consecutive_solvers": "SELECT * EXCLUDE (letters) FROM profiles WHERE letters = ascii(max_difficulty_solved) - 64",
    "status_dist": _STATUS,
    "status_dist_by_group": _GROUP_STATUS,
    "lang_dist": _LANG,
    "lang_dist_by_group": _GROUP_LANG,
    "status_by_lang": _LANG_STATUS,
    "status_by_lang_group": _dist("cohort", "difficulty, language, proficiency_group", "status_code"),
    "pair_stats": "SELECT user_id, problem_id, difficulty, is_resolved, total_attempts, first_try_ac, first_error_type, attempts_to_ac FROM pairs",
    "resolution_by_level": _resolution("pairs", "difficulty", True),
    "resolution_by_group": _resolution("gpairs", "difficulty, proficiency_group", True),
    "resolution_by_first_error": _ERR,
    "resolution_by_first_error_group": _ERR_GROUP,
    "error_paths": f"SELECT *, {_pct('n_pairs', 'sum(n_pairs) OVER (PARTITION BY difficulty, proficiency_group, first_error)')} AS proportion_pct FROM path_counts",
    "path_top10_by_level": _top("path_counts", "difficulty", 10, "difficulty, sequence, resolved"),
    "path_top5_slice": _top("path_counts WHERE difficulty = 'D' AND first_error = 'TLE'", "proficiency_group", 5, "proficiency_group, sequence, resolved"),
    "path_top12_others": f"SELECT proficiency_group, CASE WHEN rank <= 12 THEN sequence ELSE 'Others' END AS sequence, least(rank, 13)::INT AS rank, sum(n_pairs)::BIGINT AS n_pairs, {_pct('sum(n_pairs)', 'max(total)', 1)} AS pct FROM (SELECT *, row_number() OVER (PARTITION BY proficiency_group ORDER BY n_pairs DESC, sequence) AS rank, sum(n_pairs) OVER (PARTITION BY proficiency_group) AS total FROM (SELECT proficiency_group, sequence, sum(n_pairs) AS n_pairs FROM path_counts WHERE first_error = 'TLE' GROUP BY ALL)) GROUP BY ALL",
    "path_slice_totals": f"SELECT difficulty, first_error, sum(n_pairs)::BIGINT AS n_pairs, {_pct('sum(n_pairs)', '(SELECT sum(n_pairs) FROM path_counts)')} AS pct FROM path_counts GROUP BY ALL",
    "error_combos": _COMBOS,
    "error_combos_min_total": f"SELECT * FROM (SELECT *, (sum(total) OVER (PARTITION BY combo))::BIGINT AS combo_total, total <= 20 AS small_sample FROM ({_COMBOS})) WHERE combo_total >= 50",
    "path_transitions": _EDGES.format(by="", steps=7, where="n_pairs >= 1"),
    "path_transitions_slice": _EDGES.format(by="", steps=5, where="n_pairs >= 2 AND first_error = 'TLE' AND difficulty = 'D'"),
    "path_flow_nodes": f"SELECT DISTINCT node FROM (SELECT source AS node FROM ({_EDGES.format(by="", steps=7, where='n_pairs >= 1')}) UNION ALL SELECT target FROM ({_EDGES.format(by="", steps=7, where='n_pairs >= 1')}))",
    "resolution_by_path_length": f"SELECT *, {_pct('n_resolved', 'total', 1)} AS rate FROM (SELECT proficiency_group, least(sequence_length - 1, 5)::INT AS length, sum(n_pairs)::BIGINT AS total, sum(CASE WHEN resolved THEN n_pairs ELSE 0 END)::BIGINT AS n_resolved FROM path_counts WHERE sequence_length > 1 GROUP BY ALL) WHERE total >= 5",
    "status_matrix": _wide(_STATUS, "difficulty", "status_code", _STATUSES, "pct"),
    "ac_matrix_by_group": _wide(_GROUP_STATUS + ") WHERE (status_code = 'AC'", "difficulty", "proficiency_group", _GROUPS, "pct", False),
    "tle_matrix_by_group": _wide(_GROUP_STATUS + ") WHERE (status_code = 'TLE'", "difficulty", "proficiency_group", _GROUPS, "pct", False),
    "counts_wide": f"SELECT * FROM (SELECT *, {_pct('AC', 'total', 1)} AS ac_pct FROM (SELECT *, AC + WA + TLE + RE + CE + Other AS total FROM ({_wide(_GROUP_STATUS, 'difficulty, proficiency_group', 'status_code', _STATUSES, 'n_submissions')}))) WHERE AC > 0",
    "reject_share": _wide(f"SELECT *, {_pct('n_submissions', 'sum(n_submissions) OVER (PARTITION BY difficulty)')} AS share FROM ({_STATUS}) WHERE status_code <> 'AC'", "difficulty", "status_code", _STATUSES[1:], "share"),
    "ac_by_level": f"SELECT difficulty, pct, p AS published_pct, {_R2.format('(pct - p)')} AS diff FROM ({_STATUS}) JOIN (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _PUBLISHED_AC.items())}) v(d, p) ON d = difficulty WHERE status_code = 'AC'",
    "level_a_group_status": _wide(_GROUP_STATUS + ") WHERE (difficulty = 'A'", "proficiency_group", "status_code", _STATUSES, "pct"),
    "lang_matrix": _wide(_LANG, "difficulty", "language", _LANGUAGES, "pct"),
    "lang_matrix_level_a": _wide(_GROUP_LANG + ") WHERE (difficulty = 'A'", "proficiency_group", "language", _LANGUAGES, "pct"),
    "lang_status_matrix": _wide(_LANG_STATUS + ") WHERE (status_code = 'TLE'", "language", "difficulty", _LETTERS, "pct"),
    "lang_totals": "SELECT language, count(*) AS n_submissions FROM fact GROUP BY 1",
    "level_a_by_lang": f"SELECT language, pct FROM ({_LANG_STATUS}) WHERE difficulty = 'A' AND status_code = 'AC'",
    "resolution_matrix": _wide(_resolution("gpairs", "difficulty, proficiency_group", True), "difficulty", "proficiency_group", _GROUPS, "resolution_rate", False),
    "first_error_share": f"SELECT difficulty, first_error_type, n_pairs, {_pct('n_pairs', 'sum(n_pairs) OVER (PARTITION BY difficulty)')} AS pct FROM ({_ERR}) WHERE first_error_type <> 'Other'",
    "first_error_matrix": _wide(_ERR, "difficulty", "first_error_type", _ERRORS, "avg_attempts_to_ac", False),
    "first_error_matrix_masked": _wide(f"SELECT *, CASE WHEN NOT (resolution_rate = 0 AND avg_attempts_to_ac IS NULL) THEN resolution_rate END AS shown FROM ({_ERR_GROUP}) WHERE first_error_type <> 'Other'", "difficulty, first_error_type", "proficiency_group", _GROUPS, "shown", False),
    "group_gap_total": f"SELECT *, {_pct('n_users - n_published', 'n_published', 1)} AS gap_pct FROM (SELECT count(*) AS n_users, {_PUBLISHED_TOTAL}::BIGINT AS n_published, count(*) - {_PUBLISHED_TOTAL}::BIGINT AS diff FROM users)",
    **{f"{s.lower()}_matrix_by_group": _wide(_GROUP_STATUS + f") WHERE (status_code = '{s}'", "difficulty", "proficiency_group", _GROUPS, "pct", False) for s in ("WA", "RE", "CE")},
    **{f"lang_status_matrix_{s.lower()}": _wide(_LANG_STATUS + f") WHERE (status_code = '{s}'", "language", "difficulty", _LETTERS, "pct") for s in ("AC", "CE")},
    "resolution_matrix_attempts": _wide(_resolution("gpairs", "difficulty, proficiency_group", True), "difficulty", "proficiency_group", _GROUPS, "avg_attempts_to_ac", False),
    "resolution_matrix_first_try": _wide(_resolution("gpairs", "difficulty, proficiency_group", True), "difficulty", "proficiency_group", _GROUPS, "first_try_rate", False),
    "level_a_resolution_by_group": f"SELECT proficiency_group, resolution_rate, first_try_rate FROM ({_resolution('gpairs', 'difficulty, proficiency_group', True)}) WHERE difficulty = 'A'",
    "level_d_wa_resolution_by_group": f"SELECT proficiency_group, resolution_rate, avg_attempts_to_ac FROM ({_ERR_GROUP}) WHERE difficulty = 'D' AND first_error_type = 'WA'",
    "path_transitions_d_by_error": _EDGES.format(by="first_error, ", steps=7, where="n_pairs >= 50 AND difficulty = 'D'"),
    "path_transitions_d_tle_by_group": _EDGES.format(by="proficiency_group, ", steps=7, where="n_pairs >= 15 AND difficulty = 'D' AND first_error = 'TLE' AND proficiency_group IN ('G4', 'G5', 'G6')"),
    "path_transitions_by_error_level": _EDGES.format(by="difficulty, first_error, ", steps=7, where="n_pairs >= 2"),
    "windowed_status_counts": "SELECT date_trunc('day', date) AS window_start, difficulty, status_code, count(*) AS n_submissions FROM fact GROUP BY ALL",
    "title_extract": "SELECT page_id, title FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages) WHERE title <> ''",
    "scan_filter_project": "SELECT submission_id, user_id, problem_id FROM subs WHERE status = 'Accepted'",
    "union_all_scan": "SELECT problem_id, status, count(*) AS n FROM (SELECT problem_id, status FROM subs WHERE submission_id % 2 = 0 UNION ALL SELECT problem_id, status FROM subs WHERE submission_id % 2 <> 0) GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return {name: f"{_BASE.rstrip().rstrip(',')}\n{sql}" for name, sql in _SQL.items()}
