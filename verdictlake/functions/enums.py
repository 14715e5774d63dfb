"""Names, codes and orders of the submission domain."""

from __future__ import annotations

# They must equal the published ones for right results.
STATUS_CODES = {
    "Accepted": "AC",
    "Wrong Answer": "WA",
    "Compile Error": "CE",
    "Time Limit Exceeded": "TLE",
    "Runtime Error": "RE",
    "Memory Limit Exceeded": "Other",
    "Output Limit Exceeded": "Other",
    "Judge Not Available": "Other",
}
LANGUAGES = {"cpp": "C++", "py": "Python", "java": "Java", "c": "C", "rb": "Ruby", "cs": "C#", "rs": "Rust", "go": "Go"}
LETTERS = ["A", "B", "C", "D", "E", "F"]
GROUPS = ["G1", "G2", "G3", "G4", "G5", "G6"]
STATUS_ORDER = ["AC", "WA", "TLE", "RE", "CE", "Other"]
ERROR_ORDER = ["WA", "TLE", "CE", "RE", "Other"]
COMBINATION_ORDER = ["WA", "CE", "RE", "TLE"]
LANGUAGE_ORDER = ["C++", "Python", "Java", "C", "Ruby", "C#", "Rust", "Go", "Other"]
CONTEST_PREFIX = "AtCoder Beginner Contest"
OTHER, ACCEPTED, ARROW, ABANDON = "Other", "AC", "→", "Abandon"
MIN_SUBMISSIONS = 3
#: Published users per group, for the replication gap.
PUBLISHED_USERS = {"G1": 8177, "G2": 15649, "G3": 21753, "G4": 21349, "G5": 11292, "G6": 10652}
#: Published acceptance rates by level, for comparison.
PUBLISHED_AC = {"A": 72.8, "B": 64.5, "C": 50.4, "D": 42.5, "E": 37.7, "F": 35.1}
# End of fixed values.
