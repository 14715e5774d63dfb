"""Secret scans through a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression on the driver: an OR of
clauses, each an AND of trigrams that every match must hold. The index lists, for each trigram that
some query needs, the documents that hold it; the postings of a clause are intersected, and only the
documents left are scanned with the rule's regular expression. A rule whose expression forces no
trigram scans every document. All of it is DataFrame and SQL functions.

Defined cases: a null text is the empty text (``redact`` leaves it null); texts without secrets have zero
counts and the digest of the empty string; repeated rows are each reported; null ids are kept; an empty
table gives an empty result; whole texts are read, and time grows with their length and hits, not with the
square; spans that start together stand in the order of the rules; other columns may have any name, and
``redact`` keeps them all. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import materialise, maybe_broadcast

#: A trigram query: a set of clauses, each a set of trigrams; an empty clause holds for any text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Beyond this many alternative strings a part of an expression counts as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """``least`` code points are asked of capture group ``group``; shorter matches are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three kinds of the contract, in its order.
BASE_RULES = [
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
]
#: A PEM or PGP private key: all from BEGIN to the next END line of a private key with no BEGIN between; where
#: there is none, its header lines and lines of base64 as far as they go, a short last one included. Line breaks may be
#: escaped, as in JSON, and lines indented or quoted.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\r|\\n|[>#*\"',+])*+(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+|=?[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]{1,15}+={1,2}|=[A-Za-z0-9+/]{4}))*+"
    r"(?:(?<=[A-Za-z0-9+/]{16})\r?\n[\x20\t]*[A-Za-z0-9+/]{1,15}(?=[\x20\t\r]*(?:\n|\Z)))?)"
)
#: Published shapes of further credentials.
MORE_RULES = [
    SecretRule("private_key", PRIVATE_KEY),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    SecretRule("bearer", r"[Bb]earer\x20+[A-Za-z0-9_.~+/=-]{24,}"),
]


def trigram_query(regex: str) -> Query:
    """The clauses of trigrams, lower-cased, one of which any match of ``regex`` holds in full."""
    return _simplify(_Walk().sequence(sre_parse.parse(regex)))


class _Walk:
    """Collects runs of known strings along a concatenation; each run becomes trigrams when it ends."""

    def sequence(self, items) -> Query:
        query, run = ANY, {""}
        for op, arg in items:
            known = self.strings(op, arg)
            if known is not None and len(run) * len(known) <= MOST_STRINGS:
                run = {a + b for a in run for b in known}
                continue
            query = _both(query, _grams(run))
            run = known if known is not None and len(known) <= MOST_STRINGS else {""}
            if known is None:
                query = _both(query, self.forced(op, arg))
        return _both(query, _grams(run))

    def strings(self, op, arg) -> set[str] | None:
        """All strings that the item can match, lower-cased, or None if they are too many."""
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return self.all_of(arg[-1])
        if op is sre.BRANCH:
            parts = [self.all_of(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            inner = self.all_of(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return {""} if op is sre.AT else None

    def all_of(self, items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            known = self.strings(op, arg)
            if known is None or len(out) * len(known) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in known}
        return out

    def forced(self, op, arg) -> Query:
        """What an item of too many strings still forces."""
        if op is sre.SUBPATTERN:
            return self.sequence(arg[-1])
        if op is sre.BRANCH:
            return frozenset().union(*(self.sequence(x) for x in arg[1]))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            return self.sequence(arg[2])
        return ANY


def _grams(run: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run)


def _both(a: Query, b: Query) -> Query:
    return _simplify(frozenset(x | y for x in _simplify(a) for y in _simplify(b)))


def _simplify(q: Query) -> Query:
    """Clauses that ask for more than another clause are idle."""
    return frozenset(c for c in q if not any(d < c for d in q))


#: Elements of a block in running totals, and code points of a chunk of text: what one step may look back over.
BLOCK, CHUNK = 128, 4096


def before_each(values: Column, fold, nothing: Column) -> Column:
    """For each element, ``fold`` over all elements before it, in two levels.

    An accumulator that held the result so far would be copied at each step; here every fold has a number.
    """
    total = lambda part: F.aggregate(part, nothing, fold)
    block = lambda v, k: F.slice(v, k * BLOCK + 1, BLOCK)

    def run(v: Column) -> Column:
        ks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))

        def inside(totals: Column) -> Column:
            so_far = lambda k: total(F.slice(totals, 1, k))
            one = lambda part, base: F.transform(part, lambda _, i: fold(base, total(F.slice(part, 1, i))))
            # a transform over one element names a value once
            return F.flatten(F.transform(ks, lambda k: F.flatten(F.transform(F.array(F.struct(block(v, k).alias("part"), so_far(k).alias("base"))), lambda x: one(x["part"], x["base"])))))

        return F.flatten(F.transform(F.array(F.transform(ks, lambda k: total(block(v, k)))), inside))

    return F.when(F.size(values) > 0, F.flatten(F.transform(F.array(values), run))).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, rank, end, kind), in code points.

    The text is split by the expression; running totals of the lengths of pieces and matches are the offsets.
    """
    regex = F.lit(rule.regex)
    found, parts = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, rule.regex, -1)
    kept = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    length = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    steps = F.transform(F.arrays_zip(parts.alias("p"), found.alias("m"), kept.alias("g")), lambda x: F.struct(length(x["p"]).alias("p"), length(x["m"]).alias("m"), F.char_length(x["g"]).alias("g")))

    def placed(steps: Column) -> Column:
        at = before_each(F.transform(steps, lambda x: x["p"] + x["m"]), lambda a, b: a + b, F.lit(0))
        hit = lambda x, a: F.struct((a + x["p"]).alias("start"), F.lit(rank).alias("rank"), (a + x["p"] + x["m"]).alias("end"), F.lit(rule.kind).alias("kind"), (x["g"] >= rule.least).alias("good"))
        return F.filter(F.zip_with(steps, at, hit), lambda h: h["good"])

    spans = F.transform(F.flatten(F.transform(F.array(steps), placed)), lambda h: F.struct(h["start"].alias("start"), h["rank"].alias("rank"), h["end"].alias("end"), h["kind"].alias("kind")))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    return F.when(F.rlike(text, regex), spans.cast(kind)).otherwise(F.array().cast(kind))


def candidates(docs: DataFrame, rules: list[SecretRule], key: str) -> DataFrame:
    """(key, rules): the documents left for each rule once its postings are intersected."""
    spark = docs.sparkSession
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    clauses = [(kind, n, gram, len(clause)) for kind, q in queries.items() if ANY != q for n, clause in enumerate(sorted(map(sorted, q))) for gram in clause]
    needed = sorted({c[2] for c in clauses})
    if not needed:
        return spark.createDataFrame([], f"{key} long, rules array<string>")
    lowered = docs.select(key, F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in needed]), lambda g: g.isNotNull())
    postings = lowered.select(key, F.explode(held).alias("gram"))
    wanted = spark.createDataFrame(clauses, "kind string, clause int, gram string, size int")
    met = (
        postings.join(F.broadcast(wanted), "gram")  # as many rows as the rules have trigrams
        .groupBy(key, "kind", "clause", "size")
        .agg(F.countDistinct("gram").alias("n"))
        .where("n = size")
    )
    return met.groupBy(key).agg(F.collect_set("kind").alias("rules"))


def scan(docs: DataFrame, rules: list[SecretRule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, hits): every row with its spans sorted by start, then by the order of the rules."""
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("__key", F.xxhash64("doc_id", "text"))
    left = materialise(candidates(rows, rules, "__key"), "secret-candidates")
    rows = rows.join(maybe_broadcast(left, 128), "__key", "left")
    forced = {r.kind for r in rules if trigram_query(r.regex) != ANY}
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = [F.when(F.array_contains("rules", r.kind), spans_of(F.col("text"), r, i)).otherwise(none) if r.kind in forced else spans_of(F.col("text"), r, i) for i, r in enumerate(rules)]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("hits"))


def redact(docs: DataFrame, mask: str = "[secret]", rules: list[SecretRule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans are masked as one.

    The text is cut into chunks once; each piece between spans is taken from the chunks that it lies in, and
    all are joined at the end.
    """
    named = [c for c in docs.columns if c != text_col]
    # the rest of a row travels as its id
    rest = F.struct((F.struct(*named) if named else F.struct(F.lit(0).alias("_"))).alias("row"), F.col(text_col).isNull().alias("none"))
    rows = docs.select(rest.alias("__rest"), F.col(text_col).alias("__text"))
    found = scan(rows, rules, "__rest", "__text").withColumnRenamed("doc_id", "__rest")

    def masked(held: Column) -> Column:
        chunks, hits = held["chunks"], held["hits"]

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
            return F.substr(near, a - first * CHUNK + 1, b - a)

        ends = before_each(F.transform(hits, lambda h: h["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        fresh = F.filter(F.zip_with(hits, ends, lambda h, e: F.struct(e.alias("from"), h["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        last = F.array_max(F.transform(hits, lambda h: h["end"]))
        return F.concat(F.array_join(F.transform(fresh, lambda g: F.concat(piece(g["from"], g["to"]), F.lit(mask))), ""), piece(last, F.char_length("text")))

    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = F.element_at(F.transform(F.array(F.struct(chunks.alias("chunks"), F.col("hits").alias("hits"))), masked), 1)
    clean = F.when(F.col("__rest.none"), F.lit(None).cast("string")).when(F.size("hits") == 0, F.col("text")).otherwise(clean)
    return found.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text_col else F.col("__rest.row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests that the query's contract lays down."""
    found = scan(docs)
    base = [r.kind for r in BASE_RULES]
    joined = lambda hits: F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")
    basic = F.filter("hits", lambda h: h["rank"] < len(base))
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(joined(basic).cast("binary"), 256).alias("base_sha256"), joined(F.col("hits")).alias("spans"))
