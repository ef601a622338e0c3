"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: an AND of clauses, each an OR of strings that
every match must hold one of, each string the AND of its trigrams. The index lists, for every trigram
that some query names, the rows whose text has it (A-Z folded). Postings are intersected by grouped
counts; the rows that satisfy a rule's query are its candidates, and only they are matched with its
regex. A rule without mandatory trigrams (hexadecimal runs) scans every text.

Base rules and their positions follow the contract: leftmost matches that don't overlap, of each kind;
start and end in code points, end exclusive; matches with too short a value are dropped after matching.
Null texts are empty. Null ids and repeated rows are rows like others; equal rows get equal spans.
`find` keeps the columns it is given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{16,}"),
)
_MOST_STRINGS = 32


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of lower-case strings: every match holds a string of each clause. Empty: nothing is mandatory."""

    def walk(nodes) -> tuple[set[str] | None, list[set[str]]]:
        """The strings that are all the matches, if they are few; and the clauses."""
        now, clauses, exact = {""}, [], True

        def flush() -> None:
            nonlocal now, exact
            if all(len(x) >= 3 for x in now):
                clauses.append(now)
            now, exact = {""}, False

        for op, arg in nodes:
            name, options, inner = str(op), None, []
            if name == "LITERAL":
                options = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                options, inner = walk(arg[-1])
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                if all(p[0] is not None for p in parts):
                    options = set().union(*[p[0] for p in parts])
                elif all(c for _, c in parts):
                    inner = [set().union(*[max(c, key=lambda s: min(map(len, s))) for _, c in parts])]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                own, held = walk(body)
                if own is not None and (low, high) == (0, 1):
                    options = own | {""}
                elif own is not None and low == high == 1:
                    options = own
                elif low >= 1:
                    inner = held if own is None else [own] if all(len(x) >= 3 for x in own) else []
            elif name == "AT":
                options = {""}
            if options is not None and len(now) * len(options) <= _MOST_STRINGS:
                now = {a + b for a in now for b in options}
            else:
                flush()
                clauses += inner
        if exact:
            return now, []
        flush()
        return None, clauses

    exact, clauses = walk(sre.parse(pattern))
    clauses = [exact] if exact is not None else clauses
    return [sorted(c) for c in clauses if all(len(x) >= 3 for x in c)]


def _trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, key) for rows (key, text)."""
    low = rows.select("key", F.lower("text").alias("low"))
    return low.select("key", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains("low", t))).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the indexes of the rules whose query the row's postings satisfy."""
    wanted = [(r, c, a, t, len(_trigrams(text))) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern)) for a, text in enumerate(clause) for t in _trigrams(text)]
    clauses = {r: len(trigram_query(rule.pattern)) for r, rule in enumerate(rules)}
    # A constant of the rules: some dozens of rows.
    query = F.broadcast(rows.sparkSession.createDataFrame(wanted, "rule int, clause int, alternative int, trigram string, size int"))
    found = postings(rows, sorted({w[3] for w in wanted})).join(query, "trigram")
    held = found.groupBy("key", "rule", "clause", "alternative").agg(F.count_distinct("trigram").alias("n"), F.first("size").alias("size")).filter("n = size")
    met = held.groupBy("key", "rule").agg(F.count_distinct("clause").alias("n"))
    full = reduce(lambda a, b: a | b, [(F.col("rule") == r) & (F.col("n") == n) for r, n in clauses.items() if n])
    return met.filter(full).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, rule: Rule, index: int) -> Column:
    """Array of (start, index, stop, kind). Each step of the regex takes what lies before a match, and the match."""
    pattern = F.lit(rf"(?s)\G(.*?)(?:({rule.pattern})|\z)")
    gaps, whole = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    value = F.regexp_extract_all(text, pattern, F.lit(2 + rule.group))
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = f"array<struct<start:int,kind_no:int,stop:int,kind:string>>"
    start = lambda s, x: s["at"] + F.length(x["gap"])
    one = lambda s, x: F.array(F.struct(start(s, x).alias("start"), F.lit(index).alias("kind_no"), (start(s, x) + F.length(x["whole"])).alias("stop"), F.lit(rule.kind).alias("kind")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("out"))
    kept = lambda x: (F.length(x["whole"]) > 0) & (F.length(x["value"]) >= rule.least)
    step = lambda s, x: F.struct((start(s, x) + F.length(x["whole"])).alias("at"), F.when(kept(x), F.concat(s["out"], one(s, x).cast(none))).otherwise(s["out"]).alias("out"))
    return F.aggregate(steps, begin, step, lambda s: s["out"])


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` (with `text`) and `found`: its spans by start, then by rule."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("_key", F.xxhash64(*[F.col(c) for c in docs.columns]))
    hits = candidates(rows.select(F.col("_key").alias("key"), F.col("_text").alias("text")), rules).withColumnsRenamed({"key": "_key", "rules": "_rules"})
    both = rows.join(hits, "_key", "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,stop:int,kind:string>>")
    parts = []
    for k, rule in enumerate(rules):
        indexed = bool(trigram_query(rule.pattern))
        due = F.array_contains("_rules", k) if indexed else F.col("_text").rlike(rule.pattern[:-1] + f"{{{rule.least}}}" if rule.pattern.endswith("+") and not rule.group else rule.pattern)
        parts.append(F.when(due, matches(F.col("_text"), rule, k)).otherwise(none))
    return both.select(*docs.columns, F.sort_array(F.concat(*parts)).alias("found"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind_no"] == k)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
