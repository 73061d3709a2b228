"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived: literals that every match holds, alternatives joined by OR,
the trigrams of one literal by AND. The index holds the postings (trigram, document) of all trigrams that some rule asks
for. Intersecting postings yields each rule's candidate documents, and only those are searched with the pattern. A rule
whose pattern compels no trigram (long hex) scans every text.

Matches are leftmost and non-overlapping per rule; positions are code points, end exclusive. Null texts count as empty.
Rows that repeat a doc_id keep results of their own.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read, row_key
from .native import free_name, let, sized, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, and the group that must have min_length characters."""

    kind: str
    pattern: str
    min_length: int = 0
    group: int = 0


BASE_RULES = (
    Rule(
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings that a stretch of a pattern may stand for before it is closed.
_MOST_STRINGS = 16


def _options(node) -> set[str] | None:
    """The lower-cased strings that a part of a pattern stands for, if they are few."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _sequence_options(arg[3])
    if op is rc.BRANCH:
        found = [_sequence_options(x) for x in arg[1]]
        return set().union(*found) if all(x is not None for x in found) else None
    if op is rc.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _sequence_options(arg[2])
        return None if inner is None else inner | {""}
    return None


def _sequence_options(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _options(node)
        if one is None or len(out) * len(one) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over clauses, OR over a clause's literals, AND over a literal's trigrams; no clause: scan all."""
    clauses, now = [], {""}

    def close() -> None:
        if min(map(len, now)) >= 3:
            clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(now)])

    for node in parser.parse(pattern):
        one = _options(node)
        if one is not None and len(now) * len(one) <= _MOST_STRINGS:
            now = {a + b for a in now for b in one}
        else:
            close()
            now = one if one is not None else {""}
    close()
    return clauses


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, key) for each of the trigrams that a text holds, letters in lower case."""
    lowered = keyed.select("key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select(F.explode(present).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key and the bits of the rules (by place) whose queries the postings meet."""
    rows, clauses_of = [], {}
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        clauses_of[r] = (1 << len(query)) - 1
        for c, clause in enumerate(query):
            for a, trigrams in enumerate(clause):
                for i, t in enumerate(sorted(trigrams)):
                    rows.append((t, 1 << r, 1 << c, a, 1 << i, (1 << len(trigrams)) - 1))
    spark = index.sparkSession
    asked = spark.createDataFrame(rows, "trigram string, rule long, clause long, literal int, bit long, all_bits long")
    full = spark.createDataFrame([(1 << r, n) for r, n in clauses_of.items() if n], "rule long, all_clauses long")
    literals = index.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "clause", "literal", "all_bits").agg(F.bit_or("bit").alias("bits"))
    clauses = literals.where("bits = all_bits").groupBy("key", "rule").agg(F.bit_or("clause").alias("met"))
    met = clauses.join(F.broadcast(full), "rule").where("met = all_clauses")
    return met.groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _pieces(text: Column, rule: Rule) -> Column:
    """Of each match of the rule the lengths of the text since the match before (b), of the match (m) and of its group (n)."""
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("held"),
    )

    def lengths(x: Column, i: Column) -> Column:
        return F.struct(*(F.length(F.element_at(x[c], i)).alias(n) for c, n in (("between", "b"), ("match", "m"), ("held", "n"))))

    return F.when(F.rlike(text, pattern), let(found, lambda x: F.transform(F.sequence(F.lit(1), F.size(x["match"])), lambda i: lengths(x, i))))


def secret_spans(documents: DataFrame, rules: tuple[Rule, ...], scratch: Scratch) -> DataFrame:
    """key, secrets of the rows with any: an array of (start, rank, end, kind, n) by start, then rank of the rule.

    Starts are running sums of lengths over a rule's matches in one text, so the work is linear in the matches.
    """
    keyed = documents.select(row_key().alias("key"), text_of().alias("text"))
    asked = sorted({t for rule in rules for clause in trigram_query(rule.pattern) for s in clause for t in s})
    index = scratch.write(postings(keyed, asked), "index")
    wanted = scratch.write(candidates(index, rules), "candidates")
    rows = keyed.join(sized(wanted), "key", "left")
    parts = []
    for r, rule in enumerate(rules):
        pieces = _pieces(F.col("text"), rule)
        if trigram_query(rule.pattern):
            pieces = F.when(F.col("rules").bitwiseAND(F.lit(1 << r)) != 0, pieces)
        parts.append(F.struct(F.lit(r).alias("rank"), pieces.alias("pieces")))
    some = rows.select("key", F.explode(F.array(*parts)).alias("x")).select("key", "x.rank", F.posexplode("x.pieces").alias("at", "p"))
    once = scratch.write(some.groupBy("key", "rank", "at").agg(F.first("p").alias("p")).select("key", "rank", "at", "p.*"), "matches")
    so_far = Window.partitionBy("key", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kinds, least = (F.element_at(F.array(*(F.lit(getattr(x, name)) for x in rules)), F.col("rank") + 1) for name in ("kind", "min_length"))
    placed = once.withColumn("end", F.sum(F.col("b") + F.col("m")).over(so_far).cast("int")).where(F.col("n") >= least)
    span = F.struct((F.col("end") - F.col("m")).alias("start"), "rank", "end", kinds.alias("kind"), "n")
    return scratch.write(placed.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("secrets")), "spans")


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,n:int>>"


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of documents with their spans in the column secrets, which replaces one of that name; without any, it is empty."""
    found = secret_spans(documents, rules, Scratch(documents.sparkSession, "secrets"))
    key, spans = free_name(documents, "key"), free_name(documents, "spans")
    rows = documents.join(sized(found.toDF(key, spans)), row_key() == F.col(key), "left")
    secrets = F.coalesce(F.col(spans), F.array().cast(_SPAN)).alias("secrets")
    return rows.select(*(F.col(f"`{c}`") for c in documents.columns if c.lower() != "secrets"), secrets)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span that any rule found replaced; overlapping spans are replaced as one."""
    found = find_secrets(documents)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        marked = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], fresh, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), marked.alias("out"))

    done = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", done).drop("secrets")


def _count(rank: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE_RULES))
    counts = [_count(r).alias(f"n_{rule.kind}") for r, rule in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    """Every rule by brute force over every text."""
    lists, ranked = [], []
    for r, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        lists.append(
            f"regexp_extract_all(t, '{p}') AS m{r}, regexp_extract_all(t, '{p}', {rule.group}) AS g{r}, string_split_regex(t, '{p}') AS b{r}"
        )
        at = f"CAST(len(array_to_string(b{r}[1:i], '')) + len(array_to_string(m{r}[1:i - 1], '')) AS BIGINT)"
        one = f"{{'s': {at}, 'r': {r}, 'e': {at} + len(m{r}[i]), 'k': '{rule.kind}', 'n': len(g{r}[i])}}"
        ranked.append(f"list_filter(list_transform(range(1, len(m{r}) + 1), lambda i: {one}), lambda x: x.n >= {rule.min_length})")
    everything = " || ".join(ranked)
    written = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.r = {r})) AS n_{rule.kind}" for r, rule in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(lists)} FROM d),
s AS (SELECT doc_id, list_sort({everything}) AS a FROM f)
SELECT doc_id, {counts},
       sha256({written.format(f'list_filter(a, lambda x: x.r < {len(BASE_RULES)})')}) AS base_sha256,
       {written.format('a')} AS spans
FROM s
"""


ORACLE = _oracle()
