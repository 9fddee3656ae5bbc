"""Secrets in texts, found through a trigram index. Built of DataFrame functions alone.

Each rule is a regular expression. From its parse tree comes a Boolean query over trigrams that every match must hold:
a set of clauses, each a set of trigrams, of which one must be there as a whole. The index has a posting (trigram,
document) for each trigram that some rule asks for. Intersecting the postings of a clause gives the candidates, and only
their texts are searched with the expression. A rule without a mandatory trigram is searched in every text.

Trigrams are taken from lower-cased text and rules, so the index serves rules of either kind; the search itself keeps to
the rule's case. Texts that are null count as empty.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.frames import kept, packed


class Rule(NamedTuple):
    """``group`` must have ``least`` characters, else the match is dropped (it still uses up its text)."""

    kind: str
    pattern: str
    group: int
    least: int


#: The order is that of the kinds in the result.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # only runs of the full length are asked for: a shorter run would be dropped, and runs do not overlap
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]

Query = frozenset[frozenset[str]]
#: The query that every text meets.
ALWAYS: Query = frozenset([frozenset()])
#: Alternatives that are kept apart while a query is derived; beyond these it gets weaker, never wrong.
MOST = 48


def _absorb(clauses: set[frozenset[str]]) -> Query:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: Query, b: Query) -> Query:
    out = _absorb({x | y for x, y in product(a, b)})
    return out if len(out) <= MOST else a


def _strings(exact: set[str]) -> Query:
    """What a text must hold that has one of these strings."""
    return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact})


def _class(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            found.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def _sequence(tree) -> tuple[set[str] | None, Query]:
    """The strings that the part matches, if they are few, and else what a match must hold."""
    run, need, exact = {""}, ALWAYS, True
    for op, arg in tree:
        strings, query = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        need, exact = _both(_both(need, _strings(run)), query if strings is None else _strings(strings)), False
        run = {""}
    return (run, _strings(run)) if exact else (None, _both(need, _strings(run)))


def _part(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ALWAYS
    if op is sre.IN:
        return _class(arg), ALWAYS
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
            return set().union(*(s for s, _ in parts)), ALWAYS
        return None, _absorb(set().union(*(q if s is None else _strings(s) for s, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALWAYS
        return None, ALWAYS if low == 0 else query if strings is None else _strings(strings)
    return ({""} if op is sre.AT else None), ALWAYS


def trigram_query(pattern: str) -> Query:
    """Boolean query of a pattern: an OR of ANDs of lower-case trigrams; ``ALWAYS`` where none is mandatory."""
    strings, query = _sequence(sre_parser.parse(pattern))
    return query if strings is None else _strings(strings)


def build_index(docs: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """Postings (trigram, key), one for each document and trigram that a rule asks for, written to the shared folder."""
    trigrams = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    low = docs.select(F.col(f"`{key}`").alias("key"), F.lower(F.col(f"`{text}`")).alias("low"))
    here = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return kept(low.select(F.explode(here.cast("array<string>")).alias("trigram"), "key"), "trigrams")


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): for each document the kinds of the rules whose query its postings meet."""
    spark = postings.sparkSession
    clauses = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in c]
    if not clauses:
        return postings.select("key", F.array(F.lit("")).alias("kinds")).limit(0)
    wanted = spark.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    met = (postings.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "clause", "size")
           .agg(F.count_distinct("trigram").alias("found")).where("found = size"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule as an array of (start, order, kind, end): code points, end exclusive.

    The pieces between the matches and the matches themselves give the places by their lengths.
    """
    pattern = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(found).alias("size"),
                         lengths(tested).alias("tested"))
    span = lambda start, end: F.struct(start.alias("start"), F.lit(order).alias("order"),
                                       F.lit(rule.kind).alias("kind"), end.alias("end"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")

    def step(done, x):
        start = done["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(F.coalesce(end, start).alias("at"), F.when(
            x["tested"] >= rule.least, F.concat(done["spans"], F.array(span(start, end)))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda done: done["spans"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(row, spans): every row as a struct, with all spans by start and then by the rules' order.

    Rows that share a key are candidates together, a null key included; each is searched by itself. A text without a
    match, an empty one and a null one have no spans. Extra columns travel inside ``row``.
    """
    chosen = candidates(build_index(docs, key, text, rules), rules).withColumnRenamed("key", "candidate")
    rows = packed(docs, key=F.col(f"`{key}`"), text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    joined = rows.join(chosen, F.col("key").eqNullSafe(F.col("candidate")), "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    each = []
    for order, rule in enumerate(rules):
        wanted = F.rlike("text", F.lit(rule.pattern))
        if trigram_query(rule.pattern) != ALWAYS:
            wanted = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & wanted
        each.append(F.when(wanted, matches(F.col("text"), rule, order)).otherwise(none))
    return joined.select("row", F.array_sort(F.flatten(F.array(*each))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; spans that touch or overlap share one."""

    def step(done, s):
        apart = s["start"] > done["at"]
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        first = F.size(done["parts"]) == 0
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(
            apart | first, F.concat(done["parts"], F.array(gap, F.lit(mark)))).otherwise(done["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda done: F.concat(
        F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))))
