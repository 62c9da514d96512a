"""Secret scans behind a trigram index, in DataFrame functions alone.

Each rule is a regular expression.  From its parse a Boolean query over trigrams is derived: which
trigrams of the lower-cased text every match must contain.  Sequences join the strings they can
be, as far as these are few; where they can't be listed, the query asks for the trigrams of what
stands before and behind.  Alternatives become ORs, and optional parts ask for nothing.

The index holds, for each text, its membership in the posting list of each trigram that some query
names, as bits next to the text: it is the inverted index turned on its side, so that queries
intersect and unite posting lists as bit operations and neither texts nor postings are shuffled.
Candidates are verified by the expression itself; a rule without mandatory trigrams (runs of hex
digits) scans every text.

Matches are leftmost and do not overlap within a kind; places are code points, end exclusive,
found from the pieces between matches.  Defined results: null text is empty and has no matches;
every row of the input gives a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, reduce
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind; pattern (Java's and Python's meaning must agree); the least length of ``group``."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: The rules of the scan, in the order in which ties of the start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", 24, base=True),
    Rule("aws_secret", r"""(?i:aws_?secret_?(access_?)?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/]{40}"""),
    Rule("azure", r"AccountKey=[A-Za-z0-9+/=]{40,}"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}|ya29[.][A-Za-z0-9_-]{20,}"),
    Rule("huggingface", r"hf_[A-Za-z0-9]{30,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{16,}"),
    Rule("sendgrid", r"SG[.][A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}|hooks[.]slack[.]com/services/[A-Za-z0-9/]{20,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"(https?|ftp|postgres(ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$*+-]+@[A-Za-z0-9.-]+"),
)

#: So many strings of a part are listed at most; beyond, the query asks for less.
MOST_STRINGS = 32

Query = tuple  # ("all", *queries), ("any", *queries) or ("has", trigram); ("all",) is always true
TRUE: Query = ("all",)


def both(queries: Iterable[Query], kind: str = "all") -> Query:
    """One query of several, without repeats and without what says nothing."""
    parts: list[Query] = []
    for q in queries:
        parts += [x for x in (q[1:] if q[0] == kind else (q,)) if x not in parts]
    if kind == "any":  # an alternative that asks for more than another one adds nothing
        asks = [set(q[1:]) if q[0] == "all" else {q} for q in parts]
        parts = [q for q, ask in zip(parts, asks, strict=True) if not any(other < ask for other in asks)]
    return parts[0] if len(parts) == 1 else (kind, *parts)


#: The letters that are most frequent in European texts, and the space.
FREQUENT = "etaoinsrlhdcu "
#: So many trigrams of a string are asked for at most: the ones with the fewest frequent letters.
MOST_TRIGRAMS = 2


def of_strings(strings: Iterable[str]) -> Query:
    """What a text must hold if it holds one of the strings: of each its rarest trigrams, which is
    less than all of them, so no match is lost.  A string that holds another one needs no query."""
    strings = set(strings)
    strings = {s for s in strings if not any(other != s and other in s for other in strings)}
    common = lambda g: sum(c in FREQUENT for c in g)

    def one(s: str) -> Query:
        grams = dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))
        return both(("has", g) for g in sorted(grams, key=common)[:MOST_TRIGRAMS])

    return both(map(one, sorted(strings)), "any")


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] - arg[0] < MOST_STRINGS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS // 2 else None


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """All lower-cased strings that a part of an expression can be (None: too many), or its query."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, TRUE
    if name == "IN":
        return _class(arg), TRUE
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, TRUE
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        sides = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in sides) and len(union := set().union(*(s for s, _ in sides))) <= MOST_STRINGS:
            return union, TRUE
        return None, both((q if s is None else of_strings(s) for s, q in sides), "any")
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, part = arg
        strings, query = _sequence(part)
        if high == 1 and strings is not None:
            return strings | {""} if low == 0 else strings, TRUE
        if low == 0:
            return None, TRUE
        if low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
            return {"".join(x) for x in product(strings, repeat=low)}, TRUE
        return None, query if strings is None else of_strings(strings)
    return None, TRUE


def _sequence(items) -> tuple[set[str] | None, Query]:
    found: list[Query] = []
    run, whole = {""}, True
    for op, arg in items:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        found += [of_strings(run), query]
        run, whole = {""} if strings is None else strings, False
    return (run, TRUE) if whole else (None, both([*found, of_strings(run)]))


@cache
def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of ``pattern`` satisfies."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else of_strings(strings)


def _named(query: Query) -> list[str]:
    return [query[1]] if query[0] == "has" else [g for q in query[1:] for g in _named(q)]


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that some rule's query names, in order of their bit."""
    return list(dict.fromkeys(g for r in rules for g in _named(trigram_query(r.pattern))))


_BITS = 63  # of one long


def posting_bits(low: Column, grams: list[str]) -> Column:
    """Membership of a lower-cased text in the posting list of each trigram, one bit each, as array<long>."""
    one = lambda i, g: F.when(F.contains(low, F.lit(g)), F.lit(1 << i % _BITS).cast("long")).otherwise(F.lit(0).cast("long"))
    word = lambda at: reduce(lambda a, b: a.bitwiseOR(b), (one(i, g) for i, g in list(enumerate(grams))[at : at + _BITS]))
    return F.array(*(word(at) for at in range(0, len(grams), _BITS))).cast("array<bigint>")


def satisfies(query: Query, bits: Column, grams: list[str]) -> Column:
    """Whether the posting bits satisfy a query; the trigrams of an AND are tested together."""
    if query[0] == "any":
        return reduce(lambda a, b: a | b, (satisfies(q, bits, grams) for q in query[1:]))
    masks: dict[int, int] = {}
    parts = query[1:] if query[0] == "all" else (query,)
    for i in (grams.index(q[1]) for q in parts if q[0] == "has"):
        masks[i // _BITS] = masks.get(i // _BITS, 0) | 1 << i % _BITS
    tests = [F.get(bits, F.lit(k)).bitwiseAND(F.lit(m).cast("long")) == F.lit(m) for k, m in masks.items()]
    return reduce(lambda a, b: a & b, tests + [satisfies(q, bits, grams) for q in parts if q[0] != "has"], F.lit(True))


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and the posting bits of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return base.withColumn("low", F.lower("text")).select("doc_id", "text", posting_bits(F.col("low"), vocabulary(rules)).alias("bits"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted lists themselves, (trigram, doc_id), for use outside the scan."""
    at = lambda i: F.get("bits", F.lit(i // _BITS)).bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0
    grams = F.array(*(F.when(at(i), F.lit(g)) for i, g in enumerate(vocabulary(rules))))
    return trigram_index(docs, rules).select(F.explode(F.array_compact(grams)).alias("trigram"), "doc_id").distinct()


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in one text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else F.transform(found, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, F.length).alias("len"), sized.alias("size"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["len"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["size"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and, for each rule, its spans in the whole text of every row (empty: none)."""
    grams, none = vocabulary(rules), F.array().cast("array<struct<start:bigint,end:bigint>>")
    first = {r.kind: F.regexp_extract(F.col("text"), r.pattern, 0) != "" for r in rules}
    spans = [F.when(satisfies(trigram_query(r.pattern), F.col("bits"), grams) & first[r.kind], rule_spans(F.col("text"), r)).otherwise(none).alias(r.kind) for r in rules]
    return trigram_index(docs, rules).select("doc_id", *spans)


def _joined(rules: list[tuple[int, Rule]]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    def tag(n: int, kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("s"))

    tagged = F.concat(*(F.transform(r.kind, tag(n, r.kind)) for n, r in rules))
    return F.concat_ws(",", F.transform(F.array_sort(tagged), lambda x: x["s"]))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    listed = list(enumerate(rules))
    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return scan(docs, rules).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined([x for x in listed if x[1].base]), 256).alias("base_sha256"), _joined(listed).alias("spans"))
