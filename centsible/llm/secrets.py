"""Secret scans: a trigram inverted index picks the documents that a rule can match, regexes verify them.

From each rule's regex a Boolean query over trigrams is derived: an OR over alternatives of the AND of
all trigrams that every match of the alternative must contain. The index holds, for the trigrams that
any query asks for, the documents with that trigram (in lower case). Intersecting the postings of each
alternative gives a rule's candidates; only these are searched with the regex. A rule without mandatory
trigrams is searched in every document. All of it is DataFrame expressions.

Spans are code points, end exclusive. Edge cases: null text is empty text and has no spans; repeated
rows are each reported; rows that share a doc_id but not the text are kept apart; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.llm.frames import text_id

#: At most so many alternatives are kept apart in a query; beyond that it asks for less.
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and without overlap; a match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the base kinds, in the order in which equal starts are listed
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9_.=-]{20,}"),
    Rule("hosted_token", r"(?:ghp|gho|ghu|ghs|glpat|xoxb|xoxp)[_-][A-Za-z0-9_-]{20,}"),
)


# ---- Boolean trigram queries ---------------------------------------------------------------


def _alternatives(parsed) -> list[list[str]]:
    """Each alternative as the literal runs that every match of it contains, lower-cased; a run that may be
    interrupted by anything else ends there. The last run of each is still open to its right."""
    found = [[""]]
    for op, arg in parsed:
        if op is rc.LITERAL:
            options = [[chr(arg).lower()]]
        elif op is rc.SUBPATTERN:
            options = _alternatives(arg[3])
        elif op is rc.BRANCH:
            options = [option for branch in arg[1] for option in _alternatives(branch)]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[:2] == (0, 1):
            options = [[""], *_alternatives(arg[2])]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            once = _alternatives(arg[2])
            options = once if arg[0] == arg[1] == 1 else [[*option, ""] if len(option) > 1 or option[0] else ["", ""] for option in once]
        else:
            options = [["", ""]]
        joined = [[*left[:-1], left[-1] + right[0], *right[1:]] for left in found for right in options]
        found = joined if len(joined) <= MAX_ALTERNATIVES else [[*left, ""] for left in found]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR over the list, AND within each set; None if some match need not contain any trigram."""
    query = []
    for runs in _alternatives(rp.parse(pattern)):
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not grams:
            return None
        query.append(grams)
    return [q for q in dict.fromkeys(query) if not any(other < q for other in query)]


# ---- index and intersection ----------------------------------------------------------------


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """doc_id, tid, gram: the inverted index of the documents for the given trigrams."""
    lowered = docs.select("doc_id", text_id().alias("tid"), F.lower("text").alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select("doc_id", "tid", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id, tid, kinds: the rules whose trigram query the document fulfils (documents with one at least)."""
    asked = [
        (gram, number, len(grams), kind)
        for number, (kind, grams) in enumerate((k, g) for k, query in rules.items() for g in query)
        for gram in sorted(grams)
    ]
    wanted = docs.sparkSession.createDataFrame(asked, "gram string, part int, need int, kind string")
    index = postings(docs, sorted({gram for gram, *_ in asked}))
    hits = (
        index.join(wanted, "gram")
        .groupBy("doc_id", "tid", "part", "need", "kind")
        .agg(F.size(F.collect_set("gram")).alias("have"))  # a set of a few trigrams
        .where("have = need")
    )
    return hits.groupBy("doc_id", "tid").agg(F.collect_set("kind").alias("kinds"))


# ---- verification --------------------------------------------------------------------------


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Sorted array of (start, order, end, kind) of a rule's matches in the text.

    Splitting at the matches gives the lengths between them; running sums give the positions.
    """
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m)).alias("whole"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)).alias("judged"),
    )
    one = lambda start, end: F.struct(
        start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")
    )
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def step(state, part):
        start = state["at"] + part["gap"]
        end = start + F.coalesce(part["whole"], F.lit(0))
        kept = part["judged"].isNotNull() & (part["judged"] >= rule.least)
        return F.struct(
            end.alias("at"),
            F.when(kept, F.concat(state["found"], F.array(one(start, end)))).otherwise(state["found"]).alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    found = F.aggregate(parts, start, step, lambda state: state["found"])
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id and ``found``: array of (start, order, end, kind) sorted by start, then the rules' order."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query}
    rows = docs.select("doc_id", text_id().alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        picked = candidates(docs, indexed).select(F.col("doc_id").alias("c_id"), F.col("tid").alias("c_tid"), "kinds")
        rows = rows.join(picked, (F.col("tid") == F.col("c_tid")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, order)
        if rule.kind in indexed:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        each.append(spans)
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def spans_text(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_kinds(found: Column, kinds: list[str]) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(kinds))
