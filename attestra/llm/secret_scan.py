"""Operator 4, secret scans: a trigram inverted index finds each rule's candidates, the rule's regex verifies them.

From a rule's regex comes a Boolean query over lower-case trigrams that every text with a match satisfies, as a list
of conjunctions, one of which must hold. The index has, for each trigram that some rule asks for and each block of
documents, the block's documents with that trigram. A rule's candidates are the union over its conjunctions of the
intersected postings; only they are scanned. A rule without mandatory trigrams scans every text.

Defined results: null text is empty and has no spans; rows that share an id and a text have the same spans; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import read_table, spans, text_key, written


@dataclass(frozen=True)
class Rule:
    """kind; the regex its trigrams come from; the pattern that scans (it finds what regex does, and tolerates long
    runs); whether ASCII letters match in either case; the part of a match that must be long enough, and how long."""

    kind: str
    regex: str
    pattern: str | None = None
    any_case: bool = False
    value: str | None = None
    least: int = 1

    @property
    def scanner(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.pattern or self.regex)


_KEYWORDS = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", _KEYWORDS + r"([A-Za-z0-9+/_.=-]+)", any_case=True, value=_KEYWORDS, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", pattern=r"(?<![0-9a-f])[0-9a-f]{24,}", least=24),
)
#: Token formats that vendors and standards publish.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay_key", r"sk_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES
DOCS_PER_BLOCK = 4096
#: Strings that a part of a regex may stand for are listed up to so many.
MOST_STRINGS, MOST_CLASS = 64, 8


def _trigrams(strings: set[str]) -> list[frozenset[str]]:
    """A text with one of the strings satisfies one of the conjunctions; [frozenset()] is always true."""
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [g for g in grams if not any(h < g for h in grams)]


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """a and b; the weaker half is dropped where the product would be long, which only adds candidates."""
    if a == [frozenset()] or len(a) * len(b) > MOST_STRINGS:
        return b if a == [frozenset()] else a
    grams = {x | y for x in a for y in b}
    return [g for g in grams if not any(h < g for h in grams)]


def _part(op, arg) -> tuple[set[str] | None, list[frozenset[str]]]:
    """(all strings that the part stands for, or None if too many; its query)."""
    anything = [frozenset()]
    if op is sre.LITERAL:
        return {chr(arg).lower()}, anything
    if op is sre.IN:
        chars = {chr(v).lower() for k, v in arg if k is sre.LITERAL}
        if all(k is sre.LITERAL for k, _ in arg) and len(chars) <= MOST_CLASS:
            return chars, anything
        return None, anything
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), anything
        grams = {g for s, q in parts for g in (q if s is None else _trigrams(s))}
        return None, [g for g in grams if not any(h < g for h in grams)]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        strings, query = _sequence(sub)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, anything
        if (low, high) == (1, 1):
            return strings, query
        return None, (query if strings is None else _trigrams(strings)) if low else anything
    if op is sre.AT:
        return {""}, anything
    return None, anything


def _sequence(parts) -> tuple[set[str] | None, list[frozenset[str]]]:
    run, query, whole = {""}, [frozenset()], True
    for op, arg in parts:
        strings, sub = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _both(_both(query, _trigrams(run)), sub if strings is None else _trigrams(strings)), False
        run = {""}
    return (run, query) if whole else (None, _both(query, _trigrams(run)))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Conjunctions of lower-case trigrams, one of which holds in every text that regex matches, also in either
    case; [frozenset()] if there are no mandatory trigrams."""
    strings, query = _sequence(_parser.parse(regex))
    return query if strings is None else _trigrams(strings)


def _number(doc_id: Column, text: Column) -> Column:
    """What stands for a document in postings. Two documents of one number are candidates together; each is verified."""
    return F.xxhash64(doc_id, text_key(text))


def build_index(docs: DataFrame, grams: list[str], n_blocks: int) -> DataFrame:
    """docs (doc_id, text) as postings (block, gram, docs): docs is an array<bigint> of numbers. gram is the place in
    grams."""
    low = docs.select(_number(F.col("doc_id"), F.col("text")).alias("number"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    rows = low.select("number", F.explode(has).alias("gram"))
    return rows.groupBy(F.pmod("number", F.lit(n_blocks)).alias("block"), "gram").agg(F.collect_set("number").alias("docs"))


def _tagged(kind: str):
    return lambda d: F.struct(d.alias("number"), F.lit(kind).alias("rule"))


def candidates(index: DataFrame, grams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(number, rules): documents whose trigrams satisfy the query of a rule; rules has the kinds. Postings are sets of
    numbers, so each intersection and union takes time in proportion to them."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("postings"))
    none = F.array().cast("array<bigint>")

    def having(gram: str) -> Column:
        return F.coalesce(F.try_element_at("postings", F.lit(grams.index(gram))), none)

    def matching(query: list[frozenset[str]]) -> Column:
        out = none
        for conj in query:
            posting = None
            for g in sorted(conj):
                posting = having(g) if posting is None else F.array_intersect(posting, having(g))
            out = F.array_union(out, posting)
        return out

    rules = F.flatten(F.array(*[F.transform(matching(q), _tagged(k)) for k, q in queries.items()]))
    rows = blocks.select(F.explode(rules).alias("r")).select("r.*")
    return rows.groupBy("number").agg(F.collect_set("rule").alias("rules"))


def _rule_spans(rule: Rule, text: Column, gate: Column | None = None) -> Column:
    """array<struct<start,end,kind>> of a rule's matches that are long enough."""
    found = spans(text, rule.scanner)
    if gate is not None:
        found = F.when(gate, found)

    def long_enough(s: Column) -> Column:
        match = F.regexp_replace(s["match"], ("(?i)^" if rule.any_case else "^") + rule.value, "") if rule.value else s["match"]
        return F.length(match) >= rule.least

    kept = F.filter(found, long_enough) if rule.least > 1 else found
    kept = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.coalesce(kept, F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """docs (doc_id, text) as (doc_id, spans): array<struct<start,end,kind>> in no order."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    full = [r for r in rules if frozenset() in queries[r.kind]]
    indexed = {r.kind: queries[r.kind] for r in rules if r not in full}
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    scanned = [_rule_spans(r, F.col("text")) for r in full]
    if not indexed:
        return docs.select("doc_id", F.concat(none, *scanned).alias("spans"))
    grams = sorted({g for q in indexed.values() for conj in q for g in conj})
    index = written(build_index(docs, grams, max(1, math.ceil(docs.count() / docs_per_block))), "secret-index")
    found = written(candidates(index, grams, indexed), "secret-candidates")
    # texts meet their candidates by a shuffle at every size: the candidates grow with the input
    told = docs.withColumn("number", _number(F.col("doc_id"), F.col("text"))).join(found.hint("merge"), "number", "left")
    verified = [_rule_spans(r, F.col("text"), F.array_contains("rules", r.kind)) for r in rules if r.kind in indexed]
    return told.select("doc_id", F.concat(none, *scanned, *verified).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of all documents."""
    found = scan(read_table(spark, sf_dir, "documents"))
    rank = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = found.select("doc_id", F.sort_array(ranked).alias("spans"))
    n = len(BASE_RULES)

    def told(x: Column) -> Column:
        return F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(rule: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rule)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < n)
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """Matches and the texts between them, whose running lengths give the places."""
    found, kept = [], []
    for i, r in enumerate(rules):
        pattern = (("(?i)" if r.any_case else "") + r.regex).replace("\\x20", " ").replace("'", "''")
        found.append(f"select doc_id, '{r.kind}' as kind, {i} as rank, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as g from d")
        value = f"regexp_replace(mt, '(?i)^{r.value.replace(chr(92) + 'x20', ' ').replace(chr(39), chr(39) * 2)}', '')" if r.value else "mt"
        kept.append(f"(kind = '{r.kind}' and length({value}) >= {r.least})")
    told = "kind || ':' || st || ':' || (st + length(mt))"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(found)}),
s as (select doc_id, kind, rank, m[k] as mt, list_sum([length(x) for x in g[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) as st from f, unnest(range(1, len(m) + 1)) as u(k)),
v as (select doc_id, kind, rank, mt, cast(st as bigint) as st from s where {" or ".join(kept)}),
a as (select doc_id, {", ".join(f"count(*) filter (where rank = {i}) as n_{r.kind}" for i, r in enumerate(BASE_RULES))},
  coalesce(string_agg({told}, ',' order by st, rank) filter (where rank < {len(BASE_RULES)}), '') as base, string_agg({told}, ',' order by st, rank, length(mt)) as spans from v group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)
"""


OP4_SQL = _sql()
