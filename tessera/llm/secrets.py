"""Secret scans by a trigram index: each rule's regular expression gives a Boolean query of trigrams that every match must have.

Postings (trigram, document) are kept for the trigrams that some query names. A rule's candidates are the documents whose postings
satisfy its query; only those are matched. Rules without mandatory trigrams are matched against every text. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound, running, salted_join, small_or_shuffled, table, written

#: Literal texts of one stretch of a pattern; a stretch with more of them counts as open. Characters of a class that is spelt out.
MOST_LITERALS = 64
MOST_CLASS = 8


def stretches(pattern: str) -> list[set[str]]:
    """The parts of a pattern that follow each other in every match, each a finite set of texts of which one must occur; what has no finite set of texts stands between them.

    Reads literals, escapes, classes, groups, alternatives and repetition; anything that it doesn't know counts as open.
    """
    at = 0

    def product(parts: list[set[str] | None]) -> set[str] | None:
        out = {""}
        for p in parts:
            if p is None or len(out) * len(p) > MOST_LITERALS:
                return None
            out = {a + b for a in out for b in p}
        return out

    def escape() -> set[str] | None:
        nonlocal at
        c, at = pattern[at + 1], at + 2
        if c == "x":
            at += 2
            return {chr(int(pattern[at - 2 : at], 16))}
        return None if c.isalnum() else {c}

    def group() -> set[str] | None:
        nonlocal at
        at += 1
        known = True
        if pattern.startswith("?", at):
            known = pattern.startswith(("?:", "?i:"), at)
            at = pattern.index(":", at) + 1 if known else at
        inner = alternatives()
        at += 1
        each = [product(b) for b in inner]
        return None if not known or None in each else set().union(*each)

    def atom() -> set[str] | None:
        nonlocal at
        c = pattern[at]
        if c == "\\":
            return escape()
        if c == "(":
            return group()
        if c == "[":
            end = at + 2
            while pattern[end] != "]":
                end += 1 + (pattern[end] == "\\")
            body, at = pattern[at + 1 : end], end + 1
            plain = body[0] != "^" and "\\" not in body and "-" not in body[1:-1] and len(body) <= MOST_CLASS
            return {*body} if plain else None
        at += 1
        return None if c in ".^$" else {c}

    def alternatives() -> list[list[set[str] | None]]:
        nonlocal at
        out: list[list[set[str] | None]] = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                out.append([])
                continue
            one, times = atom(), pattern[at : at + 1]
            if times and times in "?*+{":
                at = pattern.index("}", at) + 1 if times == "{" else at + 1
                one = {"", *one} if times == "?" and one is not None else None
            out[-1].append(one)
        return out

    every = alternatives()
    whole = [product(b) for b in every]
    parts = every[0] if len(every) == 1 else [None if None in whole else set().union(*whole)]
    done: list[set[str]] = [{""}]
    for p in parts:
        if p is None or len(done[-1]) * len(p) > MOST_LITERALS:
            done.append({""})
        else:
            done[-1] = {a + b for a in done[-1] for b in p}
    return done


def query_of(pattern: str) -> tuple[tuple[tuple[str, ...], ...], ...]:
    """An AND of ORs of ANDs of lower-case trigrams that every match has; empty when there are none that must occur."""
    clauses = []
    for texts in stretches(pattern):
        if min(map(len, texts)) >= 3:
            grams = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in map(str.lower, texts)}
            # an alternative that asks for more than another one adds nothing
            clauses.append(tuple(sorted(tuple(sorted(g)) for g in grams if not any(o < g for o in grams))))
    return tuple(clauses)


@dataclass(frozen=True)
class Rule:
    """kind; pattern (Java); group whose length, or 0 for the match's, is at least least. A pattern has no look-around."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def query(self) -> tuple[tuple[tuple[str, ...], ...], ...]:
        return query_of(self.pattern)


#: The contract's patterns, then public token formats. A run of a class is taken whole or not at all, so its least length stands in the pattern.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = BASE + (
    Rule("github", r"ghp_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

SPANS = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"


def spans_of(text: Column, r: Rule, order: int) -> Column:
    """Leftmost matches that don't overlap, in code points: what split() leaves between matches gives their places. Those that are too short fall away afterwards."""
    group = lambda m: F.regexp_extract(m, r.pattern, r.group) if r.group else m
    one = lambda m, b: F.struct(F.length(b).cast("bigint").alias("b"), F.length(m).cast("bigint").alias("m"), (F.length(group(m)) >= r.least).alias("ok"))
    found = F.struct(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("m"), F.split(text, r.pattern, -1).alias("b"))
    each = bound(found, lambda x: F.zip_with(x["m"], F.slice(x["b"], F.lit(1), F.size(x["m"])), one))
    add = lambda a, b: a + b
    at = lambda a: running(F.transform(a, lambda x: x["b"] + x["m"]), F.lit(0).cast("bigint"), add)
    span = lambda x, before: F.when(x["ok"], F.struct((before + x["b"]).alias("start"), F.lit(order).alias("order"), F.lit(r.kind).alias("kind"), (before + x["b"] + x["m"]).alias("end")))
    return bound(each, lambda a: F.array_compact(F.zip_with(a, at(a), span))).cast(SPANS)


def no_spans() -> Column:
    return F.expr(f"CAST(array() AS {SPANS})")


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, id) for each trigram that a rule's query names and the lower-cased text has, once."""
    grams = sorted({g for r in rules for clause in r.query() for alt in clause for g in alt})
    if not grams:
        return docs.select(F.lit("").alias("trigram"), "id").limit(0)
    low = docs.select("id", F.lower("text").alias("low"))
    has = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])
    return low.select("id", F.explode(F.array_compact(has)).alias("trigram")).select("trigram", "id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, rules): by document, the sorted places of the rules whose trigram queries its postings satisfy.

    Lists are intersected by counting: for each document and alternative of a query the postings that the alternative names, then for each rule the
    clauses with an alternative that is met. The table of alternatives is as long as the rules make it.
    """
    spark = index.sparkSession
    wanted = [(n, len(r.query()), c, k, g, len(alt)) for n, r in enumerate(rules) for c, clause in enumerate(r.query()) for k, alt in enumerate(clause) for g in alt]
    if not wanted:
        return index.select("id", F.array(F.lit(0)).alias("rules")).limit(0)
    array = F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(w, ("rule", "clauses", "clause", "alt", "trigram", "need"))]) for w in wanted])
    terms = spark.range(1).select(F.explode(array).alias("w")).select("w.*")
    met = index.join(F.broadcast(terms), "trigram").groupBy("id", "rule", "clauses", "clause", "alt", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    whole = met.groupBy("id", "rule", "clauses").agg(F.countDistinct("clause").alias("n")).where("n = clauses")
    return whole.groupBy("id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(id, text, ...) -> (id, text, spans, ...keep): the spans of every rule, by start, then in the order of the rules.

    Null text counts as empty. Ids name rows: rows that repeat an id get the candidates of all of them, which changes no span, as candidates are
    matched again. A null id is matched by every rule. Other columns than those in keep are not read.
    """
    d = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    found, small = small_or_shuffled(written(candidates(postings(d.where("id IS NOT NULL"), rules).distinct(), rules), "secret-candidates"))
    d = (d.join(found, "id", "left") if small else salted_join(d, found, ["id"], "left", F.xxhash64("text"))).withColumn("rules", F.when(F.col("id").isNull(), F.array(*[F.lit(n) for n in range(len(rules))])).otherwise(F.coalesce("rules", F.expr("CAST(array() AS array<int>)"))))
    parts = [F.when(F.array_contains("rules", n), spans_of(F.col("text"), r, n)).otherwise(no_spans()) if r.query() else spans_of(F.col("text"), r, n) for n, r in enumerate(rules)]
    return d.select("id", "text", F.array_sort(F.concat(*parts)).alias("spans"), *keep)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Characters of the pieces that a text is cut into, so that a stretch of it is found without counting from its beginning.
PIECE = 1024


def redacted(text: Column, spans: Column) -> Column:
    """Every stretch that spans (by start) cover becomes [SECRET]; stretches that overlap or touch become one. Work grows with text and spans."""
    far = lambda a: running(F.transform(a, lambda x: x["end"]), F.lit(-1).cast("bigint"), F.greatest)  # noqa: E731  the furthest end before each span
    first = bound(spans, lambda a: F.filter(F.zip_with(a, far(a), lambda x, before: F.struct(before.alias("from"), x["start"].alias("to"))), lambda x: x["to"] > x["from"]))
    # what lies between: from the furthest end before to each first span of a stretch, and what comes after all
    tail = F.array(F.struct(F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0)).cast("bigint").alias("from"), F.length(text).cast("bigint").alias("to")))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(p: Column, x: Column) -> Column:
        low = F.greatest(x["from"], F.lit(0).cast("bigint"))
        k = F.floor(low / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(p, k + 1, F.floor(x["to"] / PIECE).cast("int") - k + 1), ""), (low % PIECE).cast("int") + 1, (x["to"] - low).cast("int"))

    return bound(F.struct(pieces.alias("p"), F.concat(first, tail).alias("g")), lambda s: F.array_join(F.transform(s["g"], lambda x: cut(s["p"], x)), "[SECRET]"))


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of documents; null texts are empty, rows that repeat a doc_id are rows of their own."""
    s = scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
