"""Full-text search: a vector is an array of (lexeme, pos, weight); a query is compiled on the driver to a condition."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default weights of D to A, and the constants of the rank.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
WORD = "[a-z0-9]+"


def to_tsvector(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, counted from 1."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("pos"), F.lit("D").alias("weight")))


def setweight(vector: Column, weight: str) -> Column:
    return F.transform(vector, lambda x: F.struct(x["lexeme"].alias("lexeme"), x["pos"].alias("pos"), F.lit(weight).alias("weight")))


def plainto_tsquery(text: str) -> str:
    return " & ".join(re.findall(WORD, text.lower()))


def to_tsquery(text: str) -> str:
    return text if re.search(r"[&|!()]|<->", text) else plainto_tsquery(text)


def parse(query: str) -> tuple:
    """! binds closest, then <->, &, |: nested ('!', x), ('<->', x, y), ('&', x, y), ('|', x, y) and words."""
    tokens = re.findall(r"<->|[&|!()]|[a-z0-9]+", query.lower())
    at = 0

    def atom():
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the query ends early")
        t, at = tokens[at], at + 1
        if t == "!":
            return ("!", atom())
        if t == "(":
            x = level(0)
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("a parenthesis is open")
            at += 1
            return x
        if t in ("&", "|", "<->", ")"):
            raise ValueError(f"{t} stands where a word should")
        return t

    def level(n: int):
        nonlocal at
        if n == 3:
            return atom()
        x = level(n + 1)
        while at < len(tokens) and tokens[at] == ("|", "&", "<->")[n]:
            op, at = tokens[at], at + 1
            x = (op, x, level(n + 1))
        return x

    out = level(0)
    if at < len(tokens):
        raise ValueError(f"{tokens[at]} is left over")
    return out


def _ends(vector: Column, q) -> Column:
    """Places where a phrase ends."""
    if isinstance(q, str):
        return F.transform(F.filter(vector, lambda x: x["lexeme"] == q), lambda x: x["pos"])
    if q[0] == "<->":
        return F.array_intersect(F.transform(_ends(vector, q[1]), lambda p: p + 1), _ends(vector, q[2]))
    if q[0] == "|":
        return F.array_union(_ends(vector, q[1]), _ends(vector, q[2]))
    raise ValueError("<-> joins words, phrases and alternatives only")


def _needed(q) -> set[str]:
    """Words that every match has."""
    if isinstance(q, str):
        return {q}
    return _needed(q[1]) | _needed(q[2]) if q[0] in ("&", "<->") else set()


def _words(q) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(_words, q[1:]))


def matches(vector: Column, query: str, text: Column | None = None) -> Column:
    """vector @@ query. With the text that the vector is made of, vectors are made only of texts that have all words that a match needs.

    The vector is named once, cut down to the words of the query.
    """

    def of(v: Column, q) -> Column:
        if isinstance(q, str) or q[0] == "<->":
            return F.size(_ends(v, q)) > 0
        if q[0] == "!":
            return ~of(v, q[1])
        return of(v, q[1]) & of(v, q[2]) if q[0] == "&" else of(v, q[1]) | of(v, q[2])

    if not query.strip():
        return F.lit(False)
    q = parse(query)
    own = F.filter(vector, lambda x: x["lexeme"].isin(*sorted(_words(q))))
    found = F.element_at(F.transform(F.array(own), lambda v: of(v, q)), 1)
    if text is None or not _needed(q):
        return found
    low = F.lower(text)
    has = None
    for w in sorted(_needed(q)):
        has = F.contains(low, F.lit(w)) if has is None else has & F.contains(low, F.lit(w))
    return F.when(has, found).when(has.isNotNull(), F.lit(False))


def ts_rank(vector: Column, query: str, weights: tuple[float, float, float, float] | None = None) -> Column:
    """0.05 + 0.4 * share of the query's words that occur + at most 0.5 of their weights (of D, C, B, A) by place, to four digits; 0 for a query without words."""
    of = dict(zip("DCBA", weights)) if weights else WEIGHTS
    words = list(dict.fromkeys(re.findall(WORD, query.lower())))
    if not words:
        return F.when(vector.isNotNull(), F.lit(0.0))
    own = F.filter(vector, lambda x: x["lexeme"].isin(words))
    share = F.size(F.array_distinct(F.transform(own, lambda x: x["lexeme"]))) / len(words)
    weight = lambda x: F.when(x["weight"] == "A", of["A"]).when(x["weight"] == "B", of["B"]).when(x["weight"] == "C", of["C"]).otherwise(of["D"])
    near = F.aggregate(own, F.lit(0.0), lambda s, x: s + weight(x) / x["pos"])
    return F.round(0.4 * share + F.least(F.lit(0.5), 0.1 * near) + 0.05, 4)
