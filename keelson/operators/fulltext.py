"""The plain replacement of full-text indexes: lower-case word tokens, without stemming, stop words or ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.model import Kind, SourceIndex, TablePlan


def columns(index: SourceIndex, table: TablePlan) -> list[str] | None:
    """Target columns of an index that the replacement can serve, in order; None if it can't."""
    if index.unique or index.primary or not index.parts:
        return None
    out = []
    for p in index.parts:
        column = next((c for c in table.columns if c.source_name == p.column), None)
        if column is None or column.kind != Kind.TEXT or p.expression or p.prefix_length or p.descending:
            return None
        out.append(column.target_name)
    return out


def expression_sql(names: list[str]) -> str:
    """The target index expression over the columns, every name in it qualified."""
    from keelson.plans.names import quote

    joined = " || ' '::pg_catalog.text || ".join(f"COALESCE({quote(n)}::pg_catalog.text, ''::pg_catalog.text)" for n in names)
    return f"pg_catalog.to_tsvector('pg_catalog.simple'::pg_catalog.regconfig, {joined})"


WORDS = re.compile(r"""\s+|"(?:[^"]|"")*"|'(?:[^']|'')*'|::|\|\||[^\W\d][\w$]*|[(),.]""")
CALLS = ("to_tsvector", "coalesce")


def _plain(expression: str) -> list[str] | None:
    """An expression's words without what a server adds when it shows one: schema of built-in names, casts to text, grouping.

    Literals keep the type that they are cast to, unquoted names are lower case, quoted ones are marked as names; None for what can't be read.
    """
    words, at = [], 0
    for m in WORDS.finditer(expression):
        if m.start() != at:
            return None
        at = m.end()
        word = m[0]
        if not word.isspace():
            words.append(f"name {word[1:-1].replace(chr(34) * 2, chr(34))}" if word[0] == '"' else word if word[0] == "'" else word.lower())
    if at != len(expression):
        return None
    text = "\0".join(words) + "\0"
    text = text.replace("pg_catalog\0.\0", "")
    text = re.sub(r"('(?:[^']|'')*')\0::\0(text|regconfig)\0", r"\1 \2\0", text)  # a literal and its type are one word
    text = text.replace("::\0text\0", "")
    out: list[str] = []
    grouped: list[bool] = []
    for word in text.split("\0")[:-1]:
        if word == "(":
            grouped.append(not out or out[-1] not in CALLS)
            if grouped[-1]:
                continue
        elif word == ")":
            if not grouped:
                return None
            if grouped.pop():
                continue
        out.append(word)
    return None if grouped else out


def is_expression(expression: str, names: list[str]) -> bool:
    """Whether a target's index expression is the one over these columns, however the server shows it."""
    if not names or expression.count("(") != expression.count(")"):
        return False
    want = ["to_tsvector", "(", "'simple' regconfig", ","]
    for i, n in enumerate(names):
        want += ["||", "' ' text", "||"] if i else []
        want += ["coalesce", "(", f"name {n}", ",", "'' text", ")"]
    found = _plain(expression)
    if found is None:
        return False
    found = ["'simple' regconfig" if w == "'pg_catalog.simple' regconfig" else w for w in found]
    # an unquoted word is a name where one is due
    same = lambda w, f: w == f or (w.startswith("name ") and w[5:] == f and re.fullmatch(r"[^\W\d][\w$]*", f) is not None)
    return len(found) == len(want) + 1 and found[-1] == ")" and all(map(same, want, found))


def document(names: list[str]) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names))


def tokens(doc: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores; an approximation of the target's simple parser."""
    return F.array_distinct(F.filter(F.split(F.lower(doc), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))


def matching(rows: DataFrame, names: list[str], term: str) -> DataFrame:
    """Rows whose document has the term as a token. A plain search comes first; only what holds the term is looked at for its edges."""
    term = term.lower()
    if not re.fullmatch(r"\w+", term):
        return rows.where(F.array_contains(tokens(document(names)), term))
    low = F.lower(document(names))
    return rows.where(F.contains(low, F.lit(term)) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"))
