"""The full-text query language: words, phrases, prefixes, AND OR NOT NEAR, columns, initial ``^``.

A query is parsed on the driver to a tree over numbered phrases. The phrases go through the same
tables as all others; the tree becomes one boolean expression over the phrases that a chunk holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspoor.functions.text import accent_table
from turfspoor.operators.lexical import PHRASES, LexicalIndex, best

SIGNS = re.compile(r'[*"^:()]|\b(?:AND|OR|NOT|NEAR)\b')
COLUMNS = {"titel": "title", "sectie": "section", "tekst": "text", "stammen": "stems", "title": "title", "section": "section", "text": "text", "stems": "stems"}
_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([^\s"*^:(){}+,.;!?\[\]<>=/\\|&%$#@~`\'-]+)|(.))', re.S)


class QuerySyntaxError(ValueError):
    """The text is no valid query; it may still be an ordinary question."""


@dataclass
class Phrase:
    tokens: list[str]
    prefix: bool = False
    cols: frozenset[str] | None = None
    initial: bool = False
    near: int | None = None


def is_syntax(question: str) -> bool:
    return bool(SIGNS.search(question))


def without_syntax(question: str) -> str:
    return SIGNS.sub(" ", question)


def fold(text: str) -> list[str]:
    source, target = accent_table()
    table = {ord(a): target[i] if i < len(target) else None for i, a in enumerate(source)}
    return re.findall(r"[^\W_]+", text.translate(table).lower())


class Parser:
    """Recursive descent: OR binds loosest, then NOT, AND and, tightest, words side by side."""

    def __init__(self, query: str):
        self.phrases: list[Phrase] = []
        self.items, at = [], 0
        while m := _LEX.match(query, at):
            at = m.end()
            if m[1] is not None:
                self.items.append(("text", m[1].replace('""', '"')))
            elif m[2] is not None:
                self.items.append((m[2] if m[2] in ("AND", "OR", "NOT") else "word", m[2]))
            else:
                self.items.append((m[3], m[3]))
        if query[at:].strip():
            raise QuerySyntaxError(query)
        self.items.append(("end", ""))
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.items[min(self.at + k, len(self.items) - 1)][0]

    def take(self, kind: str | None = None) -> str:
        found, value = self.items[self.at]
        if kind is not None and found != kind:
            raise QuerySyntaxError(f"{value!r} where {kind!r} was expected")
        self.at += 1
        return value

    def parse(self):
        tree = self.any_of(None)
        self.take("end")
        return tree

    def any_of(self, cols):
        tree = self.but_not(cols)
        while self.peek() == "OR":
            self.take()
            tree = ("or", tree, self.but_not(cols))
        return tree

    def but_not(self, cols):
        tree = self.all_of(cols)
        while self.peek() == "NOT":
            self.take()
            tree = ("not", tree, self.all_of(cols))
        return tree

    def all_of(self, cols):
        tree = self.side_by_side(cols)
        while self.peek() == "AND":
            self.take()
            tree = ("and", tree, self.side_by_side(cols))
        return tree

    def side_by_side(self, cols):
        tree = self.one(cols)
        while self.peek() in ("text", "word", "^", "(", "{", "-"):
            tree = ("and", tree, self.one(cols))
        return tree

    def column_filter(self) -> frozenset[str] | None:
        start = self.at
        minus = self.peek() == "-"
        if minus:
            self.take()
        names = []
        if self.peek() == "{":
            self.take()
            while self.peek() in ("word", "text"):
                names.append(self.take())
            self.take("}")
        elif self.peek() in ("word", "text") and self.peek(1) == ":":
            names.append(self.take())
        if self.peek() != ":" or not names:
            self.at = start
            if minus or self.peek() == "{":
                raise QuerySyntaxError("a column filter needs a colon")
            return None
        self.take(":")
        if unknown := [n for n in names if n.lower() not in COLUMNS]:
            raise QuerySyntaxError(f"no such column: {unknown[0]}")
        named = frozenset(COLUMNS[n.lower()] for n in names)
        return frozenset(COLUMNS.values()) - named if minus else named

    def one(self, cols):
        found = self.column_filter()
        if found is not None:
            return self.one(found if cols is None else found & cols)
        if self.peek() == "(":
            self.take()
            tree = self.any_of(cols)
            self.take(")")
            return tree
        if self.peek() == "word" and self.items[self.at][1] == "NEAR" and self.peek(1) == "(":
            return self.near(cols)
        return ("phrase", self.phrase(cols))

    def near(self, cols):
        self.at += 2
        members = [self.phrase(cols)]
        while self.peek() in ("text", "word", "^"):
            members.append(self.phrase(cols))
        distance = 10
        if self.peek() == ",":
            self.take()
            number = self.take("word")
            if not number.isdigit():
                raise QuerySyntaxError("NEAR takes a number")
            distance = int(number)
        self.take(")")
        return ("near", distance, members)

    def phrase(self, cols) -> int:
        initial = self.peek() == "^"
        if initial:
            self.take()
        words = [self.string()]
        while self.peek() == "+":
            self.take()
            words.append(self.string())
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        self.phrases.append(Phrase([t for w in words for t in fold(w)], prefix, cols, initial))
        return len(self.phrases) - 1

    def string(self) -> str:
        if self.peek() not in ("text", "word"):
            raise QuerySyntaxError(f"unexpected {self.items[self.at][1]!r}")
        return self.take()


def parse(query: str) -> tuple[object, list[Phrase]]:
    parser = Parser(query)
    return parser.parse(), parser.phrases


def holds(tree, held: Column) -> Column:
    """The tree as an expression over the array of phrase numbers that a chunk holds."""
    kind = tree[0]
    if kind == "phrase":
        return F.array_contains(held, tree[1])
    if kind == "near":
        return F.array_contains(held, F.lit(-1 - tree[2][0]))
    a, b = holds(tree[1], held), holds(tree[2], held)
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def nears(tree) -> list[tuple[int, list[int]]]:
    if tree[0] == "phrase":
        return []
    return [(tree[1], tree[2])] if tree[0] == "near" else nears(tree[1]) + nears(tree[2])


def gates(tree, above: tuple = ()) -> dict[int, tuple]:
    """For each phrase the subtrees that a chunk must satisfy for the phrase to count in its score.

    A phrase in a branch that fails adds nothing, nor does one to the right of NOT.
    """
    kind = tree[0]
    if kind == "phrase":
        return {tree[1]: above}
    if kind == "near":
        return {m: (*above, tree) for m in tree[2]}
    here = (*above, tree)
    return gates(tree[1], here) if kind == "not" else gates(tree[1], here) | gates(tree[2], here)


def search_raw(index: LexicalIndex, query: str, source: str | None = None, limit: int = 40) -> DataFrame:
    """(question_id, ord, chunk_id, score, rank) of a query in the language above.

    Raises QuerySyntaxError if it is none. A valid query without a hit gives no rows.
    """
    tree, phrases = parse(query)
    spark = index.lengths.sparkSession
    rows = [(0, 1, n, p.tokens, p.prefix, sorted(p.cols) if p.cols is not None else None) for n, p in enumerate(phrases)]
    found = index.occurrences(spark.createDataFrame(rows, PHRASES))
    if first := [n for n, p in enumerate(phrases) if p.initial]:
        found = found.filter(~F.col("phrase_no").isin(first) | (F.col("start") == 0))
    together, counted = [], found
    for distance, members in nears(tree):
        if len(members) > 1:
            groups = found.filter(F.col("phrase_no").isin(members))
            found = found.filter(~F.col("phrase_no").isin(members))
            # the occurrences within one column of one chunk: as many as its text has words
            close = groups.groupBy("question_id", "attempt", "ord", "col").applyInPandas(near_filter(distance, members), groups.schema)
            found = found.unionByName(close)
        together.append((members, distance))
    parts = index.score(found, counted)
    held = parts.groupBy("question_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("phrase_no", "part"))).alias("parts")).withColumn("held", F.map_keys("parts"))
    for members, _ in together:
        whole = F.forall(F.array(*[F.lit(m) for m in members]), lambda m: F.array_contains("held", m))
        held = held.withColumn("held", F.when(whole, F.array_append("held", F.lit(-1 - members[0]))).otherwise(F.col("held")))
    score = F.lit(0.0)
    for phrase, above in sorted(gates(tree).items()):
        passed = F.lit(True)
        for branch in above:
            passed = passed & holds(branch, F.col("held"))
        score = score + F.when(passed, F.coalesce(F.try_element_at("parts", F.lit(phrase)), F.lit(0.0))).otherwise(0.0)
    hits = held.filter(holds(tree, F.col("held"))).withColumn("score", score).join(index.lengths, "ord")
    if source:
        hits = hits.filter(F.col("source") == source)
    return best(hits, ["question_id"], limit).select("question_id", "ord", "chunk_id", "score", "rank")


def near_filter(distance: int, members: list[int]):
    """Keep the occurrences that stand together: at most ``distance`` tokens between the first's end
    and the last's start, for some choice of one of each."""
    import itertools

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = {m: list(zip(g["start"], g["size"])) for m, g in pdf.groupby("phrase_no")}
        if set(spans) != set(members):
            return pdf.iloc[:0]
        keep = set()
        for m in members:
            for start, size in spans[m]:
                reach = distance + sum(p[0][1] for p in spans.values()) + size
                around = [[s for s in spans[o] if abs(s[0] - start) <= reach] if o != m else [(start, size)] for o in members]
                for choice in itertools.product(*around):
                    first = min(choice)
                    if max(s for s, _ in choice) - (first[0] + first[1]) <= distance:
                        keep.add((m, start))
                        break
        return pdf[[(m, s) in keep for m, s in zip(pdf["phrase_no"], pdf["start"])]]

    return run
