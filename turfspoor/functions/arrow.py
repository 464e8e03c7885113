"""Functions that need a real programming language per text; all run in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from turfspoor.functions.text import DASHED_RUN, HIDDEN

#: Types as objects: workers import this module, and only a driver can parse a type from text.
PARTS = ArrayType(StructType([StructField("section", StringType()), StructField("text", StringType())]))

# --- markdown -------------------------------------------------------------------------------------

# fixed values: lengths of sections and chunks, fences and headings
SHORT, LONG = 300, 1800
_FENCE = re.compile(r"^[^\S\n]*```[^\n]*$", re.M)
_HEADING = re.compile(r"^(#{2,4})\s+(.*)$")


def pack(text: str, limit: int = LONG) -> list[str]:
    """Paragraphs packed greedily; see ``packed_paragraphs``, which is the same as an expression."""
    if len(text) <= limit:
        return [text]
    parts: list[list[str]] = [[]]
    size = 0
    for paragraph in text.split("\n\n"):
        if size and size + len(paragraph) > limit:
            parts.append([])
            size = 0
        if size:
            size += 2
            parts[-1].append(paragraph)
        else:  # nothing but empty paragraphs so far
            parts[-1] = [paragraph]
        size += len(paragraph)
    return [p for p in ("\n\n".join(x).strip() for x in parts) if p]


def heading_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, name) of each heading of level 2 to 4 that is in no fenced block."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    spans, at, passed = [], 0, 0
    for line in text.split("\n"):
        while passed < len(fences) and fences[passed] < at:
            passed += 1
        if passed % 2 == 0 and (m := _HEADING.match(line)):
            spans.append((at, at + len(line), len(m.group(1)) - 2, m.group(2).strip()))
        at += len(line) + 1
    return spans


def sections(text: str, title: str) -> list[tuple[str, str]]:
    """(heading path, text) of each section that is not empty; without a heading the path is the title."""
    spans = heading_spans(text)
    path: list[str] = []
    out = [(title, text[: spans[0][0]] if spans else text)]
    for k, (_, end, level, name) in enumerate(spans):
        path = [*path[:level], name]
        out.append((" › ".join(path), text[end : spans[k + 1][0] if k + 1 < len(spans) else len(text)]))
    return [(p, body.strip()) for p, body in out if body.strip()]


def chunk_markdown(text: str, title: str, short: int = SHORT, limit: int = LONG) -> list[tuple[str, str]]:
    """(section, text) of the chunks of a markdown text.

    A short section goes to the one before it, a short first one to the second; then each is packed.
    """
    joined: list[tuple[str, list[str]]] = []
    for name, body in sections(text, title):
        if joined and len(body) < short:
            joined[-1][1].append(body)
        else:
            joined.append((name, [body]))
    bodies = [(name, "\n\n".join(parts)) for name, parts in joined]
    if len(bodies) > 1 and len(bodies[0][1]) < short:
        bodies = [(bodies[1][0], bodies[0][1] + "\n\n" + bodies[1][1]), *bodies[2:]]
    return [(name, part) for name, body in bodies for part in pack(body, limit)]


@F.pandas_udf(PARTS)
def markdown_chunks(text: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([[{"section": s, "text": b} for s, b in chunk_markdown(t or "", n or "")] for t, n in zip(text, title)])


# --- masking --------------------------------------------------------------------------------------

_DASHED = re.compile(DASHED_RUN)
_MIXED = [re.compile(x) for x in ("[0-9]", "[a-z]", "[A-Z]")]


def hide_dashed(text: str | None) -> str | None:
    """Four or more dashed groups are hidden if the whole run mixes digits, lower and upper case."""
    if not text:
        return text
    return _DASHED.sub(lambda m: HIDDEN if all(p.search(m.group()) for p in _MIXED) else m.group(), text)


@F.pandas_udf(StringType())
def mask_dashed_runs(text: pd.Series) -> pd.Series:
    return pd.Series([hide_dashed(t) for t in text], dtype=object)


# --- readable JSON --------------------------------------------------------------------------------


def scalar(value) -> str:
    if isinstance(value, bool):
        return "ja" if value else "nee"
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def plain(value) -> bool:
    """Whether a value stands on one line: no object, and no list that holds objects or lists."""
    return not isinstance(value, dict) and not (isinstance(value, list) and any(isinstance(x, (dict, list)) for x in value))


def outline(value, depth: int = 0):
    """(depth, line) of each line of a value that stands on several, in order."""
    if isinstance(value, dict):
        for key, inner in value.items():
            if inner is None or inner in ("", [], {}):
                continue
            yield depth, f"{key}: {one_line(inner)}" if plain(inner) else f"{key}:"
            if not plain(inner):  # an empty line where nothing is left
                yield from list(outline(inner, depth + 1)) or [(0, "")]
    else:
        for item in value:
            lines = [(depth + 1, one_line(item))] if plain(item) else list(outline(item, depth + 1))
            # an item begins on the line of its dash, one that is empty leaves the dash alone
            yield depth, f"- {lines[0][1].strip() if lines else ''}"
            yield from lines[1:]


def one_line(value) -> str:
    return ", ".join(scalar(x) for x in value) if isinstance(value, list) else scalar(value)


def readable(value) -> str:
    """Nested values as ``key: value`` lines.

    Empty values go; lists of plain values stand on one line, objects and lists of objects in an
    indented block.
    """
    return one_line(value) if plain(value) else "\n".join("  " * depth + line for depth, line in outline(value))


@F.pandas_udf(StringType())
def readable_json(text: pd.Series) -> pd.Series:
    """JSON text as readable lines; text that is no JSON stays as it is."""

    def one(t):
        try:
            return readable(json.loads(t)) if t else t
        except ValueError:
            return t

    return pd.Series([one(t) for t in text], dtype=object)


# --- snippets -------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+")


def snippet_of(text: str | None, terms: list[str], before: str = "[", after: str = "]", size: int = 24) -> str:
    """The window of ``size`` tokens with the most different terms, marked; else the first 200 characters.

    A term ending in ``*`` is a prefix. White space is collapsed.
    """
    import unicodedata

    text = text or ""
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).lower()
    spans = [(m.start(), m.end(), fold(m.group())) for m in _TOKEN.finditer(text)]
    whole, prefixes = {t for t in terms if not t.endswith("*")}, tuple(t[:-1] for t in terms if t.endswith("*"))
    hits = [i for i, (_, _, w) in enumerate(spans) if w in whole or (prefixes and w.startswith(prefixes))]
    if not hits:
        return " ".join(text[:200].split())
    first = max(hits, key=lambda h: (len({spans[i][2] for i in hits if h <= i < h + size}), -h))
    first = max(0, min(first, len(spans) - size))
    last = min(len(spans), first + size)
    out, at = [], spans[first][0]
    for i in range(first, last):
        start, end, _ = spans[i]
        if i in set(hits):
            out += [text[at:start], before, text[start:end], after]
            at = end
    out.append(text[at : spans[last - 1][1]])
    body = " ".join("".join(out).split())
    return ("…" if first else "") + body + ("…" if last < len(spans) else "")


def snippets(text: Column, terms: Column, marks: tuple[str, str] = ("[", "]")) -> Column:
    """The fragment of each text for its terms; see ``snippet_of``."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(t, list(w) if w is not None else [], *marks) for t, w in zip(texts, words)], dtype=object)

    return cut(text, terms)


# --- Dutch stems ----------------------------------------------------------------------------------

VOWELS = "aeiouyè"


def dutch_stem(word: str) -> str:
    """The stem of a Dutch word by the published Snowball algorithm (R1 and R2 regions, four steps)."""
    w = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(rf"^y|(?<=[{VOWELS}])y", "Y", w)
    w = re.sub(rf"(?<=[{VOWELS}])i(?=[{VOWELS}])", "I", w)

    def region(start):
        m = re.compile(rf"[{VOWELS}][^{VOWELS}]").search(w, start)
        return m.end() if m else len(w)

    r1 = region(0)
    r2 = region(r1)
    r1 = max(r1, 3)

    def undouble(x):
        return x[:-1] if x[-2:] in ("kk", "dd", "tt") else x

    def drop_en(x, suffix):
        stem = x[: -len(suffix)]
        if len(stem) >= r1 and stem and stem[-1] not in VOWELS and not stem.endswith("gem"):
            return undouble(stem)
        return x

    # step 1
    if w.endswith("heden"):
        if len(w) - 5 >= r1:
            w = w[:-5] + "heid"
    elif w.endswith(("ene", "en")):
        w = drop_en(w, "ene" if w.endswith("ene") else "en")
    elif w.endswith(("se", "s")):
        suffix = "se" if w.endswith("se") else "s"
        stem = w[: -len(suffix)]
        if len(stem) >= r1 and stem and stem[-1] not in VOWELS + "j":
            w = stem
    # step 2
    removed_e = False
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in VOWELS:
        w, removed_e = undouble(w[:-1]), True
    # step 3a
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = drop_en(w, "en")
    # step 3b
    for suffix in ("baar", "lijk", "bar", "end", "ing", "ig"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if len(stem) >= r2:
                if suffix in ("end", "ing"):
                    w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else undouble(stem)
                elif suffix == "ig":
                    w = w if stem.endswith("e") else stem
                elif suffix == "lijk":
                    w = stem
                    if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in VOWELS:
                        w = undouble(w[:-1])
                elif suffix == "baar" or removed_e:
                    w = stem
            break
    # step 4
    if len(w) > 3 and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-1] not in VOWELS + "I" and w[-4] not in VOWELS:
        w = w[:-2] + w[-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def dutch_stems(words: pd.Series) -> pd.Series:
    return pd.Series([[dutch_stem(w) for w in x] if x is not None else [] for x in words])
