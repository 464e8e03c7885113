"""Column expressions on text: tokens, masking, references, dates, hashes. All run inside codegen."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------
STOP_WORDS = (
    "de het een en of maar want dus als dan dat die deze dit is was zijn ben bent wordt "
    "worden er wij jij hij zij ik je u we ze op in aan van voor met bij naar om over uit "
    "niet geen nog wel ook al maar toch al te tot per zo hoe wie wat welke welk"
).split()
QUESTION_WORDS = "wie wat waar wanneer waarom hoe hoeveel welke welk waarmee waarover wiens who what where when why how which whose".split()
ENDED = ("klaar", "afgerond", "gesloten", "vervallen", "vervangen", "done", "closed", "deprecated")
TRUE_WORDS = ("1", "true", "ja", "yes", "waar", "y", "j")
HIDDEN = "[verborgen]"
REFERENCE = r"\b[A-Z]{2,10}-\d{1,6}\b"
#: The masking passes, in their order: key blocks, values of named keys, known token forms, long mixed runs, dashed groups.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
NAMED_VALUE = r"""(?iU)\b(wachtwoord|password|passwd|pwd|pincode|secret|geheim|token|api[_\- ]?key|apikey|client[_\- ]?secret|access[_\- ]?key)([\s\x1c-\x1f]*[*_`]*[\s\x1c-\x1f]*[:=][\s\x1c-\x1f]*[*_`"']*)([^\s\x1c-\x1f*_`"']+)"""
KNOWN_TOKEN = r"(?U)\b(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|sk-[A-Za-z0-9_\-]{20,}|xox[abpr]-[A-Za-z0-9\-]{10,}|AKIA[0-9A-Z]{16})\b"
LONG_RUN = r"[A-Za-z0-9+/_\-]{32,}={0,2}"
DASHED_RUN = r"\b(?:[A-Za-z0-9]{4,}-){3,}[A-Za-z0-9]{4,}\b"
# ---------------------------------------------------------------------------------------------------

#: White space of Unicode and the separators of ASCII, in a pattern that begins with ``(?U)``.
SPACE = r"[\s\x1c-\x1f]"
MIXED = r"(?=[A-Za-z0-9+/_\-]*[0-9])(?=[A-Za-z0-9+/_\-]*[a-z])(?=[A-Za-z0-9+/_\-]*[A-Z])"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """What ``translate`` maps: each letter whose decomposition is a base letter with marks, and the
    combining marks themselves, which are deleted."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            source.append(c)
            target.append(parts[0])
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Without accents, lower-cased; accents go first, since lower-casing may make new marks."""
    source, target = accent_table()
    ascii_only = F.octet_length(text) == F.length(text)  # it has no accents, and looking up each character is slow
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, source, target)))


def tokens(text: Column) -> Column:
    """Tokens of the index: runs of letters and numbers, folded. Null gives an empty list."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def question_words(text: Column) -> Column:
    """Words of a question: lower-cased runs of word characters, the underscore included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def content_words(text: Column) -> Column:
    """Question words that are no stop words and longer than two characters; repeats stay."""
    return F.filter(question_words(text), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def coarse_stems(words: Column) -> Column:
    """(token, prefix) of each word: from seven characters on it loses three and is a prefix."""
    return F.transform(words, lambda w: F.struct(F.when(F.length(w) >= 7, F.substr(w, F.lit(1), F.length(w) - 3)).otherwise(w).alias("token"), (F.length(w) >= 7).alias("prefix")))


#: Ends of a word of a name and of a name, while the names of a question are one string.
_JOIN, _END = "\u0001", "\u0002"


def names(question: Column) -> Column:
    """The proper names and abbreviations of a question, each as its lower-cased words, without repeats.

    A name is a word in capitals, or one with an initial capital that does not begin a sentence;
    names side by side are one. Of a hyphenated word only the parts with a capital or of digits count.
    Each sentence is cut into words with what stands behind them; a word that is no name becomes an
    end, one that is becomes its parts, and what lies between two ends is a name.
    """
    word = r"(?U)(\w+(?:[-'’]\w+)*)"

    def mark(piece: Column, nth: Column) -> Column:
        token, gap = F.regexp_extract(piece, word, 1), F.regexp_replace(piece, r"(?U)\A\w+(?:[-'’]\w+)*", "")
        letters = F.regexp_replace(token, r"\P{L}", "")
        capitals = (F.length(letters) > 1) & (F.upper(letters) == letters) & (F.lower(letters) != letters)
        is_name = (F.length(token) > 1) & ~F.lower(token).isin([*STOP_WORDS, *QUESTION_WORDS]) & (capitals | (token.rlike(r"^\p{Lu}") & (nth > 0)))
        parts = F.filter(F.split(token, "[-'’]"), lambda p: p.rlike(r"^\p{Lu}|^\p{Nd}+$"))
        return F.when(is_name, F.concat(F.lower(F.array_join(parts, _JOIN)), F.when(gap.rlike(rf"(?U)\A{SPACE}+\z"), F.lit(_JOIN)).otherwise(F.lit(_END)))).otherwise(F.lit(_END))

    def of_sentence(sentence: Column) -> Column:
        pieces = F.regexp_extract_all(sentence, F.lit(r"(?U)(\w+(?:[-'’]\w+)*\W*)"), F.lit(1))
        return F.split(F.array_join(F.transform(pieces, mark), ""), _END)

    runs = F.flatten(F.transform(F.split(blank(question), "[.!?:;]"), of_sentence))
    found = F.transform(runs, lambda run: F.filter(F.split(run, _JOIN), lambda w: w != ""))
    return F.array_distinct(F.filter(found, lambda n: F.size(n) > 0))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    """Without the white space around it, of whatever kind."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_true(value: Column) -> Column:
    """Truth of a free value: null is false, else one of the words for yes, in any case."""
    return F.coalesce(F.lower(stripped(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; ``*`` and ``?`` cross slashes."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            at = end
        else:
            out.append("\\" + c if not c.isalnum() and c not in "_/ " else c)
        at += 1
    return "(?s)^" + "".join(out) + "$"


def selected(path: Column, only: list[str] = (), without: list[str] = ()) -> Column:
    """Whether a path is to be indexed: a pattern matches the whole path or its last part.

    An exclusion always wins; no inclusion means everything.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)

    def any_of(patterns):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | path.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
        return hit

    return ~any_of(without) & (any_of(only) if only else F.lit(True))


def mask_key_blocks(text: Column) -> Column:
    return F.regexp_replace(text, KEY_BLOCK, HIDDEN)


def mask_named_values(text: Column) -> Column:
    return F.regexp_replace(text, NAMED_VALUE, "$1$2" + HIDDEN.replace("[", "\\[").replace("]", "\\]"))


def mask_known_tokens(text: Column) -> Column:
    return F.regexp_replace(text, KNOWN_TOKEN, HIDDEN)


def mask_long_runs(text: Column) -> Column:
    """Runs of 32 characters and more that mix digits, lower and upper case.

    The look-aheads span the characters of the run itself, so they test the run and nothing beyond.
    """
    return F.regexp_replace(text, r"(?U)\b" + MIXED + LONG_RUN, HIDDEN)


def references(text: Column, own: Column | None = None, patterns: tuple[str, ...] = (REFERENCE,)) -> Column:
    """The matches of all patterns, distinct and sorted, without the record's own id."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(blank(text), F.lit(f"({p})"), F.lit(1)) for p in patterns])))
    return F.array_sort(F.array_remove(found, own) if own is not None else found)


def derived_date(path: Column, text: Column, modified: Column) -> Column:
    """A yyyy-mm-dd of this century in the path, else in the first 400 characters, else the file's time."""
    pattern = r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})"
    first = lambda c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(first(path), first(F.substring(text, 1, 400)), F.date_format(modified, "yyyy-MM-dd"), F.lit(""))


def short_id(*parts: Column) -> Column:
    """Twelve hexadecimal characters that identify the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[blank(p.cast("string")) for p in parts])), 1, 12)


def fingerprint(*fields: Column) -> Column:
    """Sixteen hexadecimal characters of the fields; a null and an empty field differ."""
    return F.substring(F.sha1(F.to_json(F.array(*[f.cast("string") for f in fields]))), 1, 16)


def text_key(text: Column) -> Column:
    """Equal for texts that differ only in case, outer blanks or the length of white space."""
    return F.sha1(F.lower(F.trim(F.regexp_replace(blank(text), rf"(?U){SPACE}+", " "))))


def embedding_input(title: Column, section: Column, text: Column) -> Column:
    """Title, the section unless it is the title, and the text below."""
    section = blank(section)
    head = F.when((section != "") & (section != blank(title)), F.concat(blank(title), F.lit(" › "), section)).otherwise(blank(title))
    return F.concat(head, F.lit("\n"), blank(text))


def recency(date: Column, as_of: Column, horizon: int = 730) -> Column:
    """1 today, falling to 0 at the horizon; 0 without a valid date. A future date gives more than 1."""
    day = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")
    good = F.substring(date, 1, 10).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(good & day.isNotNull(), F.greatest(F.lit(0.0), 1 - F.datediff(as_of, day) / F.lit(horizon))).otherwise(0.0)


FRONT = rf"(?U)\A---{SPACE}*\n([\s\S]*?)\n---{SPACE}*(\n|\z)"


def front_block(text: Column) -> Column:
    """The lines between the dashes at the very start, or an empty string. BOMs are to be gone."""
    return F.regexp_extract(blank(text), FRONT, 1)


def front_value(text: Column, name: str) -> Column:
    """The value of a key of the front block, or an empty string. Of a repeated key the last one counts.

    Keys are matched in any case; indented lines and lines without a colon are none. Quotes around
    the value go, double ones first.
    """
    raw = F.regexp_extract(front_block(text), rf"(?is)\A(?:.*\n)?{name}[ \t]*:([^\n]*)", 1)
    return F.regexp_replace(F.regexp_replace(stripped(raw), r'^"+|"+$', ""), "^'+|'+$", "")


def front_body(text: Column) -> Column:
    return F.regexp_replace(blank(text), FRONT, "")


def first_field(text: Column, *names: str) -> Column:
    """The first of the named keys of the front block that is not empty, or null."""
    return F.coalesce(*[F.nullif(front_value(text, n), F.lit("")) for n in names])


def opted_out(text: Column, keys: tuple[str, ...] = ("index",)) -> Column:
    """Whether the front block has a line like ``index: nee``."""
    return front_block(text).rlike(rf"(?imdU)^{SPACE}*({'|'.join(keys)}){SPACE}*:{SPACE}*(nee|no|false|uit|off){SPACE}*$")


def packed_paragraphs(text: Column, limit: int = 1800) -> Column:
    """Texts up to the limit stay; longer ones are packed greedily by paragraph.

    A paragraph is appended while the buffer and it together stay within the limit (the blank line
    between them is not counted); a paragraph beyond the limit stays whole.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"))

    def add(acc, part):
        buf, out = acc.getField("buf"), acc.getField("out")
        fits = buf.isNotNull() & (F.length(buf) + F.length(part) <= limit)
        first = buf.isNull() | (buf == "")
        return F.when(first, F.struct(out.alias("out"), part.alias("buf"))).when(fits, F.struct(out.alias("out"), F.concat(buf, F.lit("\n\n"), part).alias("buf"))).otherwise(F.struct(F.concat(out, F.array(buf)).alias("out"), part.alias("buf")))

    folded = F.aggregate(F.split(text, "\n\n"), start, add, lambda acc: F.concat(acc.getField("out"), F.array(F.coalesce(acc.getField("buf"), F.lit("")))))
    kept = F.filter(F.transform(folded, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(kept)
