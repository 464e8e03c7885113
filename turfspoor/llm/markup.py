"""Markup residue: find it, and turn it into clean text that keeps its structure.

``constructs`` finds the constructs of four languages (html, markdown, wiki, latex). Code blocks are
taken out first, so their signs count for no other language. A sign that several languages share
(lists, ``#`` lines, rules) counts for the language of the rest of the field.

``clean`` strips the markup but keeps headings, lists, code, tables and formulas in one plain
notation. ``main_text`` finds the body of a page by its line-block distribution: the lengths of the
stripped lines are summed over sliding windows, a surge of the sums begins a body and a dive ends it.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("html", "markdown", "wiki", "latex")

# --- fixed values: the elements of HTML and commands of LaTeX that the rules know ------------------
ELEMENTS = "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
COMMANDS = "item bf it em tt sc rm sf sl par noindent newline newpage clearpage maketitle tableofcontents ldots dots cdots quad qquad hline centering large Large small footnotesize LaTeX TeX leq geq neq alpha beta gamma delta epsilon lambda mu pi sigma omega sum prod int infty times cdot pm approx rightarrow leftarrow to partial nabla in textbackslash appendix toprule midrule bottomrule"
# ---------------------------------------------------------------------------------------------------

_E = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))
_C = "|".join(sorted(COMMANDS.split(), key=len, reverse=True))
TAG = re.compile(rf"</?(?:{_E})(?:\s[^<>]*)?/?>", re.I)
COMMENT = re.compile(r"<!--(?:(?!<!--).)*?-->|<!doctype[^<>]*>", re.I | re.S)
ENTITY = re.compile(r"&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

CODE = (
    (("```", "~~~"), "markdown", re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S), 2),
    (("\\begin",), "latex", re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(.*?)(?:\\end\{\1\}|\Z)", re.S), 2),
    (("<",), "wiki", re.compile(r"<(syntaxhighlight|source|nowiki)\b[^<>]*>(.*?)(?:</\1>|\Z)", re.S | re.I), 2),
    (("`",), "markdown", re.compile(r"(?<!`)(`+)(?!`)([^`\n]+)\1(?!`)"), 2),
)
BOXES = re.compile(r"<(/?)(pre|code|script|style|samp|kbd)\b[^<>]*>", re.I)
INDENTED = re.compile(r"(?:(?<=\n\n)|\A)((?:(?: {4}|\t)[^\n]*(?:\n|\Z))+)")

#: Of each language (signs of which a text must hold one, pattern).
STRONG = {
    "latex": (
        (("\\begin", "\\end"), re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}")),
        (("\\",), re.compile(r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|(?<=\})\\[A-Za-z]+\*?\{")),
        (("\\",), re.compile(rf"(?<![\w:\\])\\(?:{_C})(?![A-Za-z\\])")),
        (("$$",), re.compile(r"\$\$.+?\$\$", re.S)),
        (("$",), re.compile(r"(?<![\\$\w])\$(?![\s$])(?=[^$\n]*[\\_^={}<>+])[^$\n]*[^$\s]\$(?![\d$])|(?<![\\$\w])\$[A-Za-z]\$(?![\d$])")),
        (("\\(", "\\["), re.compile(r"\\\((?:(?!\\\()[^\n])+?\\\)|\\\[(?:(?!\\\[).)+?\\\]", re.S)),
    ),
    "wiki": (
        (("\n=",), re.compile(r"^(={1,6})[ \t]*[^=\s](?:[^\n]*[^=\s])?[ \t]*\1[ \t]*$", re.M)),
        (("''",), re.compile(r"(?<!')'{2,5}(?!')[^'\n]+(?:'[^'\n]+)*'{2,5}(?!')")),
        (("[[",), re.compile(r"\[\[[^\[\]\n]+(?:\[\[[^\[\]\n]+\]\][^\[\]\n]*)*\]\]")),
        (("://", "mailto:"), re.compile(r"\[(?:https?|ftp|mailto):[^\s\]]+(?:[ ][^\]\n]*)?\](?![(\[:])")),
        (("{{",), re.compile(r"\{\{[^{}\n][^{}]*\}\}")),
        (("{|", "\n|", "!!"), re.compile(r"^[ \t:]*\{\||^\|\}|^\|-[-]*[ \t]*$|^![^\n]*!!", re.M)),
        (("__", "<ref", "<REF", "<Ref", "<rEf", "<reF", "<REf", "<rEF", "<ReF"), re.compile(r"__(?:TOC|NOTOC|FORCETOC|INHOUD|GEENINHOUD|NOEDITSECTION)__|<ref\b[^>]*/?>", re.I)),
    ),
    "markdown": (
        (("](",), re.compile(r"!?(?<![\w\]])\[[^\[\]\n]+\]\((?=[^()\n]*[/.#:])[^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:[ ]+[\"'][^\"'\n]*[\"'])?\)|!\[[^\[\]\n]*\]\([^()\s]+[^()\n]*\)")),
        (("][", "] ["), re.compile(r"(?<![\w\]\[])\[[^\[\]\n]+\][ ]?\[[^\[\]\n]*\](?![\[(])")),
        (("]:",), re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S+", re.M)),
        (("**",), re.compile(r"(?<![*\\])\*\*\*?(?![\s*])(?:[^\n*]|\*(?!\*))*(?<=[^\s*])\*\*\*?(?!\*)")),
        (("__",), re.compile(r"(?<![\w_\\])__(?![\s_])(?!(?:TOC|NOTOC|FORCETOC|INHOUD|GEENINHOUD|NOEDITSECTION)__)[^_\n]+(?<!\s)__(?![\w_])")),
        (("~~",), re.compile(r"~~(?![\s~])[^~\n]+~~")),
        (("*",), re.compile(r"(?<![\w*\\/.])\*(?![\s*.])[^*\n]+?(?<![\s*])\*(?![\w*.])|(?<![\w*\\/.])\*(?![\s*.])[^*\n]+?(?<![\s*])\*(?=\.(?:\s|$))")),
        (("_",), re.compile(r"(?<![\w_\\])_(?![\s_])[^_\n]+(?<![\s_])_(?![\w_])")),
        (("[ ] ", "[x] ", "[X] "), re.compile(r"^[ \t]*[-*+][ ]\[[ xX]\][ ]", re.M)),
        (("--",), re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M)),
        (("\n==", "\n--"), re.compile(r"^(?![ \t]*(?:[=|-]|$))[^\n]+\n(?:={3,}|-{3,})[ \t]*$", re.M)),
        (("\n>", "\n >", "\n  >", "\n   >"), re.compile(r"^[ ]{0,3}>[ ]?(?=[^\s>\d])", re.M)),
    ),
}
#: Signs of several languages: they count for a language that the rest of the field shows.
HASHED = re.compile(r"^[ ]{0,3}#{1,6}[ \t]+\S", re.M)
LISTED = re.compile(r"^[ \t]*[-+*][ \t]+\S|^[ \t]*\d{1,3}[.)][ \t]+\S", re.M)
TABLED = re.compile(r"^[ \t]*\|[^\n]*\|[ \t]*$", re.M)


def html_boxes(text: str) -> list[tuple[int, int, int, int]]:
    """(start, inside, end of inside, end) of the outermost code elements that are closed, in one pass."""
    tags = [(m.start(), m.end(), m[1], m[2].lower()) for m in BOXES.finditer(text)]
    closing, closers = {}, [None] * len(tags)
    for n in range(len(tags) - 1, -1, -1):
        if tags[n][2]:
            closing[tags[n][3]] = n
        else:
            closers[n] = closing.get(tags[n][3])
    out, at = [], 0
    for n, (start, end, slash, _) in enumerate(tags):
        if not slash and start >= at and closers[n] is not None:
            last = tags[closers[n]]
            out.append((start, end, last[0], last[1]))
            at = last[1]
    return out


def uncoded(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with the insides of its code blocks blanked, and (language, start, end) of each block."""
    blocks = []
    blank = lambda piece: re.sub(r"[^\n]", " ", piece)
    for signs, language, pattern, inside in CODE:
        if not any(x in text for x in signs):
            continue
        at, done, pieces = 0, 0, []
        while m := pattern.search(text, at):
            a, b = m.span(inside)
            pieces += [text[done:a], blank(text[a:b])]
            blocks.append((language, *m.span()))
            done, at = b, max(m.end(), at + 1)
        text = "".join([*pieces, text[done:]])
        if language == "wiki" and "</" in text:  # the elements of HTML come after those of a wiki
            pieces, done = [], 0
            for start, a, b, end in html_boxes(text):
                pieces += [text[done:a], blank(text[a:b])]
                blocks.append(("html", start, end))
                done = b
            text = "".join([*pieces, text[done:]])
    return text, blocks


def constructs(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of the constructs of each language that the text holds."""
    found: dict[str, list[tuple[int, int]]] = {}
    if not text or not text.strip():
        return found
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    for m in INDENTED.finditer(text) if "    " in text or "\t" in text else ():  # indented code: its signs count for nobody
        if re.search(r"[;{}()=$|]", m.group()) and not LISTED.match(m.group()):
            text = text[: m.start()] + re.sub(r"[^\n]", " ", m.group()) + text[m.end() :]
            found.setdefault("indented", []).append(m.span())
    plain, blocks = uncoded(text)
    for language, a, b in blocks:
        found.setdefault(language, []).append((a, b))
    spans = [m.span() for p in (COMMENT, TAG) for m in p.finditer(plain)] if "<" in plain else []
    if "&" in plain:
        spans += [m.span() for m in ENTITY.finditer(plain) if m.group()[1] == "#" or m.group()[1:] in html5]
    if spans:
        found.setdefault("html", []).extend(spans)
    # what stands in tags, comments and addresses is no sign of another language
    bare = TAG.sub(lambda m: " " * len(m.group()), COMMENT.sub(lambda m: " " * len(m.group()), plain)) if "<" in plain else plain
    hinted = "\n" + bare  # so that a line start is a sign like any other
    for language in ("latex", "wiki", "markdown"):
        for signs, pattern in STRONG[language]:
            if any(x in hinted for x in signs) and (spans := [m.span() for m in pattern.finditer(bare)]):
                found.setdefault(language, []).extend(spans)
    _settle(bare, found)
    found.pop("indented", None)
    return found


def _settle(text: str, found: dict) -> None:
    hashed = [m.span() for m in HASHED.finditer(text)] if "#" in text else []
    rest = [m.span() for m in TABLED.finditer(text)] if "|" in text else []
    lists = [m.span() for m in LISTED.finditer(text)] if "wiki" in found or "markdown" in found or hashed or rest else []
    if hashed or rest or lists:
        if "wiki" in found and "markdown" not in found:
            found["wiki"].extend(hashed + lists)
        elif "latex" in found and "markdown" not in found:
            pass
        elif "markdown" in found or hashed or rest:
            found.setdefault("markdown", []).extend(hashed + rest + lists)


# --- clean text -----------------------------------------------------------------------------------


def line_blocks(lines: list[str], window: int = 3) -> list[int]:
    """The summed text lengths over ``window`` lines from each line on."""
    lengths = [len(re.sub(r"\s", "", x)) for x in lines]
    total, out = sum(lengths[:window]), []
    for i in range(len(lines)):
        out.append(total)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - lengths[i]
    return out


HOLD = "\ue000{}\ue001"
HELD = re.compile("\ue000(\\d+)\ue001")
#: Elements of a page with parts around its body; mere fragments (paragraphs, divisions, tables) have no menus or footers.
LAYOUT = re.compile(r"<(?:html|body|main|article|nav|header|footer|aside)\b|<(?:div|ul|section)\s[^<>]*?\b(?:id|class|role)\s*=\s*[\"']?(?:[^\"'<>]*[^a-z\"'<>])?(?:top|main|site|page|sub)?(?:nav|menu|footer|header|sidebar|banner)", re.I)
SENTENCE = re.compile(r"[^\n]*\w[.!?][\"')\u2019\u201d]*\s*$")
HEADED = re.compile(r"\s*#{1,6}\s")
#: Lines of headings, lists and tables, and lines with code or a formula.
STRUCTURE = re.compile(r"\s*(?:#{1,6}\s|[-+*](?:\s|$)|\d{1,3}[.)]\s|\||```|~~~|\$\$)|[^\n]*\ue000")


def restored(text: str, held: list[str]) -> str:
    while HELD.search(text):
        text = HELD.sub(lambda m: held[int(m[1])], text)
    return text


def main_text(stripped: str, window: int = 3, surge: int = 60, held: list[str] | None = None) -> str:
    """The bodies of a stripped page, blank runs and all, by its line-block distribution.

    The page falls into parts where the block sum dives to zero, as the elements of a layout make it
    by the blank lines they leave. A part is a body if its sums surge to ``surge`` or more; held code
    counts with its own length. A heading belongs to what follows it, and a part with a heading, list,
    table, code or formula is kept like a body, and so is one with a sentence between two bodies. A page
    without a body (short texts) is kept whole.
    """
    lines: list[str] = []
    for line in stripped.split("\n"):
        if line.strip() or len(lines) < 2 or lines[-1].strip() or not HEADED.match(lines[-2]):  # one blank line behind a heading
            lines.append(line)
    blocks = line_blocks([restored(x, held or []) for x in lines], window)
    parts, inside = [], False
    for i, b in enumerate(blocks):
        if b and not inside and lines[i].strip():
            parts.append([])
        inside = b > 0 and (inside or bool(lines[i].strip()))
        if inside:
            parts[-1].append(i)
    bodies = [max(blocks[i] for i in x) >= surge for x in parts]
    if not any(bodies):
        return stripped.strip()
    first, last = bodies.index(True), len(bodies) - 1 - bodies[::-1].index(True)
    kept = []
    for n, x in enumerate(parts):
        if bodies[n] or any(STRUCTURE.match(lines[i]) or first < n < last and SENTENCE.match(lines[i]) for i in x):
            kept.append(x)
    return "\n\n".join("\n".join(lines[i] for i in x).strip("\n") for x in kept).strip()


def _strip_html(text: str, hold) -> str:
    text = COMMENT.sub("", text)
    text = re.sub(r"<(script|style)\b[^<>]*>(?:(?!<\1\b).)*?</\1\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?((?:(?!<pre\b).)*?)(?:</code\s*>\s*)?</pre\s*>", lambda m: "\n" + hold(f"```\n{html.unescape(m[1]).strip(chr(10))}\n```") + "\n", text, flags=re.S | re.I)
    text = re.sub(r"<(code|kbd|samp|tt)\b[^<>]*>((?:(?!<\1\b)[^\n])*?)</\1\s*>", lambda m: hold(f"`{html.unescape(m[2])}`"), text, flags=re.I)
    text = re.sub(r"<h([1-6])\b[^<>]*>((?:(?!<h[1-6]\b).)*?)</h\1\s*>", lambda m: f"\n\n{'#' * int(m[1])} {m[2].strip()}\n\n", text, flags=re.S | re.I)
    text = re.sub(r"<li\b[^<>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ", text, flags=re.I)
    text = re.sub(r"<tr\b[^<>]*>\s*<t[dh]\b[^<>]*>", "\n| ", text, flags=re.I)
    text = re.sub(r"</t[dh]\s*>\s*</tr\s*>", " |\n", text, flags=re.I)
    text = re.sub(r"</p\s*>\s*<p\b[^<>]*>", "\n\n", text, flags=re.I)  # paragraphs of one body stay close
    text = re.sub(r"<(?:br|hr)\b[^<>]*>|</?(?:tr|dt|dd|caption|option)\b[^<>]*>", "\n", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|ul|ol|dl|table|section|article|header|footer|nav|main|aside|blockquote|form|body|html|head|title)\b[^<>]*>", "\n\n", text, flags=re.I)
    return TAG.sub("", text)


def _strip_latex(text: str, hold) -> str:
    text = re.sub(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(.*?)\\end\{\1\}", lambda m: "\n" + hold("```\n" + m[2].strip("\n") + "\n```") + "\n", text, flags=re.S)
    text = re.sub(r"\\begin\{(equation|align|gather|displaymath|math)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: hold("$$" + m[3].strip() + "$$"), text, flags=re.S)
    for _, pattern in STRONG["latex"][3:]:
        text = pattern.sub(lambda m: hold(m.group()), text)
    text = re.sub(r"(?m)(?<!\\)%[^\n]*$", "", text)
    text = re.sub(r"(?<![\w:\\])\\((?:sub)*)(?:section|paragraph)\*?\{([^{}\n]*)\}", lambda m: f"\n{'#' * (1 + len(m[1]) // 3)} {m[2]}\n", text)
    text = re.sub(r"\\chapter\*?\{([^{}\n]*)\}", r"\n# \1\n", text)
    text = re.sub(r"(?<![\w:\\])\\item(?![A-Za-z\\])(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "- " + (m[1] + " " if m[1] else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "", text)
    text = re.sub(r"\\(?:label|cite[pt]?|ref|eqref|pageref|index|vspace|hspace|documentclass|usepackage)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    text = re.sub(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}", r"\1", text)
    for _ in range(4):
        more = re.sub(r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", text)
        if more == text:
            break
        text = more
    text = re.sub(rf"\{{\\(?:{_C})\s+([^{{}}\n]*)\}}", r"\1", text)
    text = re.sub(rf"(?<![\w:\\])\\(?:{_C})(?![A-Za-z\\])[ ]?", "", text)
    text = re.sub(r"\\\\[ \t]*$", "", text, flags=re.M)
    text = re.sub(r"(?<=\S)~(?=\S)", " ", text)
    return re.sub(r"\\([%&_#{}$])", r"\1", text)


def _strip_wiki(text: str, hold) -> str:
    text = re.sub(r"<(syntaxhighlight|source|nowiki)\b[^<>]*>(.*?)</\1>", lambda m: hold(f"```\n{m[2].strip(chr(10))}\n```") if "\n" in m[2] else hold(f"`{m[2]}`"), text, flags=re.S | re.I)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref>", "", text, flags=re.S | re.I)
    text = re.sub(r"__[A-Z]+__", "", text)
    text = re.sub(r"\[\[(?:Bestand|File|Image|Afbeelding|Categorie|Category):[^\[\]\n]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]+[ ]([^\]\n]+)\](?![(\[:])", r"\1", text)
    text = re.sub(r"\{\{([^{}|]*)\|([^{}|=]*)\}\}", r"\2", text)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"^([*#:;]+)[ \t]*(?=\S)", lambda m: "  " * (len(m[1]) - 1) + ("1. " if m[1][-1] == "#" else "- " if m[1][-1] == "*" else "  "), text, flags=re.M)
    text = re.sub(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], text, flags=re.M)
    text = re.sub(r"(?<!')'{2,5}(?!')([^'\n]+(?:'[^'\n]+)*)'{2,5}(?!')", r"\1", text)
    text = re.sub(r"^[ \t:]*\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n]*$|^\|\+[^\n]*$", "", text, flags=re.M)
    text = re.sub(r"^[!|][ \t]*([^\n]*?)[ \t]*$", lambda m: "| " + re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m[1]).strip(" |") + " |", text, flags=re.M)
    return text


def _strip_markdown(text: str, hold) -> str:
    text = re.sub(r"^[ \t]{0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", lambda m: hold(f"```\n{m[2].rstrip(chr(10))}\n```"), text, flags=re.M | re.S)
    text = re.sub(r"(?<!`)(`+)(?!`)([^`\n]+)\1(?!`)", lambda m: hold(m.group()), text)
    text = re.sub(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S+[^\n]*$", "", text, flags=re.M)
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]+[^()\n]*\)", r"\1", text)
    text = re.sub(r"(?<![\w\]])\[([^\[\]\n]+)\]\((?=[^()\n]*[/.#:])[^()\n]*\)", r"\1", text)
    text = re.sub(r"(?<![\w\]\[])\[([^\[\]\n]+)\][ ]?\[[^\[\]\n]*\]", r"\1", text)
    text = re.sub(r"^(?![ \t]*(?:[=|-]|$))([^\n]+)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), text, flags=re.M)
    text = re.sub(r"(?<![*\\])(\*{1,3})(?![\s*])([^\n*]+?)(?<![\s*])\1(?!\*)", r"\2", text)
    text = re.sub(r"(?<![\w_\\])(_{1,2})(?![\s_])([^_\n]+)(?<![\s_])\1(?![\w_])", r"\2", text)
    text = re.sub(r"~~(?![\s~])([^~\n]+)~~", r"\1", text)
    text = re.sub(r"^[ ]{0,3}>[ ]?", "", text, flags=re.M)
    text = re.sub(r"^([ \t]*)[-*+][ ](?:\[([ xX])\][ ])?", lambda m: m[1] + "- ", text, flags=re.M)
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", "", text, flags=re.M)
    return re.sub(r"^[ ]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", r"\1 \2", text, flags=re.M)


STRIP = {"latex": _strip_latex, "html": _strip_html, "wiki": _strip_wiki, "markdown": _strip_markdown}


def clean(text: str | None, body_only: bool = False, found: dict | None = None) -> str | None:
    """Plain text with ``#`` headings, ``-`` lists, ``|`` tables, fenced code and formulas as they are.

    Null stays null. A text without markup comes out with its line ends unified, BOMs and trailing
    blanks removed and nothing else changed. With ``body_only`` only the bodies by the line-block
    distribution are kept of a text with the layout elements of a page; other texts stay whole.
    """
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    found = constructs(text) if found is None else found
    page = body_only and "html" in found and LAYOUT.search(text) and LAYOUT.search(uncoded(text)[0])
    held: list[str] = []

    def hold(piece: str) -> str:
        held.append(piece)
        return HOLD.format(len(held) - 1)

    for language in ("markdown", "latex", "wiki", "html"):  # code and formulas first, so they are held
        if language in found:
            text = STRIP[language](text, hold)
    if "html" in found:
        text = html.unescape(text)
    text = re.sub(r"[ \t\u00a0]+$", "", text, flags=re.M)
    if page:
        text = main_text(text, held=held)
    return restored(re.sub(r"\n{3,}", "\n\n", text).strip(), held)


# --- Spark ----------------------------------------------------------------------------------------


def analyse(df: DataFrame, key: str, fields: list[str], body_only: bool = True) -> DataFrame:
    """(key, veld, soorten, schoon): the languages found in each field and its clean text.

    One row for each row and field; null fields have no languages and a null text, empty ones an empty
    text. Keys may repeat.
    Other columns are not read. Fields are analysed whole, whatever their length.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("veld"), F.col(f).alias("t")) for f in fields]))
    rows = df.select(F.col(key).alias("_k"), stacked.alias("x")).select("_k", "x.veld", "x.t")
    kind = rows.schema["_k"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = [constructs(t) for t in pdf["t"]]
            names = [[x for x in LANGUAGES if x in c] for c in found]
            texts = [clean(t, body_only, c) for t, c in zip(pdf["t"], found)]
            yield pd.DataFrame({key: pdf["_k"], "veld": pdf["veld"], "soorten": names, "schoon": texts})

    return rows.mapInPandas(run, f"`{key}` {kind}, veld string, soorten array<string>, schoon string")


def residue(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, veld, soort): the markup languages of which a field holds at least one construct."""
    return analyse(df, key, fields).select(key, "veld", F.explode("soorten").alias("soort")).distinct()
