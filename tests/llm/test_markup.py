import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turfspoor.llm import markup as M


def kinds(text):
    return {x for x in M.LANGUAGES if x in M.constructs(text)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("<p>Hallo</p>", {"html"}), ("een <br> twee", {"html"}), ("R&amp;D &#64; &ndash;", {"html"}), ("&lt;b&gt;x&lt;/b&gt;", {"html"}), ("<!-- einde -->", {"html"}),
        ("**vet** en *schuin*", {"markdown"}), ("[t](https://x.example/1)", {"markdown"}), ("[t][1]\n\n[1]: https://x.example", {"markdown"}), ("```\n<b>code</b>\n```", {"markdown"}),
        ("Kop\n====\n\ntekst", {"markdown"}), ("> citaat", {"markdown"}), ("| a | b |\n|---|:--:|\n| 1 | 2 |", {"markdown"}), ("~~weg~~ `code`", {"markdown"}), ("- [ ] taak", {"markdown"}), ("# Kop", {"markdown"}),
        ("== Kop ==", {"wiki"}), ("=Kop=\n\n# een\n# twee", {"wiki"}), ("'''vet''' [[Pagina|naam]]", {"wiki"}), ("{{Sjabloon|a=b}}", {"wiki"}), ("[https://x.example naam]", {"wiki"}), ('{| class="wikitable"\n|-\n| a || b\n|}', {"wiki"}),
        (r"\section{Kop}", {"latex"}), (r"$n_{max} = 5$", {"latex"}), (r"\(x^2 \leq n\)", {"latex"}), ("\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", {"latex"}), (r"{\bf vet}", {"latex"}),
        ("<h2>Kop</h2>\n\n- [ ] taak", {"html", "markdown"}), ("<pre><code>**x** $a_b$</code></pre>", {"html"}),
        ("Score 4*5 is hoog, zie [2]. 3 * 4 dozen", set()), ("rij[0] en rij[1], R&D", set()), (r"C:\beheer\logs en \\srv\team\sectie", set()), ("$ 40 of 35 euro, {excl. btw}", set()),
        ("vul <gebruikersnaam> in, < 5 en > 3, 443 -> 8443", set()), ("#storing @team --volledig bestand_zonder_naam_2.txt # 12", set()), ("'s nachts en 's ochtends", set()), ("", set()), (None, set()), ("   \n", set()),
    ],
)
def test_languages(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("<h2 id=a>Kop</h2><p>Een <b>twee</b> &amp; drie</p><ul><li>a<li>b</ul><pre><code>x &lt; 5</code></pre>", "## Kop\n\nEen twee & drie\n\n- a\n- b\n\n```\nx < 5\n```"),
        ("Kop\n===\n\n**vet** en [t](https://x.example/a) `c*d*`\n\n* een\n* twee", "# Kop\n\nvet en t `c*d*`\n\n- een\n- twee"),
        ("== Kop ==\n\n'''vet''' [[P|naam]] {{nb|blijft}}\n\n* een\n** twee\n# drie", "## Kop\n\nvet naam blijft\n\n- een\n  - twee\n1. drie"),
        ("\\section{Kop}\n\\begin{itemize}\n\\item \\emph{een} $x_1$\n\\end{itemize}\n% weg", "# Kop\n\n- een $x_1$"),
        ("<table><tr><th>a</th><td>b</td></tr></table>", "| a | b |"),
        ("gewoon\r\ntekst  \ufeff", "gewoon\ntekst"), ("", ""), (None, None),
    ],
)
def test_clean_text_keeps_structure(text, want):
    assert M.clean(text) == want


def test_cleaning_leaves_no_markup_behind_and_is_stable():
    for text in ("<p>a</p><ol><li>b</ol>", "**a** [b](https://c.example/)", "''a'' [[b]]", "\\textbf{a} \\item b"):
        once = M.clean(text)
        assert "<" not in once and "[[" not in once and "\\" not in once and "**" not in once


def test_bodies_by_line_blocks():
    menu = "a\n\n\n\n\n"
    body = "\n".join(["Deze regel hoort bij de tekst van de pagina zelf."] * 6)
    got = M.main_text(menu + body + "\n\n\n\n\n\nvoet")
    assert got == body and M.main_text("kort") == "kort" and M.main_text("") == ""
    assert M.line_blocks(["aa", "", "b c"], 2) == [2, 2, 2]


def test_a_page_loses_what_stands_around_its_body_and_nothing_else(spark):
    long = "Deze regel hoort bij de tekst van de pagina zelf en is lang genoeg om er een te zijn."
    menu, foot = "<nav><a href='/a'>Start</a> <a href='/b'>Nieuws</a></nav>\n", "\n<footer>Bedrijf bv</footer>"
    page = f"{menu}<div><h2>Kop</h2><p>{long}</p><p>Kort.</p><p>{long}</p></div>{foot}"
    want = f"## Kop\n\n{long}\n\nKort.\n\n{long}"
    assert M.clean(page, body_only=True) == want and "Bedrijf bv" in M.clean(page)
    kept = "<div><h3>Status</h3><p>Open.</p></div><div><ul><li>a</li></ul></div><div><pre>x = 1\n\n\n\n\ny</pre></div>"
    assert M.clean(f"<div><p>{long}</p></div>{kept}{foot}", body_only=True) == f"{long}\n\n### Status\n\nOpen.\n\n- a\n\n```\nx = 1\n\n\n\n\ny\n```"
    between = f"<article>{long}</article><div>Kamer 12 is dicht.</div><div>Menu</div><article>{long}</article>"
    assert M.clean(between, body_only=True) == f"{long}\n\nKamer 12 is dicht.\n\n{long}"
    loose = f"<div>{long}</div><div>Mail: a@b.example</div>"  # no page: nothing stands around its text
    assert M.clean(loose, body_only=True) == M.clean(loose)
    code = "<div>Zo:<pre>" + "regel = waarde\n" * 9 + "</pre></div>"  # held code is a body by its own length
    assert M.clean(code + foot, body_only=True).endswith("waarde\n```")
    plain = f"# Kop\n\nkort\n\n\n\n\n{long}\n\n\n\n\nGroet"
    assert M.clean(plain, body_only=True) == M.clean(plain) and M.clean(plain.replace("#", "**a** &amp;"), body_only=True).endswith("Groet")
    shown = f"<p>{long}</p><pre>{menu}</pre>\n\n\n\nGroet" + "<div class='unavailable'>x</div>"  # a layout in code is none
    assert M.clean(shown, body_only=True) == M.clean(shown)
    old = f"<div id=topmenu>Start</div><div>{long}</div><div class='a footer'>Bedrijf bv</div>"
    assert M.clean(old, body_only=True) == long
    df = spark.createDataFrame([("1", page, plain)], "id string, tekst string, ruw string")
    assert {r.veld: r.schoon for r in M.analyse(df, "id", ["tekst", "ruw"]).collect()} == {"tekst": want, "ruw": M.clean(plain)}


def test_tables(spark):
    rows = [("1", "**a**", "<b>x</b> $a_b$", "x"), ("2", None, "", "x"), ("1", "plat", None, "x"), (None, "''w''", None, "x")]
    df = spark.createDataFrame(rows, "id string, tekst string, ruw string, veld string")
    got = sorted((r.id or "", r.veld, r.soort) for r in M.residue(df, "id", ["tekst", "ruw"]).collect())
    assert got == [("", "tekst", "wiki"), ("1", "ruw", "html"), ("1", "ruw", "latex"), ("1", "tekst", "markdown")]
    assert M.analyse(df, "id", ["tekst"]).count() == 4 and M.residue(df.limit(0), "id", ["tekst"]).count() == 0
    long = spark.createDataFrame([("l", "woord * 3 " * 50_000 + "**vet**", None, "")], df.schema)
    assert [r.soort for r in M.residue(long, "id", ["tekst"]).collect()] == ["markdown"]


def test_cheap_signs_let_through_a_deep_quote_and_mixed_case():
    assert kinds("tekst\n\n   > citaat") == {"markdown"} and kinds("een <Ref name=a/> b") == {"wiki"}


LINES = st.sampled_from(["Beste collega,", "kort regel een.", "", "", "Een lange alinea over de verhuizing van de kast naar de kelder, met alles wat erbij hoort.", "3 * 4 dozen", "C:\\item\\x en C:\\beheer", "prijs 5 < 6", "  ingesprongen", "Groet"])


@settings(max_examples=150, deadline=None)
@given(st.lists(LINES, max_size=14))
def test_a_text_without_markup_loses_nothing(lines):
    text = "\n".join(lines)
    if not M.constructs(text):
        assert re.sub(r"\s", "", M.clean(text, body_only=True)) == re.sub(r"\s", "", text)


def test_structure_before_a_body_is_kept():
    long = "Deze regel hoort bij de tekst van de pagina zelf en is lang genoeg om er een te zijn."
    for head in ("# Titel", "- een\n- twee", "```\nmake install\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "$$x_1 = 2$$"):
        out = M.clean(f"{head}\n\nkort\n\n{long}", body_only=True)
        assert all(w in out for w in re.findall(r"\w+", head)) and "kort" in out and long in out
    path = "\\section{Kop} zie C:\\item\\x en C:\\section{a}"
    assert "C:\\item\\x" in M.clean(path)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Start", "Nieuws", "Contact"]), min_size=1, max_size=3), st.integers(1, 4))
def test_menus_before_and_behind_a_body_go(menu, count):
    body = "Deze regel hoort bij de tekst van de pagina zelf en is lang genoeg om er een te zijn."
    bar = "<nav>" + " ".join(f"<a href='/{m}'>{m}</a>" for m in menu) + "</nav>"
    page = f"<html><body>{bar}<div>" + "".join(f"<p>{body}</p>" for _ in range(count)) + f"</div>{bar}</body></html>"
    assert M.clean(page, body_only=True) == "\n\n".join([body] * count)
