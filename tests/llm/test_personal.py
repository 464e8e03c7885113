import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turfspoor.llm import personal as P

GIVEN, SUR = ["Marit", "Özlem", "Bjørn"], ["Tolbrug", "Østerbæk", "Mc'Tarrel", "Windhaspel"]
LEX = P.Lexicon.of(GIVEN, SUR)
KEY = b"een geheime sleutel"
NAMES = P.Pseudonyms(KEY)


def found(text):
    return [(k, text[a:b]) for a, b, k in P.find(text, LEX)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail jan.jansen+x@example.org.", [("email", "jan.jansen+x@example.org")]),
        ("via marit [at] nl [punt] example [punt] org!", [("email", "marit [at] nl [punt] example [punt] org")]),
        ("(marit(at)example.net)", [("email", "marit(at)example.net")]),
        ("marit&#64;example.net en xandra apenstaartje mail punt test,", [("email", "marit&#64;example.net"), ("email", "xandra apenstaartje mail punt test")]),
        ("logo kop@2x.png svc@.service @team-x 3 dozen @ 12,50", []),
        ("Bel 06-12345678 of (050) 0143552", [("telefoon", "06-12345678"), ("telefoon", "(050) 0143552")]),
        ("+31 (0)6 00144163, 0031 20 096 8381, [06 - 00 67 22 09], 020.066.8675", [("telefoon", x) for x in ("+31 (0)6 00144163", "0031 20 096 8381", "06 - 00 67 22 09", "020.066.8675")]),
        ("van 06-01-2026 tot 08-02-2026, kostenplaats 0104-92-22, versie 10.0.10.24, order 4410-20931-7", []),
        ("BSN 999990822, (999-910-024), 9999.82.874", [("idnummer", x) for x in ("999990822", "999-910-024", "9999.82.874")]),
        ("Ordernummer 999990822 en 123456789", []),
        ("NRN 41.03.32-731.64 of 83063615862", [("idnummer", "41.03.32-731.64"), ("idnummer", "83063615862")]),
        ("met pas XZ 2PJS2L3, document xz2k00782 (doc. SP2K4HD95)", [("idnummer", x) for x in ("XZ 2PJS2L3", "xz2k00782", "SP2K4HD95")]),
        ("Serienummer SN06564002 staat onderop", []),
        ("Pickup at Oude Gruttohof 136-b te 8098 SA Vlietermond", [("adres", "Oude Gruttohof 136-b")]),
        ("Woonadres kompassteeg 56 III, Hazelwormstr. 111", [("adres", "kompassteeg 56 III"), ("adres", "Hazelwormstr. 111")]),
        ("De Lindelaan is dicht, kamer 12 en gang 4", []),
        ("De heer Marit van 't Tolbrug-Windhaspel heeft dit", [("naam", "Marit van 't Tolbrug-Windhaspel")]),
        ("Volgens Y.E. van der Tolbrug en BJØRN ØSTERBÆK", [("naam", "Y.E. van der Tolbrug"), ("naam", "BJØRN ØSTERBÆK")]),
        ("cc: Tolbrug, Özlem van den; graag", [("naam", "Tolbrug, Özlem van den")]),
        ("totdat Tolbrug, Marit de nieuwe kast opent", [("naam", "Tolbrug, Marit")]),
        ("met Tolbrug, Marit de over de kast; marit de mc'tarrel", [("naam", "Tolbrug, Marit de"), ("naam", "marit de mc'tarrel")]),
        ("Zaal Tolbrug is vol; marit.tolbrug@example.org", [("email", "marit.tolbrug@example.org")]),
        ("", []), (None, []),
    ],
)
def test_rules(text, want):
    assert (found(text) if text else P.find(text, LEX)) == want


def test_masking_keeps_all_other_text_and_links_equal_values():
    text = "A 06-12345678 b Marit Tolbrug, c 06 - 12 34 56 78 d."
    out = P.replace(text, LEX, NAMES)
    assert out.startswith("A [telefoon:06-") and "] b [naam:" in out and out.endswith("] d.")
    digits = ["".join(c for c in x if c.isdigit()) for x in out.split("[telefoon:")[1:]]
    assert digits[0][:10] == digits[1][:10] != "0612345678"
    assert P.replace(None, LEX, NAMES) is None and P.replace("", LEX, NAMES) == ""
    assert P.replace("x 06-12345678", LEX, P.Pseudonyms(b"een andere sleutel")) != P.replace("x 06-12345678", LEX, NAMES)
    for weak in (b"", b"kort", "tekst, geen bytes", None):
        with pytest.raises(ValueError):
            P.Pseudonyms(weak)


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(P.feistel(n, size, KEY, b"t") for n in range(size)) == list(range(size))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=string.digits + string.ascii_letters + " .-", min_size=1, max_size=12))
def test_pseudonyms_keep_the_format(value):
    out = P.permute_format(value, KEY, b"t")
    kind = lambda s: ["d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else c for c in s]
    assert kind(out) == kind(value)


digits = lambda s: "".join(c for c in s if c.isdigit())


def test_validated_numbers_stay_valid():
    bsn = P.pseudonym("9999.82.874", "idnummer", KEY)
    assert P.eleven_test(bsn.replace(".", "")) and bsn[4] == bsn[7] == "."
    nrn = P.pseudonym("41.03.32-731.64", "idnummer", KEY)
    assert P.register_test(digits(nrn))
    assert P.pseudonym("999982874", "idnummer", KEY) == bsn.replace(".", "")


def registers(body):
    return [f"{body}{97 - int(body) % 97:02d}", f"{body}{97 - int('2' + body) % 97:02d}"]


def test_different_numbers_never_share_a_pseudonym():
    bodies = [f"{y:02d}{m:02d}{d:02d}{n:03d}" for y in (0, 19, 85) for m in (0, 2, 7, 13) for d in (0, 28, 29, 31) for n in (1, 333)]
    numbers = [r for body in bodies for r in registers(body)]
    out = [P.pseudonym(n, "idnummer", KEY) for n in numbers]
    assert len(set(out)) == len(set(numbers)) == 2 * len(bodies) and all(P.register_test(x) for x in out)
    for n, x in zip(numbers, out):
        century = 1900 if int(n[9:]) == 97 - int(n[:9]) % 97 else 2000
        assert (P.register_day(n, century) is None) == (P.register_day(x, century) is None) and x[9:] == registers(x[:9])[century == 2000][9:]
    assert P.pseudonym("85073003328", "idnummer", KEY) != P.pseudonym("85073003357", "idnummer", KEY)
    valid = [f"{n:08d}{c}" for n in range(10_000_000, 10_002_000) for c in [sum(int(d) * w for d, w in zip(f"{n:08d}", range(9, 1, -1))) % 11] if c < 10]
    out = {P.pseudonym(n, "idnummer", KEY) for n in valid}
    assert len(out) == len(valid) and all(P.eleven_test(x) for x in out)
    phones = [f"06{n:08d}" for n in range(500)] + [f"020{n:07d}" for n in range(500)]
    assert len({P.pseudonym(p, "telefoon", KEY) for p in phones}) == 1000


@pytest.mark.parametrize(
    "kind, forms",
    [
        ("telefoon", ["0612345678", "06-12345678", "06 - 12 34 56 78", "+31612345678", "+31 (0)6 12345678", "0031 6 12345678"]),
        ("telefoon", ["(020) 1234567", "020-1234567", "0201234567", "+31 20 123 4567"]),
        ("email", ["jan.smit@voorbeeld.nl", "Jan.Smit [at] voorbeeld [punt] nl", "jan.smit&#64;voorbeeld.nl", "jan.smit apenstaartje voorbeeld punt nl", "jan.smit%40voorbeeld.nl"]),
        ("naam", ["J. de Vries", "Vries, J. de", "j. DE  vries"]), ("naam", ["Marit van 't Tolbrug", "Tolbrug, Marit van 't", "MARIT VAN ’T TOLBRUG"]), ("naam", ["Y.E. van der Tolbrug", "Tolbrug, Y. E. van der"]),
        ("adres", ["Kompassteeg 56-b", "kompassteeg 56 b", "Kompasstg. 56b"]), ("idnummer", ["XZ2PJS2L3", "xz 2pjs2l3"]), ("idnummer", ["41.03.32-731.64", "410332-731.64", "41033273164"]),
        ("datum", ["1987-03-12", "12-03-1987", "12/3/1987", "12.03.1987"]),
    ],
)
def test_equal_values_are_linked_in_all_notations(kind, forms):
    out = [P.pseudonym(f, kind, KEY) for f in forms]
    if kind == "telefoon":
        national = lambda s: "".join(s[i] for i in P.phone_parts(s)[1])
        assert len({national(x) for x in out}) == 1 and national(out[0]) != national(forms[0])
        assert [[c if not c.isdigit() else "0" for c in x] for x in out] == [[c if not c.isdigit() else "0" for c in x] for x in forms]
    elif kind == "datum":
        assert len({P.date_of(x) for x in out}) == 1 and P.date_of(out[0]) != P.date_of(forms[0])
    else:
        assert len({digits(x) if "." in x else x for x in out}) == 1


def test_dates_are_found_and_permuted_where_asked_for():
    text = "geboren 12-03-1987, versie 10.0.10.24, op 31-02-2020 en 2026-09-30T10:00, om 1/2/2003."
    kinds = [text[a:b] for a, b, k in P.find(text, LEX, dates=True) if k == "datum"]
    assert kinds == ["12-03-1987", "1/2/2003"] and P.find(text, LEX) == []
    out = P.replace(text, LEX, NAMES, dates=True)
    assert out.startswith("geboren [datum:") and "31-02-2020" in out and P.replace(text, LEX, NAMES) == text
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1900, 1999, 2000, 2099) for m in range(1, 13) for d in range(1, 29)]
    assert len({P.pseudonym(d, "datum", KEY) for d in days}) == len(days)


SCHEMA = "id string, tekst string, soort string, waarde string, _k string"


def test_found_values_of_a_table(spark):
    rows = [("1", "Marit Tolbrug, 06-12345678, Marit Tolbrug", "", "", ""), ("1", "06-12345678", "", "", ""), (None, "x@example.org", "", "", ""), ("2", None, "", "", ""), ("3", "", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id or "", r.soort, r.waarde) for r in P.find_values(df, "id", "tekst", LEX, KEY).collect())
    assert got == [("", "email", "x@example.org"), ("1", "naam", "Marit Tolbrug"), ("1", "telefoon", "06-12345678")]
    masked = P.mask_values(df, "tekst", LEX, KEY)
    assert masked.columns == df.columns and masked.filter("id = '2'").first().tekst is None
    assert P.find_values(df.limit(0), "id", "tekst", LEX, KEY).count() == 0
    long = spark.createDataFrame([("l", "woord " * 200_000 + "Marit Tolbrug", "", "", "")], SCHEMA)
    assert {r.pseudoniem for r in P.find_values(df, "id", "tekst", LEX, KEY).filter("soort = 'telefoon'").collect()} == {P.pseudonym("06-12345678", "telefoon", KEY)}
    assert P.find_values(long, "id", "tekst", LEX, KEY).count() == 1


def test_names_are_learned_from_the_texts(spark):
    names = spark.createDataFrame([("Marit", "voornaam"), ("Fenna", "voornaam"), ("Tolbrug", "achternaam"), ("Merelhof", "achternaam"), (None, "voornaam")], "naam string, soort string")
    texts = [f"gesproken met {g} {p}{s} over iets" for g in ("Marit", "Fenna", "Yoeri") for p in ("", "van der ") for s in ("Tolbrug", "Merelhof", "Steenvliet")]
    texts += ["klaar. Zaal Merelhof is vol", "bij Korte Tolbrug 12", None, ""]
    lex = P.learn_lexicon(spark.createDataFrame([(t,) for t in texts], "t string"), "t", names)
    assert lex.is_given("yoeri") and lex.is_surname("STEENVLIET") and not lex.is_given("zaal") and not lex.is_given("korte")
    assert [k for _, _, k in P.find("Volgens yoeri ten steenvliet is het zo", lex)] == ["naam"]
    # a word that stands with a known given name now and then, but mostly with other words, is no surname
    many = texts + [f"met de {w} Server hier" for w in ("Linux", "Mail", "Print", "File", "Web", "Proxy", "Test", "Back", "Sql", "App", "Fax", "Log")] + ["zag Marit Server en Fenna Server staan"]
    assert not P.learn_lexicon(spark.createDataFrame([(t,) for t in many], "t string"), "t", names).is_surname("server")
    none = P.learn_lexicon(spark.createDataFrame([], "t string"), "t", names.limit(0))
    assert not none.is_given("marit")


def test_cheap_signs_let_through_what_the_patterns_match():
    own = P.Lexicon.of(["jan"], ["li"])
    for form in ("jan { at } firma.nl", "jan < at > firma.nl"):
        assert P.EMAIL.search(form) and any(x in form for x in P.EMAIL_HINT)
        assert ("email", form) in {(kind, form[a:b]) for a, b, kind in P.find(form, own)}
    text = "gesproken met Jan Li."
    assert own.any_surname(text) and [text[a:b] for a, b, kind in P.find(text, own) if kind == "naam"] == ["Jan Li"]
