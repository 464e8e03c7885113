import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from turfspoor.operators import grammar, lexical

WORDS = "storing server printer kabel mail sleutel café über naam deur kast planning sensor sensoren sensorkast".split()


def rows_of(count, seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [(n, f"c{n:03d}", rng.choice(["a", "b"]), f"p{n % 9}", text(2), text(3), text(rng.randint(0, 25))) for n in range(count)]


@pytest.fixture(scope="module")
def both(spark):
    rows = rows_of(120)
    chunks = spark.createDataFrame(rows, "ord long, chunk_id string, source string, path string, title string, section string, text string").cache()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, titel, sectie, tekst, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(r[1], r[4], r[5], r[6]) for r in rows])
    return lexical.LexicalIndex.of(chunks), con


QUERIES = [
    "server printer", "server OR kabel", '"server printer"', "sens*", "titel : storing", "{titel sectie} : kast", "(mail OR deur) NOT tekst : kabel",
    "cafe AND uber", "^server", "server server", "NEAR(server printer, 2)", 'NEAR("mail" kast)', "server + printer", "- titel : storing", "mail OR deur AND kabel", "onbekend",
]


@pytest.mark.parametrize("query", QUERIES)
def test_queries_score_as_a_full_text_database_does(both, query):
    index, con = both
    want = con.execute("SELECT id, -bm25(f, 0, 6, 3, 1) FROM f WHERE f MATCH ? ORDER BY bm25(f, 0, 6, 3, 1), rowid", (query,)).fetchall()
    got = {r.chunk_id: r.score for r in grammar.search_raw(index, query, limit=1000).collect()}
    assert set(got) == {i for i, _ in want}
    for i, score in want:
        assert got[i] == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize("query", ["(server", "server: x", "server?", "a AND", "NOT a", "*", '"open', "server (kabel) x)", "50% x*", ""])
def test_invalid_queries_are_refused(query):
    with pytest.raises(grammar.QuerySyntaxError):
        grammar.parse(query)


def test_syntax_is_seen_and_removed():
    assert grammar.is_syntax("server*") and grammar.is_syntax("a OR b") and not grammar.is_syntax("hoe werkt dit")
    assert grammar.without_syntax('hoe (snel) "werkt" OR dit').split() == ["hoe", "snel", "werkt", "dit"]


def test_word_list_fills_up_by_attempts(spark, both):
    index, con = both
    asked = spark.createDataFrame([(1, "server printer kabel", None), (2, "sensoren", "a"), (3, "de het een", None), (4, None, None), (5, "onbekend", "")], "question_id long, question string, source string")
    got = lexical.word_list(index, asked, limit=5).orderBy("question_id", "rank").collect()
    by = {q: [r for r in got if r.question_id == q] for q in range(1, 6)}
    run = lambda q: [r[0] for r in con.execute("SELECT id FROM f WHERE f MATCH ? ORDER BY bm25(f, 0, 6, 3, 1), rowid LIMIT 5", (q,))]
    want = []
    for query, weight in (('"server" "printer" "kabel"', 1.0), ("server AND prin* AND kabel", 0.7), ("server OR prin* OR kabel", 0.5)):
        if len(want) < 5:
            want += [(i, weight) for i in run(query) if i not in [x for x, _ in want]]
    assert [(r.chunk_id, r.weight) for r in by[1]] == want and [r.rank for r in by[1]] == list(range(1, len(want) + 1))
    assert by[2] and {r.chunk_id for r in by[2]} <= {r[1] for r in rows_of(120) if r[2] == "a"}
    assert not by[3] and not by[4] and not by[5]


def test_name_lists_add_one_for_all(spark, both):
    index, _ = both
    asked = spark.createDataFrame([(1, [["server"], ["printer", "kabel"]])], "question_id long, names array<array<string>>")
    got = lexical.name_lists(index, asked, F.col("names"), limit=1000).collect()
    lists = {n: {r.chunk_id for r in got if r.list_no == n} for n in (0, 1, 2)}
    assert lists[2] == lists[0] & lists[1] and lists[2] < lists[0]


def test_an_empty_index_has_no_hits(spark):
    chunks = spark.createDataFrame([], "ord long, chunk_id string, source string, path string, title string, section string, text string")
    assert grammar.search_raw(lexical.LexicalIndex.of(chunks), "server").count() == 0
