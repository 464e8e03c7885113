import itertools
import random

import numpy as np
import pytest

from turfspoor.llm import neardup

SCHEMA = "id string, tekst string, class string, n int, words string"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"woord{n}" for n in range(400)]
    rows, texts = [], []
    for d in range(60):
        words = rng.sample(vocabulary, rng.randint(30, 60))
        texts.append(words)
        for v in range(rng.randint(0, 3)):
            edited = list(words)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rng.shuffle(edited)
            texts.append(edited)
    for n, words in enumerate(texts):
        rows.append((f"d{n:03d}", " ".join(words), "x", 0, "y"))
    return rows


def exact(rows, least=30, threshold=0.8):
    sets = {}
    for i, t, *_ in rows:
        if i is not None and t:
            s = neardup.distinct_words(t)
            if len(s) >= least:
                sets.setdefault(i, s)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_pairs_equal_brute_force(spark):
    rows = corpus() + [("leeg", "", "", 0, ""), ("nul", None, None, None, None), (None, corpus()[0][1], "", 0, ""), ("kort", "een twee drie", "", 0, "")]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    got = {(r.id_a, r.id_b) for r in nd.pairs().collect()}
    assert got == exact(rows) and len(got) > 50


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_groups_are_the_components(spark):
    rows = corpus(2) + [("kopie", corpus(2)[0][1].upper() + "!", "", 0, "")]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    groups = {r.id: r.groep for r in nd.groups().collect()}
    assert groups == components(exact(rows)) and groups["kopie"] == groups["d000"]


def test_products_modulo_the_prime():
    a = np.array([1, 2**61 - 2, 2**60 + 12345, 987654321987654321], np.uint64)
    x = np.array([0, 2**61 - 2, 2**31, 1152921504606846977], np.uint64)
    got = neardup.times61(a[:, None], x[None, :])
    assert got.tolist() == [[int(p) * int(q) % (2**61 - 1) for q in x] for p in a]


def test_a_large_class_of_copies_is_a_star_and_loses_no_link(spark):
    text = " ".join(f"w{n}" for n in range(40))
    near = text.replace("w0 ", "anders ")
    rows = [(f"k{n:03d}", text, "", 0, "") for n in range(80)] + [("z", near, "", 0, ""), ("z2", near, "", 0, "")]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    got = {(r.id_a, r.id_b) for r in nd.pairs(expand=10).collect()}
    assert got == {("k000", f"k{n:03d}") for n in range(1, 80)} | {("k000", "z"), ("k000", "z2"), ("z", "z2")}
    assert {r.groep for r in nd.groups().collect()} == {"k000"} and nd.members().count() == 82


def test_different_texts_of_one_word_set_are_all_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, words = random.Random(3), [f"w{n}" for n in range(40)]
    texts = [" ".join(rng.sample(words, 40)) + "!" * (n % 3) for n in range(90)]
    near = [" ".join(["Anders", *rng.sample(words, 39)]) for _ in range(70)]
    rows = [(f"r{n:03d}", t, "", 0, "") for n, t in enumerate(texts + near)]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == exact(rows)
    one = [(f"r{n:03d}", t, "", 0, "") for n, t in enumerate([*texts, *[texts[0]] * 70])]  # copies beside reorderings
    copies = {f"r{n:03d}" for n in range(90, 160)}
    want = {(a, b) for a, b in exact(one) if not {a, b} & copies} | {("r000", c) for c in copies}
    nd = neardup.NearDuplicates(spark.createDataFrame(one, SCHEMA))
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == want and {r.groep for r in nd.groups().collect()} == {"r000"}
    assert {(r.id_a, r.id_b) for r in nd.pairs(expand=None).collect()} == exact(one)


def test_hot_buckets_are_cut_into_blocks_and_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "HOT", 10)
    monkeypatch.setattr(neardup, "SLOTS", 64)
    monkeypatch.setattr(neardup.join_hot, "__defaults__", (10,))
    base = [f"w{n}" for n in range(60)]
    rows = [(f"h{n:02d}", " ".join(base[:n] + [f"x{n}"] + base[n + 1 :]), "", 0, "") for n in range(30)]
    # like some members of the hot buckets, but not like the first one
    far = " ".join([f"x{n}" if n in (1, 2, 3, 4, 5) else w for n, w in enumerate(base)])
    rows += [("far", far, "", 0, ""), ("farther", far.replace("w7 ", "anders ").replace("w8 ", "weer "), "", 0, "")] + corpus(5)
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    want = exact(rows)
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == want and len(want) >= 30 * 29 // 2
    assert {r.id: r.groep for r in nd.groups().collect()} == components(want)
    assert nd.group_links().count() < nd.links().count()


def test_empty_table_and_long_text(spark):
    empty = neardup.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0
    long = " ".join(f"w{n}" for n in range(30_000))
    rows = [("a", long, "", 0, ""), ("b", long + " nog een", "", 0, "")]
    got = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()
    assert [(r.id_a, r.id_b) for r in got] == [("a", "b")] and got[0].similarity == pytest.approx(30_000 / 30_002)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(900, 901), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in neardup.connected_components(edges).collect()}
    assert got == {n: 0 for n in range(301)} | {900: 900, 901: 900}
