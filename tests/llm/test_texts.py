"""Problems 8, 9 and 10."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from folia.llm import leaks, packing, spam
from folia.llm.queries import VOCABULARY


def test_optimal_buckets_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths, counts = np.array(sorted(rng.choice(50, 8, replace=False) + 1)), rng.integers(1, 9, 8)
        cost = lambda tops: sum(int(c) * (min(x for x in tops if x >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        want = min(cost([*s, lengths[-1]]) for s in itertools.combinations(lengths[:-1].tolist(), 2))
        assert cost(packing.optimal_buckets(lengths, counts, 3)) == want


def test_pack(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 3, 10, 40, 41, 60, 99, 100, 101, 350])) for i in range(400)] + [(1000 + i, 50) for i in range(200)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int")
    out = packing.pack(df, [(1, 100), (2, 1000)], "doc_id").collect()
    for c, room in ((1, 100), (2, 1000)):
        mine = [r for r in out if r.capacity_id == c]
        filled: dict[int, int] = {}
        whole: dict[int, int] = {}
        for r in mine:
            filled[r.container] = filled.get(r.container, 0) + r.tokens
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
        assert whole == dict(sizes) and max(filled.values()) <= room
        assert len({(r.doc_id, r.part) for r in mine}) == len(mine) == sum(max(1, -(-n // room)) for _, n in sizes)
        assert len(filled) <= 1.1 * -(-sum(whole.values()) // room) + 1
    assert packing.pack(df.limit(0), [(1, 100)], "doc_id").count() == 0
    with pytest.raises(ValueError, match="room"):
        packing.pack(df, [(1, 0)], "doc_id")


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
def test_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello", 9), (2, "", 9), (3, None, 9), (1, "Hello world, hello", 9)], "doc_id long, text string, tokens int")
    assert {r.doc_id: r.tokens for r in packing.count_tokens(docs, "doc_id", "text", VOCABULARY).collect()} == {1: 4, 2: 0}


ITEM = "Oddly two Sumenu trainees had to replace the drag coefficient of Ravekebaane in nine of many trials so noise level fell by far while Galifobiite residue outran the Foloto trays next to foams"


def test_leaks(spark, rows):
    words = ITEM.split()
    filler = "The plain text goes on and on with words that no item has at all. " * 30
    texts = {
        1: filler + ITEM.upper() + filler,
        2: filler + " ".join(words[5:21]).replace(" drag ", " drag, ") + "\n\n" + filler,
        3: filler + " ".join(w for i, w in enumerate(words) if i % 9 != 4),
        4: " ".join(words[:9]) + filler,
        5: " ".join(sorted(words)),
        6: "", 7: None, 8: "x",
        9: " ".join(words[:10]) + " [advertisement: buy now or never] " + " ".join(words[10:]),
    }
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(1, texts[1], 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, "short one"), (9, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()} == {(1, 7), (2, 7), (3, 7), (9, 7)}
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0 == leaks.find_leaks(docs.limit(0), items).count()


def test_two_edits_in_any_place_of_fourteen_words():
    words = ITEM.lower().split()
    index = leaks.Items([(7, ITEM)])
    filler = ["filler"] * 30
    for start in (0, 9, len(words) - leaks.LEAST):
        texts = []
        for a, b in itertools.combinations(range(1, leaks.LEAST - 1), 2):
            w = words[start : start + leaks.LEAST]
            texts.append([*w[:a], "other", *w[a + 1 : b], "other", *w[b + 1 :]])
            texts.append([*w[:a], *w[a + 1 : b], *w[b + 1 :]])
            texts.append([*w[:a], "other", *w[a:b], "other", *w[b:]])
        found = leaks._search_shard([" ".join([*filler, *t, *filler]) for t in texts], index)
        assert {d for d, *_ in found} == set(range(len(texts)))


def test_interruptions_of_any_length():
    words = ITEM.lower().split()
    index = leaks.Items([(7, ITEM)])
    texts = [" ".join([*words[a : a + 10], *["filler"] * n, *words[a + 10 : a + 20]]) for a in (0, 12) for n in (1, 6, 119, 120, 500, 5000)]
    assert {d for d, *_ in leaks._search_shard(texts, index)} == set(range(len(texts)))


def test_other_items_and_blocks_change_nothing(spark, monkeypatch, rows):
    words = ITEM.split()
    rng = random.Random(3)
    kin = [(100 + i, " ".join(rng.sample(words, len(words)))) for i in range(40)]  # items of the same words in another order
    texts = [(i, " ".join(w if k % 7 != i % 7 else "other" for k, w in enumerate(words[i : i + 15]))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    alone = leaks.find_leaks(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).filter("item_id = 7")
    among = spark.createDataFrame([(7, ITEM), *kin], "item_id long, text string")
    want = rows(leaks.find_leaks(docs, among))
    assert rows(alone) == [r for r in want if r[1] == 7] != []
    monkeypatch.setattr(leaks, "ITEM_LIMIT", 900)
    assert rows(leaks.find_leaks(docs, among)) == want


def test_phrase_hits_are_all_runs_of_three():
    rng = random.Random(1)
    vocab = list("abcde")
    index = leaks.Items([(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(5)])
    texts = [" ".join(rng.choice([*vocab, "zz"]) for _ in range(60)) for _ in range(4)]
    t, text_of = leaks.positions(texts, index.terms)
    p, g = leaks.phrase_hits(t, index)
    want = sorted((q, k) for k, gram in enumerate(index.grams.tolist()) for q in range(len(t) - 2) if t[q : q + 3].tolist() == gram)
    assert sorted(zip(p.tolist(), g.tolist(), strict=True)) == want and text_of.max() == 3


PROSE = ["We report the results of a long study and compare them with those of others.", "The samples were kept in a cold room for two days before the test was carried out.", "It is not clear why the first batch failed when the second one did not.", "In most runs the new method gave better values than the old one, as shown in the table."]


def test_spam(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice(PROSE) for _ in range(12)) for _ in range(60)]
    bad = {
        100: "\n".join(rng.choice(["cheap pills", "low fee journal", "buy metal foams", "fast publication", "guest author slots"]) for _ in range(60)),
        101: "\n".join(f"http://shop{i}.example/alloys/{i}" for i in range(40)),
        102: PROSE[0] + "\n\nTags: " + ", ".join(rng.choice(["cheap pills", "free article download", "alloys pdf"]) for _ in range(80)),
        103: " ".join(f"#alloys #porous {i}.50 EUR" for i in range(40)),
    }
    good = {
        200: "Index of names\n" + "\n".join(f"Doe{chr(97 + i)}, Jane, {i + 3}, {i + 90}" for i in range(20)),
        201: "\n".join(f"[{i}] Doe J., Roe K.L., How cold air shifts porous alloys, Annals of Tests, {i}, 3, pp. 1-9, (2001) https://doi.example/10.1/{i}" for i in range(20)),
        202: "Contents\n" + "\n".join(f"Porous alloys for storage, part {i} ..... {i * 7}" for i in range(20)),
        203: "batch; a; b; c\n" + "\n".join(f"R{i}; {i}.5; {i}.25; {i * 3}" for i in range(20)), 204: "", 205: None, 206: PROSE[1] * 2000,
    }
    data = [(i, t) for i, t in enumerate(prose)] + list((bad | good).items()) + [(100, bad[100])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, words int")
    assert {r.doc_id for r in spam.find_spam(docs).collect()} == set(bad)
    assert spam.find_spam(docs.limit(0)).count() == 0
