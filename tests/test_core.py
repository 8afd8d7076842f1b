from __future__ import annotations

import difflib
import itertools
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folia.functions import normalize as N
from folia.functions.text import fold, fold_py
from folia.operators import aggregate, dedup, explode, institutions, joins
from folia.plans import pipeline
from folia.plans.lookups import category_table, journal_table, type_table, zip_table
from folia.sources import readers, sinks


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_scalars(spark):
    assert one(spark, N.normalize_issn, "1234-567X", "15343219", "", None) == ["1234-567X", "1534-3219", "unknown", "unknown"]
    assert one(spark, N.normalize_year, "2020.0", "x", None, " 2019 ", "NaN") == [2020, 0, 0, 2019, 0]
    assert one(spark, N.normalize_country, "England", "Peoples R China", "NY 10027 USA", "Turkiye", "Atlantis") == ["United Kingdom", "China", "United States", "Turkey", "Unknown"]
    assert one(spark, N.normalize_type, "Proceedings Paper", "Article; Data Paper", "Other") == ["Conference paper", "Data paper", "Other"]
    assert one(spark, N.normalize_journal, "Journal of Science & Technology", "Proceedings of the 5th Conference") == ["j sci and tech", "the conf"]
    assert one(spark, N.normalize_name, " GrÔŁ-biçà-vèLU D'aillön, E-kj. ") == ["Grol-Bica-Velu D'Aillon E-KJ"]
    assert one(spark, N.normalize_town, "Saint-Martin lez Tatinghem") == ["st martin les tatinghem"]
    assert one(spark, N.standard_address, "Dept. Phys, Univ. Lille, 59000 Lille, FRANCE", "Univ X, Nowhere") == ["Department Phys,University Lille, 59000 Lille, France".replace("Phys,U", "Phys, U"), "University X, Nowhere, Unknown"]
    assert one(spark, N.without_accents, "Łódź ﬁ", None) == ["Łodz fi", None]


def test_fold_is_the_same_in_both_engines(spark):
    texts = ["Ｌｏ‍ Ѕоdrоn\xa0Z.", "ÅÉñø ß", "плюс", "中文 α", "", "a\tb", "é"]
    assert one(spark, fold, *texts) == [fold_py(t) for t in texts]
    for code in range(0x80, 0x2000):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if base.isascii() and base != ch and base.isalpha():
            assert fold_py(ch) == base.lower()


def test_explodes(spark, rows):
    df = spark.createDataFrame([(1, "Dr; Rodat S."), (2, "A. B, C. D"), (3, "")], "pub_id int, a string")
    assert rows(explode.authors_a(df, "pub_id", "a")) == [(1, 0, " Rodat S"), (2, 0, "A B"), (2, 1, " C D"), (3, 0, "")]
    kw = spark.createDataFrame([(1, "Biomass; NULL ;;x"), (2, None)], "pub_id int, k string")
    assert rows(explode.keywords(kw, "pub_id", "k")) == [(1, "biomass"), (1, "unknown"), (1, "x"), (2, "unknown")]
    refs = spark.createDataFrame([(1, "Smith J., A title, J Appl Phys, 12, 3, pp. 1-9, (2020); no author")], "pub_id int, r string")
    got = rows(explode.references_a(refs, "pub_id", "r"))
    assert got == [(1, "Smith J", "2020", "J Appl Phys", "12", "1-9"), (1, "partial", "0", "unknown", "0", "0")]
    accents = spark.createDataFrame([(1, "Grácia-lópez J., A title, J Appl Phys, 12, 3, pp. 1-9, (2020)")], "pub_id int, r string")
    assert rows(explode.references_a(accents, "pub_id", "r"))[0][1] == "Gracia-Lopez J"
    wos = spark.createDataFrame([(1, "Jung B, 1999, PHYS CHEM, V42, P13; nobody")], "pub_id int, r string")
    assert rows(explode.references_b(wos, "pub_id", "r")) == [(1, "Jung B", "1999", "PHYS CHEM", "42", "13")]


def test_bracketed_addresses(spark, rows):
    cell = "[Jung, Bo Kum; Elesina, Varvara V.] Tech Univ, Braunschweig, Germany; [Matos, S] Univ Lisbon, Portugal"
    df = spark.createDataFrame([(1, cell, "Jung, Bo Kum; Elesina, Varvara V.; Matos, S; Lost, A")], "pub_id int, c string, n string")
    tables = explode.addresses_b(df, "pub_id", "c", "n")
    assert [r[2] for r in rows(tables["addresses"])] == ["Tech University, Braunschweig, Germany", "University Lisbon, Portugal", "3_unknown"]
    assert [r[2] for r in rows(tables["countries"])] == ["Germany", "Portugal", "Unknown"]
    got = rows(explode.author_addresses_b(df, "pub_id", "c", "n"))
    assert [(r[1], r[3]) for r in got] == [(0, "Germany"), (1, "Germany"), (2, "Portugal"), (3, "Unknown")]


def test_author_numbers_of_the_first_source(spark, rows):
    df = spark.createDataFrame([(1, "Univ A, France; Lab B, Italy", "Doe J., Univ A, France; Doe J., Lab B, Italy; Roe K., nowhere")], "pub_id int, f string, a string")
    got = rows(explode.author_addresses_a(df, "pub_id", "f", "a"))
    assert sorted((r[1], r[3]) for r in got) == [(0, "France"), (0, "Italy"), (1, "Unknown")]
    lost = spark.createDataFrame([(1, "Inst Foo, Atlantis; Univ A, France", "Doe J., Inst Foo, Atlantis, Univ A, France"), (2, None, None), (3, "", "Roe K., Univ Paris, France")], "pub_id int, f string, a string")
    assert [r[:3] for r in rows(explode.author_addresses_a(lost, "pub_id", "f", "a"))] == [(1, 0, " University A, France"), (1, 0, "Institute Foo, Atlantis, Unknown"), (2, 0, "0_unknown, Unknown"), (3, 0, "0_unknown, Unknown")]
    assert [r[2] for r in rows(explode.addresses_a(lost, "pub_id", "f", "a")["addresses"])] == ["Inst Foo, Atlantis", " Univ A, France", "unknown", "0_unknown", "unknown", "0_unknown"]
    spelled = spark.createDataFrame([(1, "University Paris, France", "Doe J., Univ Paris, France")], "pub_id int, f string, a string")
    assert explode.addresses_a(spelled, "pub_id", "f", "a")["addresses"].count() == 1


def test_brackets_with_accents_stay_with_their_addresses(spark, rows):
    df = spark.createDataFrame([(1, "[Jé, A] Inst X; [Doe, B] Inst Y, France", "Jé, A; Doe, B"), (2, None, None), (3, "Inst Z, Italy; Inst W", "Roe, C")], "pub_id int, c string, n string")
    assert [r[:3] for r in rows(explode.author_addresses_b(df, "pub_id", "c", "n"))] == [(1, 0, "Institute X, Unknown"), (1, 1, "Institute Y, France"), (2, 0, "unknown"), (3, 0, "unknown")]
    assert [r[2] for r in rows(explode.addresses_b(df, "pub_id", "c", "n")["addresses"])] == ["Institute X", "Institute Y, France", "unknown", "Institute Z, Italy", "Institute W"]


def test_first_author_of_both_notations(spark):
    assert one(spark, N.first_author, "Doe J., Roe K.", "Doe J.; Roe, K.", "solo") == ["Doe J", "Doe J", "SOLO"]


def test_success_and_roll_up(spark, rows):
    items = spark.createDataFrame([(1, "a"), (2, ""), (3, "b"), (4, "c")], "pub_id int, keyword string")
    assert rows(aggregate.success(items, "pub_id", "keyword", items)) == [("keyword", 75.0)]
    assert rows(aggregate.failed(items, "pub_id", "keyword")) == [("keyword", 2)]
    inst = spark.createDataFrame([(1, 0, "x", "F", "N1", None), (1, 0, "y", "F", "N2", "r"), (2, 0, None, "", "N", "")], "pub_id int, idx_author int, address string, country string, norm_institutions string, raw_institutions string")
    assert rows(aggregate.roll_up(inst)) == [(1, 0, "x; y", "F", "N1; N2", "r"), (2, 0, "empty", "empty", "N", "empty")]


def test_title_keywords(spark, rows):
    df = spark.createDataFrame([(i, "Thermal stability of Mg2Si alloys") for i in range(3)] + [(9, "thermal rare")], "pub_id int, t string")
    got = rows(aggregate.title_keywords(df, "pub_id", "t"))
    twice = spark.createDataFrame([(1, "creep of creep in creep"), (2, "Studies of creeps")], "pub_id int, t string")
    assert rows(aggregate.title_keywords(twice, "pub_id", "t")) == [(1, "creep"), (2, "creep")]
    assert rows(aggregate.title_keywords(twice, "pub_id", "t", 1, lambda c: F.split(c, " ")))[0] == (1, "creep")
    assert (9, "thermal") in got and (9, "rare") not in got and (0, "mg2si") in got and (1, "alloy") in got


def articles(spark, values):
    names = ["pub_id", "authors", "year", "journal", "volume", "page", "doi", "document_type", "language", "title", "issn", "norm_journal"]
    full = [tuple(v.get(n, {"year": 2020}.get(n, "unknown")) for n in names) for v in values]
    return spark.createDataFrame(full, "pub_id long, authors string, year int, " + ", ".join(f"{n} string" for n in names[3:]))


def test_cascade_rules(spark):
    base = {"authors": "Doe J", "document_type": "Article", "norm_journal": "j x"}
    two = articles(spark, [base | {"pub_id": 1, "title": "T one", "doi": "10.1/a"}, base | {"pub_id": 2, "title": "t ONE ", "doi": "10.1/b"}])
    assert [(r.pub_id, r.doi) for r in dedup.deduplicate(two).collect()] == [(1, "10.1/a")]
    three = articles(spark, [base | {"pub_id": i, "title": "T", "doi": d, "authors": f"A{i}", "page": str(i)} for i, d in ((1, "10.1/a"), (2, "10.1/b"), (3, "10.1/c"))])
    assert dedup.deduplicate(three).count() == 3
    fill = articles(spark, [base | {"pub_id": i, "title": f"T{i}", "issn": s} for i, s in ((1, "unknown"), (2, "A"), (3, "B"))])
    assert {r.issn for r in dedup.same_issn(dedup.prepare(fill)).collect()} == {"A"}
    assert dedup.deduplicate(articles(spark, [])).count() == 0


def test_cascade_is_stable_and_complete(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [{"pub_id": i, "authors": pick("A", "B", "unknown"), "title": pick("t1", "t2", "T1 "), "doi": pick("unknown", "10.1/a", "10.1/A", "10.1/b", None), "document_type": pick("Article", "unknown"), "issn": pick("1", "unknown"), "page": pick("1", "2"), "norm_journal": pick("j", "k")} for i in range(60)]
    df = articles(spark, rows)
    kept = dedup.deduplicate(df)
    assert kept.count() + dedup.dropped_ids(df, kept).count() == 60
    assert kept.select("pub_id").distinct().count() == kept.count()


def test_leader_clustering_against_a_loop(spark):
    rng = random.Random(2)
    names = [f"{chr(97 + i)}{i}" for i in range(14)]
    for _ in range(3):
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.25]
        want: dict[str, str] = {}
        leaders: list[str] = []
        for n in names:
            lead = next((x for x in leaders if (x, n) in pairs), None)
            want[n] = lead or n
            leaders += [] if lead else [n]
        at = {n: i for i, n in enumerate(names)}
        values = spark.createDataFrame([(n, at[n]) for n in names], "value string, first long")
        edges = spark.createDataFrame([(a, b, at[a], at[b]) for a, b in pairs] or [("", "", 0, 0)], "a string, b string, fa long, fb long")
        assert {r.value: r.leader for r in dedup.leaders(values, edges).collect()} == want


def test_leaders_of_a_long_chain(spark):
    n = 56
    values = spark.createDataFrame([(str(i), i) for i in range(n)], "value string, first long")
    edges = spark.createDataFrame([(str(i), str(i + 1), i, i + 1) for i in range(n - 1)], "a string, b string, fa long, fb long")
    assert {int(r.value): int(r.leader) for r in dedup.leaders(values, edges).collect()} == {i: i - i % 2 for i in range(n)}


def test_similarity_rule(spark):
    a = "international journal of thermal storage systems"
    assert dedup.similar(a, "international journal of thermal storage system") and dedup.similar(a, "journal of thermal storage systems international")
    assert not dedup.similar("short one", "short one") and not dedup.similar(a, "letters on something else entirely, volume nine")
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta theta lambda sigma omega".split()
    texts = sorted({" ".join(rng.choice(words) for _ in range(6)) + rng.choice(["", "s", " x"]) for _ in range(60)})
    values = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, first long")
    got = {(r.a, r.b) for r in dedup.similar_pairs(values).collect()}
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if dedup.similar(a, b)}
    assert got == want and difflib


def test_similar_pairs_are_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = ["frontline applied thermal storage", "seasonal zeolites for soil remediation", "annals of porous alloys and cold storage reports", "letters in digital enzyme kinetics and more"]
    typed = lambda t: "".join(rng.choice("xq") + c if rng.random() < 0.06 else "" if rng.random() < 0.05 else rng.choice("abe") if rng.random() < 0.05 else c for c in t)
    texts = sorted({typed(t) for t in base for _ in range(40)} | {"frontline aplpied hermal storage", "Seasonal zeolitws for soil reemdiation", "Seasοnal zeοlites fοr soil remediatiοn", *base})
    values = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, first long")
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if dedup.similar(a, b)}
    assert {(r.a, r.b) for r in dedup.similar_pairs(values).collect()} == want
    monkeypatch.setattr(dedup, "BLOCK", 20)
    assert {(r.a, r.b) for r in dedup.similar_pairs(values).collect()} == want


def test_few_pairs_are_compared_letter_by_letter(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghiklmnoprstuvwyz") for _ in range(160))
    texts = sorted(text[k:] + text[:k] for k in range(0, 160, 8))  # rotations: the same pairs of letters, most of them too far away
    size = len(texts)
    part = pd.DataFrame({"cell": "x", "side": [0] * size + [1] * size, "value": texts * 2, "first": [*range(size)] * 2})
    compared, common = [], dedup._common
    monkeypatch.setattr(dedup, "_common", lambda *given: compared.append(given[1].shape[-1]) or common(*given))
    got = dedup._near(part).drop_duplicates()
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if dedup.similar(a, b)}
    assert want and want <= set(zip(got["a"], got["b"], strict=True)) and sum(compared) <= size * (size - 1) // 2 * 0.6


def test_pairs_that_fall_short_are_given_up(monkeypatch):
    def common(x, y, far):
        row = [0] * (len(y) + 1)
        for i, c in enumerate(x):
            row, above = [0], row
            for j, d in enumerate(y):
                row.append(above[j] + 1 if c == d and abs(i - j) <= far else max(above[j + 1], row[j]))
        return row[-1]

    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    base = made(150)
    a = [made(n) for n in (1, 63, 64, 65, 128, 140)] + [base[k:] for k in range(0, 40, 5)]
    b = [made(n) for n in (2, 60, 64, 90, 130)] + [base[:k] + "x" + base[k + 2 :] for k in range(0, 150, 7)]
    codes = {c: k for k, c in enumerate(sorted(set("".join(b))), 1)}
    letters = np.zeros((max(map(len, b)), len(b)), np.int64)
    for k, text in enumerate(b):
        letters[: len(text), k] = [codes[c] for c in text]
    masks = dedup._masks(a, codes, 3)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    at, sizes = x * (len(codes) + 1), np.array([len(b[k]) for k in y])
    taken, take = [], np.take
    monkeypatch.setattr(dedup.np, "take", lambda *given, **more: taken.append(len(given[1])) or take(*given, **more))
    for far in (3, 20, 70, None):
        want = np.array([common(a[p], b[q], 999 if far is None else far) for p, q in zip(x, y, strict=True)])
        taken.clear()
        assert (dedup._common(masks, at, letters, y, far) == want).all()
        n = sum(taken)
        needed = 0.4025 * (np.array([len(a[k]) for k in x]) + sizes)
        taken.clear()
        got = dedup._common(masks, at, letters, y, far, needed, sizes)
        assert ((got >= needed) == (want >= needed)).all() and (got <= want).all() and sum(taken) < 0.9 * n


def test_hashed_pairs_of_letters_are_bounds():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé\u4e00 ") for _ in range(n)) for n in (0, 1, 2, 31, 64, 65, 90, 200)]
    for far in (0, 5, 40):
        segments, around = dedup._placed(texts, 0), dedup._placed(texts, far)
        for i, a in enumerate(texts):
            lost = max(len(a) - 1, 0) - int(np.bitwise_count(segments[i]).sum())
            for j, b in enumerate(texts):
                shared = sum(a[k : k + 2] == b[k : k + 2] for k in range(min(len(a), len(b)) - 1))  # at the same place, so near enough
                assert int(np.bitwise_count(segments[i] & around[j]).sum()) + lost >= shared
                assert float(dedup._profiles(texts)[i] @ dedup._profiles(texts)[j]) >= shared


def test_lookups_and_sets(spark, rows):
    a = spark.createDataFrame([(1, "Letters in Digital Enzyme Kinetics", "x"), (2, "zzz", "9011-0072"), (3, None, None)], "pub_id long, journal string, issn string")
    coded = joins.journal_categories(a, journal_table(spark), "pub_id", "journal", "issn")
    assert {(r[0], tuple(r[1])) for r in coded.collect()} == {(1, (1303, 1500)), (2, (2100, 2502)), (3, ())}
    assert rows(joins.subjects(coded, category_table(spark), "pub_id"))[0] == (1, " Biochemistry")
    first, second = spark.createDataFrame([(0, "a"), (4, "b")], "pub_id long, t string"), spark.createDataFrame([(0, "c")], "pub_id long, t string")
    assert rows(joins.concatenate(first, second, joins.offset_of(first))) == [(0, "a"), (4, "b"), (5, "c")]
    assert rows(joins.concatenate(first.limit(0), second, joins.offset_of(first.limit(0)))) == [(0, "c")]


def test_one_offset_for_all_items(spark, rows):
    table = lambda *r: spark.createDataFrame(list(r), "pub_id long, t string")
    a = {"articles": table((0, "a"), (1, "b"), (2, "c")), "keywords": table((0, "k"))}  # the last publications have no keyword
    b = {"articles": table((0, "d"), (1, "e")), "keywords": table((0, "l"), (1, "m"))}
    both = joins.concatenate_corpora(a, b)
    assert rows(both["keywords"]) == [(0, "k"), (3, "l"), (4, "m")] and rows(both["articles"])[3:] == [(3, "d"), (4, "e")]


def test_institutions(spark, rows):
    aff = spark.createDataFrame([("France", "Lille Univ", "University of Lille"), ("France", "CEA Nro", "CEA")], "country string, norm_aff string, alias string")
    address = spark.createDataFrame([(1, 0, "CEA, University of Lille, 12 rue Verte, 59000 Lille, France"), (1, 1, "Institute Foo, Atlantis, Unknown")], "pub_id long, idx_address int, address string")
    towns = spark.createDataFrame([("France", "Lille")], "country string, town string")
    lookups = institutions.Lookups(institutions.dictionary(aff), type_table(spark), towns, zip_table(spark))
    out = institutions.build_institutions(address, lookups)
    assert [r[2] for r in rows(out["norm_institutions"])] == ["CEA Nro; Lille Univ", "empty"]
    assert rows(out["raw_institutions"])[1][2].startswith("Institute Foo")
    of_author = address.select("pub_id", F.col("idx_address").alias("idx_author"), "address", F.lit("France").alias("country")).unionByName(spark.createDataFrame([(1, 0, "1_unknown, Unknown", "Unknown")], "pub_id long, idx_author int, address string, country string"))
    got = rows(institutions.author_institutions(of_author, lookups))
    assert [r[:2] for r in got] == [(1, 0), (1, 1)] and got[0][4] == "CEA Nro;Lille Univ; empty" and "12 rue Verte" in got[0][5]
    assert rows(institutions.author_institutions(of_author, None))[0][4:] == ("empty", "")
    flagged = institutions.flag_author_institutions(institutions.author_institutions(of_author, lookups), [("CEA", "is_cea")])
    assert [r["is_cea"] for r in flagged.orderBy("idx_author").collect()] == [1, 0] and "raw_institutions" in flagged.columns


def test_readers_and_sinks(spark, tmp_path, rows):
    header = ",".join(readers.RAW_A)
    line = ",".join(['"x ""q"", y"'] + ["v"] * (len(readers.RAW_A) - 2) + ["2020"])
    (tmp_path / "a.csv").write_text(f"{header}\n{line}\n{line}\n", encoding="utf-8")
    got = readers.check_a(readers.read_export_a(spark, str(tmp_path / "a.csv"))).collect()
    assert [r.pub_id for r in got] == [0, 1] and got[0].affiliations == 'x "q", y' and got[0].year == "2020"
    assert readers.latest_file(spark, str(tmp_path), "csv").endswith("a.csv")
    with pytest.raises(readers.MissingColumns):
        readers.check_a(spark.createDataFrame([(1,)], "Title int"))
    tsv = "\t".join(readers.RAW_B) + "\n" + "\t".join("v" for _ in readers.RAW_B) + "\n" + "\t".join("" for _ in readers.RAW_B) + "\n"
    (tmp_path / "b.txt").write_text(tsv, encoding="utf-8")
    assert readers.check_b(readers.read_export_b(spark, str(tmp_path / "b.txt"))).count() == 1
    df = spark.createDataFrame([(1, "a\tb")], "i int, t string")
    for extent in sinks.FORMATS:
        sinks.write_items({"t": df}, str(tmp_path), extent)
    assert rows(spark.read.parquet(str(tmp_path / "t.parquet"))) == [(1, "a\tb")]


def test_whole_corpora(spark):
    raw_a = spark.createDataFrame([tuple(["Univ A, France", "k1; k2", "Doe J.; Roe K.", "Doe J., Univ A, France; Roe K., Univ A, France", "Article", "10.1/x", "i1", "12345678", "Journal of X", "English", "1", "Doe J., T, J Appl Phys, 12, 3, pp. 1-9, (2020)", f"A title number {i}", "3", "2020"]) for i in range(3)], list(readers.RAW_A))
    raw_b = spark.createDataFrame([tuple(["k1", "Doe J", "Doe, Jane", "[Doe, Jane] Univ A, France", "Article", "10.1/X", "i", "1234-5678", "J X", "English", "1", "A, 1999, J PHYS", "S1", "S2", "A title number 0", "3", "2020", ""])], list(readers.RAW_B))
    a = pipeline.parse_a(readers.check_a(raw_a), journal_table(spark), category_table(spark))
    b = pipeline.parse_b(readers.check_b(raw_b))
    both = pipeline.concatenate_and_deduplicate(a, b)
    ids = {r.pub_id for r in both["articles"].collect()}
    assert ids and ids <= {0, 1, 2, 3}
    for name, table in both.items():
        assert {r[0] for r in table.select("pub_id").distinct().collect()} <= ids, name
    rates, lost = pipeline.success_rates(a, a["articles"])
    assert rates.count() == len(a) - 2 and lost.count() == 0


def test_from_files_to_all_tables(spark, tmp_path):
    from folia.sources.layout import Layout

    layout = Layout(str(tmp_path))
    layout.create("2024")
    full = {"Authors": "Roe K.; Doe J.", "Author full names": "Roe, Kim (1); Doe, Jane (2)", "Affiliations": "Univ A, Lille, France; Lab; Foo, Italy", "Authors with affiliations": "Roe K., Univ A, Lille, France; Doe J., Lab, Italy", "EID": "e1"}
    columns = [*readers.RAW_A, *readers.RAW_A_OPTIONAL]
    lines = [",".join(columns)] + [",".join('"' + (full | {"Title": f"A title {i}", "EID": f"e{i}", "Year": "2020"}).get(c, "v") + '"' for c in columns) for i in range(3)]
    (tmp_path / "2024/Corpus/scopus/rawdata/a.csv").write_text("\n".join(lines), encoding="utf-8")
    other = {"C1": "[Roe, Kim] Univ A, Lille, France", "AF": "Roe, Kim", "PY": "2021", "UT": "w1", "TI": "Another title"}
    columns = [*readers.RAW_B, *readers.RAW_B_OPTIONAL]
    (tmp_path / "2024/Corpus/wos/rawdata/b.txt").write_text("\t".join(columns) + "\n" + "\t".join(other.get(c, "v") for c in columns) + "\n", encoding="utf-8")
    aff = spark.createDataFrame([("France", "A Univ", "University A")], "country string, norm_aff string, alias string")
    towns = spark.createDataFrame([("France", "Lille")], "country string, town string")
    lookups = institutions.Lookups(institutions.dictionary(aff), type_table(spark), towns, zip_table(spark))
    stages = pipeline.run_all(spark, layout, "2024", journal_table(spark), category_table(spark), lookups, [("A Univ", "is_a")])
    assert set(stages) == {"scopus", "wos", "concat", "dedup"}
    read = lambda stage, item: spark.read.parquet(layout.path("2024", stage, "parsing") + f"/{item}.parquet")
    assert read("concat", "articles").count() == 4 and read("dedup", "articles").count() == 1  # all have one DOI
    assert {r.is_a for r in read("concat", "authors_institutions").collect()} == {0, 1} and read("dedup", "norm_institutions").filter("institution = 'A Univ'").count() > 0
    assert [r.co_author for r in read("scopus", "authors").filter("pub_id = 0").orderBy("idx_author").collect()] == ["Roe K", " Doe J"]
    wrong = lookups._replace(words=lookups.words.withColumn("norm_aff", F.lit("A Nonsense")))
    with pytest.raises(pipeline.WrongTypes):
        pipeline.concatenate_and_deduplicate(stages["scopus"], stages["wos"], wrong, similar=False)


def test_read_corpus(spark, tmp_path, rows):
    assert readers.read_corpus_a(spark, str(tmp_path)) is None and readers.read_corpus_b(spark, str(tmp_path)) is None
    columns = [*readers.RAW_A, *readers.RAW_A_OPTIONAL]
    cell = {"Authors": "Li J.; Li J.", "Author full names": "Li, Jun (1); Li, Jie Q. (2)", "Affiliations": "Univ A, France", "Authors with affiliations": "Li J., Univ A, France; Li J., Univ B, France"}
    lines = [",".join(columns)] + [",".join('"' + (cell | {"EID": f"e{i}"}).get(c, "2020") + '"' for c in columns) for i in range(3)]
    (tmp_path / "x.csv").write_text("\n".join(lines), encoding="utf-8")
    got = readers.read_corpus_a(spark, str(tmp_path), correct=True, dropped=spark.createDataFrame([("e1",)], "eid string"))
    assert sorted(rows(got.ids)) == [("e0", 0), ("e2", 1)]
    assert {r.authors for r in got.rows.collect()} == {"Li J.; Li J.Q."}  # two of one spelling stay two
    assert {(r.old, r.new) for r in got.changed_authors.collect()} == {("Li J.", "Li J.Q.")} and got.changed_affiliations.count() == 0


def test_row_numbers_and_lookups(spark, rows):
    df = spark.range(100).repartition(7).selectExpr("cast(id as string) as v")
    assert sorted(r.pub_id for r in readers.row_numbers(df).collect()) == list(range(100))
    assert readers.row_numbers(df.limit(0)).count() == 0
    listed = spark.createDataFrame([("France", "FRA", "(48.8, 2.3)", "['f', 'fr.']", "[5]", "Europe"), ("Nowhere", "NOW", None, "[]", "[]", None)], "country string, short_name string, gps string, zip_letters string, zip_digits string, continent string")
    got = {r.country: r for r in readers.read_countries(listed).collect()}
    assert got["France"].latitude == 48.8 and got["France"].pattern == r"\b(f|fr\.)[\s-]?(\d{5})\b" and got["Nowhere"].pattern == "(?!)" and got["Nowhere"].latitude is None
    wide = spark.createDataFrame([("France", "Lille Univ", "University of Lille", None)], "country string, `Norm affiliations` string, a1 string, a2 string")
    assert [(r.country, r.norm_aff, sorted(r.words)) for r in readers.read_affiliations(wide).collect()] == [("France", "Lille Univ", ["lille", "university"])]
    assert rows(readers.read_types(spark.createDataFrame([(1, "Nro "), (2, None)], "Level int, Abbreviation string"))) == [("Nro", 1)]


def test_merge_files(spark, tmp_path):
    for name, text in (("a.tsv", "x\ty\n1\t2\n"), ("b.tsv", "x\ty\n3\t4\n"), ("c.tsv", "y\tz\n5\t6\n")):
        (tmp_path / name).write_text(text)
    got = readers.merge_files(spark, str(tmp_path), "tsv", "\t", str(tmp_path / "out"))
    assert {tuple(r) for r in got.select("x", "y", "z").collect()} == {("1", "2", None), ("3", "4", None), (None, "5", "6")}
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out")).count() == 3


def test_headers_of_a_folder(spark, tmp_path):
    (tmp_path / "articles.dat").write_text("1\tx\n")
    (tmp_path / "other.dat").write_text("1\n")
    schema = spark.createDataFrame([], "pub_id int, title string").schema
    assert sinks.add_headers(spark, str(tmp_path), str(tmp_path / "new"), {"articles": schema}) == ["articles"]
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "new/articles.dat")).columns == ["pub_id", "title"]


def test_layout(tmp_path):
    from folia.sources.layout import Layout

    layout = Layout(str(tmp_path))
    layout.create("2024")
    assert (tmp_path / "2024/Corpus/scopus/rawdata").is_dir() and len(layout.paths("2024")) == 6
