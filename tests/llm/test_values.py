"""Problems 1, 2 and 7."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from folia.llm import canonical, consensus, lookalikes


def test_alignment_votes():
    assert consensus.consensus(["10.1/abc", "10.1/abd", "10.1/abd"], [1.0, 1.0, 1.0]) == "10.1/abd"
    for order in itertools.permutations([("a b c", 1.0), ("a x c", 0.6), ("a b d", 0.6), ("q", 0.5)]):
        assert consensus.consensus(*map(list, zip(*order, strict=True))) == "a b c"  # voted for by others' tokens too
    assert consensus.consensus(["10.1/trusted", "10.1/other", "10.1/others"], [1.0, 1.4, 0.5]) == "10.1/other"
    assert consensus.consensus(["same"], [0.1]) == "same"
    assert consensus.consensus(["a b c d", "a b c e", "a b f d"], [1.0, 1.0, 1.0]) == "a b c d"


def test_values_that_count(spark):
    one = lambda f, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(f(F.col("x"))).collect()]
    assert one(consensus.doi_value, "https://doi.example/10.99111/AB c.", "1O.99152/x", "10.0000/0000", "10.123/x", "doi:10.1234/(a)", None, "") == ["10.99111/abc", None, None, None, "10.1234/(a", None, None]
    assert one(consensus.issn_value, "ISSN 0317-8471", "03178471", "0317-8472", "00000000", "9011", None, "2434-561x") == ["0317-8471", "0317-8471", None, None, None, None, "2434-561X"]


def test_representative(spark, rows):
    data = [(1, 1, "10.1234/abc", 2), (1, 2, "10.1234/abcdef", 3), (1, 3, "10.1234/abcdef", 2), (2, 4, None, 1), (1, 2, "10.1234/abcdef", 3)]
    df = spark.createDataFrame(data, "g long, pub_id long, doi string, rank int").withColumn("_value", F.lit("clash"))
    values = consensus.distinct_values(df, "g", {"doi": consensus.doi_value(F.col("doi"))}, [F.col("rank"), F.col("pub_id")])
    groups = spark.createDataFrame([(1,), (2,), (3,), (1,), (None,)], "g long")
    for choose in (consensus.represent, consensus.represent_first):
        assert rows(choose(groups, consensus.drop_beginnings(values, "g", "doi"), "g", ["doi"])) == [(1, "10.1234/abcdef"), (2, "unknown"), (3, "unknown")]
        assert choose(groups.limit(0), values.limit(0), "g", ["doi"]).count() == 0


def test_votes_and_precedence(spark, rows):
    data = [(1, 1, "10.1234/one", 1), (1, 2, "10.1234/two", 3), (1, 3, "10.1234/two", 3), (1, 4, "10.1234/two", 2), (1, 5, "10.1234/tow", 3)]
    df = spark.createDataFrame(data, "g long, pub_id long, doi string, rank int")
    values = consensus.distinct_values(df, "g", {"doi": consensus.doi_value(F.col("doi"))}, [F.col("rank"), F.col("pub_id")], F.lit(1.0) / F.col("rank"))
    groups = spark.createDataFrame([(1,)], "g long")
    assert rows(consensus.represent(groups, values, "g", ["doi"])) == [(1, "10.1234/two")]  # copies add up
    assert rows(consensus.represent_first(groups, values, "g", ["doi"])) == [(1, "10.1234/one")]


def test_mapping(spark):
    reference = [(1, "country", "Niger"), (2, "country", "Nigeria"), (3, "country", "United Kingdom"), (4, "country", "South Korea"), (5, "country", "France"), (10, "institution", "Tolraburg Univ"), (11, "institution", "Tolraburg Textiles Rto"), (20, "journal", "Letters in Digital Enzyme Kinetics")]
    typed = {
        "country": {"nigeria": 2, "Nigerai": 2, "Scotland": 3, "U.K.": 3, "Souht Korea": 4, "North Korea": -1, "Gondor": -1, "F-France": 5, "France (FR)": 5, "Frankreich": 5, "???": -1},
        "institution": {"Université de Tolraburg": 10, "Textiles Rto, Tolraburg": 11, "Research and Technology Organisation of Textiles at Tolrabrg": 11, "City Hall": -1, "x" * 5000: -1},
        "journal": {"Lett Digit Enzyme Kinet": 20, "Digital Enzyme Kinetics, Letters in": 20, "Letters of Digtal Enzyme Kinetics, Vol. 3": 20, "Lecture notes 3": -1},
    }
    values = [(f, v, "x") for f, vs in typed.items() for v in vs] * 2 + [("country", None, "x"), ("country", "unknown", "x"), ("country", "Niger", "x"), ("country", " ", "x")]
    out = canonical.map_to_list(spark.createDataFrame(values, "field_name string, raw_value string, item_id string"), spark.createDataFrame(reference, "item_id long, field_name string, canonical string"))
    got = {(r.field_name, r.raw_value): r.item_id for r in out.collect()}
    assert got == {(f, v): i for f, vs in typed.items() for v, i in vs.items()}
    assert out.count() == len(got)


def test_blocks_of_a_long_list(spark, monkeypatch):
    reference = spark.createDataFrame([(i, "journal", f"Annals of {w} Studies") for i, w in enumerate(("Alpha", "Beta", "Gamma", "Delta"))], "item_id long, field_name string, canonical string")
    values = spark.createDataFrame([("journal", "annals of betta studies"), ("journal", "nothing")], "field_name string, raw_value string")
    monkeypatch.setattr(canonical, "LIST_LIMIT", 1)
    assert {r.raw_value: r.item_id for r in canonical.map_to_list(values, reference).collect()} == {"annals of betta studies": 1, "nothing": -1}
    assert {r.item_id for r in canonical.map_to_list(values, reference.limit(0)).collect()} == {-1}


def test_blocks_don_t_change_the_result(spark, monkeypatch, rows):
    journals = ["Textiles", "Texture", "Annals of Textile Research", "Journal of Texture Studies", "Letters in Tectonics", "Annals of Tests"]
    institutions = ["Tolra Textiles Rto", "Tolra Texture Rto", "Kamo Optics Univ", "Kamo Opera Univ", "Lyso Optics Site"]
    listed = [(i, "journal", c) for i, c in enumerate(journals)] + [(100 + i, "institution", c) for i, c in enumerate(institutions)]
    raw = [("journal", v) for v in ("Text.", "textils", "Ann Text Res", "J. Texture Stud.", "lettres in tectonic", "Ann. Test", "nothing at all")]
    raw += [("institution", v) for v in ("Tolra Text. Rto", "Tolra Textil. Rto", "Univ of Kamo, Opt.", "Lyso Optic Site", "Kamo Oper. Univ", "none")]
    reference = spark.createDataFrame(listed, "item_id long, field_name string, canonical string")
    values = spark.createDataFrame(raw, "field_name string, raw_value string")
    aliases = spark.createDataFrame([(4, "journal", "Plate News"), (104, "institution", "Old Glass House")], "item_id long, field_name string, alias string")
    raw_too = values.union(spark.createDataFrame([("journal", "plate nwes"), ("institution", "old glas house")], values.schema))
    whole = rows(canonical.map_to_list(raw_too, reference, aliases))
    assert ("journal", "plate nwes", 4) in whole and ("institution", "old glas house", 104) in whole and ("institution", "Tolra Text. Rto", -1) in whole
    monkeypatch.setattr(canonical, "LIST_LIMIT", 1)
    assert rows(canonical.map_to_list(raw_too, reference, aliases)) == whole


def test_lookalikes(spark):
    texts = {
        "\u0405\u043edr\u043en Z.": "Sodron Z.", "Sodron T.": None, "X\u0443zvaq": None, "Hot\u00f3 \u041c.": "Hot\u00f3 M.", "Lom\u200bbar": "Lombar", "a\u00a0b": "a b", "x\u2011y": "x-y", "\uff35\uff4e\uff49ted": "United",
        "Cafe\u0301": "Caf\u00e9", "Влияние тепла": None, "Влияни\u0065 тепла": "Влияние тепла", "α-Zirconia": None, "CO₂ uptake": None, "基于镍，铜": None, "plain M.": None, "Henry \u2163": "Henry IV", "\u13a1oman": "Roman", "roman": None, "": None, "Škoda": None,
    }
    df = spark.createDataFrame([(t, "clash") for t in texts] * 2 + [(None, None)], "text string, plain string")
    got = {r["text"]: r["plain"] for r in lookalikes.repair_lookalikes(df).collect()}
    assert got == {t: p for t, p in texts.items() if p is not None}
    assert lookalikes.repair_lookalikes(df.limit(0)).count() == 0
    assert lookalikes.plain_form("x" * 100_000 + "​") == "x" * 100_000
