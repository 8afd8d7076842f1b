from __future__ import annotations

from folia.operators import repair


def test_separators(spark):
    df = spark.createDataFrame([(1, "A; B;", "U;, X; V", "A, U;, X; B;, V"), (2, "A; B", "U; V", "A, U; B, V")], "i int, authors string, affiliations string, authors_with_affiliations string")
    one, two = sorted(repair.repair_separators(df).collect())
    assert (one.authors, one.affiliations, one.authors_status, one.affiliations_status) == ("A; B", "U, X; V", 1, 1) and ";," not in one.authors_with_affiliations
    assert (two.authors, two.affiliations, two.authors_with_affiliations, two.authors_status) == ("A; B", "U; V", "A, U; B, V", 0)


def test_initials(spark):
    assert repair.initials_name("Doe, Jean-Luc Marc (57)") == "Doe J.L.M." and repair.initials_name("Team X") == "Team X U.F.N."
    row = ("Doe J.; Roe K.", "Doe, Jane Ann (1); Roé, Kim (2)", "Univ A", "Doe J., Univ A; Roe K., Univ B")
    df = spark.createDataFrame([row], "authors string, author_full_names string, affiliations string, authors_with_affiliations string")
    got = repair.repair_initials(df).first()
    assert got.authors == "Doe J.A.; Roe K." and got.authors_with_affiliations == "Doe J.A., Univ A; Roe K., Univ B"
    assert [(c.old, c.new) for c in got.changed] == [("Doe J.", "Doe J.A.")]
