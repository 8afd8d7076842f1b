"""Column names of the raw exports and of the item tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the item tables (fixed values).
ITEMS = [
    "articles", "authors", "addresses", "countries", "institutions", "authors_institutions", "authors_keywords", "indexed_keywords", "title_keywords",
    "subjects", "sub_subjects", "references", "norm_institutions", "raw_institutions",
]

# Header of the comma-separated export and the name used here (fixed values).
RAW_A = {
    "Affiliations": "affiliations", "Author Keywords": "author_keywords", "Authors": "authors", "Authors with affiliations": "authors_with_affiliations", "Document Type": "document_type",
    "DOI": "doi", "Index Keywords": "index_keywords", "ISSN": "issn", "Source title": "source_title", "Language of Original Document": "language", "Page start": "page_start",
    "References": "cited_refs", "Title": "title", "Volume": "volume", "Year": "year",
}
RAW_A_OPTIONAL = {"EID": "eid", "Author full names": "author_full_names"}
# Header of the tab-separated export (fixed values).
RAW_B = {
    "DE": "author_keywords", "AU": "authors", "AF": "author_full_names", "C1": "addresses", "DT": "document_type", "DI": "doi", "ID": "index_keywords", "SN": "issn", "SO": "source_title",
    "LA": "language", "BP": "page_start", "CR": "cited_refs", "WC": "subjects", "SC": "sub_subjects", "TI": "title", "VL": "volume", "PY": "year", "EI": "eissn",
}
RAW_B_OPTIONAL = {"UT": "ut"}

ARTICLES = T.StructType(
    [T.StructField("pub_id", T.LongType()), T.StructField("authors", T.StringType()), T.StructField("year", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("journal", "volume", "page", "doi", "document_type", "language", "title", "issn", "norm_journal")]
)
