"""DuckDB SQL of the core queries."""

from __future__ import annotations

from folia.functions import normalize as N
from folia.functions.text import ascii_map
from folia.operators.aggregate import STOP_WORDS
from folia.operators import institutions as I
from folia.operators.explode import SKIPPED_AUTHORS
from folia.plans.lookups import CATEGORIES, JOURNALS, TYPES, ZIP_COUNTRIES, ZIP_PLAIN


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def translated(c: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        if len(new) > 1:
            c = f"replace({c}, {q(old)}, {q(new)})"
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if v == ""]
    if single:
        c = f"translate({c}, {q(''.join(single))}, {q(''.join(single.values()))})"
    for k in gone:
        c = f"replace({c}, {q(k)}, '')"
    return c


def ascii_sql(c: str) -> str:
    source, target = ascii_map()
    return f"regexp_replace(translate({c}, {q(source)}, {q(target)}), '[^\\x00-\\x7F]', '', 'g')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B\\x{{85}}]+|[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B\\x{{85}}]+$', '', 'g')"


def standard(c: str) -> str:
    return ascii_sql(translated(translated(translated(c, N.DASHES), N.QUOTES), N.DROPPED_SYMBOLS))


def country(c: str) -> str:
    rules = " ".join(f"WHEN {c} = {q(t)} THEN {q(r)}" if how == "is" else f"WHEN contains({c}, {q(t)}) THEN {q(r)}" for how, t, r in N.COUNTRY_RULES)
    return f"CASE WHEN {c} IN {listed(N.COUNTRIES)} THEN {c} {rules} ELSE 'Unknown' END"


def journal(c: str) -> str:
    text = f"lower(' ' || {c} || ' ')"
    text = f"regexp_replace(regexp_replace({text}, '\\s\\d{{4}}\\s', ' ', 'g'), '\\s\\d+th\\s|\\s\\d+nd\\s', ' ', 'g')"
    for old, new in N.JOURNAL_PARTS:
        text = f"replace({text}, {q(old)}, {q(new)})"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def doc_type(c: str, lower: bool) -> str:
    low = (lambda x: x.lower()) if lower else (lambda x: x)
    c = f"lower({c})" if lower else c
    whens = " ".join(f"WHEN {c} = {q(low(s))} THEN {q(low(t))}" for t, ss in N.DOCUMENT_TYPES.items() for s in ss)
    return f"CASE {whens} ELSE {c} END"


def known(column: str, order: str, longest: bool = False) -> str:
    rank = f"length({column}) DESC, {order}" if longest else order
    return f"coalesce(first({column} ORDER BY {rank}) FILTER (WHERE {column} <> 'unknown'), 'unknown')"


KEYWORDS = "SELECT pub_id, keyword FROM (SELECT pub_id, CASE WHEN w = 'null' THEN 'unknown' ELSE w END AS keyword FROM (SELECT pub_id, {strip} AS w FROM (SELECT pub_id, unnest(string_split(coalesce({c}, 'unknown'), ';')) AS r FROM scopus_rawdata))) WHERE keyword <> ''"
TITLE_WORDS = """SELECT pub_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+(?:[-.][a-z0-9]+)*')) AS w FROM articles WHERE title IS NOT NULL"""
TITLE_WORDS = f"""SELECT pub_id, CASE WHEN regexp_matches(w, '(?:ss|us|is|[0-9.-])s?$') THEN w WHEN regexp_matches(w, '[a-z]{{2}}ies$') THEN left(w, -3) || 'y' WHEN regexp_matches(w, '[a-z]{{3}}s$') THEN left(w, -1) ELSE w END AS keyword
  FROM ({TITLE_WORDS}) WHERE length(w) > 2 AND w NOT IN {listed(STOP_WORDS)} AND NOT regexp_matches(w, '^[0-9.-]+$')"""
FILLED = "SELECT pub_id, idx_author, coalesce(nullif(address, ''), 'empty') AS address, coalesce(nullif(country, ''), 'empty') AS country, coalesce(nullif(norm_institutions, ''), 'empty') AS n, coalesce(nullif(raw_institutions, ''), 'empty') AS r FROM address_inst"
_COLUMNS = ["authors", "journal", "volume", "page", "doi", "document_type", "language", "title", "issn", "norm_journal"]
PREPARED = (
    "SELECT *, coalesce(nj0, 'unknown') AS same_journal, " + strip("lower(coalesce(nullif(t0, ''), 'unknown'))") + " AS title_lc, " + doc_type("document_type", True) + " AS type_lc FROM (SELECT pub_id, coalesce(year, 0) AS year, "
    + ", ".join((strip(f"coalesce(nullif({c}, ''), 'unknown')") if c == "title" else f"coalesce(nullif({c}, ''), 'unknown')") + f" AS {c}" for c in _COLUMNS)
    + ", norm_journal AS nj0, title AS t0 FROM articles)"
)


def overwrite(source: str, key: str, column: str, order: str) -> str:
    group = f"SELECT {key} AS gk, bool_or({column} = 'unknown') AS any_unknown, {known(column, order)} AS k FROM {source} GROUP BY 1"
    return f"SELECT x.* EXCLUDE ({column}), CASE WHEN g.any_unknown THEN g.k ELSE x.{column} END AS {column} FROM {source} x JOIN ({group}) g ON x.{key} = g.gk"


_P7 = "doi, title_lc, same_journal, pub_id"
_P8 = "authors, type_lc, issn, page, doi_0, title_0, same_journal, pub_id"
CASCADE = f"""
WITH s0 AS ({PREPARED}), s3 AS ({overwrite('s0', 'same_journal', 'issn', 'pub_id')}), s5 AS ({overwrite('s3', 'title_lc', 'doi', 'same_journal, pub_id')}),
k5 AS (SELECT * FROM s5 WHERE doi <> 'unknown'), s6 AS ({overwrite('k5', 'doi', 'document_type', 'title_lc, same_journal, pub_id')} UNION ALL BY NAME SELECT * FROM s5 WHERE doi = 'unknown'),
g7 AS (SELECT authors, type_lc, issn, page, bool_or(doi = 'unknown') AND max(title_lc) <> min(title_lc) AS hit, {known('doi', _P7)} AS d, {known('title_lc', _P7)} AS t FROM s6 GROUP BY 1, 2, 3, 4),
s7 AS (SELECT s6.* EXCLUDE (doi, title_lc), s6.doi AS doi_0, s6.title_lc AS title_0, CASE WHEN hit THEN d ELSE doi END AS doi, CASE WHEN hit THEN t ELSE title_lc END AS title_lc,
  lower(CASE WHEN hit THEN d ELSE doi END) AS doi_lc FROM s6 JOIN g7 USING (authors, type_lc, issn, page)),
g8 AS (SELECT type_lc, issn, title_lc, page, bool_or(doi_lc = 'unknown') AND max(authors) <> min(authors) AS hit, {known('authors', _P8, True)} AS a, {known('doi_lc', _P8)} AS d FROM s7 GROUP BY 1, 2, 3, 4),
s8 AS (SELECT s7.* EXCLUDE (authors, doi_lc), CASE WHEN hit THEN a ELSE authors END AS authors, CASE WHEN hit THEN d ELSE doi_lc END AS doi_lc FROM s7 JOIN g8 USING (type_lc, issn, title_lc, page)),
g9 AS (SELECT doi_lc, {known('title', 'pub_id')} AS t, {known('document_type', 'pub_id')} AS y, min(pub_id) AS pub_id FROM s8 WHERE doi_lc <> 'unknown' GROUP BY 1),
u9 AS (SELECT min(pub_id) AS pub_id FROM s8 WHERE doi_lc = 'unknown' GROUP BY title_lc, type_lc),
s9 AS (SELECT s8.* EXCLUDE (title, document_type), g9.t AS title, g9.y AS document_type FROM s8 JOIN g9 USING (doi_lc, pub_id)
  UNION ALL BY NAME SELECT s8.* FROM s8 JOIN u9 USING (pub_id)),
s10 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY title_lc, type_lc, same_journal ORDER BY doi_lc, pub_id) AS r FROM s9 WINDOW w AS (PARTITION BY title_lc, type_lc, same_journal))
SELECT pub_id, authors, year, journal, volume, page, doi, document_type, language, title, issn, norm_journal, same_journal FROM s10 WHERE CASE WHEN n < 3 THEN r = 1 ELSE doi_lc <> 'unknown' END
"""
_JOURNALS = "(VALUES " + ", ".join(f"({q(j)}, {q(i)}, {c})" for j, i, c in JOURNALS) + ") AS lj(journal, issn, codes)"
_CODES = "(VALUES " + ", ".join(f"({c}, {q(t)})" for c, t in CATEGORIES) + ") AS lc(code, category)"
_CODED = f"""SELECT pub_id, coalesce(a.codes, b.codes, []) AS codes FROM articles x LEFT JOIN (SELECT * FROM {_JOURNALS}) a ON x.journal = a.journal
 LEFT JOIN (SELECT * FROM {_JOURNALS}) b ON replace(x.issn, '-', '') = b.issn"""
_TYPES = listed(t for t, _ in TYPES)
_TOWN = "replace(replace(translate(lower(norm_institutions), '-''', '  '), ' lez ', ' les '), 'saint ', 'st ')"


def _fix() -> str:
    """Separators repaired, with list functions."""
    n, p, e = (f"string_split({c}, '; ')" for c in ("authors", "affiliations", "authors_with_affiliations"))
    bare = lambda x: f"list_transform({x}, lambda y: replace(y, ';', ''))"
    commas = lambda x: f"list_transform({x}, lambda y: replace(replace(y, ';, ', ', '), ';', ', '))"
    stray = lambda x: f"len(list_filter({x}, lambda y: regexp_matches(y, '[\\pL\\pN_]+;,\\s[\\pL\\pN_]+|[\\pL\\pN_]+;[\\pL\\pN_]+'))) > 0"
    return f"""WITH l AS (SELECT *, {n} AS n, {p} AS p, {e} AS e, len({n}) <> len(string_split(authors_with_affiliations, ';')) AS d, len(list_filter({n}, lambda y: contains(y, ';'))) > 0 AS s
      FROM (SELECT eid, loaded_at, coalesce(authors, 'unknown') AS authors, coalesce(affiliations, 'unknown') AS affiliations, coalesce(authors_with_affiliations, 'unknown') AS authors_with_affiliations FROM scopus_rawdata)), m AS (SELECT *, CASE WHEN s THEN {bare('e')} ELSE e END AS f FROM l)
      SELECT eid, loaded_at, CASE WHEN d AND s THEN array_to_string({bare('n')}, '; ') ELSE authors END AS authors, CASE WHEN d AND {stray('p')} THEN array_to_string({commas('p')}, '; ') ELSE affiliations END AS affiliations,
      CASE WHEN d THEN array_to_string(CASE WHEN {stray('f')} THEN {commas('f')} ELSE f END, '; ') ELSE authors_with_affiliations END AS authors_with_affiliations,
      CAST(d AND s AS INT) AS authors_status, CAST(d AND {stray('p')} AS INT) AS affiliations_status, CAST(d AND {stray('f')} AS INT) AS both_status FROM m"""


def address_words(c: str) -> str:
    text = standard(c)
    for word, pattern in N.ADDRESS_WORDS.items():
        text = f"regexp_replace({text}, {q(pattern)}, {q(word + ' ')}, 'g')"
    return f"regexp_replace(regexp_replace({text}, '\\s+', ' ', 'g'), '\\s,', ',', 'g')"


def standard_list(values: str, unknown: bool) -> str:
    """Standard addresses of a list of texts."""
    words = f"list_transform({values}, lambda x: {address_words('x')})"
    last = country("trim(string_split(string_split(t, ',')[-1], ' - ')[-1])")
    none = "t || ', Unknown'" if unknown else "t"
    pairs = f"list_transform({words}, lambda t: {{'t': t, 'c': {last}}})"
    done = lambda x: none.replace("t", x + ".t", 1)
    return f"list_transform({pairs}, lambda p: CASE WHEN p.c = 'Unknown' THEN {done('p')} WHEN len(string_split(p.t, ',')) > 1 THEN array_to_string(string_split(p.t, ',')[:-2], ',') || ', ' || p.c ELSE ' ' || p.c END)"


def _standard_address() -> str:
    return f"SELECT pub_id, idx_address, {standard_list('[address]', True)}[1] AS address FROM address WHERE address IS NOT NULL"


def name(c: str) -> str:
    """A person's name in one writing, as tidy_name makes it without options; c is NULL or a text."""
    tables = lambda x: translated(translated(translated(x, N.DASHES), N.LANGUAGE_LETTERS), N.PUNCTUATION)
    capital = lambda w: f"upper(left({w}, 1)) || lower(substr({w}, 2))"
    words = f"CASE WHEN contains({c}, '.') THEN {c} ELSE array_to_string(list_transform(string_split({c}, ' '), lambda w: {capital('w')}), ' ') END"
    bare = strip(ascii_sql(tables(words)))
    runs = f"regexp_extract_all({bare}, '[a-zA-Z]+|[^a-zA-Z]+')"
    beside = "(regexp_matches(left(coalesce(r[i + 1], '.'), 1), '[-''\\s]') OR regexp_matches(right(CASE WHEN i > 1 THEN r[i - 1] ELSE '.' END, 1), '[-'']'))"
    cased = f"list_transform([{{'r': {runs}}}], lambda s: array_to_string(list_transform(s.r, lambda x, i: CASE WHEN regexp_matches(x, '^[a-zA-Z]') AND {beside.replace('r[', 's.r[')} THEN {capital('x')} ELSE x END), ''))[1]"
    ended = f"list_transform([{{'t': {cased}}}], lambda s: left(s.t, length(s.t) - length(regexp_extract(s.t, '\\s[a-zA-Z]+-[a-zA-Z]+$'))) || upper(regexp_extract(s.t, '\\s[a-zA-Z]+-[a-zA-Z]+$')))[1]"
    return f"list_transform([{ended}], lambda t: CASE WHEN regexp_matches(t, '^Mc[a-zA-Z]') THEN 'Mc' || upper(substr(t, 3, 1)) || substr(t, 4) ELSE t END)[1]"


def upper_last(c: str) -> str:
    return f"list_transform([string_split({c}, ' ')], lambda l: array_to_string(list_concat(l[:-2], [upper(l[-1])]), ' '))[1]"


_CELLS_A = f"""cells AS (SELECT pub_id, string_split(coalesce(nullif(affiliations, ''), 'unknown'), ';') AS f, string_split(coalesce(nullif(authors_with_affiliations, ''), 'unknown'), ';') AS t FROM scopus_rawdata),
 std AS (SELECT pub_id, f, {standard_list('f', False)} AS b, {standard_list('f', True)} AS u, {standard_list('t', False)} AS t FROM cells),
 named AS (SELECT *, list_transform(t, lambda x: CASE WHEN contains(string_split(x, ',')[1], '.') THEN 1 ELSE 2 END) AS k FROM std),
 parted AS (SELECT pub_id, f, b, u, list_transform(t, lambda x, i: {{'n': {strip("array_to_string(string_split(x, ',')[:k[i]], ',')")}, 'r': array_to_string(string_split(x, ',')[k[i] + 1:], ',')}}) AS e FROM named),
 numbered AS (SELECT pub_id, f, b, u, list_transform(e, lambda x, i: {{'i': len(list_filter(e[:i], lambda y, j: j = 1 OR y.n <> e[j - 1].n)) - 1, 'r': x.r}}) AS a FROM parted)"""
_HAS = "contains(x.r, y) AND trim(y) <> ''"
_ALL_A = f"""WITH {_CELLS_A}, every AS (SELECT pub_id, list_concat(f, list_transform(list_filter(a, lambda x: len(list_filter(b, lambda y: {_HAS})) = 0), lambda x: x.i || '_unknown')) AS l FROM numbered),
 rows AS (SELECT pub_id, CAST(i - 1 AS INT) AS idx_address, l[i] AS address FROM (SELECT pub_id, l, unnest(generate_series(1, len(l))) AS i FROM every))"""
_CHUNKS = f"list_transform(string_split(address, ','), lambda x: {strip('x')})"
_BRACKETED = f"""raw AS (SELECT pub_id, author_full_names AS n, CASE WHEN pub_id % 3 = 0 THEN affiliations ELSE array_to_string(list_transform(string_split(affiliations, ';'), lambda p, i: '[' || string_split(author_full_names, '; ')[i] || '] ' || trim(p)), '; ') END AS c FROM scopus_rawdata),
 known AS (SELECT pub_id, coalesce(nullif(c, ''), 'unknown') AS c, list_transform(string_split(coalesce(n, 'unknown'), ';'), lambda x: {strip('x')}) AS n FROM raw),
 groups AS (SELECT pub_id, c, n, list_transform(regexp_extract_all(c, '\\[([^\\]]*)\\]\\s*([^;\\[]*)', 1), lambda x: list_transform(string_split(x, ';'), lambda y: {strip('y')})) AS ga, list_transform(regexp_extract_all(c, '\\[([^\\]]*)\\]\\s*([^;\\[]*)', 2), lambda x: {strip('x')}) AS gd FROM known)"""
_ADDRESSES_B = f"""WITH {_BRACKETED}, every AS (SELECT pub_id, CASE WHEN contains(c, '[') THEN list_concat(gd, list_filter(list_transform(n, lambda x, i: CASE WHEN list_contains(flatten(ga), x) THEN NULL ELSE (i - 1) || '_unknown' END), lambda x: x IS NOT NULL))
  ELSE list_transform(string_split(c, ';'), lambda x: {strip('x')}) END AS parts FROM groups), std AS (SELECT pub_id, {standard_list('parts', False)} AS l FROM every)
 SELECT pub_id, CAST(i - 1 AS INT) AS idx_address, l[i] AS address FROM (SELECT pub_id, l, unnest(generate_series(1, len(l))) AS i FROM std)"""
_AUTHORS_B = f"""WITH {_BRACKETED}, std AS (SELECT pub_id, n, ga, {standard_list('gd', True)} AS s FROM groups WHERE contains(c, '[')),
 pairs AS (SELECT pub_id, n, list_filter(flatten(list_transform(ga, lambda g, k: list_transform(g, lambda a: {{'i': coalesce(list_position(n, a), 0) - 1, 'a': s[k]}}))), lambda e: e.i >= 0) AS p FROM std),
 every AS (SELECT pub_id, list_concat(list_transform(p, lambda e: {{'i': CAST(e.i AS INT), 'a': e.a}}), list_filter(list_transform(n, lambda x, j: CASE WHEN len(list_filter(p, lambda e: e.i = j - 1)) > 0 THEN NULL ELSE {{'i': CAST(j - 1 AS INT), 'a': (j - 1) || '_unknown, Unknown'}} END), lambda x: x IS NOT NULL)) AS l FROM pairs),
 listed AS (SELECT pub_id, e.i AS idx_author, e.a AS address FROM (SELECT pub_id, unnest(l) AS e FROM every))
 SELECT pub_id, idx_author, address, {country(f"{_CHUNKS}[-1]")} AS country FROM listed UNION ALL SELECT pub_id, 0, 'unknown', 'unknown' FROM groups WHERE NOT contains(c, '[')"""
_HELD = "len(list_filter(b, lambda y: contains(x.r, y) AND trim(y) <> ''))"
_AUTHORS_A = f"""WITH {_CELLS_A}, each AS (SELECT pub_id, b, u, unnest(a) AS x FROM numbered),
 own AS (SELECT pub_id, x.i AS i, list_filter(list_transform(u, lambda z, j: CASE WHEN contains(x.r, b[j]) AND trim(b[j]) <> '' THEN z END), lambda z: z IS NOT NULL) AS o FROM each),
 listed AS (SELECT pub_id, CAST(i AS INT) AS idx_author, unnest(CASE WHEN len(o) > 0 THEN o ELSE [i || '_unknown, Unknown'] END) AS address FROM own)
 SELECT pub_id, idx_author, address, {country(f"{_CHUNKS}[-1]")} AS country FROM listed"""


def _references(column: str) -> str:
    """Citations of the first source."""
    pick = lambda p, g=0: f"nullif(regexp_extract(r, {q(p)}, {g}), '')"
    new = pick(r",\s([^,]*,\s+\d+,)", 1)
    titled = pick(r"(\(\d{4}\)\s+[^,]*,|\(\d{4}\)\s+[^,]*$)", 1)
    vol = pick(r"(,\s+\d{1,6},|,\s+\d{1,6}\s\(|,\s+\d{1,6}$)", 1)
    page = lambda p: f"string_split({pick(p)}, 'p.')[2]"
    word = r"\s+[p]{1,2}\.\s+[a-zA-Z0-9]{1,9}"
    return f"""WITH cut AS (SELECT pub_id, ltrim(unnest(string_split(coalesce({column}, 'unknown'), ';'))) AS r FROM scopus_rawdata), listed AS (SELECT *, regexp_matches(r, '\\(\\d{{4}}\\)(\\s)?$') AS recent FROM cut WHERE trim(r) <> ''),
 read AS (SELECT pub_id, CASE WHEN recent THEN {pick('^[^,0-9:]*,')} ELSE {pick('^[^,0-9:]*,[^,0-9:]*,')} END AS a, {pick(r"\((\d{4})\)", 1)} AS y,
  CASE WHEN recent THEN string_split({new}, ',')[1] ELSE coalesce({pick('[Pp]roceedings.*')}, regexp_replace(substr({titled}, 7), ',$', '')) END AS j,
  CASE WHEN recent THEN string_split({new}, ',')[2] ELSE nullif(regexp_extract(coalesce({vol}, ''), '\\d{{1,6}}'), '') END AS v, CASE WHEN recent THEN {page(word + '-[a-zA-Z0-9]{1,9}')} ELSE {page(word)} END AS p FROM listed)
 SELECT pub_id, CASE WHEN a IS NULL OR j IS NULL THEN 'partial' ELSE {name('a')} END AS author, coalesce(y, '0') AS year, coalesce({strip('j')}, 'unknown') AS journal, coalesce({strip('v')}, '0') AS volume, coalesce({strip('p')}, '0') AS page FROM read"""


def _references_tagged() -> str:
    """Citations of the second source, made from the articles."""
    cite = "concat_ws(', ', regexp_replace(authors, ',', '', 'g'), CAST(year AS VARCHAR), upper(regexp_replace(journal, '[^A-Za-z ]', '', 'g')), 'V' || volume, 'P' || page)"
    pick = lambda p, g=0: f"nullif(regexp_extract(r, {q(p)}, {g}), '')"
    digits = lambda p: f"nullif(regexp_extract(coalesce({pick(p)}, ''), '\\d+'), '')"
    journal_ = r"[A-Z]{2}[0-9A-Z&\s\-.\[\]]+"
    return f"""WITH cut AS (SELECT pub_id, ltrim(unnest(string_split({cite}, ';'))) AS r FROM articles), listed AS (SELECT * FROM cut WHERE trim(r) <> ''),
 read AS (SELECT pub_id, regexp_replace({pick('^[^,0-9:]*,')}, ',$', '') AS a, {pick(r",\s(\d{4}),", 1)} AS y, {strip(pick(",\\s(" + journal_ + ")(?:,|$)", 1))} AS j, {digits(r",\s+V\d{1,6}")} AS v, {digits(r",\s+P\d{1,6}")} AS p FROM listed)
 SELECT pub_id, {name('a')} AS author, coalesce(y, '0') AS year, j AS journal, coalesce(v, '0') AS volume, coalesce(p, '0') AS page FROM read WHERE a IS NOT NULL AND j IS NOT NULL"""


def _success(distinct: bool) -> str:
    bad = "count(DISTINCT CASE WHEN coalesce(author_keywords, '') = '' THEN pub_id END)" if distinct else "count(CASE WHEN coalesce(author_keywords, '') = '' THEN pub_id END)"
    return f"SELECT 'keyword' AS item, round(100 * (1 - {bad} / count(DISTINCT pub_id)), 4) AS success_pct FROM scopus_rawdata"


_FIX, _STANDARD = _fix(), _standard_address()
_SPLIT = f"""SELECT address, array_to_string(list_transform(flatten(list_transform(k, lambda x: string_split_regex(x, ' - | \\| '))), lambda x: {strip('x')}), '|') AS chunks, k[-1] AS country
  FROM (SELECT address, list_filter(l, lambda x, i: NOT list_contains(l[i + 1:], x)) AS k FROM (SELECT DISTINCT address, list_transform(string_split(address, ','), lambda x: {strip('x')}) AS l FROM address WHERE address IS NOT NULL))"""

_TOWNS = f"""SELECT country, {strip("replace(replace(translate(lower(town), '-''', '  '), ' lez ', ' les '), 'saint ', 'st ')")} AS town, town AS named FROM (SELECT town, country, row_number() OVER (PARTITION BY town ORDER BY n DESC, country DESC) AS r FROM (
  SELECT town, country, count(*) AS n FROM (SELECT country, unnest(list_distinct(string_split_regex(address, '[^\\pL]+'))) AS town FROM address_inst WHERE address IS NOT NULL AND country IS NOT NULL)
  WHERE town IN (SELECT string_split(canonical, ' ')[1] FROM canonical_values WHERE field_name = 'institution') GROUP BY 1, 2)) WHERE r = 1"""


def _any_word(words: list[str]) -> str:
    return q("(?:^|[^\\pL\\pN_])(?:" + "|".join(sorted({w.replace(".", r"\.") for w in words}, key=len, reverse=True)) + ")(?:[\\s)]|$|\\b)")


def _kept_chunks() -> str:
    """CTEs up to `affs` (address, country, l): the chunks of distinct standardised addresses that name institutions."""
    prefixes, bounded = "|".join(I.KEEP_PREFIX), "|".join(x for x in I.DROP_SUFFIX if x[0] != "-")
    m = lambda pattern: f"regexp_matches(c, {pattern if pattern[0] == chr(39) else q(pattern)})"
    zips = " WHEN country IN " + listed(ZIP_COUNTRIES) + f" THEN {m(ZIP_PLAIN)}"
    return f"""a AS (SELECT DISTINCT address FROM ({_STANDARD})), s1 AS (SELECT address, list_filter(l, lambda x, i: NOT list_contains(l[i + 1:], x)) AS k FROM (SELECT address, list_transform(string_split(address, ','), lambda x: {strip('x')}) AS l FROM a)),
 s2 AS (SELECT address, k[-1] AS country, list_transform(flatten(list_transform(k, lambda x: string_split_regex(x, ' - | \\| '))), lambda x: {strip('x')}) AS chunks FROM s1),
 s3 AS (SELECT address, country, len(chunks) AS n, i - 1 AS i, chunks[i] AS chunk, lower(trim(chunks[i])) AS c FROM (SELECT *, unnest(generate_series(1, len(chunks))) AS i FROM s2)),
 s4 AS (SELECT *, {m(I.BOX)} AS bp, {m(f'\\b(?:{prefixes})-?\\d{{4}}\\b')} AS umr, CASE WHEN country = 'United Kingdom' THEN {m(I.ZIP_UK)} WHEN country IN ('United States', 'Canada') THEN {m(I.ZIP_STATES)}{zips} ELSE false END AS zip,
  country IN {listed(['United Kingdom', 'United States', 'Canada', *ZIP_COUNTRIES])} AS known, {m(I.DIGITS)} AS num, {m(f'(?:\\B(?:{"|".join(I.DROP_SUFFIX)})\\b)|(?:\\b(?:{bounded})\\b)')} AS suffix,
  (country, translate(c, '-''', '  ')) IN (SELECT (country, town) FROM ({_TOWNS})) AS town, {m(_any_word(I.DROP_WORDS_FRANCE))} OR (country <> 'France' AND {m(_any_word(I.DROP_WORDS))}) AS words,
  country = 'France' AND {m(f'\\b(?:{prefixes})[\\s-]?\\d{{3,4}}\\b')} AS prefix, {m(_any_word(I.KEEP_GENERAL))} AS gen, {m(_any_word(I.KEEP_BASIC))} AS basic, {m(_any_word(I.KEEP_USER))} AS usr FROM s3),
 s5 AS (SELECT *, known AND NOT umr AND (zip OR num) AS digits, gen OR basic OR usr AS held, gen OR usr AS strong FROM s4),
 s6 AS (SELECT *, digits AND CASE WHEN country IN ('France', 'Algeria') THEN NOT prefix AND NOT held ELSE NOT strong OR words END AS dstop, NOT town AND NOT suffix AND words AND held AND NOT digits AS wkeep FROM s5),
 s7 AS (SELECT *, NOT town AND NOT suffix AND words AND NOT wkeep AS wstop FROM s6),
 s8 AS (SELECT *, bp OR dstop OR (town AND n - i - 1 <= 2) OR (NOT town AND suffix AND NOT strong) OR wstop AS stop,
  NOT (bp OR digits OR suffix OR town OR words) OR (NOT bp AND NOT dstop AND ((digits AND NOT dstop AND NOT wstop) OR (NOT town AND suffix AND strong) OR wkeep)) AS keep FROM s7),
 s9 AS (SELECT *, min(CASE WHEN i > 0 AND length(c) > 3 AND stop THEN i END) OVER (PARTITION BY address) AS till FROM s8),
 affs AS (SELECT address, country, list(chunk ORDER BY i) FILTER (WHERE (i = 0 OR (length(c) > 3 AND keep AND (till IS NULL OR i <= till))) AND chunk NOT IN (country, 'England', 'Wales', 'North Ireland', 'Scotland', '')) AS l FROM s9 GROUP BY 1, 2)"""


def _symbols(c: str) -> str:
    return translated(c, N.CHUNK_SYMBOLS)


def _alias_words() -> str:
    """CTE `words` (country, norm_aff, w): the sets of words that aliases ask for."""
    text = "alias"
    for word, pattern in N.ADDRESS_WORDS.items():
        text = f"regexp_replace({text}, {q(pattern)}, {q(word + ' ')}, 'g')"
    text = f"lower(regexp_replace(regexp_replace({text}, '\\s+', ' ', 'g'), '\\s,', ',', 'g'))"
    text = strip(translated(_symbols(translated(translated(text, N.DASHES), N.QUOTES)), N.DROPPED_SYMBOLS))
    return f"""towns AS (SELECT country, named FROM ({_TOWNS})), listed AS (SELECT canonical AS norm_aff, string_split(canonical, ' ') AS p FROM canonical_values WHERE field_name = 'institution'),
 aliases AS (SELECT country, norm_aff, unnest(list_distinct([norm_aff, array_to_string(list_concat(p[:-2], [CASE WHEN p[-1] = 'Univ' THEN 'University' ELSE p[-1] END]), ' ')])) AS alias FROM listed JOIN towns ON p[1] = named),
 texts AS (SELECT country, norm_aff, {text} AS t FROM aliases), split AS (SELECT *, list_distinct(string_split(t, ' ')) AS d FROM texts),
 words AS (SELECT country, norm_aff, list_filter(d, lambda x: x <> '' AND x NOT IN {listed(I.SMALL_WORDS)}) AS w FROM split UNION ALL SELECT country, norm_aff, [replace(t, ' ', '')] FROM split WHERE len(d) = 2 AND len(list_filter(d, lambda x: x IN {listed(I.ACRONYMS)})) > 0)"""


_KEPT = _kept_chunks()
_MATCHED = f"""{_KEPT}, {_alias_words()}, each AS (SELECT address, country, i, l[i] AS chunk, list_filter(list_distinct(string_split_regex(lower({_symbols('l[i]')}), '[\\s)]+')), lambda x: x <> '') AS tokens FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM affs)),
 found AS (SELECT DISTINCT address, i, norm_aff FROM each e JOIN words w USING (country) WHERE len(w.w) > 0 AND list_has_all(e.tokens, w.w)),
 norms AS (SELECT address, list(norm_aff ORDER BY level NULLS FIRST, norm_aff) AS l FROM (SELECT DISTINCT address, norm_aff FROM found) LEFT JOIN (VALUES {', '.join(f"({q(t)}, {n})" for t, n in TYPES)}) AS t(kind, level) ON string_split(norm_aff, ' ')[-1] = kind GROUP BY 1),
 named AS (SELECT address, list_filter(l, lambda x: x <> 'Paris-Cité Univ' OR len(list_filter(l, lambda y: contains(y, 'Univ') AND contains(y, 'Paris'))) < 2) AS l FROM norms),
 raws AS (SELECT address, list(CASE WHEN country IN (SELECT country FROM words) THEN {_symbols('chunk')} ELSE chunk END ORDER BY i) AS l FROM each WHERE (address, i) NOT IN (SELECT (address, i) FROM found) GROUP BY 1),
 done AS (SELECT affs.address, affs.country, coalesce(nullif(array_to_string(named.l, '; '), ''), 'empty') AS norm, coalesce(nullif(array_to_string(raws.l, '; '), ''), 'empty') AS raw FROM affs LEFT JOIN named USING (address) LEFT JOIN raws USING (address)),
 rows AS (SELECT DISTINCT pub_id, idx_address, address FROM ({_STANDARD}))"""

_ALL_CHUNKS = (
    _MATCHED.replace(_STANDARD, f"SELECT address FROM ({_AUTHORS_A})", 1).replace("(i = 0 OR (length(c) > 3 AND keep AND (till IS NULL OR i <= till))) AND ", "", 1)
    .replace("array_to_string(named.l, '; ')", "array_to_string(named.l, ';')", 1).replace("array_to_string(raws.l, '; ')", "array_to_string(raws.l, ';')", 1).rsplit(", rows AS (", 1)[0].rstrip().rstrip(",")
)
_AUTHOR_INSTITUTIONS = f"""{_ALL_CHUNKS}, own AS ({_AUTHORS_A}), filled AS (SELECT pub_id, idx_author, o.address, o.country, norm AS n, raw AS r FROM own o LEFT JOIN done USING (address))
 SELECT pub_id, idx_author, array_to_string(list_sort(list(address)), '; ') AS address, array_to_string(list_sort(list(DISTINCT country)), '; ') AS country, array_to_string(list_sort(list(DISTINCT n)), '; ') AS norm_institutions,
  CASE WHEN count(*) > 1 THEN array_to_string(list_filter(list_sort(list(DISTINCT r)), lambda x: x <> 'empty'), '; ') ELSE max(r) END AS raw_institutions FROM filled GROUP BY 1, 2"""

SQL = {
    "exp_author_institutions": f"WITH {_AUTHOR_INSTITUTIONS}",
    "inst_affiliations": f"WITH {_KEPT} SELECT address, country, coalesce(array_to_string(l, '|'), '') AS affiliations FROM affs",
    "inst_words": f"WITH {_alias_words()} SELECT country, norm_aff, array_to_string(list_sort(w), ' ') AS words FROM words",
    "inst_norm": f"WITH {_MATCHED} SELECT pub_id, idx_address, norm AS institution FROM rows JOIN done USING (address)",
    "inst_raw": f"WITH {_MATCHED} SELECT pub_id, idx_address, raw AS institution, address FROM rows JOIN done USING (address)",
    "inst_countries": f"WITH {_MATCHED} SELECT pub_id, idx_address, {country('country')} AS country FROM rows JOIN done USING (address)",
    "flt_valid_affiliations_strict": f"""SELECT eid, coalesce(nullif(array_to_string(list_filter(string_split(affiliations, '; '), lambda x: ({country(strip("string_split(x, ', ')[-1]"))}) <> 'Unknown'), '; '), ''), 'unknown') AS affiliations FROM scopus_rawdata WHERE affiliations IS NOT NULL""",
    "exp_authors": f"""SELECT pub_id, CAST(i - 1 AS INT) AS idx_author, l[i] AS co_author FROM (SELECT pub_id, l, unnest(generate_series(1, len(l))) AS i FROM (
      SELECT pub_id, list_filter(list_transform(string_split(authors, CASE WHEN contains(authors, ';') THEN ';' ELSE ',' END), lambda x: replace(x, '.', '')), lambda x: x NOT IN {listed(SKIPPED_AUTHORS)}) AS l
      FROM (SELECT pub_id, coalesce(authors, 'unknown') AS authors FROM scopus_rawdata)))""",
    "exp_authors_named": f"""SELECT pub_id, CAST(i - 1 AS INT) AS idx_author, {upper_last('n')} AS co_author FROM (SELECT pub_id, i, {name('l[i]')} AS n FROM (SELECT pub_id, l, unnest(generate_series(1, len(l))) AS i FROM (
      SELECT pub_id, list_filter(string_split(coalesce(authors, 'unknown'), ';'), lambda x: x NOT IN {listed(SKIPPED_AUTHORS)}) AS l FROM scopus_rawdata)))""",
    "norm_name": f"SELECT pub_id, {name('authors')} AS author FROM articles WHERE authors IS NOT NULL",
    "first_author": f"SELECT eid, {upper_last('n')} AS author FROM (SELECT eid, {name('a')} AS n FROM (SELECT eid, string_split(authors, CASE WHEN contains(authors, ';') THEN ';' ELSE ',' END)[1] AS a FROM scopus_rawdata WHERE authors IS NOT NULL))",
    "exp_addresses": f"{_ALL_A} SELECT * FROM rows",
    "exp_address_countries": f"{_ALL_A} SELECT pub_id, idx_address, {country(f'{_CHUNKS}[-1]')} AS country FROM rows",
    "exp_address_institutions": f"{_ALL_A} SELECT pub_id, idx_address, coalesce(list_filter({_CHUNKS}, lambda x: x <> '')[1], '') AS institution FROM rows",
    "exp_author_addresses": _AUTHORS_A,
    "exp_addresses_bracketed": _ADDRESSES_B,
    "exp_author_addresses_bracketed": _AUTHORS_B,
    "exp_references": _references("cited_refs"),
    "exp_references_tagged": _references_tagged(),
    "exp_author_keywords": KEYWORDS.format(c="author_keywords", strip=strip("lower(r)")),
    "exp_index_keywords": KEYWORDS.format(c="index_keywords", strip=strip("lower(r)")),
    "exp_parted": f"SELECT * FROM (SELECT pub_id, {strip('r')} AS subject FROM (SELECT pub_id, unnest(string_split(index_keywords, ';')) AS r FROM scopus_rawdata WHERE index_keywords IS NOT NULL)) WHERE subject <> ''",
    "sort_items": "SELECT * FROM address ORDER BY pub_id, idx_address",
    "sort_authors": "SELECT * FROM address_inst ORDER BY pub_id, idx_author",
    "sort_frequency": f"SELECT keyword, count(*) AS n FROM ({TITLE_WORDS}) GROUP BY 1 ORDER BY 2 DESC, 1",
    "top_first_author": f"SELECT eid, l[1] AS author FROM (SELECT eid, list_filter(list_transform(string_split(a, CASE WHEN contains(a, ';') THEN ';' ELSE ',' END), lambda x: replace(x, '.', '')), lambda x: x NOT IN {listed(SKIPPED_AUTHORS)}) AS l FROM (SELECT eid, coalesce(authors, 'unknown') AS a FROM scopus_rawdata)) WHERE len(l) > 0",
    "flt_valid_affiliations": "SELECT eid, coalesce(nullif(affiliations, ''), 'unknown') AS affiliations FROM scopus_rawdata WHERE affiliations IS NOT NULL",
    "fix_separators": _FIX,
    "std_address": _STANDARD,
    "inst_split": _SPLIT,
    "norm_issn": "SELECT pub_id, CASE WHEN d = '' THEN 'unknown' ELSE substr(d, 1, 4) || '-' || substr(d, 5) END AS issn FROM (SELECT pub_id, array_to_string(regexp_extract_all(issn, '^\\d{8}|\\d{4}|\\d{3}X'), '') AS d FROM articles WHERE issn IS NOT NULL)",
    "norm_year": "SELECT pub_id, coalesce(year, 0) AS year FROM articles WHERE year IS NOT NULL",
    "norm_year_text": "SELECT pub_id, coalesce(TRY_CAST(trunc(TRY_CAST(volume AS DOUBLE)) AS INT), 0) AS number FROM articles WHERE volume IS NOT NULL",
    "norm_journal": f"SELECT pub_id, {journal('journal')} AS journal FROM articles WHERE journal IS NOT NULL",
    "norm_type": f"SELECT pub_id, {doc_type('document_type', False)} AS document_type FROM articles WHERE document_type IS NOT NULL",
    "norm_type_lower": f"SELECT pub_id, {doc_type('document_type', True)} AS document_type FROM articles WHERE document_type IS NOT NULL",
    "norm_title": f"SELECT pub_id, {translated(translated(translated('title', N.DASHES), N.LANGUAGE_LETTERS), N.PUNCTUATION)} AS title FROM articles WHERE title IS NOT NULL",
    "norm_country": f"SELECT pub_id, idx_address, {country('country')} AS country FROM country WHERE country IS NOT NULL",
    "norm_town": f"SELECT pub_id, idx_author, {strip(_TOWN)} AS town FROM address_inst WHERE norm_institutions IS NOT NULL",
    "str_ascii": f"SELECT pub_id, {ascii_sql('title')} AS title FROM articles WHERE title IS NOT NULL",
    "str_standard": f"SELECT pub_id, idx_address, {standard('address')} AS address FROM address WHERE address IS NOT NULL",
    "unknown_address": "SELECT pub_id, idx_address || '_unknown, Unknown' AS address FROM address WHERE idx_address IS NOT NULL",
    "agg_success": _success(True),
    "agg_success_rows": _success(False),
    "agg_failed": "SELECT DISTINCT 'keyword' AS item, pub_id FROM scopus_rawdata WHERE coalesce(author_keywords, '') = ''",
    "flt_empty": "SELECT pub_id, author_keywords AS keyword FROM scopus_rawdata WHERE author_keywords <> ''",
    "agg_author_institutions": f"""SELECT pub_id, idx_author, array_to_string(list_sort(list(address)), '; ') AS address, array_to_string(list_sort(list(DISTINCT country)), '; ') AS country,
      array_to_string(list_sort(list(DISTINCT n)), '; ') AS norm_institutions, CASE WHEN count(*) > 1 THEN array_to_string(list_filter(list_sort(list(DISTINCT r)), lambda x: x <> 'empty'), '; ') ELSE max(r) END AS raw_institutions
      FROM ({FILLED}) GROUP BY 1, 2""",
    "agg_title_keywords": f"WITH w AS ({TITLE_WORDS}) SELECT DISTINCT pub_id, keyword FROM w WHERE keyword IN (SELECT keyword FROM w GROUP BY 1 HAVING count(*) >= 3)",
    "agg_word_counts": f"SELECT keyword, count(*) AS n FROM ({TITLE_WORDS}) GROUP BY 1",
    "agg_first_known": f"""SELECT norm_journal, {known('issn', 'pub_id')} AS issn, {known('authors', 'pub_id', True)} AS longest_author
      FROM (SELECT pub_id, coalesce(norm_journal, 'unknown') AS norm_journal, coalesce(issn, 'unknown') AS issn, coalesce(authors, 'unknown') AS authors FROM articles) GROUP BY 1""",
    "agg_wrong_types": f"""SELECT country, array_to_string(list_sort(list(DISTINCT t)), ',') AS types FROM (SELECT country, string_split(trim(norm_institutions), ' ')[-1] AS t FROM address_inst
      WHERE norm_institutions IS NOT NULL AND country IS NOT NULL) WHERE t NOT IN {_TYPES} GROUP BY 1""",
    "dedup_issn": f"WITH s0 AS ({PREPARED}) SELECT pub_id, issn FROM ({overwrite('s0', 'same_journal', 'issn', 'pub_id')})",
    "dedup_doi_by_title": f"WITH s0 AS ({PREPARED}) SELECT pub_id, doi FROM ({overwrite('s0', 'title_lc', 'doi', 'same_journal, pub_id')})",
    "dedup_type": f"WITH s0 AS ({PREPARED}), k0 AS (SELECT * FROM s0 WHERE doi <> 'unknown') SELECT pub_id, document_type FROM ({overwrite('k0', 'doi', 'document_type', 'title_lc, same_journal, pub_id')}) UNION ALL SELECT pub_id, document_type FROM s0 WHERE doi = 'unknown'",
    "dedup_type_compat": f"WITH s0 AS ({PREPARED}) SELECT pub_id, document_type FROM ({overwrite('s0', 'doi', 'document_type', 'title_lc, same_journal, pub_id')})",
    "dedup_cascade": CASCADE,
    "dedup_dropped_ids": f"SELECT pub_id FROM articles WHERE pub_id NOT IN (SELECT pub_id FROM ({CASCADE}))",
    "dedup_items": f"SELECT * FROM address WHERE pub_id NOT IN (SELECT pub_id FROM articles WHERE pub_id NOT IN (SELECT pub_id FROM ({CASCADE})))",
    "set_concat": "SELECT pub_id, title, doi FROM articles UNION ALL SELECT CAST(substr(ut, 5) AS BIGINT) + (SELECT max(pub_id) + 1 FROM articles), title, doi FROM wos_articles",
    "set_concat_items": f"""WITH o AS (SELECT max(pub_id) + 1 AS o FROM articles), k AS ({KEYWORDS.format(c="author_keywords", strip=strip("lower(r)"))})
      SELECT 'articles' AS item, pub_id, title AS value FROM articles UNION ALL SELECT 'articles', pub_id + o, title FROM scopus_rawdata, o UNION ALL SELECT 'keywords', pub_id, keyword FROM k WHERE pub_id % 2 = 0 UNION ALL SELECT 'keywords', pub_id + o, keyword FROM k, o
      UNION ALL SELECT 'addresses', pub_id, concat_ws(' ', idx_address, address) FROM address UNION ALL SELECT 'addresses', pub_id + o, concat_ws(' ', 0, affiliations) FROM scopus_rawdata, o""",
    "set_difference": "SELECT pub_id FROM articles WHERE pub_id NOT IN (SELECT pub_id FROM scopus_rawdata WHERE pub_id IS NOT NULL)",
    "flt_drop_listed": "SELECT eid, pub_id FROM scopus_rawdata r WHERE NOT EXISTS (SELECT 1 FROM article_groups g WHERE g.pub_id = r.pub_id)",
    "fill_unknown": "SELECT pub_id, coalesce(journal, 'unknown') AS journal, coalesce(doi, 'unknown') AS doi, coalesce(issn, 'unknown') AS issn, coalesce(volume, 'unknown') AS volume FROM articles",
    "pivot_flags": "SELECT *, CAST(coalesce(contains(norm_institutions, 'Univ'), false) AS INT) AS is_univ, CAST(coalesce(contains(norm_institutions, 'Rto'), false) AS INT) AS is_rto FROM address_inst",
    "join_subjects": f"""SELECT DISTINCT pub_id, replace(category, 'General', '') AS subject FROM (SELECT pub_id, CAST(unnest(codes) // 100 * 100 AS INT) AS code FROM ({_CODED})) JOIN (SELECT * FROM {_CODES}) USING (code) WHERE replace(category, 'General', '') <> ''""",
    "join_sub_subjects": f"SELECT DISTINCT pub_id, category AS sub_subject FROM (SELECT pub_id, unnest(codes) AS code FROM ({_CODED})) JOIN (SELECT * FROM {_CODES}) USING (code)",
}
