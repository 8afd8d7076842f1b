"""Problem 3: several values packed in one field.

Method: segmentation by expectation-maximisation. Unmistakable separators outside quoted spans cut a cell into pieces at once.
Commas may separate or belong to a value: a cell without any unmistakable separator becomes a lattice of its comma-parted
atoms, quoted spans staying whole. The value frequencies of the whole column and the distribution of the number of commas in
a value are learned from the cells cut so far; the Viterbi path chooses the likeliest split of each lattice; both steps repeat.

Only the hashes of values that several cells may hold are kept, with their count among the settled cells and the first solution. Later
rounds read the counts that have changed since and solve the lattices in which these may matter. Rounds end when no path changes. The
comma distribution (at most COMMAS + 1 numbers a field) is all that reaches the driver; it also says how many atoms a value may join at most.

Defined cases: a NULL or blank cell gives no row; blank values count for nothing and take no position; a quote without its
partner is an ordinary character; a record delivered several times counts once, in its earliest delivery; texts of any length
are cut whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folia.runtime import release, store

COMMAS = 40  # longer values share the last class
ROUNDS = 50  # only guards against paths that never settle
NEW_VALUE, NEW_CHAR, KNOWN = -2.3, -1.5, 0.9  # log cost of a new value and of each of its characters; weight of known values
NEW = math.log(1 - KNOWN)
SLACK = 1e-2  # far above the rounding errors of scores and of floats
_QUOTED = r'"(?:[^"]|"")*"'
_PIECE = re.compile(rf'(?:{_QUOTED}|[^;；|•·‖¦\t\r\n"/]+|(?<!\s/)(?<!^/)(?!//(?:\s|$))/|")+')
_ATOM = re.compile(rf'(?:{_QUOTED}|[^,"]+|")+')
_SPAN = re.compile(_QUOTED)
_WHOLE = re.compile(r'"((?:[^"]|"")*)"', re.S)
_ALL_QUOTED = re.compile(rf"{_QUOTED}(?:\s*,\s*{_QUOTED})*\s*,?", re.S)


def clean(value: str) -> str:
    """A value without outer blanks and without quotes around the whole of it; doubled quotes inside such quotes become single."""
    value = value.strip()
    whole = _WHOLE.fullmatch(value) if value[:1] == '"' else None
    return whole[1].replace('""', '"').strip() if whole else value


def pieces(cell: str) -> list[str]:
    """Parts of a cell between unmistakable separators outside quotes."""
    return [x for p in _PIECE.findall(cell) if (x := p.strip())]


def read_cell(cell: str | None) -> tuple[list[str], list[str]]:
    """(values, atoms): the values of a cell that is beyond doubt, else the comma-parted atoms of its lattice."""
    parts = pieces(cell or "")
    if len(parts) == 1:
        only = parts[0]
        if _ALL_QUOTED.fullmatch(only):  # every value is quoted, so every comma outside quotes separates
            parts = _SPAN.findall(only)
        elif "," in only and "," in _SPAN.sub("", only):
            return [], [x for x in _ATOM.findall(only) if x.strip()]
    return [x for p in parts if (x := clean(p))], []


def spans(atoms: list[str], longest: int) -> list[tuple[int, int, str]]:
    """Values that neighbouring atoms may form: (first atom, last atom, value), of at most `longest` commas between atoms, or the whole cell."""
    n = len(atoms)
    return [(i, j, clean(",".join(atoms[i : j + 1]))) for i in range(n) for j in range(i, n) if j - i <= longest or (i == 0 and j == n - 1)]


def read_records(raw: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """(key, field_name, values, atoms) of each record once, in its earliest delivery."""
    picked = raw.select(key, order, *columns).filter(F.col(key).isNotNull())
    sorted_rows = picked.repartition(key).sortWithinPartitions(key, order, F.xxhash64(*columns)).select(key, *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for k, *cells in b.itertuples(index=False, name=None):
                if k != last:
                    out += [(k, c, *read_cell(x)) for c, x in zip(columns, cells, strict=True) if isinstance(x, str)]
                last = k
            yield pd.DataFrame(out, columns=["k", "field_name", "values", "atoms"])

    kind = dict(raw.dtypes)[key]
    return sorted_rows.mapInPandas(run, f"k {kind}, field_name string, values array<string>, atoms array<string>").withColumnRenamed("k", key)


def unpack(raw: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """(key, field_name, pos, item): the values of every cell in order, pos counting from 0."""
    records = store(read_records(raw, key, columns, order).withColumn("cell", F.monotonically_increasing_id()))
    settled = records.filter(F.size("atoms") == 0).select(key, "field_name", "values")
    lattices = records.filter(F.size("atoms") > 0).select(key, "field_name", "cell", "atoms")
    solved = settle(lattices, settled.select("field_name", F.explode("values").alias("v")), key)
    return settled.unionByName(solved.select(key, "field_name", "values")).select(key, "field_name", F.posexplode("values").alias("pos", "item"))


Spread = dict[str, tuple[dict[int, int], int]]  # by field: number of values by number of commas, number of values


def settle(lattices: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """lattices (key, field_name, cell, atoms) to their likeliest values, by expectation-maximisation from the settled values (field_name, v).

    Two rounds read every lattice, the second with the comma distribution of all values; it also tells by how much each path leads. From then
    on a round takes the counts that differ from those of the second and solves only lattices in which they may outweigh the lead; all
    others keep their path. Rounds end when no path changes.
    """
    spread = _comma_counts(values)
    longest = {f: max(k) for f, (k, _) in spread.items()}
    hashes = F.transform(_span_values(longest)("field_name", "atoms"), lambda v: F.xxhash64("field_name", v))
    # a value that only one cell may hold, and no settled one holds, is new in every round
    may = lattices.select("cell", F.posexplode(hashes).alias("at", "h")).repartition("h")
    known = values.select(F.xxhash64("field_name", "v").alias("h")).groupBy("h").agg(F.count("*").alias("n0"))
    # in two places; asked of the columns that are needed below anyway, so that the spans are made and shuffled once
    twice = may.groupBy("h").agg(((F.min("cell") != F.max("cell")) | (F.min("at") != F.max("at"))).alias("twice"))
    several = twice.join(known, "h", "left").filter("twice or n0 is not null")
    met = store(may.join(several.select("h", F.coalesce("n0", F.lit(0)).alias("n")), "h").select("cell", "at", "h", "n"))

    path = _path_udf(spread, longest)
    ready = _with_counts(lattices, met.filter("n > 0"))
    first = store(ready.select(*lattices.columns, path("field_name", "atoms", "ats", "ns").alias("first")))
    added = first.select("field_name", F.explode("first").alias("v"))
    spread = _added(spread, _comma_counts(added))
    path = _path_udf(spread, longest)
    more = added.select(F.xxhash64("field_name", "v").alias("h")).groupBy("h").agg(F.count("*").alias("d"))
    counted = met.join(more, "h", "left").select("cell", "at", "h", (F.col("n") + F.coalesce("d", F.lit(0))).alias("n"))
    ready = _with_counts(first, counted).withColumn("best", _lead_udf(spread, longest)("field_name", "atoms", "ats", "ns"))
    base = store(ready.select(*first.columns, "ats", "hs", "ns", "best.values", "best.lead", "best.gaps", "best.weights"))
    release(first)
    release(met)

    start = store(_moves(base.filter("values != first").select("field_name", F.col("first").alias("old"), F.col("values").alias("new"))))
    moved, other, mark = start, None, (0, None)
    for _ in range(ROUNDS):
        open_ = store(_open(base, moved))
        now = F.concat("ats", "more_ats"), F.concat("ns", "more_ns")
        again = base.join(open_, "cell").select("cell", "field_name", "values", path("field_name", "atoms", *now).alias("new"))
        found = store(again.filter("values != new"))
        release(open_)
        last, mark = mark, tuple(found.agg(F.count("*"), F.bit_xor(F.xxhash64("cell", "new"))).first())
        if mark == last:
            release(found)
            break
        for old in (moved, other):
            if old is not None and old is not start:
                release(old)
        other = found
        moved = store(start.unionByName(_moves(found.select("field_name", F.col("values").alias("old"), "new"))).groupBy("h").agg(F.sum("d").alias("d")).filter("d != 0"))
    else:
        warnings.warn(f"paths still change after {ROUNDS} rounds", stacklevel=2)
    if other is None:
        return base
    return base.join(other.select("cell", "new"), "cell", "left").select(key, "field_name", F.coalesce("new", "values").alias("values"))


def _with_counts(cells: DataFrame, met: DataFrame) -> DataFrame:
    """cells with what met (cell, at, h, n) has of them: numbers, hashes and counts of their spans."""
    found = met.groupBy("cell").agg(*(F.collect_list(c).alias(f"{c}s") for c in ("at", "h", "n")))
    return cells.join(found, "cell", "left")


def _moves(paths: DataFrame) -> DataFrame:
    """(h, d): by how much the counts change if the values `old` of paths (field_name, old, new) become `new`."""
    less, more = (paths.select(F.explode(c).alias("v"), "field_name", F.lit(d).alias("d")) for c, d in (("old", -1), ("new", 1)))
    return less.unionByName(more).select(F.xxhash64("field_name", "v").alias("h"), "d").groupBy("h").agg(F.sum("d").alias("d")).filter("d != 0")


def _open(base: DataFrame, moved: DataFrame) -> DataFrame:
    """(cell, more_ats, more_ns): the cells of base whose path may not stay when the counts change by moved (h, d), with their changed counts.

    The score of a span of weight w changes by ln(1 + d / w). The path may lose what its own spans lose, another one may win what others
    win; one that wins anything uses a span that has become better, so it starts from that span's gap or more.
    """
    parts = {"ats": "at", "hs": "h", "ns": "n", "gaps": "gap", "weights": "w"}
    met = base.select("cell", "lead", F.explode(F.arrays_zip(*parts)).alias("m")).select("cell", "lead", *(F.col(f"m.{a}").alias(b) for a, b in parts.items()))
    d, w, own = F.col("d"), F.col("w").cast("double"), F.col("gap").isNull()
    change = F.when(w > 0, F.coalesce(F.abs(F.log1p(d / w)), F.lit(math.inf))).otherwise(F.lit(math.inf))
    lost, won = F.when(own & (d < 0), change).otherwise(F.lit(0.0)), F.when(~own & (d > 0), change).otherwise(F.lit(0.0))
    hit = met.join(moved, "h").select("cell", "lead", "at", (F.col("n") + d).alias("now"), lost.alias("lost"), won.alias("won"), F.when(d > 0, F.col("gap")).alias("gap"))
    by_cell = hit.groupBy("cell").agg(F.collect_list("at").alias("more_ats"), F.collect_list("now").alias("more_ns"), F.sum("lost").alias("lost"), F.sum("won").alias("won"), F.first("lead").alias("lead"), F.min("gap").alias("gap"))
    lost, won = F.col("lost") + SLACK, F.col("won")
    return by_cell.filter((lost >= F.col("lead")) | (lost + won >= F.coalesce("gap", F.lit(math.inf)))).select("cell", "more_ats", "more_ns")


def _span_values(longest: dict[str, int]):
    @F.pandas_udf(ArrayType(StringType()))
    def run(field: pd.Series, atoms: pd.Series) -> pd.Series:
        return pd.Series([[v for _, _, v in spans(list(a), longest.get(f, len(a)))] for f, a in zip(field, atoms, strict=True)], dtype=object)

    return run


def _comma_counts(values: DataFrame) -> Spread:
    """By field: how many values have so many commas, the longest ones in the class of the most that any has."""
    c = F.length("v") - F.length(F.replace("v", F.lit(","), F.lit("")))
    out: Spread = {}
    for f, k, n in values.groupBy("field_name", F.least(c, F.lit(COMMAS)).alias("k")).agg(F.count("*"), F.max(c).alias("m")).select("field_name", F.when(F.col("k") < COMMAS, F.col("k")).otherwise(F.col("m")), "count(1)").collect():  # at most COMMAS + 1 rows a field
        counts, total = out.get(f, ({}, 0))
        out[f] = (counts | {k: n}, total + n)
    return out


def _added(a: Spread, b: Spread) -> Spread:
    out = {}
    for f in a.keys() | b.keys():
        (x, m), (y, n) = a.get(f, ({}, 0)), b.get(f, ({}, 0))
        out[f] = ({k: x.get(k, 0) + y.get(k, 0) for k in x.keys() | y.keys()}, m + n)
    return out


def _comma_prior(spread: Spread) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Log probability of the number of commas in a value, and the number of values, by field."""
    prior = {}
    for f, (counts, _) in spread.items():
        p = np.full(COMMAS + 1, 0.5)
        for k, n in counts.items():
            p[min(k, COMMAS)] += n
        prior[f] = np.log(p / p.sum())
    return prior, {f: float(n) for f, (_, n) in spread.items()}


Into = list[list[tuple[int, float]]]  # by last atom: first atom and score of each span


def _lengths(atoms: list[str], longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(first atom, last atom, length, commas) of each of spans(atoms); without quotes all of it follows from the atoms."""
    if any('"' in a for a in atoms):
        yield from ((i, j, len(v), v.count(",")) for i, j, v in spans(atoms, longest))
        return
    n = len(atoms)
    ends = list(itertools.accumulate((len(a) + 1 for a in atoms), initial=0))
    starts = [e + len(a) - len(a.lstrip()) for e, a in zip(ends, atoms, strict=False)]
    stops = [e + len(a.rstrip()) for e, a in zip(ends, atoms, strict=False)]
    for i in range(n):
        for j in range(i, min(n, i + longest + 1)):
            yield i, j, stops[j] - starts[i], j - i
        if i == 0 and longest < n - 1:
            yield 0, n - 1, stops[-1] - starts[0], n - 1


def _scored(atoms: list[str], times: dict[int, int], costs: list[float], total: float, longest: int) -> Into:
    into: Into = [[] for _ in atoms]
    for k, (i, j, size, commas) in enumerate(_lengths(atoms, longest)):
        met = times.get(k, 0)
        new = NEW + NEW_VALUE + NEW_CHAR * size + costs[commas if commas < COMMAS else COMMAS]
        into[j].append((i, math.log(KNOWN * met / total + math.exp(max(new, -700.0))) if met else new))
    return into


def _forward(into: Into) -> tuple[list[float], list[int]]:
    """Of the best path to each place: its score, and the first atom of its last span."""
    n = len(into)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(n):
        for i, s in into[j]:
            if score[i] + s > score[j + 1]:
                score[j + 1], back[j + 1] = score[i] + s, i
    return score, back


def _values(atoms: list[str], back: list[int]) -> list[str]:
    out, j = [], len(atoms)
    while j:
        out.append(clean(",".join(atoms[back[j] : j])))
        j = back[j]
    return [x for x in out[::-1] if x]


def best_path(atoms: list[str], times: dict[int, int], costs: list[float], total: float, longest: int) -> list[str]:
    """The likeliest split of a lattice; times: how often spans(atoms), by their number, are met as values of their own."""
    return _values(atoms, _forward(_scored(atoms, times, costs, total, longest))[1])


_by_start = operator.itemgetter(0, 1)


def best_and_lead(atoms: list[str], times: dict[int, int], costs: list[float], total: float, longest: int) -> tuple[list[str], float, list[float | None], list[float]]:
    """The likeliest split and by how much its score exceeds that of any other; for the spans of `times` by how much it exceeds the best
    split with that span (None: the span is part of it), and their weights, in which their scores are ln(KNOWN * weight / total) (0: none).
    """
    into, n = _scored(atoms, times, costs, total, longest), len(atoms)
    score, back = _forward(into)
    rest = [-math.inf] * n + [0.0]
    for j in range(n - 1, -1, -1):
        for i, s in into[j]:
            if s + rest[j + 1] > rest[i]:
                rest[i] = s + rest[j + 1]
    on, j = set(), n
    while j:
        on.add((back[j], j - 1))
        j = back[j]
    best, second, numbered = score[n], -math.inf, []  # type: float, float, list
    for j, ends in enumerate(into):
        for i, s in ends:
            gap = None
            if (i, j) not in on:
                through = score[i] + s + rest[j + 1]
                gap, second = best - through, max(second, through)
            numbered.append((i, j, gap, s))
    numbered.sort(key=_by_start)  # as in spans()
    met = [numbered[k] for k in times]
    gaps, unit = [x[2] for x in met], total / KNOWN
    weights = [math.exp(x[3]) * unit if x[3] > -80 else 0.0 for x in met]  # smaller ones are none as floats
    return _values(atoms, back), best - second, gaps, weights


def _solver(spread: Spread, longest: dict[str, int], solve):
    """Calls `solve` for columns of lattices; where a span is numbered twice, the later count holds."""
    prior, totals = _comma_prior(spread)
    known, flat = {f: p.tolist() for f, p in prior.items()}, np.log(np.full(COMMAS + 1, 1 / (COMMAS + 1))).tolist()

    def run(field: pd.Series, atoms: pd.Series, ats: pd.Series, ns: pd.Series) -> list:
        out = []
        for f, a, at, n in zip(field, atoms, ats, ns, strict=True):
            times = {} if at is None else dict(zip(at.tolist(), n.tolist(), strict=True))
            out.append(solve(list(a), times, known.get(f, flat), totals.get(f, 1.0), longest.get(f, len(a))))
        return out

    return run


def _path_udf(spread: Spread, longest: dict[str, int]):
    run = _solver(spread, longest, best_path)

    @F.pandas_udf(ArrayType(StringType()))
    def path(field: pd.Series, atoms: pd.Series, ats: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series(run(field, atoms, ats, ns), dtype=object)

    return path


def _lead_udf(spread: Spread, longest: dict[str, int]):
    run = _solver(spread, longest, best_and_lead)

    @F.pandas_udf("values array<string>, lead double, gaps array<float>, weights array<float>")
    def lead(field: pd.Series, atoms: pd.Series, ats: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(run(field, atoms, ats, ns), columns=["values", "lead", "gaps", "weights"])

    return lead
