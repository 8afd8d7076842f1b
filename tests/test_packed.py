from __future__ import annotations

import itertools
from collections import Counter

import numpy as np

from folia.operators import packed

SCHEMA = "eid string, loaded_at int, kw string, other string"


def items(spark, rows):
    out = packed.unpack(spark.createDataFrame(rows, SCHEMA), "eid", ["kw"], "loaded_at").collect()
    got: dict[str, dict[int, str]] = {}
    for r in out:
        got.setdefault(r["eid"], {})[r["pos"]] = r["item"]
    return {k: [v[i] for i in sorted(v)] for k, v in got.items() if sorted(v) == list(range(len(v)))}


def test_read_cell():
    assert packed.read_cell('a; "b; ""c"""; ;d') == (["a", 'b; "c"', "d"], [])
    assert packed.read_cell("// x, y // http://z/a //")[0] == ["x, y", "http://z/a"]
    assert packed.read_cell('"a, b","c"')[0] == ["a, b", "c"]
    assert packed.read_cell('say "hi; there" now; b')[0] == ['say "hi; there" now', "b"]
    assert packed.read_cell('5" pipe; b')[0] == ['5" pipe', "b"]
    assert packed.read_cell(None) == packed.read_cell("") == packed.read_cell(" ; ;") == ([], [])
    assert packed.read_cell("a, b") == ([], ["a", " b"])


def test_commas_are_settled_by_the_column(spark):
    rows = [(f"s{i}", 1, "alpha; beta; gamma ray; lakes, shallow", "x") for i in range(20)]
    rows += [("one", 1, "alpha, gamma ray, new thing", "x"), ("two", 1, "lakes, shallow", "x"), ("three", 1, 'beta,"a; b",alpha', "x")]
    got = items(spark, rows)
    assert got["one"] == ["alpha", "gamma ray", "new thing"]
    assert got["two"] == ["lakes, shallow"]
    assert got["three"] == ["beta", "a; b", "alpha"]


def test_values_join_as_many_atoms_as_values_of_the_column_do(spark):
    a, b = "Dept of Physics, Univ A, Lyon, France", "Dept of Chemistry, Univ B, Paris, France"
    rows = [(f"s{i}", 1, f"Dept {i}, Univ {i % 3}, Town {i % 5}, France; {a}; {b}", "x") for i in range(20)]
    rows += [("open", 1, f"{a}, {b}", "x"), ("new", 1, f"{b}, Dept of Art, Univ C, Rome, Italy", "x"), ("three", 1, f"{a}, {b}, {a}", "x")]
    got = items(spark, rows)
    assert got["open"] == [a, b] and got["three"] == [a, b, a]
    assert got["new"] == [b, "Dept of Art, Univ C, Rome, Italy"]


def test_edges_of_input(spark):
    long = "; ".join(f"word {i}" for i in range(5000))
    rows = [("n", 1, None, None), ("e", 1, "  ", None), ("d", 2, "later", None), ("d", 1, "first; second", None), (None, 1, "a", None), ("l", 1, long, None), ("d", 1, "first; second", None)]
    got = items(spark, rows)
    assert got["d"] == ["first", "second"]
    assert len(got["l"]) == 5000
    assert set(got) == {"d", "l"}
    assert items(spark, []) == {}


def test_best_path_is_the_best_of_all_splits():
    rng = np.random.default_rng(3)
    costs = np.log(np.r_[0.8, 0.15, np.full(packed.COMMAS - 1, 0.05 / (packed.COMMAS - 1))])
    for _ in range(40):
        atoms = [str(rng.choice(["a", "bb", "ccc", "dd"])) for _ in range(int(rng.integers(1, 6)))]
        spans = packed.spans(atoms, 9)
        times = [int(rng.integers(0, 3)) * int(rng.integers(0, 50)) for _ in spans]
        value = {}
        for (i, j, v), n in zip(spans, times, strict=True):
            new = (1 - packed.KNOWN) * np.exp(packed.NEW_VALUE + packed.NEW_CHAR * len(v) + costs[v.count(",")])
            value[i, j] = np.log(packed.KNOWN * n / 100 + new)
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(atoms) - 1):
            ends = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(atoms)]
            parts = [(x, y - 1) for x, y in itertools.pairwise(ends)]
            if all(p in value for p in parts):
                best = max(best, sum(value[p] for p in parts))
        got = packed.best_path(atoms, dict(enumerate(times)), costs, 100.0, 9)
        k, total = 0, 0.0
        for v in got:
            n = v.count(",") + 1
            total += value[k, k + n - 1]
            k += n
        assert k == len(atoms) and abs(total - best) < 1e-9


def plain_rounds(column):
    """Expectation-maximisation that solves every lattice in every round; also how many rounds changed a path."""
    cells = [packed.read_cell(x) for x in column]
    settled, open_ = [v for values, _ in cells for v in values], [a for _, a in cells if a]
    longest = max(v.count(",") for v in settled)
    paths, taken, changes = [], list(settled), 0
    for k in range(packed.ROUNDS):
        met = Counter(settled) + Counter(v for p in paths for v in p)
        several = Counter(v for a in open_ for _, _, v in packed.spans(a, longest)) + Counter({v: 2 for v in settled})
        if k == 1:
            taken = settled + [v for p in paths for v in p]
        commas = Counter(v.count(",") for v in taken)
        prior, totals = packed._comma_prior({"kw": (dict(commas), len(taken))})
        new = []
        for a in open_:
            times = {i: met[v] for i, (_, _, v) in enumerate(packed.spans(a, longest)) if several[v] > 1 and met[v]}
            new.append(packed.best_path(a, times, prior["kw"], totals["kw"], longest))
        changes += k > 1 and new != paths
        if k > 1 and new == paths:
            break
        paths = new
    solved = iter(paths)
    return [values or (next(solved) if a else []) for values, a in cells], changes


def wave(n):
    """A column in which a value that is first met in one round parts the next cell in the round after, among cells that stay as they are."""
    column = [f"aa{i}, bb{i}; cc{i}, dd{i}; start" for i in range(20)]
    column += [f"start, step{c}0" for c in range(2)]
    column += [f"step{c}{k}, step{c}{k + 1}" for c in range(2) for k in range(6)]
    return column + [f"other word {i}, further word {i % 7}" for i in range(n)] + ['"a, b", start', " start ,start"]


def test_rounds_equal_rounds_over_all_cells(spark):
    column = wave(400)
    want, changes = plain_rounds(column)
    assert changes >= 3
    got = items(spark, [(f"{i:04}", 1, x, None) for i, x in enumerate(column)])
    assert [got.get(f"{i:04}", []) for i in range(len(column))] == want


def test_a_round_writes_only_what_changes(spark, monkeypatch):
    sizes = []
    for name in ("cut", "store"):
        if hasattr(packed, name):
            def counted(df, made=getattr(packed, name)):
                out = made(df)
                sizes.append(out.count())
                return out

            monkeypatch.setattr(packed, name, counted)
    column = wave(400)
    items(spark, [(f"{i:04}", 1, x, None) for i, x in enumerate(column)])
    lattices = sum(1 for x in column if packed.read_cell(x)[1])
    assert sum(n >= lattices // 2 for n in sizes) <= 4  # cells, spans, two solutions of all lattices


def test_lead_and_gaps_are_those_of_all_splits():
    rng = np.random.default_rng(4)
    costs = np.log(np.r_[0.8, 0.15, np.full(packed.COMMAS - 1, 0.05 / (packed.COMMAS - 1))])
    for _ in range(60):
        atoms = [str(rng.choice(["a", "bb", "ccc", "dd"])) for _ in range(int(rng.integers(1, 6)))]
        longest = int(rng.integers(0, 5))
        spans = packed.spans(atoms, longest)
        times = {k: int(rng.integers(0, 3)) * int(rng.integers(0, 50)) for k in range(len(spans)) if rng.random() < 0.7}
        into = packed._scored(atoms, times, costs, 100.0, longest)
        score = {(i, j): s for j, ends in enumerate(into) for i, s in ends}
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(atoms) - 1):
            ends = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(atoms)]
            parts = [(x, y - 1) for x, y in itertools.pairwise(ends)]
            if all(p in score for p in parts):
                splits.append((sum(score[p] for p in parts), parts))
        splits.sort(reverse=True)
        best = splits[0][0]
        values, lead, gaps, weights = packed.best_and_lead(atoms, times, costs, 100.0, longest)
        assert values == packed.best_path(atoms, times, costs, 100.0, longest)
        assert lead == np.inf if len(splits) == 1 else abs(lead - (best - splits[1][0])) < 1e-9
        for k, gap, w in zip(times, gaps, weights, strict=True):
            i, j, v = spans[k]
            most = max(s for s, parts in splits if (i, j) in parts)
            assert abs((gap or 0.0) - (best - most)) < 1e-9
            assert abs(np.log(packed.KNOWN * w / 100) - score[i, j]) < 1e-9


def test_cells_that_are_not_open_keep_their_path(spark):
    rng = np.random.default_rng(6)
    costs, longest = np.log(np.r_[0.5, 0.3, np.full(packed.COMMAS - 1, 0.2 / (packed.COMMAS - 1))]), 3
    lattices, rows = {}, []
    met = {h: int(rng.integers(0, 2)) * int(rng.integers(1, 400)) for h in range(40)}
    moves = {h: int(rng.choice([-3, -1, 1, 2, 200])) for h in range(0, 40, 5)}
    moves = {h: max(d, -met[h]) for h, d in moves.items() if max(d, -met[h])}
    for cell in range(600):
        atoms = [str(rng.choice(["a", "bb", "cc c", "ddd", ' "e, f"', "g"])) for _ in range(int(rng.integers(1, 7)))]
        hashes = {k: int(rng.integers(0, 40)) for k in range(len(packed.spans(atoms, longest))) if rng.random() < 0.5}
        times = {k: met[h] for k, h in hashes.items()}
        values, lead, gaps, weights = packed.best_and_lead(atoms, times, costs, 5000.0, longest)
        lattices[cell] = atoms, hashes, values
        rows.append((cell, float(lead), list(hashes), list(hashes.values()), list(times.values()), [g if g is None else float(g) for g in gaps], [float(w) for w in weights]))
    base = spark.createDataFrame(rows, "cell long, lead double, ats array<int>, hs array<long>, ns array<long>, gaps array<float>, weights array<float>")
    moved = spark.createDataFrame(list(moves.items()), "h long, d long")
    open_ = {r["cell"]: dict(zip(r["more_ats"], r["more_ns"], strict=True)) for r in packed._open(base, moved).collect()}
    changed = set()
    for cell, (atoms, hashes, values) in lattices.items():
        now = {k: met[h] + moves.get(h, 0) for k, h in hashes.items()}
        if packed.best_path(atoms, now, costs, 5000.0, longest) != values:
            changed.add(cell)
        assert open_.get(cell, {}).items() <= now.items()
    assert changed and changed <= open_.keys() and len(open_) < 450
