"""Neighbours, overlaps and splits against brute force."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm import group_split as gs, neighbours as nb, overlap
from massloom.llm.structures import connectivity_code, structure_codes

SPECTRA = "spectrum_id long, m array<double>, x array<double>, id string, dims int"


def spectra(spark, rows):
    return spark.createDataFrame([(*r, "z", 0) for r in rows], SPECTRA)


def exact(rows):
    v = {}
    for k, m, x in rows:
        if m and x and len(m) == len(x):
            d = {}
            for a, b in zip(m, x, strict=True):
                if a is not None and b is not None:
                    d[int(a // 1)] = d.get(int(a // 1), 0) + b
            n = sum(b * b for b in d.values()) ** 0.5
            if n:
                v[k] = {a: b / n for a, b in d.items()}
    cos = {}
    for a, b in itertools.combinations(sorted(v), 2):
        cos[a, b] = sum(w * v[b].get(d, 0) for d, w in v[a].items())
    return cos


def made(n, seed=4):
    rng = random.Random(seed)
    rows = [(i, [round(rng.uniform(50, 400), 3) for _ in range(20)], [rng.random() for _ in range(20)]) for i in range(n)]
    for i in range(0, n, 10):
        k, m, x = rows[i]
        rows.append((1000 + k, m, [y * 1000 * rng.uniform(0.97, 1.03) for y in x]))
    return rows


def test_near_pairs_and_recall(spark):
    rows = made(400)
    rows += [(5000, None, [1.0]), (5001, [], []), (5002, [1.0], [1.0, 2.0]), (5003, [60.0], [0.0]), (5004, [60.0, None], [1.0, 2.0]), (5005, [float("nan"), 60.2], [1.0, 3.0])]
    cos = exact([r for r in rows if r[0] != 5005])
    want = {p for p, c in cos.items() if c >= 0.92}
    got = nb.neighbours(spectra(spark, rows), "spectrum_id", "m", "x", least=0.92).collect()
    found = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in got}
    assert found == want | {(5004, 5005)} and max(r["rank"] for r in got) <= 10
    everything = nb.neighbours(spectra(spark, rows), "spectrum_id", "m", "x", k=10, searched=8, ratio=100.0, list_length=40).collect()
    lists = {}
    for r in everything:
        lists.setdefault(r["id"], []).append(r["other"])
    assert max(map(len, lists.values())) == 10
    hit = total = 0
    for i in range(0, 400, 7):
        best = sorted((-cos[min(i, j), max(i, j)], j) for j in [k for k, *_ in rows if k != i and k not in (5000, 5001, 5002, 5003, 5005)])[:10]
        hit, total = hit + len({j for _, j in best} & set(lists[i])), total + 10
    assert hit >= 0.9 * total


def test_lists_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(nb, "FAN", 4)
    rows = made(400)
    assert nb.levels(440, 5) == 3 and nb.levels(20, 5) == 1
    want = {p for p, c in exact(rows).items() if c >= 0.92}
    got = nb.neighbours(spectra(spark, rows), "spectrum_id", "m", "x", least=0.92, list_length=5).collect()
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in got} == want


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    matrix = rng.random((700, 30), np.float32) ** 4
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    c = nb.Centroids.unpacked(nb.Centroids(np.arange(30), matrix).packed())
    assert [len(m) for m, _ in c.layers] == [11, 88, 700]
    x = matrix[:300] + rng.random((300, 30), np.float32) / 10
    nodes, cos = c.nearest(x, 5)
    best = np.argsort(-(x @ matrix.T), axis=1)[:, :5]
    assert (nodes == best).mean() > 0.98 and (np.diff(cos, axis=1) <= 0).all()


def test_many_dimensions_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nb, "DIMENSIONS_AT_A_TIME", 16)
    monkeypatch.setattr(nb, "DIMENSIONS", 20)
    rows = made(60)
    want = {p for p, c in exact(rows).items() if c >= 0.92}
    got = nb.neighbours(spectra(spark, rows), "spectrum_id", "m", "x", least=0.92).collect()
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in got} == want


def test_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 16)
    rows = made(60)
    want = {p for p, c in exact(rows).items() if c >= 0.92}
    got = nb.neighbours(spectra(spark, rows), "spectrum_id", "m", "x", least=0.92).collect()
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in got} == want


def test_no_spectra(spark):
    assert nb.neighbours(spectra(spark, []), "spectrum_id", "m", "x").count() == 0
    assert nb.neighbours(spectra(spark, [(1, None, None)]), "spectrum_id", "m", "x").count() == 0


SAME = [
    "CC(=C)COC(=O)NC1CCC(CC1)NC(F)CSCCOC1CCCC1", "C5CCCC5OCCSCC(F)NC5CCC(CC5)NC(=O)OCC(=C)C", "CC(=C)COC(=O)NC%11CCC(CC%11)N[C@H](F)CSCCOC1CCCC1.Cl",
    "O.CC(=C)C-O-C(=O)NC1CCC(CC1)NC(F)CSCCOC1CCCC1 compound 12", " CC(=C)COC(=O)NC1CCC(CC1)NC(F)CSCCOC1CCCC1\tspec-3",
]
OTHER = ["CC(=C)COC(=O)NC1CCC(CC1)NC(F)CSCCOC1CCCCC1", "CC(C)COC(=O)NC1CCC(CC1)NC(F)CSCCOC1CCCC1", "c1ccc(cc1)c1ccccc1", "Oc1ccccc1N", "Oc1cccc(c1)N", "Oc1ccc(cc1)N"]


def test_connectivity_code():
    assert len({connectivity_code(s) for s in SAME}) == 1 and len({connectivity_code(s) for s in [SAME[0], *OTHER]}) == 1 + len(OTHER)
    assert connectivity_code("c1ccc(cc1)-c1ccccc1") == connectivity_code("c2ccc(cc2)c1ccccc1")
    assert connectivity_code("F/C=C/F") == connectivity_code("F/C=C\\F") and connectivity_code("[Na+].CC(=O)[O-]") == connectivity_code("CC(=O)O")
    assert [connectivity_code(s) for s in (None, "", "  ", "N/A", "C1CC", "C(C", "C)", "?")] == [None] * 8


ALIKE = [  # pairs that refinement alone can't tell apart
    ("C1CCC2CCCCC2C1", "C1CCC(C1)C1CCCC1"), ("C1CC1C1CC1", "C1CCCCC1"), ("C12C3C4C1C5C2C3C45", "C12C3C1C4C2C5C3C45"), ("C1CCCCC1.C1CCCCC1", "C1CCCCCCCCCCC1"),
    ("OC1CCC2CCCCC2C1", "OC1CCC(C1)C1CCCC1"),
]


def shuffled(smiles, seed):
    """The structure written anew: another order of atoms and bonds, rings opened elsewhere."""
    from massloom.llm.structures import read_graph

    atoms, bonds, _ = read_graph(smiles)
    rng = random.Random(seed)
    near = {i: [] for i in range(len(atoms))}
    for a, b, o in bonds:
        near[a].append((b, o))
        near[b].append((a, o))
    for n in near.values():
        rng.shuffle(n)
    mark = {1: "", 2: "=", 3: "#"}
    seen, used, closing = set(), set(), {i: [] for i in near}

    def tree(i, came):
        seen.add(i)
        kids = []
        for j, o in near[i]:
            if j == came or frozenset((i, j)) in used:
                continue
            used.add(frozenset((i, j)))
            if j in seen:
                number = len([1 for x in closing.values() for _ in x]) // 2 + 10
                closing[i].append(f"{mark[o]}%{number}")
                closing[j].append(f"{mark[o]}%{number}")
            else:
                kids.append((tree(j, i), o))
        return i, kids

    def text(node):
        i, kids = node
        parts = [mark[o] + text(k) for k, o in kids]
        return atoms[i] + "".join(closing[i]) + "".join(f"({p})" for p in parts[:-1]) + (parts[-1] if parts else "")

    return text(tree(rng.randrange(len(atoms)), -1))


def test_codes_are_canonical():
    for a, b in ALIKE:
        assert connectivity_code(a) != connectivity_code(b) or "." in a
        assert len({connectivity_code(shuffled(a.split(".")[0], s)) for s in range(8)}) == 1
    for s in [*SAME[:1], *OTHER, "CC1(C)C2CCC1(C)C(=O)C2", "C1CC2CCC1C2N1C=CC2=CC=CC=C21", "C(C1CCCCC1)(C1CCCCC1)(C1CCCCC1)C1CCCCC1"]:
        assert {connectivity_code(shuffled(s, k)) for k in range(8)} == {connectivity_code(s)}
    assert connectivity_code("CCO") == "7921fbcb843755023e14dbea"  # the digest is fixed
    assert structure_codes("CCO")[1] is None and structure_codes("OC1CCCCC1CC")[1] == structure_codes("C1CCCCC1")[1]


K = "ABCDEFGHIJKLMN-UHFFFAOYSA-N"
EXT = "split string, source_library string, spectrum_id string, inchikey string, canonical_smiles string, text string"
TRAIN = "spectrum_id long, inchikey string, inchikey14 string, normalized_smiles string, collision_energy double, code string"


def test_overlaps(spark, monkeypatch):
    ext = [
        ("test", "A", "e1", K.lower(), None), ("test", "A", "e2", "N/A", SAME[1]), ("validation", "B", "e3", None, OTHER[0]), ("test", "B", "e4", None, None),
        ("test", "B", "e5", "", "N/A"), ("validation", "A", "e6", f"InChIKey={K}", SAME[2]), ("test", None, "e7", None, SAME[3]), ("test", "A", "e8", "ZZZDEFGHIJKLMN-UHFFFAOYSA-N", "CCO"),
    ]
    tr = [(1, None, "abcdefghijklmn", None, None), (2, f"{K} | QQQDEFGHIJKLMN-UHFFFAOYSA-N", None, "N/A", 1.0), (3, None, None, SAME[0], 1.0), (4, "", "", "", None)]
    e = spark.createDataFrame([(*r, "t") for r in ext], EXT)
    t = spark.createDataFrame([(*r, "c") for r in tr], TRAIN)
    found = {r["spectrum_id"]: r for r in overlap.overlaps(e, t).collect()}
    got = {k: (r["by_key"], r["by_structure"], r["coverage"]) for k, r in found.items() if r["by_key"] or r["by_structure"]}
    assert got == {"e1": (True, False, 1.0), "e2": (False, True, 1.0), "e6": (True, True, 1.0), "e7": (False, True, 1.0)}
    near = {k: (r["by_rings"], r["coverage"]) for k, r in found.items() if k not in got}
    assert near == {}
    rings = spark.createDataFrame([(6, None, None, "OC1CCCCC1", 1.0, "c")], TRAIN)
    other = e.where("spectrum_id = 'e1'").withColumns({"canonical_smiles": F.lit("CC1CCCCC1"), "inchikey": F.lit(None).cast("string")})
    part = overlap.overlaps(other, rings).collect()
    assert len(part) == 1 and part[0]["by_rings"] and not part[0]["by_structure"] and part[0]["coverage"] == 0.5
    report = {(r["split"], r["source_library"]): (r["n_records"], r["n_overlap"]) for r in overlap.overlap_report(e.where("source_library IS NOT NULL"), t).collect()}
    assert report == {("test", "A"): (3, 2), ("validation", "B"): (1, 0), ("test", "B"): (2, 0), ("validation", "A"): (1, 1)}
    monkeypatch.setattr(overlap, "SHARD", 1)
    assert {r["spectrum_id"] for r in overlap.overlaps(e, t).collect()} == set(found)
    assert overlap.overlaps(e.limit(0), t).count() == 0 and overlap.overlaps(e, t.limit(0)).count() == 0


def blocks_of(letters):
    return [c * 14 for c in letters]


def key(c):
    return f"{c * 14}-UHFFFAOYSA-N"


def test_ties_and_splits(spark):
    rows = [(i, f"{key(a)} | {key(b)}", None, None, 10.0) for i, (a, b) in enumerate(("AB", "BC", "CD", "EF", "XA"))]
    rows += [(10, key("G"), "HHHHHHHHHHHHHH", None, 40.0), (11, key("G").lower(), None, None, None), (12, None, None, None, 1.0), (13, "N/A", "", None, None)]
    rows += [(100 + i, key(chr(73 + i % 14)), None, None, float(10 + i % 50)) for i in range(2000)]
    rows += [(5000 + i, None, None, None, 20.0) for i in range(300)]
    df = spark.createDataFrame([(*r, "c") for r in rows], TRAIN)
    pairs = {tuple(r) for r in gs.tied_blocks(df).collect()}
    want = {(a * 14, b * 14) for group in ("ABCDX", "EF", "GH") for a, b in itertools.combinations(group, 2)}
    assert pairs == want
    got = {r["spectrum_id"]: r["split"] for r in gs.split_records(df).collect()}
    assert set(got) == {r[0] for r in rows}
    assert len({got[i] for i in (0, 1, 2, 4)}) == 1 and got[10] == got[11]
    for i in range(14):
        assert len({got[100 + j] for j in range(i, 2000, 14)}) == 1
    assert gs.split_records(df.limit(0)).count() == 0 and gs.tied_blocks(df.limit(0)).count() == 0
    share = [list(got.values()).count(s) / len(got) for s in ("train", "validation", "test")]
    assert 0.74 <= share[0] <= 0.86 and min(share[1:]) >= 0.06


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z", "y"), ("q", "q"), (None, "q")], "u string, v string")
    got = {r["node"]: r["root"] for r in gs.components(links).distinct().collect()}
    assert {r for n, r in got.items() if n[0] == "n"} == {"n000"} and len(got) == 63 and got["z"] == "y"


def test_hub_is_one_component(spark):
    """A node with most links, and a chain from it."""
    links = [("hub", f"leaf{i:04d}") for i in range(1500)] + [(f"leaf{i:04d}", f"next{i:04d}") for i in range(0, 300)] + [("x", "y"), (None, "z"), ("q", "q")]
    got = {r["node"]: r["root"] for r in gs.components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert len(got) == 1 + 1500 + 300 + 2 and {v for k, v in got.items() if k not in ("x", "y")} == {"hub"} and got["y"] == got["x"] == "x"


def test_block_entities(spark):
    rows = [(1, f"{key('A')} | {key('B')}", None, None), (2, key("B"), "C" * 14, 1.0), (3, key("D"), None, 1.0), (4, None, None, None)]
    df = spark.createDataFrame(rows, "spectrum_id long, inchikey string, inchikey14 string, collision_energy double")
    got = {r["block"][0]: r["entity"][0] for r in gs.block_entities(df).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D"} and gs.block_entities(df.limit(0)).count() == 0


def test_differencing_makes_equal_bins():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, 3000).astype(float)
    bins = np.bincount(gs.difference(w, 32), w, 32)
    assert len(bins) == 32 and bins.max() - bins.min() <= 2
    assert set(gs.difference(np.array([5.0, 3.0]), 8)) <= set(range(8)) and len(gs.difference(np.zeros(0), 8)) == 0
    few = gs.difference(np.array([8.0, 7, 6, 5, 4]), 2)
    assert abs(np.bincount(few, [8, 7, 6, 5, 4])[0] - 15) <= 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_registered_queries_run(spark):
    from massloom.llm.queries import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, "/root/testdata/sf0.001").count() >= 0, name


def test_hot_list_is_searched_by_blocks(spark, monkeypatch):
    import numpy as np

    from massloom.llm import neighbours as nb

    monkeypatch.setattr(nb, "BLOCK", 20)
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(200, 6))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dims = np.arange(6, dtype=np.int32).tobytes()
    rows = [(i, bytearray(dims), bytearray(v.tobytes()), i != 7, [0], 0 if i == 9 else 1) for i, v in enumerate(x)]
    placed = spark.createDataFrame(rows, "id long, dims binary, vals binary, asks boolean, lists array<long>, n_stored int")
    at = nb.list_entries(placed)
    groups = nb.dealt_to_blocks(at, nb.list_lengths(at)).groupBy("list", "block", "ask_block").count().collect()
    assert len(groups) == 100 and max(r["count"] for r in groups) <= 4 * 20
    best = {}
    for r in nb.search_lists(nb.dealt_to_blocks(at, nb.list_lengths(at)), 3, -1.0).collect():
        best.setdefault(r["id"], []).append((-round(r["cos"], 5), r["other"]))
    cos = x @ x.T
    assert set(best) == set(range(200)) - {7}
    for i, found in best.items():
        want = sorted(-float(cos[i, j]) for j in range(200) if j not in (i, 9))[:3]
        assert len({o for _, o in found}) == len(found) and [c for c, _ in sorted(found)[:3]] == [pytest.approx(w, abs=2e-5) for w in want]


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    from massloom.llm.queries import shares

    df = spark.range(90_000).select(F.when(F.col("id") < 60_000, "train").otherwise("test").alias("split"), F.floor(F.col("id") / 2).alias("entity"))
    df = df.unionByName(spark.sql("SELECT 'test' AS split, CAST(NULL AS BIGINT) AS entity"))
    assert sorted(map(tuple, shares(df).collect())) == [("test", 30_001, 15_000), ("train", 60_000, 30_000)]


def test_more_levels_add_no_entries(spark, monkeypatch):
    seen, dealt = [], nb.dealt_to_blocks
    monkeypatch.setattr(nb, "FAN", 4)
    monkeypatch.setattr(nb, "dealt_to_blocks", lambda at, lengths: seen.append(at) or dealt(at, lengths))
    nb.neighbours(spectra(spark, made(400)), "spectrum_id", "m", "x", searched=3, ratio=100.0, list_length=5)
    at = seen[0].groupBy("id").count().collect()
    assert len(at) > 390 and max(r["count"] for r in at) == 3 and seen[0].select("list").distinct().count() > 40
