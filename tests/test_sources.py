"""Model files, matrices and symbolic text: small files with odd forms, read back exactly."""

from __future__ import annotations

import pytest

from semifold.sources import models, symbolic


def put(path, text: str) -> str:
    path.write_text(text)
    return str(path)


def cells(df) -> list[tuple]:
    return sorted((r["i"], r["j"], r["v"]) for r in df.collect())


def test_entry_equal_to_the_size_line_stays(spark, tmp_path):
    path = put(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate real general\n% note\n3 3 3\n1 1 1\n2 2 2\n3 3 3\n")
    assert cells(models.matrix_market(spark, path)) == [(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0)]


@pytest.mark.parametrize("kind, want", [("symmetric", 5.0), ("skew-symmetric", -5.0)])
def test_symmetric_matrices(spark, tmp_path, kind, want):
    path = put(tmp_path / "a.mtx", f"%%MatrixMarket matrix coordinate real {kind}\n2 2 1\n2 1 5\n")
    assert cells(models.matrix_market(spark, path)) == [(0, 1, want), (1, 0, 5.0)]


@pytest.mark.parametrize("kind, lines, want", [
    ("general", "2 3\n1\n2\n3\n4\n5\n6\n", [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 6.0)]),
    ("symmetric", "2 2\n1\n2\n3\n", [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]),
    ("skew-symmetric", "2 2\n7\n", [(0, 1, -7.0), (1, 0, 7.0)]),
])
def test_array_matrices(spark, tmp_path, kind, lines, want):
    assert cells(models.matrix_market(spark, put(tmp_path / "a.mtx", f"%%MatrixMarket matrix array real {kind}\n{lines}"))) == want


def test_pattern_and_complex(spark, tmp_path):
    path = put(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 2\n")
    assert cells(models.matrix_market(spark, path)) == [(0, 1, 1.0)]
    with pytest.raises(ValueError):
        models.matrix_market(spark, put(tmp_path / "b.mtx", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 0\n"))


def test_uai_model_and_evidence(spark, tmp_path):
    path = put(tmp_path / "m.uai", "MARKOV\n2\n2 3\n2\n1 0\n2 0 1\n\n2\n0.4 0.6\n6\n1 2 3 4 5 6\n")
    rows = models.uai_factors(spark, path).orderBy("factor_id", "cell").collect()
    assert [r["value"] for r in rows] == [0.4, 0.6, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and rows[2]["args"] == [0, 1] and rows[2]["arities"] == [2, 3]
    assert sorted(map(tuple, models.uai_evidence(spark, put(tmp_path / "e", "2\n0 1\n1 2\n")).collect())) == [(0, 1), (1, 2)]
    assert models.uai_evidence(spark, put(tmp_path / "none", "0\n")).count() == 0
    models.save_beliefs(spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (0, 0, 1.0)], "variable int, state int, value double"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["MAR", "2 1 1.0 2 0.25 0.75"]


def test_bif_network(spark, tmp_path):
    text = "network n {}\nvariable a { type discrete [ 2 ] { yes, no }; }\nvariable b { type discrete [ 2 ] { t, f }; }\nprobability ( a ) { table 0.2, 0.8; }\nprobability ( b | a ) { (yes) 0.9, 0.1; (no) 0.3, 0.7; }\n"
    got = {(r["child"], r["state"], tuple(r["parent_states"])): r["value"] for r in models.bif_factors(spark, put(tmp_path / "n.bif", text)).collect()}
    assert got == {("a", "yes", ()): 0.2, ("a", "no", ()): 0.8, ("b", "t", ("yes",)): 0.9, ("b", "f", ("yes",)): 0.1, ("b", "t", ("no",)): 0.3, ("b", "f", ("no",)): 0.7}


def test_pairwise_network(spark, tmp_path):
    variables, potentials = models.pairwise_network(spark, put(tmp_path / "n.net", "@Variables\n2\n0 2\n1 2\n@End\n@Potentials\n1 0 0.5 1.5\n2 0 1 1 2 3 4\n@End\n"))
    assert sorted(map(tuple, variables.collect())) == [(0, 2), (1, 2)]
    assert [(r["factor_id"], r["cell"], r["value"]) for r in potentials.orderBy("factor_id", "cell").collect()] == [(0, 0, 0.5), (0, 1, 1.5), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0)]


def test_skipped_rows_are_the_first_of_each_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        put(tmp_path / "in" / f"{k}.txt", f"head\n{k % 2} x\n\n1 ?\n")
    form = symbolic.SymbolicFormat([("a", 2), ("b", ["x", "y"])], separator=" ", skip_rows=1)
    assert sorted((r["a"], r["b"]) for r in symbolic.load(spark, str(tmp_path / "in"), form).na.fill(-1).collect()) == [(0, 0), (0, 0), (1, -1), (1, -1), (1, -1), (1, 0)]


def test_legacy_labels_and_errors(spark, tmp_path):
    form = symbolic.legacy_format([2, 3], prefix="a", index_base=1, separator=" ", weighted=True)
    path = put(tmp_path / "x.txt", "a1 a3 0.5\na2 a1 2\n")
    assert sorted((r["v0"], r["v1"], r["weight"]) for r in symbolic.load(spark, path, form).collect()) == [(0, 2, 0.5), (1, 0, 2.0)]
    for bad in ("a1 a9 1\n", "a1\n"):
        with pytest.raises(Exception, match="unknown value|expected"):
            symbolic.load(spark, put(tmp_path / "bad.txt", bad), form).collect()


def test_sequences(spark, tmp_path):
    (tmp_path / "seq").mkdir()
    put(tmp_path / "seq" / "one.txt", "0 1\n1 2\n")
    rows = symbolic.load_sequences(spark, str(tmp_path / "seq"), symbolic.SymbolicFormat([("a", 2), ("b", 3)], separator=" ")).orderBy("t").collect()
    assert [(r["t"], r["a"], r["b"]) for r in rows] == [(0, 0, 1), (1, 1, 2)]
