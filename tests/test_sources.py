import numpy as np

from tessera.sources import particles as P

STAR = """# version 30001

data_optics

loop_
_rlnOpticsGroup #1
_rlnPixelSize #2
1 1.5

data_particles

loop_
_rlnCoordinateX #1
_rlnCoordinateY #2
_rlnImageName #3
10.5 2 1@a#b.mrcs
3 4 2@a.mrcs

"""


def test_star(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.star").write_text(STAR)
    got = P.read_star(spark, f"{tmp_path}/in").orderBy("block", "row").collect()
    assert [(r.block, r.row) for r in got] == [("optics", 0), ("particles", 0), ("particles", 1)]
    assert got[1].fields == {"rlnCoordinateX": "10.5", "rlnCoordinateY": "2", "rlnImageName": "1@a#b.mrcs"}
    table = P.read_star(spark, f"{tmp_path}/in", block="particles").selectExpr("fields.rlnCoordinateX as rlnCoordinateX", "fields.rlnImageName as rlnImageName")
    text = "\n".join(r.value for r in P.star_text(table, ["rlnImageName"], block="particles").collect())
    assert P.parse_star(text)["particles"] == (["rlnCoordinateX", "rlnImageName"], [["10.5", "1@a#b.mrcs"], ["3", "2@a.mrcs"]])


def test_star_without_a_loop():
    assert P.parse_star("data_x\n_a 1\n_b 2\n") == {"x": (["a", "b"], [["1", "2"]])}


def test_atoms(spark, tmp_path):
    lines = ["HEADER    X", "ATOM      1  CA  ALA A   1       0.000   0.000   0.000  1.00  0.00           C", "HETATM    2  O   HOH A   2       2.000   0.000   0.000  1.00  0.00           O"]
    (tmp_path / "a.pdb").write_text("\n".join(lines))
    atoms = P.read_atoms(spark, f"{tmp_path}/a.pdb")
    assert [(r.serial, r.name, r.x) for r in atoms.orderBy("serial").collect()] == [(1, "CA", 0.0), (2, "O", 2.0)]
    (ball,) = P.bounding_spheres(atoms).collect()
    assert (ball.x, ball.y, ball.z, ball.r) == (1.0, 0.0, 0.0, 1.0)


def test_em_round_trip(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(3, 4, 5)).astype(np.float32)
    assert (P.parse_em(P.em_bytes(v)) == v).all()
    (tmp_path / "v.em").write_bytes(P.em_bytes(v))
    rows = P.read_em(spark, f"{tmp_path}/v.em", rows=7).collect()
    assert len(rows) == 60 and all(r.val == v[r.x, r.y, r.z] for r in rows)


def test_points(spark):
    df = spark.createDataFrame([(1, 2, 3), (4, 5, 0)], "x int, y int, z int")
    assert [r.value for r in P.point_text(df).collect()] == ["1\t1\t4\t5\t0", "1\t1\t1\t2\t3"]
