"""Readers on generated fixture files."""

from pyspark.sql import functions as F

from screenspark.sources import structures as s
from screenspark.sources.delimited import read_table, write_residue_list, write_stage


def atom(serial, name, chain, n, x, y, z, record="ATOM", altloc=" ", res="GLY", occ=1.0, b=10.0, icode=" "):
    return f"{record:<6}{serial:>5}  {name:<3}{altloc}{res:>3} {chain}{n:>4}{icode}   {x:>8.3f}{y:>8.3f}{z:>8.3f}{occ:>6.2f}{b:>6.2f}          {name[0]:>2}"


def test_atoms_altloc_models_and_blocks(spark, tmp_path):
    lines = [atom(1, "CA", "A", 10, 20, 0, 0, altloc="A", occ=0.4), atom(2, "CA", "A", 10, 21, 0, 0, altloc="B", occ=0.6), atom(3, "CA", "A", 20, 0, 0, 0), "TER", atom(4, "CA", "H", 5, 0, 0, 3.5), atom(5, "H1", "H", 5, 0, 0, 3), atom(6, "O", "H", 6, 1, 1, 1, record="HETATM", res="HOH"), "ENDMDL", atom(7, "CA", "A", 99, 0, 0, 0), "END"]
    (tmp_path / "a.pdb").write_text("\n".join(lines) + "\n")
    text = s.read_lines(spark, str(tmp_path))
    atoms = s.parse_atoms(text)
    assert sorted(r.serial for r in atoms.collect()) == [1, 2, 3, 4]
    assert sorted(r.serial for r in s.select_altloc(atoms).collect()) == [2, 3, 4]
    assert [r.block for r in s.assign_chain_blocks(text).orderBy("line_no").collect()][:4] == [0, 0, 0, 1]
    assert {r.key for r in s.read_site_atoms(atoms).collect()} == {"A:10", "A:20", "H:5"}


def test_residue_sets(spark, tmp_path):
    (tmp_path / "r.txt").write_text("A:45 # x\nA 46\nA:47,67,89\nA:37-40\n147:B\n82-84:B\nB:100:A\n// c\nC：5，6\n;x\n")
    keys = {r.key for r in s.parse_residue_sets(s.read_lines(spark, str(tmp_path))).collect()}
    assert keys == {"A:45", "A:46", "A:47", "A:67", "A:89", "A:37", "A:38", "A:39", "A:40", "B:147", "B:82", "B:83", "B:84", "B:100:A", "C:5", "C:6"}


def test_energy_scores_and_decomposition(spark, tmp_path):
    for name, text in {"a.txt": "TOTAL 5\nDELTA x TOTAL -7.5 0.1\nDELTA TOTAL -8.25\n", "b.txt": "TOTAL 1 2\n", "c.txt": "nothing 3\n"}.items():
        (tmp_path / name).write_text(text)
    lines = s.read_lines(spark, str(tmp_path))
    got = {r.file[-5]: (r.energy, r.status) for r in s.extract_energy(lines).collect()}
    assert got == {"a": (-8.25, "ok"), "b": (2.0, "warning"), "c": (None, "no_energy")}
    assert {r.file[-5]: r.value for r in s.last_float(lines).collect()} == {"a": -8.25, "b": 2.0, "c": 3.0}
    score = spark.createDataFrame([("f", 0, "SCORE: total dG"), ("f", 1, "SCORE: -5.5 2")], "file string, line_no int, line string")
    assert {r.metric: r.value for r in s.score_lines(score).collect()} == {"interface_total": -5.5, "interface_dG": 2.0}
    dec = spark.createDataFrame([("f", 0, "GLY 10 | R GLY | x | -1.5 +/- 0.1"), ("f", 1, "ALA 11 | R ALA | x | -0.5 +/- 0.1"), ("f", 2, "SER 5 | L SER | x | 2.0 +/- 0.1")], "file string, line_no int, line string")
    rows = {r.part: r["sum"] for r in s.decomposition(dec, spark.createDataFrame([(10,)], "resseq int")).collect()}
    assert rows == {"target": -2.0, "partner": 2.0, "site": -1.5}


def test_result_tree(spark):
    paths = ["/r/n1/t_1/p1/p1.pdb", "/r/n1/t_1/p1/x.txt", "/r/n1/t_1/p2/other.pdb", "/r/n1/t_2/p3/a.pdb", "/r/n1/t_2/p3/b.pdb", "/r/n2/t_1/p1/e.txt", "/r/n2/bad/p/p.pdb", "/r/x.pdb"]
    items, skipped = s.scan_result_tree(spark.createDataFrame([(p,) for p in paths], "path string"), "/r", "T")
    assert {(r.candidate, r.item): r.status for r in items.collect()} == {("n1", "p1"): "ok", ("n1", "p2"): "warning"}
    assert {(r.candidate, r.item): r.status for r in skipped.collect()} == {("n1", "p3"): "ambiguous_pdb", ("n2", "p1"): "missing_pdb"}


def test_predictions_and_free_text(spark):
    d = spark.createDataFrame([(" pocket1 ", " 1", " 0.9", " A_1 A_2 B_3"), ("pocket2", "2", "0.2", "A_2 A_9")], "`name  ` string, ` rank` string, ` probability` string, ` residue_ids` string")
    assert {r.key for r in s.read_site_predictions(d, top_n=1, chain="A").collect()} == {"A:1", "A:2"}
    assert {r.key for r in s.read_site_predictions(d, min_prob=0.1).collect()} == {"A:1", "A:2", "B:3", "A:9"}
    assert s.inspect_predictions(d).collect()[0].n_ranks == 2
    t = spark.createDataFrame([("f", 0, 'see A:45 and B_7, CYS C 119, {"chain": "D", "resi": 12}')], "file string, line_no int, line string")
    assert {r.key for r in s.extract_keys_from_text(t).collect()} == {"A:45", "B:7", "C:119", "D:12"}


def test_tables_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_bytes(b"\xef\xbb\xbfid,name\n1,\"a,b\"\n")
    d = read_table(spark, str(tmp_path / "in"), ["id", "name"])
    assert d.collect()[0].name == "a,b"
    write_stage(d, str(tmp_path / "out"), ["name"])
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["name", "id"]
    write_residue_list(spark.createDataFrame([("B:10",), ("B:9",), ("A:100",)], "key string").coalesce(1), str(tmp_path / "keys"))
    assert [r.value for r in spark.read.text(str(tmp_path / "keys")).collect()] == ["A:100", "B:9", "B:10"]
    m = s.file_manifest(spark, str(tmp_path / "in"), 1000).collect()
    assert len(m) == 1 and m[0].hash_status == "ok" and len(m[0].sha256) == 64
    assert s.file_manifest(spark, str(tmp_path / "in"), 3).select(F.first("hash_status")).collect()[0][0] == "skipped_size"


def test_atoms_and_trees_are_read_in_one_pass(spark, tmp_path):
    lines = [atom(1, "CA", "A", 10, 20, 0, 0), atom(2, "CB", "A", 11, 21, 0, 0), "TER", atom(3, "CA", "H", 5, 0, 0, 3.5), "ENDMDL", atom(4, "CA", "A", 99, 0, 0, 0), "END"]
    files = [("n1/t_1/p1/p1.pdb", "\n".join(lines)), ("n1/t_1/p2/other.pdb", "\r\n".join(lines[:2])), ("n1/t_1/p2/e.txt", "x"), ("n1/t_2/p3/a.pdb", lines[0]), ("n1/t_2/p3/b.pdb", lines[0]), ("n2/t_1/p4/none.txt", "x"), ("n1/t_1/p1/void.txt", None), ("n2/t_1/p5/p5.pdb", "END")]
    root = f"file://{tmp_path}/run"
    assert s.write_files(spark.createDataFrame(files, "path string, content string").repartition(3), root) == 8
    items, skipped = s.read_tree(spark, root, "T")
    assert {(r.item, r.status) for r in items.collect()} == {("p1", "ok"), ("p2", "warning"), ("p5", "ok")} and {r.item for r in skipped.collect()} == {"p3", "p4"}
    atoms = s.read_tree_atoms(spark, root, "t")
    assert sorted((r.item, r.serial, r.chain, r.x) for r in atoms.collect()) == [("p1", 1, "A", 20.0), ("p1", 2, "A", 21.0), ("p1", 3, "H", 0.0), ("p2", 1, "A", 20.0), ("p2", 2, "A", 21.0)]
    one = s.read_atoms(spark, f"{tmp_path}/run/n1/t_1/p1")
    same = s.parse_atoms(s.read_lines(spark, f"{tmp_path}/run/n1/t_1/p1"))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, same.collect()))
    plan = one.select("structure", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString() and "occupancy" not in plan
