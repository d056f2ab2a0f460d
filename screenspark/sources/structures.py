"""Structure text, result trees, tool outputs and residue-set text as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from screenspark.functions.columns import flags
from screenspark.operators.residues import residue_struct
from screenspark.operators.spatial import distance_join

SCHEME = r"^\w+:/*"
FLOAT = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: Water residues, left out of atom tables.
WATER = ("HOH", "WAT", "DOD", "H2O")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of text files; a file is read whole, by one task, to keep its order."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    d = d.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return d


def opened(root: str) -> tuple:
    """The store of a folder, the folder's path in it, and what stands before such paths; for use in tasks."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    return store, base.rstrip("/"), root.rstrip("/").removesuffix(base.rstrip("/")) or "file://"


def hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def list_files(spark: SparkSession, root: str, spread: int = 3) -> DataFrame:
    """``path, size`` of all files under a folder but hidden and empty ones; contents are not read.

    Tasks list the folders, through ``pyarrow.fs``: the first ``spread`` levels are dealt
    out again after each, so neither the driver nor one task holds the tree.
    """

    def run(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base, before = opened(root)
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), strict=True):
                if size is not None:  # a file of a level above
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([size], pa.int64())})
                    continue
                top = path.removeprefix(before)
                found = [i for i in store.get_file_info(fs.FileSelector(top, recursive=deep)) if not any(map(hidden, i.path[len(top) :].split("/"))) and (i.size or i.type == fs.FileType.Directory and not deep)]
                yield pa.RecordBatch.from_pydict({"path": pa.array([before + i.path for i in found], pa.string()), "size": pa.array([i.size for i in found], pa.int64())})

    _, base, before = opened(root)
    d = spark.createDataFrame([(before + base, None)], "path string, size long")
    for _ in range(spread):
        d = d.mapInArrow(lambda batches: run(batches, False), "path string, size long").repartition(F.col("path"))
    return d.mapInArrow(lambda batches: run(batches, True), "path string, size long")


def read_whole(files: DataFrame, path: str, root: str) -> DataFrame:
    """``files`` with the text of the file that each row's ``path`` names as ``value``, read by tasks; no listing goes through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, before = opened(root)
        for b in batches:
            for i, name in enumerate(b.column(path).to_pylist()):
                with store.open_input_stream(name.removeprefix(before)) as f:
                    text = f.read().decode("utf-8", "replace")
                yield b.slice(i, 1).append_column("value", pa.array([text], pa.string()))

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("value", StringType())]))


def file_manifest(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """``path, size, sha256, hash_status``; files over ``max_bytes`` are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = d if max_bytes is None else d.filter(F.col("length") <= max_bytes)
    out = small.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit("ok").alias("hash_status"))
    if max_bytes is not None:
        big = d.filter(F.col("length") > max_bytes).select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit("skipped_size").alias("hash_status"))
        out = out.unionByName(big)
    return out


def bare(path: Column | str) -> Column:
    """A path without the scheme before it, which listings write in several ways."""
    return F.regexp_replace(path, SCHEME, "/")


def scan_result_tree(files: DataFrame, root: str, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and skipped folders of ``root/<candidate>/<target>_<n>/<item>/<item>.pdb``.

    ``files`` has ``path``.  The file named like its folder counts; else the only
    structure file (a warning); none or several are skipped.
    """
    rel = F.split(F.regexp_replace(F.substring_index(bare("path"), re.sub(SCHEME, "/", root.rstrip("/")) + "/", -1), r"^/+", ""), "/")
    d = files.select("path", rel.alias("p")).filter(F.size("p") == 4)
    d = d.select("path", F.col("p")[0].alias("candidate"), F.col("p")[1].alias("variant"), F.col("p")[2].alias("item"), F.col("p")[3].alias("name"))
    d = d.withColumn("target", F.regexp_extract("variant", r"^([A-Za-z0-9]+)_(\d+)$", 1)).withColumn("target_index", F.regexp_extract("variant", r"^([A-Za-z0-9]+)_(\d+)$", 2).try_cast("int"))
    d = d.filter(F.col("target") != "") if target is None else d.filter(F.lower("target") == target.lower())
    pdb = F.lower("name").endswith(".pdb")
    same = pdb & (F.lower("name") == F.concat(F.lower("item"), F.lit(".pdb")))
    g = d.groupBy("candidate", "variant", "target", "target_index", "item").agg(F.count_if(pdb).alias("n_pdb"), F.min(F.when(same, F.col("path"))).alias("_same"), F.min(F.when(pdb, F.col("path"))).alias("_any"), F.array_sort(F.collect_list(F.when(~pdb, F.col("path")))).alias("sidecars"))
    status = F.when(F.col("_same").isNotNull(), "ok").when(F.col("n_pdb") == 1, "warning").when(F.col("n_pdb") == 0, "missing_pdb").otherwise("ambiguous_pdb")
    g = g.withColumn("status", status).withColumn("pdb_path", F.when(status == "ok", F.col("_same")).when(status == "warning", F.col("_any"))).drop("_same", "_any", "n_pdb")
    return g.filter(F.col("status").isin("ok", "warning")), g.filter(~F.col("status").isin("ok", "warning"))


def extract_energy(lines: DataFrame) -> DataFrame:
    """The last number of the last DELTA ... TOTAL line of each file, else of the last TOTAL line (a warning)."""
    u = F.upper("line")
    value = F.element_at(F.regexp_extract_all("line", F.lit(f"({FLOAT})"), F.lit(1)), -1).try_cast("double")
    d = lines.withColumn("v", F.when(F.size(F.regexp_extract_all("line", F.lit(f"({FLOAT})"), F.lit(1))) > 0, value))
    delta, total = u.contains("DELTA") & u.contains("TOTAL") & F.col("v").isNotNull(), u.contains("TOTAL") & F.col("v").isNotNull()
    g = d.groupBy("file").agg(F.max_by("v", F.when(delta, F.col("line_no"))).alias("_d"), F.max_by("v", F.when(total, F.col("line_no"))).alias("_t"))
    return g.select("file", F.coalesce("_d", "_t").alias("energy"), F.when(F.col("_d").isNotNull(), "ok").when(F.col("_t").isNotNull(), "warning").otherwise("no_energy").alias("status"))


def last_float(lines: DataFrame) -> DataFrame:
    """The last number in each file: that of its last line with a digit, the only line that is searched."""
    last = lines.filter(F.col("line").rlike("[0-9]")).groupBy("file").agg(F.max_by("line", "line_no").alias("line"))
    return last.select("file", F.element_at(F.regexp_extract_all("line", F.lit(f"({FLOAT})"), F.lit(1)), -1).try_cast("double").alias("value"))


def score_lines(lines: DataFrame) -> DataFrame:
    """``file, metric, value`` of SCORE: files, whose first such line names the columns."""
    d = lines.filter(F.ltrim("line").startswith("SCORE:")).withColumn("w", F.split(F.trim("line"), r"\s+"))
    head = d.groupBy("file").agg(F.min_by("w", "line_no").alias("h"), F.min("line_no").alias("_first"))
    d = d.join(head, "file").filter(F.col("line_no") > F.col("_first"))
    pairs = d.select("file", "line_no", F.explode(F.arrays_zip("h", "w")).alias("x")).select("file", "line_no", F.concat(F.lit("interface_"), F.col("x.h")).alias("metric"), F.col("x.w").try_cast("double").alias("value"))
    return pairs.filter(F.col("value").isNotNull()).groupBy("file", "metric").agg(F.max_by("value", "line_no").alias("value"))


def decomposition(lines: DataFrame, site: DataFrame | None = None) -> DataFrame:
    """Sum, mean, least and greatest value of target (R) and partner (L) rows ``res n | R/L ... | ... | value +/- err``, and of the site's residues.

    ``site`` has residue numbers (resseq).
    """
    p = F.split("line", r"\|")
    d = lines.filter(F.size(p) >= 3).select("file", F.regexp_extract(p[0], r"(-?\d+)\s*$", 1).try_cast("int").alias("resseq"), F.regexp_extract(F.trim(p[1]), r"^([RL])\b", 1).alias("side"), F.regexp_extract(F.element_at(p, -1), f"({FLOAT})", 1).try_cast("double").alias("v"))
    d = d.filter(F.col("resseq").isNotNull() & (F.col("side") != "") & F.col("v").isNotNull()).withColumn("part", F.when(F.col("side") == "R", "target").otherwise("partner"))
    if site is not None:
        d = d.unionByName(d.filter("part = 'target'").join(site.select("resseq").distinct(), "resseq", "left_semi").withColumn("part", F.lit("site")))
    return d.groupBy("file", "part").agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def parse_atoms(lines: DataFrame, hetero: bool = True, hydrogens: bool = False) -> DataFrame:
    """Atom table of fixed-width structure text in lines: first model only, water left out."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.when(record() == "ENDMDL", 1).otherwise(0)).over(w), F.lit(0))
    return atom_columns(lines.withColumn("_ended", ended).filter("_ended = 0"), hetero, hydrogens)


def record() -> Column:
    """The kind of a line of structure text."""
    return F.rtrim(F.substring("line", 1, 6))


def atom_columns(lines: DataFrame, hetero: bool = True, hydrogens: bool = False, *keep: str) -> DataFrame:
    """Atoms of lines (file, line_no, line) of one model each."""
    d = lines.withColumn("record", record()).filter(F.col("record").isin("ATOM", "HETATM") if hetero else F.col("record") == "ATOM")
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    name = cut(13, 4)
    d = d.select(
        F.col("file").alias("structure"), "line_no", "record", cut(7, 5).try_cast("int").alias("serial"), name.alias("atom_name"), F.trim(F.substring("line", 17, 1)).alias("altloc"), cut(18, 3).alias("resname"), F.trim(F.substring("line", 22, 1)).alias("chain"),
        cut(23, 4).try_cast("int").alias("resseq"), F.trim(F.substring("line", 27, 1)).alias("icode"), *(cut(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))), cut(55, 6).try_cast("double").alias("occupancy"), cut(61, 6).try_cast("double").alias("bfactor"),
        F.upper(F.coalesce(F.nullif(cut(77, 2), F.lit("")), F.regexp_extract(name, r"([A-Za-z])", 1))).alias("element"), *keep,
    )
    d = d.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & ~F.col("resname").isin(*WATER))
    return d if hydrogens else d.filter(~F.col("element").isin("H", "D"))


def read_atoms(spark: SparkSession, path: str, hetero: bool = True, hydrogens: bool = False, pattern: str = "*.pdb") -> DataFrame:
    """Atom table of all structure files under a path, in one pass and without a shuffle; ``structure`` is the file.

    The first model is cut off each text before it is split into lines, so lines need
    no order among files.  Columns that are not asked for are not cut out.
    """
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), "value")
    return atom_columns(first_model(texts), hetero, hydrogens)


def first_model(texts: DataFrame, *keep: Column) -> DataFrame:
    """``file, line_no, line`` of whole texts (file, value) up to the end of their first model."""
    first = F.substring_index(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")), "\nENDMDL", 1)
    return texts.select(*keep, "file", F.posexplode(F.split(F.substring(first, 2, 2**31 - 1), "\n")).alias("line_no", "line"))


def read_tree(spark: SparkSession, root: str, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and skipped folders of a result tree (see ``scan_result_tree``), from a listing of its files; nothing is read."""
    return scan_result_tree(list_files(spark, root), root, target)


def read_tree_atoms(spark: SparkSession, root: str, target: str | None = None, hetero: bool = True, hydrogens: bool = False) -> DataFrame:
    """Items of a result tree with the atoms of their structures: the tree's keys and ``status`` beside the atom columns."""
    items, _ = read_tree(spark, root, target)
    texts = read_whole(items.select("candidate", "variant", "item", "status", F.col("pdb_path").alias("file")), "file", root)
    keys = F.struct("candidate", "variant", "item", "status").alias("_keys")
    return atom_columns(first_model(texts, keys), hetero, hydrogens, "_keys").select("*", "_keys.*").drop("_keys")


def write_files(files: DataFrame, root: str) -> int:
    """Write rows (path, content) as files under a folder; how many there are.  Rows of one path: the last to be written stays.

    Executors write through ``pyarrow.fs``, so the folder must be one that it knows
    (file, hdfs, s3, gs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                place = f"{base}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def atom_key() -> Column:
    return F.concat(F.col("chain"), F.lit(":"), F.col("resseq"), F.when(F.col("icode") != "", F.concat(F.lit(":"), F.col("icode"))).otherwise(""))


def assign_chain_blocks(lines: DataFrame) -> DataFrame:
    """``file, line_no, block`` of atom lines: a block ends at TER or where the residue number decreases."""
    n = F.trim(F.substring("line", 23, 4)).try_cast("int")
    record = F.rtrim(F.substring("line", 1, 6))
    d = lines.select("file", "line_no", record.alias("record"), F.when(record.isin("ATOM", "HETATM"), n).alias("n")).filter(F.col("record").isin("ATOM", "HETATM", "TER"))
    w = Window.partitionBy("file").orderBy("line_no")
    new = (F.lag("record").over(w) == "TER") | (F.col("n") < F.lag("n").over(w))
    d = d.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    return d.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("record <> 'TER'").select("file", "line_no", "block")


def select_altloc(atoms: DataFrame) -> DataFrame:
    """One location for each atom: blank first, then greater occupancy, smaller B factor, smaller serial."""
    w = Window.partitionBy("structure", "chain", "resseq", "icode", "atom_name").orderBy(F.when(F.col("altloc") == "", 0).otherwise(1), F.desc_nulls_last("occupancy"), F.asc_nulls_last("bfactor"), "serial")
    return atoms.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def parse_residue_sets(lines: DataFrame) -> DataFrame:
    """``file, key`` of residue-definition text.

    ``A:45``, ``A 45``, ``A:45,67``, ``A:37-40``, ``147:B``, ``82-88:B``,
    ``B:100:A``; comments after #, ; or //; full-width punctuation; tokens without
    a chain take the last one before them in the line.
    """
    t = F.translate("line", "：，；－　", ":,;- ")
    t = F.trim(F.regexp_replace(t, r"(#|;|//).*$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"^([A-Za-z])\s+(?=-?\d)", "$1:"), r"\s*,\s*|\s+", ",")
    d = lines.select("file", "line_no", F.posexplode(F.split(t, ",")).alias("pos", "tok")).filter("tok <> ''")
    span = r"^(?:([A-Za-z]):)?(-?\d+)(?:-(\d+))?(?::([A-Za-z]))?$"
    part = lambda i: F.nullif(F.regexp_extract("tok", span, i), F.lit(""))
    d = d.withColumn("a", part(1)).withColumn("lo", part(2).try_cast("int")).withColumn("hi", part(3).try_cast("int")).withColumn("b", part(4)).filter("lo IS NOT NULL")
    own = F.coalesce("a", "b")
    icode = F.when(F.col("a").isNotNull(), F.col("b"))
    w = Window.partitionBy("file", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("chain", F.coalesce(own, F.last(own, ignorenulls=True).over(w), F.lit(""))).withColumn("icode", F.coalesce(icode, F.lit("")))
    d = d.withColumn("n", F.explode(F.sequence("lo", F.greatest("lo", F.coalesce("hi", "lo")))))
    return d.select("file", F.concat("chain", F.lit(":"), "n", F.when(F.col("icode") != "", F.concat(F.lit(":"), "icode")).otherwise("")).alias("key")).distinct()


def read_site_predictions(df: DataFrame, rank: int | None = None, name: str | None = None, min_prob: float | None = None, top_n: int | None = None, chain: str | None = None) -> DataFrame:
    """Keys of chosen rows of a site-prediction table (padded names and values): ``rank, key``."""
    d = df.toDF(*(c.strip() for c in df.columns))
    d = d.select(F.trim(F.col("name").cast("string")).alias("name"), F.trim(F.col("rank").cast("string")).try_cast("int").alias("rank"), F.trim(F.col("probability").cast("string")).try_cast("double").alias("probability") if "probability" in d.columns else F.lit(None).cast("double").alias("probability"), F.trim("residue_ids").alias("ids"))
    for cond in ([F.col("rank") == rank] if rank is not None else []) + ([F.col("name") == name] if name else []) + ([F.col("probability") >= min_prob] if min_prob is not None else []):
        d = d.filter(cond)
    if top_n is not None:
        d = d.filter(F.col("rank") <= top_n)
    k = d.select("rank", F.explode(F.split("ids", r"\s+")).alias("t")).select("rank", F.regexp_replace("t", "_", ":").alias("key")).filter(F.col("key").rlike(r"^\w+:-?\d+"))
    return (k if not chain else k.filter(F.split_part("key", F.lit(":"), F.lit(1)) == chain)).distinct()


def inspect_predictions(df: DataFrame, required: tuple[str, ...] = ("name", "rank", "residue_ids")) -> DataFrame:
    """Whether a prediction table has its columns, and how many sites, ranks and names."""
    d = df.toDF(*(c.strip() for c in df.columns))
    missing = [c for c in required if c not in d.columns]
    if missing:
        return d.agg(F.count("*").alias("n_sites")).withColumn("missing", F.lit(",".join(missing)))
    return d.agg(F.count("*").alias("n_sites"), F.countDistinct(F.trim(F.col("rank").cast("string"))).alias("n_ranks"), F.countDistinct(F.trim("name")).alias("n_names")).withColumn("missing", F.lit("")).withColumn("has_probability", F.lit("probability" in d.columns))


def read_site_atoms(atoms: DataFrame, chain: str | None = None, hetero: bool = False) -> DataFrame:
    """Distinct residue keys of site-atom files, by structure."""
    d = atoms if hetero else atoms.filter("record = 'ATOM'")
    d = d if not chain else d.filter(F.col("chain") == chain)
    return d.select("structure", atom_key().alias("key")).distinct()


def extract_keys_from_text(lines: DataFrame) -> DataFrame:
    """Residue keys in free text such as ``A:45``, ``A_45``, ``CYS A 119`` or ``"chain": "A", "resi": 45``."""
    found = F.concat(
        F.regexp_extract_all("line", F.lit(r"\b([A-Za-z]):(-?\d+)\b"), F.lit(0)), F.transform(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z]_-?\d+)\b"), F.lit(1)), lambda x: F.regexp_replace(x, "_", ":")),
        F.transform(F.regexp_extract_all("line", F.lit(r"\b[A-Z]{3}\s+([A-Za-z]\s+-?\d+)\b"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ":")),
        F.transform(F.regexp_extract_all("line", F.lit(r'"chain"\s*:\s*"[A-Za-z]"\s*,\s*"res\w*"\s*:\s*"?-?\d+'), F.lit(0)), lambda x: F.regexp_replace(x, r'^"chain"\s*:\s*"([A-Za-z])".*?(-?\d+)$', "$1:$2")),
    )
    return lines.select("file", F.explode(found).alias("key")).distinct()


def rank_output_files(files: DataFrame, marker: str) -> DataFrame:
    """Tool-output files by how likely they hold residues: json 1, "residue" 2, the tool's marker 3."""
    n = F.lower(F.element_at(F.split("path", "/"), -1))
    score = F.when(n.endswith(".json"), 1).otherwise(0) + F.when(n.contains("residue"), 2).otherwise(0) + F.when(n.contains(marker.lower()), 3).otherwise(0)
    return files.withColumn("score", score)


def read_ligand(atoms: DataFrame, resnames: list[str], resseqs: list[int] | None = None) -> DataFrame:
    """Heavy atoms of a ligand, one location each, with the ligand's centroid."""
    d = select_altloc(atoms.filter(F.col("resname").isin(resnames)))
    d = d if resseqs is None else d.filter(F.col("resseq").isin(resseqs))
    return d.join(d.groupBy("structure").agg(*(F.avg(c).alias(f"centre_{c}") for c in "xyz")), "structure")


def resolve_site(candidates: DataFrame, chain: str | None = None) -> DataFrame:
    """The first definition of each structure that has keys, after the chain filter.

    ``candidates`` has structure, priority, source, key.  Returns structure, source,
    mode (``explicit`` for priority 0, else ``default``), keys.
    """
    d = candidates if not chain else candidates.filter(F.split_part("key", F.lit(":"), F.lit(1)) == chain)
    best = d.groupBy("structure").agg(F.min("priority").alias("priority"))
    k = d.join(best, ["structure", "priority"]).groupBy("structure", "priority", "source").agg(F.array_sort(F.collect_set(residue_struct("key"))).alias("keys"))
    every = candidates.select("structure").distinct().join(k, "structure", "left")
    return every.withColumn("mode", F.when(F.col("keys").isNull(), "empty_after_filter").when(F.col("priority") == 0, "explicit").otherwise("default"))


def ligand_classes(atoms: DataFrame) -> DataFrame:
    """Hetero residues of each structure with their atoms and class."""
    g = atoms.filter("record = 'HETATM'").groupBy("structure", "chain", "resname", "resseq").agg(F.count("*").alias("n_atoms"))
    ion, glycan, solvent = ("NA", "CL", "MG", "CA", "ZN", "K", "MN", "FE"), ("NAG", "MAN", "BMA", "FUC", "GAL"), ("GOL", "EDO", "PEG", "SO4", "PO4", "ACT", "DMS")
    c = F.when(F.col("resname").isin(*ion), "ion").when(F.col("resname").isin(*glycan), "glycan").when(F.col("resname").isin(*solvent), "solvent").otherwise("ligand_like")
    return g.withColumn("class", c).withColumn("flags", flags(("small", F.col("n_atoms") < 6)))


def scan_ligands(atoms: DataFrame, truth: DataFrame, cutoff: float = 4.5) -> DataFrame:
    """Hetero residues with class, residues of the chains in contact, how many of them are true site keys, and a recommendation.

    ``truth`` has structure and key.  Ions, glycans and solvents are excluded; the
    others are recommended with a true contact and left to review with any.
    """
    het = atoms.filter("record = 'HETATM'").select("structure", F.struct("chain", "resname", "resseq").alias("residue"), "x", "y", "z")
    chains = atoms.filter("record = 'ATOM'").select("structure", atom_key().alias("key"), "x", "y", "z")
    near = distance_join(het, chains, cutoff, ["residue"], ["key"]).select("structure", "residue", "key").distinct()
    near = near.join(truth.select("structure", "key", F.lit(True).alias("true")).distinct(), ["structure", "key"], "left")
    met = near.groupBy("structure", "residue.chain", "residue.resname", "residue.resseq").agg(F.count("*").alias("n_contacts"), F.count("true").alias("n_truth"))
    d = ligand_classes(atoms).join(met, ["structure", "chain", "resname", "resseq"], "left").fillna(0, ["n_contacts", "n_truth"])
    pick = F.when(F.col("class") != "ligand_like", "exclude").when(F.col("n_truth") > 0, "recommended").when(F.col("n_contacts") > 0, "review").otherwise("no_contact")
    return d.withColumn("recommendation", pick)
