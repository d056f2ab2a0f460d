"""The whole feature row of structures, from their atoms, and the way from there to a ranking.

Distances come from two passes in which the points of a structure meet atoms of the
same structure, one task for each structure and set of atoms, over a k-d tree: first
all that is known at once, then the samples that depend on the inferred mouth.  A
structure is one file of at most 99,999 atoms, so a task stays small.  All else are
plain plans over these distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.columns import clip, flags, joined, ratio
from screenspark.functions.nearest import Tree
from screenspark.operators import cavity, scoring
from screenspark.operators.residues import match_residues, residue_struct
from screenspark.operators.spatial import exposure_score, in_mouth, mouth_scores, split_roles
from screenspark.plans.staging import stage
from screenspark.sources import structures

XYZ = ("x", "y", "z")
#: Radius and number of neighbours of the exposure, and shares of a site that its mouth takes for occlusion and for paths.
EXPOSURE_RADIUS, EXPOSURE_NEIGHBOURS, MOUTH_SHARE, PATH_SHARE = 8.0, 24, 0.30, 0.35
DISTANCES = "structure string, ref string, kind string, pt long, dist double, knn double, near long"


def point_distances(points: DataFrame, atoms: DataFrame, radius: float = EXPOSURE_RADIUS, k: int = EXPOSURE_NEIGHBOURS) -> DataFrame:
    """Distance of points (structure, ref, kind, pt, x, y, z) to the nearest of the atoms (structure, ref, x, y, z) of one structure and set.

    Returns ``structure, ref, kind, pt, dist``, and ``knn`` and ``near``, the mean
    distance of the k nearest atoms and their number within the radius.  A point
    without atoms, or without coordinates, has no distance.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        xyz = lambda t: np.stack([t.column(c).to_numpy().astype(np.float64) for c in XYZ], axis=1)
        q, p = xyz(left), xyz(right)
        p, good = p[np.isfinite(p).all(axis=1)], np.isfinite(q).all(axis=1)
        dist, knn, near = np.full(len(q), np.nan), np.full(len(q), np.nan), np.zeros(len(q), np.int64)
        if len(p) and good.any():
            many = left.column("kind").to_pylist()[0] == "residue"
            most = min(k, len(p)) if many else 1
            best, within = Tree(p).nearest(q[good], most, radius if many else 0.0)
            dist[good], knn[good], near[good] = best[:, 0], best.mean(axis=1), within
        gone = np.isnan(dist)
        out = {"structure": left.column("structure"), "ref": left.column("ref"), "kind": left.column("kind"), "pt": left.column("pt")}
        return pa.table(out | {"dist": pa.array(dist, mask=gone), "knn": pa.array(knn, mask=gone), "near": pa.array(near)})

    where = ("structure", "ref", "kind")
    kinds = points.select(*where).distinct()
    sets = atoms.select("structure", "ref", *XYZ).join(kinds.toDF(*where), ["structure", "ref"])
    sets = sets.toDF(*sets.columns)  # own columns, as both sides may come from one table
    return points.select(*where, "pt", *XYZ).groupBy(*where).cogroup(sets.groupBy(*where)).applyInArrow(run, DISTANCES)


def tagged(points: DataFrame, ref: str, kind: str, pt: Column | str) -> DataFrame:
    return points.select("structure", F.lit(ref).alias("ref"), F.lit(kind).alias("kind"), (F.col(pt) if isinstance(pt, str) else pt).cast("long").alias("pt"), *XYZ)


def pick(distances: DataFrame, ref: str, kind: str, pt: str, *columns: tuple[str, str]) -> DataFrame:
    """The distances of one kind of points: structure, the point's id as ``pt``, and columns under new names."""
    return distances.filter((F.col("ref") == ref) & (F.col("kind") == kind)).select("structure", F.col("pt").alias(pt), *(F.col(c).alias(n) for c, n in columns))


def label_of(radius: float) -> str:
    return f"{radius:g}".replace(".", "p")


def shell_columns(radii: tuple[float, ...], primary: float, cutoff: float) -> list[Column]:
    """Aggregates over residues (``to_anchor``, ``to_partner``, ``in_site``) for each shell, and the keys and overlap of the primary one."""
    out = []
    for r in radii:
        inside, name = F.col("to_anchor") <= r, f"shell_{label_of(r)}"
        out += [F.count_if(inside).alias(f"{name}_count"), F.count_if(inside & (F.col("to_partner") <= cutoff)).alias(f"{name}_hits"), F.min(F.when(inside, F.col("to_partner"))).alias(f"{name}_distance")]
    inside = F.col("to_anchor") <= primary
    keys = F.array_sort(F.collect_list(F.when(inside, F.struct(residue_struct("key").alias("o"), F.col("key").alias("k")))))
    out += [F.count_if(inside & F.col("in_site")).alias("shell_site_overlap"), F.array_join(F.transform(keys, lambda x: x["k"]), ";").alias("shell_keys")]
    return out


def item_features(
    items: DataFrame, atoms: DataFrame, site: DataFrame, anchors: DataFrame | None = None, ligand: DataFrame | None = None, extra: DataFrame | None = None,
    cutoff: float = 4.5, anchor_cutoff: float = 4.5, clash: float = 2.8, interface: float = 6.0, path_radius: float = 3.0, min_hits: int = 1,
    radii: tuple[float, ...] = (4.0, 6.0, 8.0), primary: float = 6.0, mouth_share: float = MOUTH_SHARE, path_share: float = PATH_SHARE,
) -> DataFrame:
    """One row of about 80 features for each structure of ``items``; what a structure lacks fails or warns in its own row and in no other.

    ``atoms`` has structure, role (target or partner), key (of the residue), n (order
    in the residue), x, y, z: heavy atoms.  ``site`` and ``anchors`` have structure and
    key (matched keys of the target), ``ligand`` structure, x, y, z, ``extra`` structure
    and further numbers (energies and the like).  ``status`` is failed where the target
    or the partner is missing (``error``: no_target, no_partner; features NULL), else
    ok; ``warning`` names no_site, no_anchor and no_ligand.  Counts of what is missing
    are 0, shares and distances NULL.  Repeated keys count once, repeated structures
    are one row, and an empty table gives no rows.
    """
    radii = tuple(sorted({*map(float, radii), float(primary)}))
    every = items.select(F.col("structure").cast("string").alias("structure")).distinct()
    text = lambda d: d.withColumn("structure", F.col("structure").cast("string"))
    none = lambda cols: items.sparkSession.createDataFrame([], cols)
    site, anchors = (text(d).select("structure", "key").distinct() if d is not None else none("structure string, key string") for d in (site, anchors))
    site, anchors = (d.withColumn("key", F.col("key").cast("string")) for d in (site, anchors))
    ligand = text(ligand).select("structure", *XYZ).withColumn("lid", F.monotonically_increasing_id()) if ligand is not None else none("structure string, x double, y double, z double, lid long")
    ligand = stage(ligand, "ligand")
    marked = text(atoms).select("structure", "role", F.col("key").cast("string").alias("key"), "n", *XYZ).join(every, "structure", "left_semi")
    for keys, flag in ((site, "in_site"), (anchors, "in_anchor")):
        marked = marked.join(keys.withColumn(flag, F.lit(True)), ["structure", "key"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)) & (F.col("role") == "target"))
    marked = stage(marked.withColumn("aid", F.monotonically_increasing_id()), "atoms")
    target, partner = marked.filter("role = 'target'"), marked.filter("role = 'partner'")

    # Residues, the site's centre (over its atoms) and its local points.
    residues = target.groupBy("structure", "key").agg(*(F.avg(c).alias(c) for c in XYZ), F.min("aid").alias("rid"), F.any_value("in_site").alias("in_site"), F.any_value("in_anchor").alias("in_anchor"))
    residues = stage(residues, "residues")
    sites = residues.filter("in_site").select("structure", F.col("key").alias("id"), "rid", *XYZ)
    middle = stage(cavity.centre(target.filter("in_site"), "c"), "centres")
    local = stage(cavity.site_points(sites.drop("rid"), target.filter("in_site").select("structure", F.col("key").alias("id"), "n", *XYZ), middle=middle), "local")

    # First pass.
    sets = partner.withColumn("ref", F.lit("partner")).unionByName(target.withColumn("ref", F.lit("target"))).unionByName(target.filter("in_anchor").withColumn("ref", F.lit("anchor")))
    centres = middle.select("structure", *(F.col(f"c{c}").alias(c) for c in XYZ))
    points = [
        tagged(target, "partner", "atom", "aid"), tagged(ligand, "partner", "ligand", "lid"), tagged(centres, "partner", "centre", F.lit(0)), tagged(local, "partner", "local", "pt"),
        tagged(sites, "target", "residue", "rid"), tagged(target, "anchor", "atom", "aid"), tagged(partner, "target", "partner", "aid"),
    ]
    first = points[0]
    for p in points[1:]:
        first = first.unionByName(p)
    first = stage(point_distances(first, sets), "distances")

    # Mouths, for occlusion and for paths, and the samples of the second pass.
    exposed = sites.join(pick(first, "target", "residue", "rid", ("knn", "knn"), ("near", "near")), ["structure", "rid"], "left")
    exposed = exposed.select("structure", "id", exposure_score(F.col("knn"), F.col("near"), EXPOSURE_RADIUS).alias("exposure"))
    scored = stage(mouth_scores(sites.drop("rid"), exposed, middle=middle), "mouths")
    mouths = {}
    for name, share in (("mouth", mouth_share), ("path", path_share)):
        mouth = sites.join(scored.filter(in_mouth(share)).select("structure", "id", F.col("mouth_score").alias("weight")), ["structure", "id"])
        outline = target.join(mouth.select("structure", F.col("id").alias("key")), ["structure", "key"], "left_semi")
        mouths[name] = mouth, stage(cavity.mouth_geometry(sites, mouth, middle, outline), "geometry")
    samples = stage(cavity.mouth_samples(mouths["mouth"][1]), "samples")
    ways = cavity.exits(mouths["path"][1], mouths["path"][0]).join(cavity.centre(ligand, "s"), "structure")
    ways = stage(ways, "paths")
    along = stage(cavity.path_samples(ways), "samples")
    second = tagged(samples, "partner", "sample", "pt").unionByName(tagged(along, "partner", "path", "pt"))
    second = stage(point_distances(second, sets.filter("ref = 'partner'")), "distances")
    with_dist = lambda d, found, kind, pt: d.join(pick(found, "partner", kind, pt, ("dist", "dist")), ["structure", pt], "left")

    # Distances of atoms and residues.
    near = target.join(pick(first, "partner", "atom", "aid", ("dist", "to_partner")), ["structure", "aid"], "left").join(pick(first, "anchor", "atom", "aid", ("dist", "to_anchor")), ["structure", "aid"], "left")
    box = F.lit(1.0)
    for c in XYZ:
        v = F.when(F.col("in_site"), F.col(c))
        box = box * (F.max(v) - F.min(v))
    of_atoms = near.groupBy("structure").agg(F.count_if(F.col("in_site") & (F.col("to_partner") <= cutoff)).alias("site_contacts"), box.alias("site_volume"))
    near = near.groupBy("structure", "key").agg(F.min("to_partner").alias("to_partner"), F.min("to_anchor").alias("to_anchor"), F.any_value("in_site").alias("in_site"), F.any_value("in_anchor").alias("in_anchor"))
    near = stage(near, "residues")
    hit = lambda flag, most: F.count_if(F.col(flag) & (F.col("to_partner") <= most))
    mine = lambda flag: F.when(F.col(flag), F.col("to_partner"))
    d = near.groupBy("structure").agg(
        F.count("*").alias("n_target"), F.count_if("in_site").alias("n_site"), F.count_if("in_anchor").alias("n_anchor"), hit("in_site", cutoff).alias("site_hits"), hit("in_anchor", anchor_cutoff).alias("anchor_hits"),
        F.min(mine("in_site")).alias("site_distance"), F.avg(mine("in_site")).alias("site_mean_distance"), F.min(mine("in_anchor")).alias("anchor_distance"), *shell_columns(radii, primary, cutoff),
    )
    c = F.col
    d = d.join(of_atoms, "structure").withColumn("site_hit_fraction", ratio("site_hits", "n_site")).withColumn("anchor_hit_fraction", ratio("anchor_hits", "n_anchor")).withColumn("anchor_block", (c("anchor_hits") >= min_hits).cast("double"))
    for r in radii:
        name = f"shell_{label_of(r)}"
        d = d.withColumn(f"{name}_fraction", F.when(c("n_anchor") > 0, ratio(f"{name}_count", "n_target"))).withColumn(f"{name}_hit_fraction", ratio(f"{name}_hits", f"{name}_count"))
    main = f"shell_{label_of(float(primary))}"
    d = d.withColumn("shell_radius", F.lit(float(primary)))
    for x in ("count", "fraction", "hits", "hit_fraction", "distance"):
        d = d.withColumn(f"shell_{x}", c(f"{main}_{x}"))
    shared = (c("n_site") > 0) & (c("shell_count") > 0)
    d = d.withColumn("shell_overlap", F.when(shared, ratio("shell_site_overlap", "shell_count"))).withColumn("site_overlap", F.when(shared, ratio("shell_site_overlap", "n_site")))
    wide = 0.45 * clip((c("shell_count") - 24) / 48, 0, 1) + 0.40 * clip((c("shell_fraction") - 0.18) / 0.32, 0, 1) + 0.15 * clip(F.lit((primary - 6) / 6), 0, 1)
    d = d.withColumn("shell_overwide", F.when(c("n_anchor") > 0, wide)).withColumn("shell_overwide_flag", F.coalesce(c("shell_overwide") >= 0.55, F.lit(False)).cast("double"))

    # Shape, centre, mouth, occupancy, clash and paths.
    spread = sites.join(cavity.centre(sites, "k"), "structure").withColumn("_r", cavity.norm(cavity.minus(cavity.vector(""), cavity.vector("k"))))
    shape = spread.groupBy("structure").agg(F.avg("_r").alias("radius_mean"), F.percentile("_r", F.lit(0.9)).alias("radius_p90"), F.max("_r").alias("radius_max"))
    faces = partner.join(pick(first, "target", "partner", "aid", ("dist", "dist")), ["structure", "aid"], "left")
    of_partner = faces.groupBy("structure").agg(F.countDistinct("key").alias("n_partner"), *(F.avg(x).alias(f"p{x}") for x in XYZ), *(F.avg(F.when(c("dist") <= interface, c(x))).alias(f"f{x}") for x in XYZ))
    gap = lambda p: cavity.norm(cavity.minus(cavity.vector(p), cavity.vector("c")))
    centred = of_partner.join(middle, "structure", "left").join(pick(first, "partner", "centre", "_0", ("dist", "centre_distance")), "structure", "left")
    centred = centred.select("structure", "n_partner", "centre_distance", gap("p").alias("centre_to_partner"), gap("f").alias("centre_to_interface"))
    rows = mouths["mouth"][0].join(near.select("structure", F.col("key").alias("id"), F.col("to_partner").alias("dist")), ["structure", "id"])
    mouth = cavity.occlusion_scores(mouths["mouth"][1], with_dist(samples, second, "sample", "pt"), rows, cutoff)
    mouth = mouth.select("structure", c("n_hit").alias("mouth_hits"), c("hit_fraction").alias("mouth_hit_fraction"), c("occlusion").alias("mouth_occlusion"), c("axis_block").alias("mouth_axis_block"), c("aperture_block").alias("mouth_aperture_block"), c("clearance").alias("mouth_clearance"))
    occupied = cavity.occupancy_scores(with_dist(local, first, "local", "pt"), middle, clash)
    occupied = occupied.select("structure", "access_delta", "occupancy_delta", "blocked_volume", c("n_points").alias("local_points"), c("n_occupied").alias("local_occupied"))
    soft = F.coalesce(clip(1 - c("dist") / (clash + 1.2), 0, 1), F.lit(0.0))
    lig = with_dist(ligand, first, "ligand", "lid").groupBy("structure").agg(F.count("*").alias("n_ligand"), F.count_if(c("dist") <= clash).alias("clash_count"), F.avg(soft).alias("overlap_score"))
    lig = lig.withColumn("clash_fraction", ratio("clash_count", "n_ligand"))
    paths = cavity.path_scores(ways, with_dist(along, second, "path", "pt"), partner, path_radius).withColumn("n_path_samples", c("n_exits") * cavity.PATH_SAMPLES)
    d = every.join(d, "structure", "left")
    for part in (shape, centred, mouth, occupied, lig, paths):
        d = d.join(part, "structure", "left")
    shares = [x for x in ("path_score", "path_fraction", "path_fraction_weighted", "path_bottleneck", "path_exit_fraction")]
    counts = [f.name for f in d.schema if f.name.startswith("n_") or f.name.endswith(("_hits", "_count", "_contacts", "_overlap", "_points", "_occupied")) and f.name not in ("shell_overlap", "site_overlap")]
    d = d.fillna(0, counts).fillna(0.0, ["anchor_block", "shell_overwide_flag"]).fillna("", ["shell_keys"])
    d = d.withColumns({x: F.when(c("n_ligand") > 0, F.coalesce(x, F.lit(0.0))) for x in shares})
    narrow = 0.45 * clip((c("n_site") - 12) / 24, 0, 1) + 0.35 * F.coalesce(clip((c("radius_p90") - 9) / 12, 0, 1), F.lit(0.0)) + 0.20 * F.coalesce(clip((F.log1p("site_volume") - 6) / 3, 0, 1), F.lit(0.0))
    d = d.withColumn("overwide", F.when(c("n_site") > 0, clip(narrow, 0, 1))).withColumn("tightness", 1 - c("overwide"))
    d = d.withColumns({f"has_{x}": (c(f"n_{x}") > 0).cast("double") for x in ("site", "anchor", "ligand")})

    # Failures and warnings, and what comes from elsewhere.
    if extra is not None:
        d = d.join(text(extra), "structure", "left")
    names = [x for x in d.columns if x != "structure" and (extra is None or x not in extra.columns)]
    error = joined(flags(("no_target", c("n_target") == 0), ("no_partner", c("n_partner") == 0)), "", ",")
    warning = joined(flags(("no_site", c("n_site") == 0), ("no_anchor", c("n_anchor") == 0), ("no_ligand", c("n_ligand") == 0)), "", ",")
    d = d.withColumn("error", error).withColumn("warning", warning).withColumn("has_warning", c("warning") != "").withColumn("status", F.when(c("error") != "", "failed").otherwise("ok"))
    failed = c("status") == "failed"
    return d.withColumns({x: F.when(~failed, c(x)) for x in names})


def features_from_text(lines: DataFrame, site: DataFrame, anchors: DataFrame | None = None, roles: dict[str, str] | None = None, ligand_names: list[str] | None = None, **settings) -> DataFrame:
    """Feature rows from structure text (file, line_no, line): atoms, alternate locations, roles of chains and matched keys.

    ``site`` and ``anchors`` have structure (the file) and wanted keys, which are
    matched to the target's residues.  ``roles`` names the role of each chain; without
    it chains are split by size.  Residues named in ``ligand_names`` are the ligand.
    """
    every = lines.select(F.col("file").alias("structure")).distinct()
    found = stage(structures.select_altloc(structures.parse_atoms(lines)).withColumn("key", structures.atom_key()), "parsed")
    protein = found.filter("record = 'ATOM'")
    if roles is None:
        chains = split_roles(protein.select("structure", "chain", "key").distinct()).select("structure", "chain", "role")
        protein = protein.join(chains, ["structure", "chain"])
    else:
        named = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
        protein = protein.withColumn("role", F.get(F.array(F.try_element_at(named, F.col("chain"))), F.lit(0)))
    atoms = protein.filter("role IN ('target', 'partner')").select("structure", "role", "key", F.col("line_no").alias("n"), *XYZ)
    residues = atoms.filter("role = 'target'").select("structure", "key").distinct()
    matched = lambda keys: match_residues(keys, residues).filter("matched_key IS NOT NULL").select("structure", F.col("matched_key").alias("key"))
    ligand = structures.read_ligand(found, ligand_names) if ligand_names else None
    return item_features(every, atoms, matched(site), matched(anchors) if anchors is not None else None, ligand, **settings)


def rank_structures(items: DataFrame, features: DataFrame, k: int = 3) -> DataFrame:
    """Ranked candidates from items (candidate, variant, item, structure) and their structures' features.

    Failed structures are left out as long as any is ok.
    """
    used = [x for x in dict.fromkeys([*scoring.RULE_FEATURES, *scoring.GEOMETRY_WEIGHTS, *scoring.CONSISTENCY_WEIGHTS, "overwide"]) if x in features.columns]
    d = items.select("candidate", "variant", "item", F.col("structure").cast("string").alias("structure")).join(features.select("structure", "status", *used), "structure")
    return scoring.rank_candidates(d, k)
