"""Distance joins over points of structures, and features from them.

Points have ``structure, x, y, z`` and an id.  Bounded joins go over grid cells:
an equi-join on (structure, cell) with the neighbouring cells of one side, then the
exact distance; nothing is compared across distant cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clip, ratio
from screenspark.plans.staging import stage


def distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in "xyz"), F.lit(0.0)))


def distance_join(a: DataFrame, b: DataFrame, cutoff: float | str, keep_a: list[str], keep_b: list[str]) -> DataFrame:
    """Pairs of points of one structure within ``cutoff``, with ``dist``; ``b`` is the side whose neighbouring cells are listed.

    The cutoff is a number, or the name of a column that both sides have and that is
    one value for each structure.
    """
    size = F.lit(float(cutoff)) if not isinstance(cutoff, str) else F.col(cutoff)
    cell = [F.floor(F.col(c) / size) for c in "xyz"]
    left = a.select("structure", *keep_a, "x", "y", "z", size.alias("_size"), *(e.alias(f"c{c}") for e, c in zip(cell, "xyz", strict=True)))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    right = b.select("structure", *keep_b, "x", "y", "z", F.explode(steps).alias("_s"), *(e.alias(f"_c{c}") for e, c in zip(cell, "xyz", strict=True)))
    right = right.select("structure", *keep_b, "x", "y", "z", *((F.col(f"_c{c}") + F.col(f"_s.{s}")).alias(f"c{c}") for c, s in zip("xyz", "ijk", strict=True)))
    p = left.alias("a").join(right.alias("b"), ["structure", "cx", "cy", "cz"])
    p = p.select("structure", *(F.col(f"a.{c}") for c in keep_a), *(F.col(f"b.{c}") for c in keep_b), distance().alias("dist"), "_size")
    return p.filter(F.col("dist") <= F.col("_size")).drop("_size")


def staged_points(points: DataFrame, pid: str) -> DataFrame:
    """Points as a table in the shared folder, for several nearest joins against them."""
    return stage(points.select("structure", pid, *"xyz"), "points")


def search_radii(a: DataFrame, b: DataFrame, radius: float | None) -> DataFrame:
    """``structure, radius, across`` of structures with points on both sides: where the search begins, and where it has seen all.

    The first radius is given or follows from the density of ``b`` in the middle of
    its structure (between the tenth and ninetieth percentile of each coordinate), so
    neither another structure nor a far point of its own widens it.
    """
    ends = lambda p: [f(c).alias(f"{p}{c}{n}") for c in "xyz" for n, f in enumerate((F.min, F.max))]
    middle = [F.percentile_approx(c, [0.1, 0.9]).alias(f"_m{c}") for c in "xyz"]
    box = b.groupBy("structure").agg(F.count("*").alias("_n"), *ends("b"), *middle).join(a.groupBy("structure").agg(*ends("a")), "structure")
    span = [F.greatest(f"a{c}1", f"b{c}1") - F.least(f"a{c}0", f"b{c}0") for c in "xyz"]
    across = F.greatest(F.lit(1e-6), F.sqrt(sum((w * w for w in span), F.lit(0.0))))
    inner = F.sqrt(sum((F.pow(F.col(f"_m{c}")[1] - F.col(f"_m{c}")[0], 2) for c in "xyz"), F.lit(0.0))) / 0.8
    first = F.lit(float(radius)) if radius is not None else F.greatest(F.lit(1e-6), across / 2**20, F.least(across, inner) / F.greatest(F.lit(1.0), F.cbrt("_n")))
    return stage(box.select("structure", first.alias("radius"), across.alias("across")), "radii")


def nearest_join(a: DataFrame, b: DataFrame, id_a: str, id_b: str, radius: float | None = None) -> DataFrame:
    """The nearest point of ``b`` in the structure for every point of ``a``: ``structure, id_a, id_b, dist``; ties to the smaller id.

    The grid is searched at a radius of each structure, which doubles, each time only
    for the points that found nothing yet, so no structure is compared as a whole.
    ``b`` may be what ``staged_points`` gave.  Points without coordinates find nothing.
    """
    b = b if getattr(b, "staged_path", None) else staged_points(b, id_b)
    radii = search_radii(a, b, radius)
    left = a.select("structure", id_a, *"xyz").join(radii, "structure")
    found, scale = None, 1.0
    while True:
        wide = b.join(radii, "structure").withColumn("radius", F.col("radius") * scale)
        pairs = distance_join(left.withColumn("radius", F.col("radius") * scale), wide, "radius", [id_a], [id_b])
        best = pairs.groupBy("structure", id_a).agg(F.min(F.struct("dist", id_b)).alias("_m"))
        met = stage(left.join(best, ["structure", id_a], "left"), "met")
        near = met.filter("_m IS NOT NULL").select("structure", id_a, F.col(f"_m.{id_b}").alias(id_b), F.col("_m.dist").alias("dist"))
        found = near if found is None else found.unionByName(near)
        left = met.filter(F.col("_m").isNull() & (F.col("radius") * scale < F.col("across"))).drop("_m")
        if left.isEmpty():
            return found
        scale *= 2


def site_contact(site: DataFrame, partner: DataFrame, cutoff: float = 4.5) -> DataFrame:
    """Hits of site points (structure, id) by the partner: count, share, contacts, least and mean least distance."""
    near = nearest_join(site, partner, "id", "pid")
    contacts = distance_join(site, partner, cutoff, ["id"], ["pid"]).groupBy("structure").agg(F.count("*").alias("n_contacts"))
    g = near.groupBy("structure").agg(F.count("*").alias("n_site"), F.count_if(F.col("dist") <= cutoff).alias("n_hit"), F.min("dist").alias("min_distance"), F.avg("dist").alias("mean_min_distance"))
    return g.join(contacts, "structure", "left").withColumn("n_contacts", F.coalesce("n_contacts", F.lit(0))).withColumn("hit_fraction", ratio("n_hit", "n_site")).withColumn("blocked", F.col("n_hit") > 0)


def anchor_shells(target: DataFrame, anchor: DataFrame, partner: DataFrame, radii: list[float], cutoff: float = 4.5) -> DataFrame:
    """Shells of target points around anchors at several radii; distances are computed once."""
    to_anchor = nearest_join(target, anchor, "id", "aid").select("structure", "id", F.col("dist").alias("to_anchor"))
    hit = nearest_join(target, partner, "id", "pid").select("structure", "id", F.col("dist").alias("to_partner"))
    grid = target.sparkSession.createDataFrame([(float(r),) for r in radii], "radius double")
    d = to_anchor.join(hit, ["structure", "id"], "left")
    total = d.groupBy("structure").agg(F.count("*").alias("n_target"))
    g = d.crossJoin(F.broadcast(grid)).filter(F.col("to_anchor") <= F.col("radius")).groupBy("structure", "radius").agg(F.count("*").alias("n_shell"), F.count_if(F.col("to_partner") <= cutoff).alias("n_hit"), F.min("to_partner").alias("min_distance"))
    g = g.join(total, "structure").withColumn("fraction", F.col("n_shell") / F.col("n_target")).withColumn("hit_fraction", ratio("n_hit", "n_shell"))
    wide = 0.45 * clip((F.col("n_shell") - 24) / 48, 0, 1) + 0.40 * clip((F.col("fraction") - 0.18) / 0.32, 0, 1) + 0.15 * clip((F.col("radius") - 6) / 6, 0, 1)
    return g.withColumn("overwide", wide).withColumn("overwide_flag", F.col("overwide") >= 0.55)


def site_shape(site: DataFrame) -> DataFrame:
    """Extent of a site: radii about its centroid, bounding box and over-wide proxy."""
    c = site.groupBy("structure").agg(*(F.avg(x).alias(f"c{x}") for x in "xyz"))
    d = site.join(c, "structure").withColumn("_r", F.sqrt(sum((F.pow(F.col(x) - F.col(f"c{x}"), 2) for x in "xyz"), F.lit(0.0))))
    box = lambda x: F.max(x) - F.min(x)
    g = d.groupBy("structure").agg(F.count("*").alias("n"), F.avg("_r").alias("radius_mean"), F.percentile("_r", F.lit(0.9)).alias("radius_p90"), F.max("_r").alias("radius_max"), (box("x") * box("y") * box("z")).alias("volume"))
    wide = 0.45 * clip((F.col("n") - 12) / 24, 0, 1) + 0.35 * clip((F.col("radius_p90") - 9) / 12, 0, 1) + 0.20 * clip((F.log1p("volume") - 6) / 3, 0, 1)
    return g.withColumn("overwide", wide).withColumn("tightness", 1 - F.col("overwide"))


def site_centre(site: DataFrame, partner: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Distances from a site's centroid to the nearest partner point, the partner centroid and the interface centroid."""
    mean = lambda d, p: d.groupBy("structure").agg(*(F.avg(x).alias(f"{p}{x}") for x in "xyz"))
    c = mean(site, "s")
    near = partner.join(c, "structure").withColumn("_d", F.sqrt(sum((F.pow(F.col(x) - F.col(f"s{x}"), 2) for x in "xyz"), F.lit(0.0)))).groupBy("structure").agg(F.min("_d").alias("nearest"))
    touching = distance_join(partner, site, cutoff, ["pid"], ["id"]).select("structure", "pid").distinct()
    face = mean(partner.join(touching, ["structure", "pid"], "left_semi"), "f")
    gap = lambda p: F.sqrt(sum((F.pow(F.col(f"s{x}") - F.col(f"{p}{x}"), 2) for x in "xyz"), F.lit(0.0)))
    d = c.join(near, "structure", "left").join(mean(partner, "p"), "structure", "left").join(face, "structure", "left")
    return d.select("structure", "nearest", gap("p").alias("to_partner"), gap("f").alias("to_interface"))


def exposure(points: DataFrame, radius: float = 8.0, k: int = 24) -> DataFrame:
    """How exposed points are: few neighbours within the radius and far nearest neighbours."""
    other = points.select("structure", F.col("id").alias("oid"), "x", "y", "z")
    p = distance_join(points, other, radius, ["id"], ["oid"]).filter("id <> oid")
    w = Window.partitionBy("structure", "id").orderBy("dist", "oid")
    g = p.withColumn("_r", F.row_number().over(w)).groupBy("structure", "id").agg(F.count("*").alias("n_near"), F.avg(F.when(F.col("_r") <= k, F.col("dist"))).alias("knn"))
    d = points.select("structure", "id").join(g, ["structure", "id"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    knn = F.coalesce("knn", F.lit(float(radius)))
    return d.withColumn("exposure", 0.55 * clip(knn / radius, 0, 1) + 0.45 / (1 + 32 * F.col("n_near") / radius**3))


def contact_site(ligand: DataFrame, target: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Keys of the target within each cutoff of a ligand; the least distance is computed once."""
    d = distance_join(target, ligand, max(cutoffs), ["key"], ["lid"]).groupBy("structure", "key").agg(F.min("dist").alias("dist"))
    grid = target.sparkSession.createDataFrame([(float(c),) for c in cutoffs], "cutoff double")
    return d.crossJoin(F.broadcast(grid)).filter("dist <= cutoff")


def near_accuracy(truth: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    """Accuracy by nearness: shares of truth and predicted points within a threshold of the other, and an over-wide score."""
    t = nearest_join(truth, predicted.withColumnRenamed("id", "oid"), "id", "oid").groupBy("structure").agg(F.count("*").alias("n_truth"), F.avg((F.col("dist") <= threshold).cast("double")).alias("near_coverage"), F.avg("dist").alias("mean_distance"), F.median("dist").alias("median_distance"))
    p = nearest_join(predicted, truth.withColumnRenamed("id", "oid"), "id", "oid").groupBy("structure").agg(F.count("*").alias("n_predicted"), F.avg((F.col("dist") <= threshold).cast("double")).alias("near_precision"), F.avg((F.col("dist") > 0).cast("double")).alias("extra"))
    d = t.join(p, "structure")
    return d.withColumn("overwide", 0.45 * F.col("extra") + 0.35 * (1 - F.col("near_precision")) + 0.20 * clip((F.col("n_predicted") / F.col("n_truth") - 1) / 3, 0, 1))


def annotate(points: DataFrame, site: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Every point (structure, id, role) with its nearest point of the other role and its site and interface flags."""
    a, b = (points.filter(F.col("role") == r) for r in ("target", "partner"))
    one = nearest_join(a, b.withColumnRenamed("id", "nearest"), "id", "nearest", cutoff)
    two = nearest_join(b, a.withColumnRenamed("id", "nearest"), "id", "nearest", cutoff)
    flag = site.select("structure", "id", F.lit(True).alias("in_site")).distinct()
    d = points.select("structure", "id", "role").join(one.unionByName(two), ["structure", "id"], "left").join(flag, ["structure", "id"], "left")
    return d.withColumn("in_site", F.coalesce("in_site", F.lit(False))).withColumn("interface", F.coalesce(F.col("dist") <= cutoff, F.lit(False)))


def split_roles(points: DataFrame, max_partner: int = 220) -> DataFrame:
    """Role of each chain: of two, the smaller is the partner; of more, the smallest if it is small enough, else none is known."""
    g = points.groupBy("structure", "chain").agg(F.count("*").alias("n"))
    w = Window.partitionBy("structure").orderBy("n", "chain")
    all_ = Window.partitionBy("structure")
    g = g.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("n").over(w)).withColumn("_c", F.count("*").over(all_)).withColumn("_min", F.min("n").over(all_)).withColumn("_second", F.max(F.when(F.col("_r") == 1, F.col("_next"))).over(all_))
    known = (F.col("_c") == 2) | (F.col("_c") > 2) & (F.col("_min") <= max_partner) & (F.col("_min") <= F.round(0.75 * F.col("_second")))
    return g.select("structure", "chain", "n", F.when(~known, "unknown").when(F.col("_r") == 1, "partner").otherwise("target").alias("role"))


def ligand_clash(ligand: DataFrame, partner: DataFrame, threshold: float = 2.8) -> DataFrame:
    """Clashing ligand points (structure, id) of each structure, and soft overlap with the partner (1.2 beyond the threshold)."""
    near = nearest_join(ligand, partner, "id", "pid")
    d = ligand.select("structure", "id").join(near.select("structure", "id", "dist"), ["structure", "id"], "left")
    soft = F.coalesce(clip(1 - F.col("dist") / (threshold + 1.2), 0, 1), F.lit(0.0))
    g = d.groupBy("structure").agg(F.count("*").alias("n_ligand"), F.count_if(F.col("dist") <= threshold).alias("n_clash"), F.avg(soft).alias("overlap_score"))
    return g.withColumn("clash_fraction", F.col("n_clash") / F.col("n_ligand"))


def mouth_scores(site: DataFrame, exposed: DataFrame, radius: float = 7.5, middle: DataFrame | None = None) -> DataFrame:
    """``structure, id, n, radial, surface, mouth_score, place`` of site points: far from the centre, few site neighbours, exposed.

    ``exposed`` has structure, id and exposure; ``middle`` (structure, c*) the centres,
    where these are not the means of the points.  Places go by score; ties to the smaller id.
    """
    w = Window.partitionBy("structure")
    c = site.groupBy("structure").agg(*(F.avg(x).alias(f"c{x}") for x in "xyz")) if middle is None else middle
    d = site.join(c, "structure").withColumn("_r", F.round(F.sqrt(sum((F.pow(F.col(x) - F.col(f"c{x}"), 2) for x in "xyz"), F.lit(0.0))), 9))
    d = d.withColumn("n", F.count("*").over(w)).withColumn("radial", F.when(F.col("n") > 1, (F.row_number().over(w.orderBy("_r", "id")) - 1) / (F.col("n") - 1)).otherwise(0.0))
    other = site.select("structure", F.col("id").alias("oid"), "x", "y", "z")
    near = distance_join(site, other, radius, ["id"], ["oid"]).filter("dist > 1e-8").groupBy("structure", "id").agg(F.count("*").alias("_k"))
    d = d.join(near, ["structure", "id"], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    d = d.withColumn("surface", 1 - F.col("_k") / F.greatest(F.max("_k").over(w), F.lit(1)))
    d = d.join(exposed.select("structure", "id", "exposure"), ["structure", "id"], "left")
    d = d.withColumn("mouth_score", 0.50 * F.col("radial") + 0.30 * F.col("surface") + 0.20 * clip("exposure", 0, 1))
    place = F.row_number().over(w.orderBy(F.desc(F.round("mouth_score", 9)), "id"))
    return d.select("structure", "id", "n", "radial", "surface", "mouth_score", place.alias("place"))


def in_mouth(share: float) -> Column:
    """Whether a place is among the top share of its structure, one at least."""
    return F.col("place") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))


def exposure_score(knn: Column, near: Column, radius: float) -> Column:
    """How exposed a point is: far nearest neighbours, and few within the radius."""
    return 0.55 * clip(F.coalesce(knn, F.lit(float(radius))) / radius, 0, 1) + 0.45 / (1 + 32 * F.coalesce(near, F.lit(0)) / radius**3)


def mouth_residues(site: DataFrame, context: DataFrame, share: float = 0.30, radius: float = 7.5, exposure_radius: float = 8.0, k: int = 24) -> DataFrame:
    """The site points (structure, id) nearest the mouth: the top share by score, one at least.

    ``context`` has the target's points (structure, cid), of which those within the
    radius count for the exposure.
    """
    crowd = distance_join(site, context, exposure_radius, ["id"], ["cid"])
    crowd = crowd.withColumn("_o", F.row_number().over(Window.partitionBy("structure", "id").orderBy("dist", "cid"))).groupBy("structure", "id").agg(F.count("*").alias("_c"), F.avg(F.when(F.col("_o") <= k, F.col("dist"))).alias("_knn"))
    exposed = site.select("structure", "id").join(crowd, ["structure", "id"], "left").withColumn("exposure", exposure_score(F.col("_knn"), F.col("_c"), exposure_radius))
    d = mouth_scores(site, exposed, radius)
    return d.select("structure", "id", "radial", "surface", "mouth_score", in_mouth(share).alias("selected"))


def shell_evidence(target: DataFrame, anchor: DataFrame, tiers: tuple[tuple[float, float], ...] = ((4.0, 0.65), (6.0, 0.45), (8.0, 0.25))) -> DataFrame:
    """Evidence rows of shells around anchors: each target point once, by the smallest radius that covers it; anchors themselves are left out.

    Returns structure, key, method, weight, distance.
    """
    far = max(r for r, _ in tiers)
    d = distance_join(target, anchor, far, ["id"], ["aid"]).groupBy("structure", "id").agg(F.min("dist").alias("distance"))
    d = d.join(anchor.select("structure", F.col("aid").alias("id")), ["structure", "id"], "left_anti")
    pick = F.coalesce(*(F.when(F.col("distance") <= r, F.struct(F.format_string("anchor_shell_%.0f", F.lit(r)).alias("method"), F.lit(w).alias("weight"))) for r, w in sorted(tiers)))
    return d.withColumn("_t", pick).select("structure", F.col("id").alias("key"), "_t.method", "_t.weight", "distance")


#: Evidence weights by kind.
EVIDENCE = {"curated": 0.95, "key_residue": 0.90, "ligand_contact": 0.75, "tool_first": 0.55, "tool_second": 0.50, "model_prior": 0.45}


def build_evidence(kinds: dict[str, DataFrame], shells: DataFrame | None = None, core: tuple[str, ...] = ("curated", "key_residue")) -> DataFrame:
    """Evidence rows structure, key, method, weight of all kinds (structure, key); a shell row of a core key is left out."""
    out = None
    for kind, keys in kinds.items():
        part = keys.select("structure", "key").distinct().withColumn("method", F.lit(kind)).withColumn("weight", F.lit(EVIDENCE[kind]))
        out = part if out is None else out.unionByName(part)
    if shells is not None:
        known = out.filter(F.col("method").isin(*core)).select("structure", "key").distinct()
        rest = shells.select("structure", "key", "method", "weight").join(known, ["structure", "key"], "left_anti")
        out = rest if out is None else out.unionByName(rest)
    return out
