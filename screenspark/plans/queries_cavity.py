"""Queries: mouth, occupancy, exit paths, feature rows and annotation summaries of structures, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from screenspark.operators import cavity as k
from screenspark.operators import features, search
from screenspark.operators import spatial as g
from screenspark.plans import views as v
from screenspark.plans.queries_readers import _structure_lines, lines
from screenspark.plans.queries_sets import _D, ATOMS, _parts, atoms
from screenspark.plans.registry import register, select_sql

THRESHOLD, RADIUS = 1.5, 2.0


def _clip(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


_SPOTS = [(s, share, angle) for s in k.SHIFTS for share, angle in [(0.0, 0.0)] + [(share, 2 * math.pi * i / n) for share, n in k.RINGS for i in range(n)]]
_VALUES = ", ".join(f"({k.AXIS_SAMPLES + i}, {s}::DOUBLE, {share * math.cos(angle)!r}::DOUBLE, {share * math.sin(angle)!r}::DOUBLE)" for i, (s, share, angle) in enumerate(_SPOTS))
GEOMETRY = f"""mouth AS (SELECT *, (id % 5 + 1) / 5 AS weight FROM atoms WHERE label = 1),
c AS (SELECT structure, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM site GROUP BY 1),
m AS (SELECT structure, sum(weight * x) / sum(weight) AS mx, sum(weight * y) / sum(weight) AS my, sum(weight * z) / sum(weight) AS mz FROM mouth GROUP BY 1),
axes AS (SELECT * EXCLUDE (n), (mx - cx) / n AS ax, (my - cy) / n AS ay, (mz - cz) / n AS az FROM (SELECT *, sqrt((mx - cx) ** 2 + (my - cy) ** 2 + (mz - cz) ** 2) AS n FROM c JOIN m USING (structure))),
pl AS (SELECT structure, sqrt((x - mx - d * ax) ** 2 + (y - my - d * ay) ** 2 + (z - mz - d * az) ** 2) AS r FROM (SELECT *, (x - mx) * ax + (y - my) * ay + (z - mz) * az AS d FROM mouth JOIN axes USING (structure))),
geo AS (SELECT axes.*, greatest(1.5, least(8.0, CASE WHEN q >= 1 THEN q ELSE 2.6 END)) AS ap FROM axes JOIN (SELECT structure, quantile_cont(r, 0.7) AS q FROM pl GROUP BY 1) USING (structure))"""
SAMPLES = f"""bu AS (SELECT *, sqrt(ux ** 2 + uy ** 2 + uz ** 2) AS un FROM (SELECT *, CASE WHEN abs(az) >= 0.85 THEN -az ELSE ay END AS ux, CASE WHEN abs(az) >= 0.85 THEN 0 ELSE -ax END AS uy, CASE WHEN abs(az) >= 0.85 THEN ax ELSE 0 END AS uz FROM geo)),
bn AS (SELECT * EXCLUDE (ux, uy, uz, un), ux / un AS ux, uy / un AS uy, uz / un AS uz FROM bu),
bv AS (SELECT *, ay * uz - az * uy AS vx, az * ux - ax * uz AS vy, ax * uy - ay * ux AS vz FROM bn),
ax9 AS (SELECT *, -greatest(0.8, 0.55 * ap) + (greatest(0.8, 0.55 * ap) + greatest(1.4, 1.2 * ap)) * i / 8 AS o FROM (SELECT *, unnest(range(9)) AS i FROM geo)),
spots AS (SELECT * FROM (VALUES {_VALUES}) AS t(pt, sh, fu, fv)),
smp AS (SELECT structure, 'axis' AS kind, CAST(i AS INTEGER) AS pt, mx + o * ax AS x, my + o * ay AS y, mz + o * az AS z FROM ax9 UNION ALL
  SELECT structure, 'aperture', CAST(pt AS INTEGER), mx + sh * ap * ax + ap * fu * ux + ap * fv * vx, my + sh * ap * ay + ap * fu * uy + ap * fv * vy, mz + sh * ap * az + ap * fu * uz + ap * fv * vz FROM bv, spots)"""


def occlusion_sql(threshold: float) -> str:
    return f"""sd AS (SELECT a.structure, kind, pt, min({_D}) AS d FROM smp a JOIN partner b ON a.structure = b.structure GROUP BY ALL),
sh AS (SELECT structure, avg(CASE WHEN kind = 'axis' THEN CASE WHEN d <= reach THEN 1.0 ELSE 0.0 END END) AS axis_block, avg(CASE WHEN kind = 'aperture' THEN CASE WHEN d <= reach THEN 1.0 ELSE 0.0 END END) AS aperture_block, min(d) AS clearance, any_value(ap) AS aperture FROM (SELECT sd.*, ap, least(greatest(1.2, 0.55 * ap), {threshold + 0.8}) AS reach FROM sd JOIN geo USING (structure)) GROUP BY 1),
md AS (SELECT a.structure, a.id, any_value(a.weight) AS weight, min({_D}) AS d FROM mouth a JOIN partner b ON a.structure = b.structure GROUP BY ALL),
mh AS (SELECT structure, count(*) AS n_mouth, count_if(d <= {threshold}) AS n_hit, sum({_clip(f'1 - d / {threshold + 1.5}')} * weight) / sum(weight) AS res FROM md GROUP BY 1),
occl AS (SELECT *, n_hit / n_mouth AS hit_fraction, {_clip(f"0.35 * res + 0.40 * {_clip('2 * axis_block * aperture_block / greatest(axis_block + aperture_block, 1e-6) * (1 - 0.5 * abs(axis_block - aperture_block))')} + 0.15 * (axis_block + aperture_block) / 2 + 0.10 * {_clip(f'1 - clearance / {threshold + 1}')}")} AS occlusion FROM mh JOIN sh USING (structure))"""


def occupancy_sql(radius: float) -> str:
    return f"""sr AS (SELECT s.structure, s.id, x, y, z, cx, cy, cz, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r FROM site s JOIN c USING (structure)),
sl AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY id, j) - 1 AS pt, count(*) OVER (PARTITION BY structure) AS n FROM (SELECT *, unnest(range(4)) AS j, unnest([0.0, 0.0, 1.2, -0.8]) AS f FROM sr)),
sp AS (SELECT structure, pt, x + f * (x - cx) / r AS x, y + f * (y - cy) / r AS y, z + f * (z - cz) / r AS z, cx, cy, cz FROM sl WHERE n <= {k.MAX_POINTS} OR floor(ceil(pt * {k.MAX_POINTS - 1} / (n - 1)) * (n - 1) / {k.MAX_POINTS - 1}) = pt),
so AS (SELECT a.structure, pt, any_value(sqrt((a.x - cx) ** 2 + (a.y - cy) ** 2 + (a.z - cz) ** 2)) AS r, min({_D}) AS d FROM sp a JOIN partner b ON a.structure = b.structure GROUP BY ALL),
occu AS (SELECT *, n_occupied / n_points AS occupancy_delta, -n_occupied / n_points AS access_delta, n_occupied / n_points * (4.0 / 3.0 * pi()) * greatest(q, 1e-3) ** 3 AS blocked_volume FROM (SELECT structure, count(*) AS n_points, count_if(d <= {radius}) AS n_occupied, quantile_cont(r, 0.75) AS q FROM so GROUP BY 1))"""


OCCLUSION, OCCUPANCY = occlusion_sql(THRESHOLD), occupancy_sql(RADIUS)
EXITS = """own AS (SELECT structure, q + 2 AS pos, x + s * (x - cx) / r AS x, y + s * (y - cy) / r AS y, z + s * (z - cz) / r AS z FROM (SELECT g.structure, x, y, z, cx, cy, cz, greatest(1.0, 0.85 * ap) AS s, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r, row_number() OVER (PARTITION BY g.structure ORDER BY weight DESC, id) AS q FROM mouth JOIN geo g USING (structure)) WHERE q <= 6),
ends AS (SELECT structure, 0 AS pos, mx + e * ax AS x, my + e * ay AS y, mz + e * az AS z FROM (SELECT *, greatest(1.4, 1.15 * ap) AS e FROM geo) UNION ALL SELECT structure, 1, mx + (e + 0.8) * ax, my + (e + 0.8) * ay, mz + (e + 0.8) * az FROM (SELECT *, greatest(1.4, 1.15 * ap) AS e FROM geo) UNION ALL SELECT * FROM own),
kept AS (SELECT structure, list_reduce(list_transform(l, lambda p: [p]), lambda acc, n: CASE WHEN list_bool_and(list_transform(acc, lambda q: sqrt((q.x - n[1].x) ** 2 + (q.y - n[1].y) ** 2 + (q.z - n[1].z) ** 2) > apart)) THEN list_concat(acc, n) ELSE acc END)[1:6] AS l FROM (SELECT structure, list(struct_pack(x := x, y := y, z := z) ORDER BY pos) AS l, any_value(greatest(0.7, 0.2 * ap)) AS apart FROM ends JOIN geo USING (structure) GROUP BY structure)),
exits AS (SELECT structure, i - 1 AS exit, l[i].x AS ex, l[i].y AS ey, l[i].z AS ez FROM (SELECT structure, l, unnest(range(1, len(l) + 1)) AS i FROM kept))"""


def paths_sql(radius: float) -> str:
    return f"""lig AS (SELECT structure, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM anchor GROUP BY 1),
ways AS (SELECT *, (ex - sx) ** 2 + (ey - sy) ** 2 + (ez - sz) ** 2 AS l2 FROM exits JOIN lig USING (structure)),
tt AS (SELECT w.*, b.x, b.y, b.z, {_clip('((b.x - sx) * (ex - sx) + (b.y - sy) * (ey - sy) + (b.z - sz) * (ez - sz)) / l2')} AS t FROM ways w JOIN partner b USING (structure)),
inf AS (SELECT structure, exit, any_value(l2) AS l2, sum({_clip(f'1 - sqrt((x - sx - t * (ex - sx)) ** 2 + (y - sy - t * (ey - sy)) ** 2 + (z - sz - t * (ez - sz)) ** 2) / {radius}')} * {_clip('1 - 1.6 * abs(t - 0.5)')}) AS s FROM tt GROUP BY ALL),
i2 AS (SELECT structure, exit, CASE WHEN s <= 0 THEN 0 ELSE {_clip(f'1 - exp(-s / greatest(1.0, sqrt(l2) / {radius}))')} END AS influence FROM inf),
ps AS (SELECT structure, exit, i, i / 24 AS t, sx + i / 24 * (ex - sx) AS x, sy + i / 24 * (ey - sy) AS y, sz + i / 24 * (ez - sz) AS z FROM (SELECT *, unnest(range(25)) AS i FROM ways)),
pd AS (SELECT a.structure, exit, i, any_value(t) AS t, min({_D}) AS d FROM ps a JOIN partner b ON a.structure = b.structure GROUP BY ALL),
pw AS (SELECT *, CASE WHEN d <= {radius} THEN 1.0 ELSE 0.0 END AS hit, greatest(0.15, least(1, 1 - abs(2 * t - 1))) AS w FROM pd),
pe AS (SELECT structure, exit, avg(hit) AS plain, sum(hit * w) / sum(w) AS weighted, min(d) AS clearance, {_clip(f'1 - min(d) / {radius * 1.25}')} AS bottleneck FROM pw GROUP BY ALL),
px AS (SELECT *, {_clip('0.45 * influence + 0.30 * weighted + 0.25 * bottleneck')} AS score FROM pe JOIN i2 USING (structure, exit)),
path AS (SELECT structure, count(*) AS n_exits, {_clip(f"0.40 * avg(score) + 0.25 * median(score) + 0.20 * min(score) + 0.15 * avg(CASE WHEN round(score, 9) >= 0.55 THEN 1.0 ELSE 0.0 END) - 0.20 * avg(CASE WHEN round(score, 9) <= 0.35 THEN 1.0 ELSE 0.0 END) - 0.15 * {_clip(f'max(clearance) / {radius + 1}')}")} AS path_score,
  {_clip('0.55 * avg(plain) + 0.45 * min(plain)')} AS path_fraction, {_clip('0.55 * avg(weighted) + 0.45 * min(weighted)')} AS path_fraction_weighted, {_clip('0.55 * avg(bottleneck) + 0.45 * min(bottleneck)')} AS path_bottleneck, avg(CASE WHEN round(score, 9) >= 0.55 THEN 1.0 ELSE 0.0 END) AS path_exit_fraction, max(clearance) AS path_clearance FROM px GROUP BY structure)"""


PATHS = paths_sql(RADIUS)


def _mouth(site):
    return site.filter("label = 1").withColumn("weight", (F.col("id") % 5 + 1) / 5)


@register("ge9_mouth_geometry", v.with_sql(ATOMS, GEOMETRY, select=select_sql("geo", "structure", "cx, cy, cz, mx, my, mz, ax, ay, az, ap")))
def ge9_mouth_geometry(spark, sf_dir):
    _, site, _, _ = _parts(spark, sf_dir)
    return k.mouth_geometry(site, _mouth(site)).withColumnRenamed("aperture", "ap")


@register("ge9_mouth_samples", v.with_sql(ATOMS, GEOMETRY, SAMPLES, select=select_sql("smp", "structure, kind, pt", "x, y, z")))
def ge9_mouth_samples(spark, sf_dir):
    _, site, _, _ = _parts(spark, sf_dir)
    return k.mouth_samples(k.mouth_geometry(site, _mouth(site)))


@register("ge10_mouth_occlusion", v.with_sql(ATOMS, GEOMETRY, SAMPLES, OCCLUSION, select=select_sql("occl", "structure, n_mouth, n_hit", "hit_fraction, aperture, axis_block, aperture_block, clearance, occlusion")))
def ge10_mouth_occlusion(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return k.mouth_occlusion(site, _mouth(site), p, THRESHOLD)


@register("ge11_site_occupancy", v.with_sql(ATOMS, GEOMETRY, OCCUPANCY, select=select_sql("occu", "structure, n_points, n_occupied", "occupancy_delta, access_delta, blocked_volume")))
def ge11_site_occupancy(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return k.site_occupancy(site, site.withColumn("n", F.lit(0)), p, RADIUS)


@register("ge13_exits", v.with_sql(ATOMS, GEOMETRY, EXITS, select=select_sql("(SELECT structure, CAST(exit AS INTEGER) AS exit, ex, ey, ez FROM exits)", "structure, exit", "ex, ey, ez")))
def ge13_exits(spark, sf_dir):
    _, site, _, _ = _parts(spark, sf_dir)
    return k.exits(k.mouth_geometry(site, _mouth(site)), _mouth(site))


@register("ge13_path_block", v.with_sql(ATOMS, GEOMETRY, EXITS, PATHS, select=select_sql("path", "structure, n_exits", "path_score, path_fraction, path_fraction_weighted, path_bottleneck, path_exit_fraction, path_clearance")))
def ge13_path_block(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return k.path_block(site, _mouth(site), site.filter("label = 0"), p, RADIUS)


# Whole rows over points thrice as far apart: one structure lacks its site, one its partner and one its ligand.
_WIDE = ATOMS.replace("* 20", "* 60").replace("WHERE label IN (0, 1))", "WHERE label IN (0, 1) AND structure <> 4)").replace("WHERE label = 0)", "WHERE label = 0 AND structure <> 4)").replace("WHERE role = 'partner')", "WHERE role = 'partner' AND structure <> 3)") + ", ligand AS (SELECT * FROM anchor WHERE structure <> 2)"
_CENTRE = GEOMETRY[GEOMETRY.index("c AS") : GEOMETRY.index("m AS")].rstrip().rstrip(",")
_SCORED_MOUTH = f"""mr AS (SELECT s.structure, s.id, x, y, z, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 9) AS r, count(*) OVER (PARTITION BY s.structure) AS n FROM site s JOIN c ON c.structure = s.structure),
mk AS (SELECT a.structure, a.id, count(*) AS k FROM site a JOIN site b ON a.structure = b.structure WHERE {_D} <= 7.5 AND {_D} > 1e-8 GROUP BY ALL),
me AS (SELECT structure, id, avg(CASE WHEN o <= 24 THEN dd END) AS knn, count_if(dd <= 8) AS cc FROM (SELECT a.structure, a.id, {_D} AS dd, row_number() OVER (PARTITION BY a.structure, a.id ORDER BY {_D}) AS o FROM site a JOIN target b ON a.structure = b.structure) GROUP BY ALL),
ms AS (SELECT mr.*, CASE WHEN n > 1 THEN (row_number() OVER (PARTITION BY mr.structure ORDER BY r, CAST(mr.id AS VARCHAR)) - 1) / (n - 1) ELSE 0 END AS radial, 1 - coalesce(k, 0) / greatest(max(coalesce(k, 0)) OVER (PARTITION BY mr.structure), 1) AS surface, {_clip('0.55 * greatest(0, least(1, knn / 8.0)) + 0.45 / (1 + 32 * cc / 512.0)')} AS ex FROM mr LEFT JOIN mk ON mk.structure = mr.structure AND mk.id = mr.id JOIN me ON me.structure = mr.structure AND me.id = mr.id),
mp AS (SELECT *, 0.5 * radial + 0.3 * surface + 0.2 * ex AS weight FROM ms),
mouth AS (SELECT structure, id, x, y, z, weight FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY round(weight, 9) DESC, CAST(id AS VARCHAR)) AS q FROM mp) WHERE q <= greatest(1, ceil(0.3 * n)))"""
_WHOLE = f"""tp AS (SELECT a.structure, a.id, min({_D}) AS d FROM target a JOIN partner b ON a.structure = b.structure GROUP BY ALL),
ta AS (SELECT a.structure, a.id, min({_D}) AS d FROM target a JOIN anchor b ON a.structure = b.structure GROUP BY ALL),
res AS (SELECT t.*, t.label IN (0, 1) AND t.structure <> 4 AS s, t.label = 0 AND t.structure <> 4 AS an, tp.d AS dp, ta.d AS da FROM target t LEFT JOIN tp ON tp.structure = t.structure AND tp.id = t.id LEFT JOIN ta ON ta.structure = t.structure AND ta.id = t.id),
ag AS (SELECT structure, count(*) AS n_target, count_if(s) AS n_site, count_if(an) AS n_anchor, count_if(s AND dp <= 4.5) AS site_hits, min(CASE WHEN s THEN dp END) AS site_distance, avg(CASE WHEN s THEN dp END) AS site_mean_distance, count_if(an AND dp <= 4.5) AS anchor_hits, min(CASE WHEN an THEN dp END) AS anchor_distance,
  count_if(coalesce(da <= 4, FALSE)) AS shell_4_count, count_if(coalesce(da <= 6, FALSE)) AS shell_6_count, count_if(coalesce(da <= 8, FALSE)) AS shell_8_count, count_if(coalesce(da <= 8 AND dp <= 4.5, FALSE)) AS shell_8_hits, min(CASE WHEN da <= 8 THEN dp END) AS shell_8_distance, count_if(coalesce(da <= 6 AND s, FALSE)) AS shell_site_overlap FROM res GROUP BY 1),
sh5 AS (SELECT structure, avg(r) AS radius_mean, quantile_cont(r, 0.9) AS radius_p90, any_value(v) AS site_volume FROM (SELECT mr.structure, r, (max(x) OVER w - min(x) OVER w) * (max(y) OVER w - min(y) OVER w) * (max(z) OVER w - min(z) OVER w) AS v FROM mr WINDOW w AS (PARTITION BY structure)) GROUP BY 1),
cd AS (SELECT structure, min(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS centre_distance, sqrt((avg(x) - any_value(cx)) ** 2 + (avg(y) - any_value(cy)) ** 2 + (avg(z) - any_value(cz)) ** 2) AS centre_to_partner FROM partner JOIN c USING (structure) GROUP BY 1),
fc AS (SELECT structure, sqrt((avg(x) - any_value(cx)) ** 2 + (avg(y) - any_value(cy)) ** 2 + (avg(z) - any_value(cz)) ** 2) AS centre_to_interface FROM (SELECT b.* FROM partner b WHERE EXISTS (SELECT 1 FROM target a WHERE a.structure = b.structure AND {_D} <= 6)) JOIN c USING (structure) GROUP BY 1),
lg AS (SELECT structure, count(*) AS n_ligand, count_if(d <= 2.8) AS clash_count, avg({_clip('1 - d / 4.0')}) AS overlap_score FROM (SELECT a.structure, a.id, min({_D}) AS d FROM ligand a JOIN partner b ON a.structure = b.structure GROUP BY ALL) GROUP BY 1),
st AS (SELECT DISTINCT structure FROM atoms)"""
_WHOLE_SELECT = """SELECT st.structure, CASE WHEN st.structure = 3 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN st.structure = 3 THEN 'no_partner' ELSE '' END AS error, CASE st.structure WHEN 4 THEN 'no_site,no_anchor,no_ligand' WHEN 2 THEN 'no_ligand' ELSE '' END AS warning,
n_site, n_anchor, site_hits, anchor_hits, shell_4_count, shell_6_count, shell_8_count, shell_8_hits, shell_site_overlap, coalesce(lg.n_ligand, 0) AS n_ligand, coalesce(lg.clash_count, 0) AS clash_count, coalesce(occl.n_hit, 0) AS mouth_hits, coalesce(occu.n_points, 0) AS local_points, coalesce(occu.n_occupied, 0) AS local_occupied, coalesce(path.n_exits, 0) AS n_exits,
round(CASE WHEN n_site > 0 THEN site_hits / n_site END, 6) AS site_hit_fraction, round(CASE WHEN n_anchor > 0 THEN anchor_hits / n_anchor END, 6) AS anchor_hit_fraction, round(site_distance, 6) AS site_distance, round(site_mean_distance, 6) AS site_mean_distance, round(anchor_distance, 6) AS anchor_distance, round(shell_8_distance, 6) AS shell_8_distance,
round(radius_mean, 6) AS radius_mean, round(radius_p90, 6) AS radius_p90, round(site_volume, 6) AS site_volume, round(centre_distance, 6) AS centre_distance, round(centre_to_partner, 6) AS centre_to_partner, round(centre_to_interface, 6) AS centre_to_interface, round(overlap_score, 6) AS overlap_score, round(clash_count / n_ligand, 6) AS clash_fraction,
round(occl.occlusion, 6) AS mouth_occlusion, round(occl.axis_block, 6) AS mouth_axis_block, round(occl.aperture_block, 6) AS mouth_aperture_block, round(occl.clearance, 6) AS mouth_clearance, round(occupancy_delta, 6) AS occupancy_delta, round(blocked_volume, 6) AS blocked_volume,
round(path_score, 6) AS path_score, round(path_fraction, 6) AS path_fraction, round(path_fraction_weighted, 6) AS path_fraction_weighted, round(path_bottleneck, 6) AS path_bottleneck, round(path_exit_fraction, 6) AS path_exit_fraction, round(path_clearance, 6) AS path_clearance
FROM st JOIN ag ON ag.structure = st.structure LEFT JOIN sh5 ON sh5.structure = st.structure LEFT JOIN cd ON cd.structure = st.structure LEFT JOIN fc ON fc.structure = st.structure LEFT JOIN lg ON lg.structure = st.structure LEFT JOIN occl ON occl.structure = st.structure LEFT JOIN occu ON occu.structure = st.structure LEFT JOIN path ON path.structure = st.structure"""
_KEEP = ["structure", "status", "error", "warning"]
_COUNTS = ["n_site", "n_anchor", "site_hits", "anchor_hits", "shell_4_count", "shell_6_count", "shell_8_count", "shell_8_hits", "shell_site_overlap", "n_ligand", "clash_count", "mouth_hits", "local_points", "local_occupied", "n_exits"]
_NUMBERS = ["site_hit_fraction", "anchor_hit_fraction", "site_distance", "site_mean_distance", "anchor_distance", "shell_8_distance", "radius_mean", "radius_p90", "site_volume", "centre_distance", "centre_to_partner", "centre_to_interface", "overlap_score", "clash_fraction", "mouth_occlusion", "mouth_axis_block", "mouth_aperture_block", "mouth_clearance", "occupancy_delta", "blocked_volume", "path_score", "path_fraction", "path_fraction_weighted", "path_bottleneck", "path_exit_fraction", "path_clearance"]
_FAILED = f"SELECT {', '.join(_KEEP)}, {', '.join(f"CASE WHEN status = 'ok' THEN {x} END AS {x}" for x in [*_COUNTS, *_NUMBERS])} FROM ({_WHOLE_SELECT})"


@register("ge14_item_features", v.with_sql(_WIDE, _CENTRE, _SCORED_MOUTH, GEOMETRY[GEOMETRY.index("m AS") :], SAMPLES, occlusion_sql(4.5), occupancy_sql(2.8), EXITS, paths_sql(3.0).replace("FROM anchor", "FROM ligand"), _WHOLE, select=_FAILED))
def ge14_item_features(spark, sf_dir):
    """Whole feature rows of all structures, one point an atom and a residue; one lacks its site, one its partner and one its ligand."""
    d = atoms(spark, sf_dir).withColumns({c: F.col(c) * 3 for c in "xyz"}).withColumn("key", F.col("id").cast("string")).withColumn("n", F.lit(0))
    site, anchor = d.filter("label IN (0, 1) AND structure <> 4"), d.filter("label = 0 AND structure <> 4")
    out = features.item_features(d, d.filter("role = 'target' OR structure <> 3"), site, anchor, anchor.filter("structure <> 2"), path_share=features.MOUTH_SHARE)
    return out.select(F.col("structure").cast("long").alias("structure"), *_KEEP[1:], *_COUNTS, *_NUMBERS)


@register("ge14_rank_structures")
def ge14_rank_structures(spark, sf_dir):
    """From structure text to ranked candidates: files written and read, atoms, roles, matched keys, whole feature rows, ranking."""
    text = lines(_structure_lines(spark, sf_dir), "structures")
    found = text.select("file").distinct()
    keys = found.select(F.col("file").alias("structure"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(999), F.lit(3)), lambda n: F.concat(F.lit("A:"), n))).alias("key"))
    rows = features.features_from_text(text, keys, keys.filter(F.col("key").endswith("6")), {"A": "target", "B": "target", "H": "partner"}, ["LIG"])
    number = F.col("file").cast("long")
    items = found.select((number % 10).alias("candidate"), F.concat(F.lit("v"), F.floor(number / 10) % 3).alias("variant"), F.concat(F.lit("i"), "file").alias("item"), F.col("file").alias("structure"))
    return features.rank_structures(items, rows).select("candidate", "rank", "n_variants", "n_items", "final_score", "consistency", "mean_variant_score")


_NEAR = "n1 AS (SELECT a.structure, a.id, any_value(a.role) AS role, min(" + _D + ") AS dist FROM atoms a JOIN atoms b ON a.structure = b.structure AND a.role <> b.role GROUP BY ALL)"


@register("ag26_annotation_summary", v.with_sql(ATOMS, _NEAR, f"""pt AS (SELECT atoms.structure, atoms.id, atoms.role, dist, label IN (0, 1) AS in_site, coalesce(dist <= {THRESHOLD}, FALSE) AS face FROM atoms LEFT JOIN n1 ON atoms.structure = n1.structure AND atoms.id = n1.id),
pr AS (SELECT a.structure, a.id, b.id AS pid, a.label IN (0, 1) AS in_site FROM target a JOIN partner b ON a.structure = b.structure WHERE {_D} <= {THRESHOLD}),
s1 AS (SELECT structure, count_if(role = 'target') AS n_target, count_if(role = 'partner') AS n_partner, count_if(role = 'target' AND face) AS n_target_interface, count_if(role = 'partner' AND face) AS n_partner_interface, count_if(in_site) AS n_site, count_if(in_site AND face) AS n_contact, avg(CASE WHEN in_site THEN {_clip(f'1 - dist / {THRESHOLD}')} END) AS closeness, min(CASE WHEN in_site THEN dist END) AS min_distance FROM pt GROUP BY 1),
s2 AS (SELECT structure, count(*) AS n_pairs, count_if(in_site) AS n_site_pairs, count(DISTINCT CASE WHEN in_site THEN pid END) AS n_neighbours FROM pr GROUP BY 1),
s3 AS (SELECT *, n_contact / n_site AS coverage, n_neighbours / n_partner AS neighbour_ratio FROM s1 LEFT JOIN s2 USING (structure)),
s4 AS (SELECT *, 0.40 * coverage + 0.25 * {_clip('n_site_pairs / n_site')} + 0.20 * {_clip(f'1 - min_distance / {THRESHOLD}')} + 0.15 * neighbour_ratio AS blocking FROM s3)""",
    select="SELECT structure, n_target, n_partner, n_target_interface, n_partner_interface, n_site, n_contact, n_pairs, n_site_pairs, n_neighbours, round(closeness, 6) AS closeness, round(min_distance, 6) AS min_distance, round(coverage, 6) AS coverage, round(neighbour_ratio, 6) AS neighbour_ratio, round(blocking, 6) AS blocking, CASE WHEN round(blocking, 9) >= 0.70 THEN 'high' WHEN round(blocking, 9) >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM s4"))
def ag26_annotation_summary(spark, sf_dir):
    d, site, t, p = _parts(spark, sf_dir)
    points = g.annotate(d.select("structure", "id", "role", "x", "y", "z"), site, THRESHOLD)
    return k.annotation_summary(points, g.distance_join(t, p, THRESHOLD, ["id"], ["pid"]), THRESHOLD)


_SHELL = "m AS (SELECT a.structure, a.id AS key, min(" + _D + ") AS distance FROM target a JOIN anchor b ON a.structure = b.structure WHERE a.label <> 0 GROUP BY ALL)"
_LIGAND = "lc AS (SELECT a.structure, a.id AS key, min(" + _D + ") AS value FROM target a JOIN (SELECT * FROM partner WHERE label = 5) b ON a.structure = b.structure GROUP BY ALL)"


@register("ge17_build_evidence", v.with_sql(ATOMS, _SHELL, _LIGAND, select="""SELECT structure, id AS key, 'curated' AS method, 0.95::DOUBLE AS weight FROM target WHERE label = 0 UNION ALL SELECT structure, id, 'key_residue', 0.90 FROM target WHERE label = 1 AND id % 2 = 0
UNION ALL SELECT structure, key, 'ligand_contact', 0.75 FROM lc WHERE value <= 1 UNION ALL SELECT structure, id, 'tool_first', 0.55 FROM target WHERE id % 7 = 0 UNION ALL SELECT structure, id, 'tool_second', 0.50 FROM target WHERE id % 11 = 0 UNION ALL SELECT structure, id, 'model_prior', 0.45 FROM target WHERE id % 13 = 0
UNION ALL SELECT m.structure, key, CASE WHEN distance <= 1 THEN 'anchor_shell_1' WHEN distance <= 2 THEN 'anchor_shell_2' ELSE 'anchor_shell_3' END, CASE WHEN distance <= 1 THEN 0.65 WHEN distance <= 2 THEN 0.45 ELSE 0.25 END FROM m JOIN target t ON m.structure = t.structure AND m.key = t.id WHERE distance <= 3 AND NOT (t.label = 1 AND t.id % 2 = 0)"""))
def ge17_build_evidence(spark, sf_dir):
    d, _, t, p = _parts(spark, sf_dir)
    t = t.withColumn("key", F.col("id"))
    near = g.contact_site(p.filter("label = 5").withColumn("lid", F.col("id")), t, [1.0])
    shells = g.shell_evidence(t, d.filter("label = 0").withColumn("aid", F.col("id")), ((1.0, 0.65), (2.0, 0.45), (3.0, 0.25)))
    kinds = {"curated": t.filter("label = 0"), "key_residue": t.filter("label = 1 AND id % 2 = 0"), "ligand_contact": near, "tool_first": t.filter("id % 7 = 0"), "tool_second": t.filter("id % 11 = 0"), "model_prior": t.filter("id % 13 = 0")}
    return g.build_evidence(kinds, shells)


_ACCURACY = "SELECT structure, parameter, n_truth, n_predicted, n_hit, round(n_hit / n_truth, 6) AS coverage, round(CASE WHEN n_predicted > 0 THEN n_hit / n_predicted END, 6) AS precision, round(n_hit / (n_predicted + n_truth - n_hit), 6) AS jaccard, round(2 * n_hit / (n_predicted + n_truth), 6) AS f1 FROM (SELECT structure, parameter, any_value(nt) AS n_truth, count(key) AS n_predicted, count_if(hit) AS n_hit FROM (SELECT s.structure, parameter, nt, p.key, EXISTS (SELECT 1 FROM tru WHERE tru.structure = p.structure AND tru.key = p.key) AS hit FROM (SELECT structure, count(*) AS nt FROM tru GROUP BY 1) s CROSS JOIN (SELECT unnest({grid}::DOUBLE[]) AS parameter) g LEFT JOIN {pred} p ON p.structure = s.structure AND p.value <= parameter) GROUP BY ALL)"


@register("sc5_cutoff_sweep", v.with_sql(ATOMS, _LIGAND, "tru AS (SELECT structure, id AS key FROM target WHERE label IN (1, 2))", select=_ACCURACY.format(grid="[0.25, 0.5, 1.0, 2.0]", pred="lc")))
def sc5_cutoff_sweep(spark, sf_dir):
    """Contact cutoffs against the truth; the least distance of each key is computed once."""
    _, _, t, p = _parts(spark, sf_dir)
    t = t.withColumn("key", F.col("id"))
    near = g.contact_site(p.filter("label = 5").withColumn("lid", F.col("id")), t, [2.0]).select("structure", "key", F.col("dist").alias("value"))
    return search.site_sweep(near, t.filter("label IN (1, 2)"), [0.25, 0.5, 1.0, 2.0])


@register("sc5_rank_sweep", v.with_sql(ATOMS, "pred AS (SELECT structure, id AS key, min(1 + id % 4)::DOUBLE AS value FROM target GROUP BY ALL)", "tru AS (SELECT structure, id AS key FROM target WHERE label IN (1, 2))", select=_ACCURACY.format(grid="[1, 2, 3]", pred="pred")))
def sc5_rank_sweep(spark, sf_dir):
    """Prediction ranks against the truth: a key counts from the best rank that has it."""
    _, _, t, _ = _parts(spark, sf_dir)
    ranked = t.groupBy("structure", F.col("id").alias("key")).agg(F.min(1 + F.col("id") % 4).cast("double").alias("value"))
    return search.site_sweep(ranked, t.filter("label IN (1, 2)").withColumn("key", F.col("id")), [1.0, 2.0, 3.0])
