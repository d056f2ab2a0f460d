"""Feature rows of whole complexes against a plain version in numpy, and nearest joins of uneven structures."""

import math

import numpy as np
import pytest

from screenspark.operators import features, spatial
from screenspark.functions.nearest import Tree


def far(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 1e-8 else None


def clip(x):
    return float(min(1.0, max(0.0, x)))


def thin(points, least):
    kept = []
    for p in points:
        if all(np.linalg.norm(p - q) > least for q in kept):
            kept.append(p)
    return kept


def mouth_of(keys, mid, centre, target, share):
    r = np.round([np.linalg.norm(mid[k] - centre) for k in keys], 9)
    place = {i: n for n, i in enumerate(sorted(range(len(keys)), key=lambda i: (r[i], keys[i])))}
    radial = np.array([place[i] / (len(keys) - 1) if len(keys) > 1 else 0.0 for i in range(len(keys))])
    d = far(np.array([mid[k] for k in keys]), np.array([mid[k] for k in keys]))
    near = ((d <= 7.5) & (d > 1e-8)).sum(axis=1)
    surface = 1 - near / max(1, near.max())
    exposed = []
    for k in keys:
        x = np.sort(far(mid[k][None], target)[0])
        exposed.append(0.55 * clip(x[:24].mean() / 8) + 0.45 / (1 + 32 * (x <= 8).sum() / 512))
    score = 0.5 * radial + 0.3 * surface + 0.2 * np.array(exposed)
    order = sorted(range(len(keys)), key=lambda i: (-round(score[i], 9), keys[i]))[: max(1, math.ceil(share * len(keys)))]
    return [(keys[i], score[i]) for i in order]


def geometry_of(mouth, mid, centre, atoms_of):
    w = np.array([x for _, x in mouth])
    pts = np.array([mid[k] for k, _ in mouth])
    m = (pts * w[:, None]).sum(axis=0) / w.sum()
    axis = unit(m - centre)
    rel = np.concatenate([atoms_of[k] for k, _ in mouth]) - m
    planar = np.linalg.norm(rel - (rel @ axis)[:, None] * axis, axis=1)
    q = np.percentile(planar, 70)
    return m, axis, min(8.0, max(1.5, q if q >= 1 else 2.6))


def brute(target, partner, site, anchors, ligand):
    """A few features of one complex; ``target`` and ``partner`` are lists of (key, xyz)."""
    t, p = np.array([x for _, x in target]), np.array([x for _, x in partner])
    atoms_of = {}
    for k, x in target:
        atoms_of.setdefault(k, []).append(x)
    atoms_of = {k: np.array(v) for k, v in atoms_of.items()}
    mid = {k: v.mean(axis=0) for k, v in atoms_of.items()}
    to_p = {k: far(v, p).min() for k, v in atoms_of.items()}
    out = {"n_target": len(mid), "n_partner": len({k for k, _ in partner}), "n_site": len(site), "n_anchor": len(anchors), "n_ligand": len(ligand)}
    keys = sorted(site)
    d = [to_p[k] for k in keys]
    atoms = np.concatenate([atoms_of[k] for k in keys])
    centre = atoms.mean(axis=0)
    out |= {"site_hits": sum(x <= 4.5 for x in d), "site_hit_fraction": np.mean([x <= 4.5 for x in d]), "site_distance": min(d), "site_mean_distance": np.mean(d), "site_contacts": int((far(atoms, p).min(axis=1) <= 4.5).sum())}
    c = np.array([mid[k] for k in keys])
    r = np.linalg.norm(c - c.mean(axis=0), axis=1)
    volume = np.prod(atoms.max(axis=0) - atoms.min(axis=0))
    wide = clip(0.45 * clip((len(keys) - 12) / 24) + 0.35 * clip((np.percentile(r, 90) - 9) / 12) + 0.20 * clip((np.log1p(volume) - 6) / 3))
    out |= {"radius_mean": r.mean(), "radius_p90": np.percentile(r, 90), "radius_max": r.max(), "site_volume": volume, "overwide": wide, "tightness": 1 - wide}
    a = [to_p[k] for k in anchors]
    out |= {"anchor_hits": sum(x <= 4.5 for x in a), "anchor_hit_fraction": np.mean([x <= 4.5 for x in a]), "anchor_distance": min(a), "anchor_block": float(any(x <= 4.5 for x in a))}
    anchor_atoms = np.concatenate([atoms_of[k] for k in anchors])
    to_a = {k: far(v, anchor_atoms).min() for k, v in atoms_of.items()}
    for radius in (4, 6, 8):
        inside = [k for k in mid if to_a[k] <= radius]
        hits = sum(to_p[k] <= 4.5 for k in inside)
        out |= {f"shell_{radius}_count": len(inside), f"shell_{radius}_fraction": len(inside) / len(mid), f"shell_{radius}_hits": hits, f"shell_{radius}_hit_fraction": hits / len(inside), f"shell_{radius}_distance": min(to_p[k] for k in inside)}
        if radius == 6:
            both = len(set(inside) & set(keys))
            wide = clip(0.45 * clip((len(inside) - 24) / 48) + 0.40 * clip((len(inside) / len(mid) - 0.18) / 0.32))
            out |= {"shell_site_overlap": both, "shell_overlap": both / len(inside), "site_overlap": both / len(keys), "shell_overwide": wide, "shell_overwide_flag": float(wide >= 0.55)}
            out["shell_keys"] = ";".join(sorted(inside, key=lambda k: int(k[2:])))
    face = p[far(p, t).min(axis=1) <= 6]
    out |= {"centre_distance": far(centre[None], p).min(), "centre_to_partner": np.linalg.norm(p.mean(axis=0) - centre), "centre_to_interface": np.linalg.norm(face.mean(axis=0) - centre) if len(face) else None}
    # mouth
    mouth = mouth_of(keys, mid, centre, t, 0.30)
    m, axis, ap = geometry_of(mouth, mid, centre, atoms_of)
    ref = np.array([0.0, 1.0, 0.0]) if abs(axis[2]) >= 0.85 else np.array([0.0, 0.0, 1.0])
    u = unit(np.cross(axis, ref))
    v = np.cross(axis, u)
    line = [m + o * axis for o in np.linspace(-max(0.8, 0.55 * ap), max(1.4, 1.2 * ap), 9)]
    plane = [m]
    for shift in (0.0, 0.35 * ap):
        plane.append(m + shift * axis)
        plane += [m + shift * axis + ap * f * (np.cos(x) * u + np.sin(x) * v) for f, n in ((0.45, 6), (0.85, 10)) for x in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    plane = thin(plane, max(0.4, 0.1 * ap))
    reach = min(max(1.2, 0.55 * ap), 5.3)
    dx, dy = far(np.array(line), p).min(axis=1), far(np.array(plane), p).min(axis=1)
    x, y, clear = (dx <= reach).mean(), (dy <= reach).mean(), min(dx.min(), dy.min())
    w, md = np.array([s for _, s in mouth]), np.array([to_p[k] for k, _ in mouth])
    res = (np.clip(1 - md / 6, 0, 1) * w).sum() / w.sum()
    agreed = clip(2 * x * y / max(x + y, 1e-6) * (1 - 0.5 * abs(x - y)))
    out |= {"mouth_hits": int((md <= 4.5).sum()), "mouth_hit_fraction": (md <= 4.5).mean(), "mouth_axis_block": x, "mouth_aperture_block": y, "mouth_clearance": clear}
    out["mouth_occlusion"] = clip(0.35 * res + 0.40 * agreed + 0.15 * (x + y) / 2 + 0.10 * clip(1 - clear / 5.5))
    # local points
    local = []
    for k in keys:
        at = atoms_of[k]
        local += [mid[k], *at[:: max(1, len(at) // 4)][:4]]
        o = unit(mid[k] - centre)
        if o is not None:
            local += [mid[k] + 1.2 * o, mid[k] - 0.8 * o]
    local = np.array(local)
    taken = far(local, p).min(axis=1) <= 2.8
    radius = max(np.percentile(np.linalg.norm(local - centre, axis=1), 75), 1e-3)
    out |= {"local_points": len(local), "local_occupied": int(taken.sum()), "occupancy_delta": taken.mean(), "access_delta": -taken.mean(), "blocked_volume": taken.mean() * 4 / 3 * np.pi * radius**3}
    # ligand and paths
    dl = far(ligand, p).min(axis=1)
    out |= {"clash_count": int((dl <= 2.8).sum()), "clash_fraction": (dl <= 2.8).mean(), "overlap_score": np.clip(1 - dl / 4, 0, 1).mean()}
    mouth = mouth_of(keys, mid, centre, t, 0.35)
    m, axis, ap = geometry_of(mouth, mid, centre, atoms_of)
    ends = [m + max(1.4, 1.15 * ap) * axis, m + (max(1.4, 1.15 * ap) + 0.8) * axis]
    ends += [mid[k] + max(1.0, 0.85 * ap) * unit(mid[k] - centre) for k, _ in mouth[:6]]
    start, scores = ligand.mean(axis=0), []
    for e in thin(ends, max(0.7, 0.2 * ap))[:6]:
        seg = e - start
        s = np.clip((p - start) @ seg / (seg @ seg), 0, 1)
        tube = np.linalg.norm(p - start - s[:, None] * seg, axis=1)
        inf = (np.clip(1 - tube / 3, 0, 1) * np.clip(1 - 1.6 * abs(s - 0.5), 0, 1)).sum()
        inf = clip(1 - math.exp(-inf / max(1, np.linalg.norm(seg) / 3))) if inf > 0 else 0.0
        q = np.linspace(0, 1, 25)
        dq = far(start + q[:, None] * seg, p).min(axis=1)
        w = np.clip(1 - abs(2 * q - 1), 0.15, 1)
        weighted, neck = ((dq <= 3) * w).sum() / w.sum(), clip(1 - dq.min() / 3.75)
        scores.append((clip(0.45 * inf + 0.30 * weighted + 0.25 * neck), (dq <= 3).mean(), weighted, neck, dq.min()))
    s, plain, weighted, neck, clear = map(np.array, zip(*scores))
    core = 0.40 * s.mean() + 0.25 * np.median(s) + 0.20 * s.min() + 0.15 * (s >= 0.55).mean()
    out["path_score"] = clip(core - 0.20 * (s <= 0.35).mean() - 0.15 * clip(clear.max() / 4))
    out |= {"path_fraction": clip(0.55 * plain.mean() + 0.45 * plain.min()), "path_fraction_weighted": clip(0.55 * weighted.mean() + 0.45 * weighted.min()), "path_bottleneck": clip(0.55 * neck.mean() + 0.45 * neck.min())}
    return out | {"path_exit_fraction": (s >= 0.55).mean(), "path_clearance": clear.max(), "n_exits": len(s), "n_path_samples": 25 * len(s)}


def complexes(n=4):
    rng = np.random.default_rng(12)
    out = {}
    for i in range(n):
        mids = rng.normal(size=(60 + 10 * i, 3)) * 9
        target = [(f"A:{k}", m + rng.normal(size=3)) for k, m in enumerate(mids) for _ in range(1 + (k + i) % 7)]
        partner = [(f"H:{k}", x) for k, x in enumerate(rng.normal(size=(80, 3)) * 5 + [6 + 2 * i, 3, 1])]
        site = {f"A:{k}" for k in np.argsort(np.linalg.norm(mids - [4, 2, 0], axis=1))[: 9 + 6 * i]}
        anchors = {f"A:{k}" for k in np.argsort(np.linalg.norm(mids - [5, 2, 0], axis=1))[:3]}
        out[f"s{i}"] = target, partner, site, anchors, rng.normal(size=(12, 3)) * 2 + [4, 2, 0]
    return out


def frames(spark, made):
    atoms = [(s, role, k, n, *map(float, x)) for s, (t, p, *_) in made.items() for role, part in (("target", t), ("partner", p)) for n, (k, x) in enumerate(part)]
    keys = lambda i: spark.createDataFrame([(s, k) for s, m in made.items() for k in m[i]], "structure string, key string")
    ligand = spark.createDataFrame([(s, *map(float, x)) for s, m in made.items() for x in m[4]], "structure string, x double, y double, z double")
    structures = spark.createDataFrame([(s,) for s in made], "structure string")
    return structures, spark.createDataFrame(atoms, "structure string, role string, key string, n int, x double, y double, z double"), keys(2), keys(3), ligand


def test_whole_rows_equal_plain_version(spark):
    made = complexes()
    rows = {r.structure: r.asDict() for r in features.item_features(*frames(spark, made)).collect()}
    assert len(rows) == len(made)
    for s, parts in made.items():
        assert rows[s]["status"] == "ok" and rows[s]["warning"] == ""
        for name, want in brute(*parts).items():
            got = rows[s][name]
            assert got == want if isinstance(want, str) or want is None else got == pytest.approx(float(want), abs=1e-9), (s, name)
    from screenspark.operators.scoring import RULE_FEATURES

    assert {f for f in RULE_FEATURES if "energy" not in f and f != "site_accuracy"} <= rows["s0"].keys() and len(rows["s0"]) >= 75


def test_failures_stay_in_their_rows(spark):
    made = complexes(3)
    structures, atoms, site, anchors, ligand = frames(spark, made)
    alone = features.item_features(structures, atoms, site, anchors, ligand)
    more = structures.union(spark.createDataFrame([("gone",), ("s0",)], "structure string"))
    extra = spark.createDataFrame([("s0", -3.5), ("gone", 1.0)], "structure string, energy_gb double")
    keep = "structure <> 's1'"
    rows = {r.structure: r for r in features.item_features(more, atoms.filter("structure <> 's2' OR role = 'target'"), site.filter(keep), anchors.filter(keep), ligand.filter(keep), extra).collect()}
    assert len(rows) == 4
    assert (rows["gone"].status, rows["gone"].error, rows["gone"].site_hits, rows["gone"].energy_gb) == ("failed", "no_target,no_partner", None, 1.0)
    assert (rows["s2"].status, rows["s2"].error, rows["s2"].n_target) == ("failed", "no_partner", None)
    assert (rows["s1"].status, rows["s1"].warning, rows["s1"].has_warning) == ("ok", "no_site,no_anchor,no_ligand", True)
    assert (rows["s1"].n_site, rows["s1"].site_hits, rows["s1"].site_hit_fraction, rows["s1"].path_score, rows["s1"].shell_6_count, rows["s1"].mouth_occlusion) == (0, 0, None, None, 0, None)
    want = {r.structure: r for r in alone.collect()}["s0"].asDict()
    got = rows["s0"].asDict()
    assert got.pop("energy_gb") == -3.5 and got.keys() == want.keys()
    assert all(got[c] == (pytest.approx(v, abs=1e-12) if isinstance(v, float) else v) for c, v in want.items())
    empty = features.item_features(structures.limit(0), atoms, site)
    assert empty.collect() == []


def test_ranking_from_structures(spark):
    made = complexes(4)
    rows = features.item_features(*frames(spark, made))
    items = spark.createDataFrame([(f"c{i % 2}", f"v{i % 2}", f"i{i}", f"s{i}") for i in range(4)], "candidate string, variant string, item string, structure string")
    ranked = features.rank_structures(items, rows).orderBy("rank").collect()
    assert [r.rank for r in ranked] == [1, 2] and {r.candidate for r in ranked} == {"c0", "c1"} and ranked[0].final_score >= ranked[1].final_score


def test_tree_equals_all_distances():
    rng = np.random.default_rng(0)
    for n in (1, 33, 900):
        p, q = rng.normal(size=(n, 3)), rng.normal(size=(300, 3)) * 2
        d = np.sort(far(q, p), axis=1)
        best, within = Tree(p).nearest(q, 3, 0.7)
        assert np.allclose(best[:, : min(n, 3)], d[:, :3]) and np.isinf(best[:, min(n, 3) :]).all() and (within == (d <= 0.7).sum(axis=1)).all()


def test_one_far_structure_does_not_widen_the_search_of_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(s, i, *(map(float, rng.random(3) * 50 + (1e6 if s == 7 else 0)))) for s in range(40) for i in range(100)]
    rows += [(3, 1000, 1e7, 0.0, 0.0)]  # and a far point in a structure
    a = spark.createDataFrame(rows, "structure int, id int, x double, y double, z double")
    pairs = []
    real = spatial.distance_join

    def counted(*args):
        d = real(*args)
        pairs.append(d.count())
        return d

    monkeypatch.setattr(spatial, "distance_join", counted)
    b = a.filter("id < 1000").withColumn("pid", F.col("id")).withColumn("x", F.col("x") + 0.5)
    found = {(r.structure, r.id): r.dist for r in spatial.nearest_join(a, b, "id", "pid").collect()}
    assert sum(pairs) < 40 * 100 * 20  # all pairs of a structure are 100 for each point
    for s in (0, 3, 7):
        p = np.array([r[2:] for r in rows if r[0] == s])
        q = np.array([r[2:] for r in rows if r[0] == s and r[1] < 1000]) + [0.5, 0, 0]
        assert np.allclose([found[s, r[1]] for r in rows if r[0] == s], far(p, q).min(axis=1))
