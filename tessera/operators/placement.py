"""Global placement of sources in one frame, residual metrics, frame extents and sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.functions.projective import cam_centered, cam_ray, proj_forward, ray_angles
from tessera.functions.similarity import (sim, sim_apply, sim_compose, sim_from_polar, sim_rotation,
                                          sim_scale)
from tessera.operators.solve import TASK_ENTRIES, eliminate, solve_spd
from tessera.operators.spread import dense_index
from tessera.session import cut

HUBER_KNEE = 3.0
IRLS_PASSES = 4
GROUP = ["set_id", "component"]
#: Groups of up to so many observations run all their passes in one task, groups of about so many together.
GROUP_ROWS, TOGETHER = 65_536, 262_144


def huber_loss(r: Column, sigma: float | None) -> Column:
    if sigma is None:
        return r * r
    return F.when(r < sigma, r * r).otherwise(2 * sigma * r - sigma * sigma)


def irls_weight(r: Column, sigma: float) -> Column:
    return F.when(r > sigma, F.lit(sigma) / r).otherwise(F.lit(1.0))


def _anchors(obs: DataFrame) -> DataFrame:
    """Best-connected source per group (ties: lowest id)."""
    ends = obs.select(*GROUP, F.explode(F.array("i", "j")).alias("source_id"))
    degree = ends.groupBy(*GROUP, "source_id").agg(F.count(F.lit(1)).alias("degree"))
    return degree.groupBy(*GROUP).agg(
        F.max_by("source_id", F.struct("degree", -F.col("source_id"))).alias("anchor"))


def _attach(obs: DataFrame, pairs: DataFrame, t: DataFrame) -> DataFrame:
    """Residual of every observation under the current transforms; ``pairs`` has its GROUP, i, j once."""
    ti = t.select(*GROUP, F.col("source_id").alias("i"), F.col("t").alias("ti"))
    tj = t.select(*GROUP, F.col("source_id").alias("j"), F.col("t").alias("tj"))
    # both transforms meet on the short table of pairs, the observations are joined once
    pairs = pairs.join(ti, [*GROUP, "i"]).join(tj, [*GROUP, "j"])
    x1, y1 = sim_apply(F.col("ti"), F.col("px"), F.col("py"))
    x2, y2 = sim_apply(F.col("tj"), F.col("qx"), F.col("qy"))
    return obs.join(pairs, [*GROUP, "i", "j"]).withColumn("r", F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2))


def _normal_entries(weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matrix cells and right-hand side of the linear problem T_i(p) = T_j(q), anchor fixed.

    A pair of sources contributes through nine weighted moments, summed before any shuffle; the
    8 x 8 cell values are then plain sums of those moments.
    """
    moments = {
        "w": "1", "px": "px", "py": "py", "qx": "qx", "qy": "qy", "pp": "px*px + py*py", "qq": "qx*qx + qy*qy",
        "pq": "px*qx + py*qy", "pxq": "px*qy - py*qx"}
    # one row per pair of sources: written once, so the observations are read once per pass
    pair = cut(weighted.groupBy(*GROUP, "anchor", "i", "j").agg(
        *[F.expr(f"sum(w * ({v}))").alias("s_" + k) for k, v in moments.items()]))

    def own(x, y, sq):
        return [[sq, "0D", x, y], ["0D", sq, "-" + y, x], [x, "-" + y, "s_w", "0D"], [y, x, "0D", "s_w"]]

    # rows of T_i(p) against columns of T_j(q): coefficients (x,-y,1,0) and (y,x,0,1)
    cross = [["s_pq", "-s_pxq", "s_px", "s_py"], ["s_pxq", "s_pq", "-s_py", "s_px"],
             ["s_qx", "-s_qy", "s_w", "0D"], ["s_qy", "s_qx", "0D", "s_w"]]
    blocks = {("i", "i"): own("s_px", "s_py", "s_pp"), ("j", "j"): own("s_qx", "s_qy", "s_qq"),
              ("i", "j"): [[f"-({c})" for c in row] for row in cross],
              ("j", "i"): [[f"-({cross[v][u]})" for v in range(4)] for u in range(4)]}
    cells = ", ".join(f"named_struct('row', {r}, 'u', {u}, 'col', {c}, 'v', {v}, 'val', {block[u][v]})"
                      for (r, c), block in blocks.items() for u in range(4) for v in range(4))
    flat = pair.selectExpr(*GROUP, "anchor", f"inline(array({cells}))")
    free = flat.filter("row <> anchor")
    row = "row * 4 + u as i"
    entries = free.filter("col <> anchor").selectExpr(*GROUP, row, "col * 4 + v as j", "val")
    # the anchor is the identity (a = 1, others 0): its a-column moves to the right-hand side
    return entries, free.selectExpr(*GROUP, row, "if(col = anchor and v = 0, -val, 0D) as b")


def _system(i: np.ndarray, j: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray, n: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, column and value of the matrix cells and the right-hand side of the problem of ``_normal_entries``, n sources less the anchor."""
    of, pair = np.unique(i * n + j, return_inverse=True)
    i, j = of // n, of % n
    s = [np.bincount(pair, w * v, len(of)) for v in (1.0, *p, *q, (p * p).sum(0), (q * q).sum(0), (p * q).sum(0), p[0] * q[1] - p[1] * q[0])]
    w, px, py, qx, qy, pp, qq, pq, pxq = s
    o = np.zeros(len(of))

    def own(x, y, sq):
        return [[sq, o, x, y], [o, sq, -y, x], [x, -y, w, o], [y, x, o, w]]

    cross = [[-pq, pxq, -px, -py], [-pxq, -pq, py, -px], [-qx, qy, -w, o], [-qy, -qx, o, -w]]
    blocks = ((i, i, own(px, py, pp)), (j, j, own(qx, qy, qq)), (i, j, cross), (j, i, [list(c) for c in zip(*cross)]))
    row = np.concatenate([4 * r + u for r, _, _ in blocks for u in range(4) for _ in range(4)])
    col = np.concatenate([4 * c + v for _, c, _ in blocks for _ in range(4) for v in range(4)])
    val = np.concatenate([x for _, _, block in blocks for line in block for x in line])
    free = row // 4 != anchor
    known = free & (col == 4 * anchor)
    b = -np.bincount(row[known], val[known], 4 * n)
    free &= col // 4 != anchor
    cells, at = np.unique(row[free] * (4 * n) + col[free], return_inverse=True)
    rank = np.cumsum(np.arange(4 * n) // 4 != anchor) - 1
    return rank[cells // (4 * n)], rank[cells % (4 * n)], np.bincount(at, val[free], len(cells)), np.delete(b, np.s_[4 * anchor:4 * anchor + 4])


def _settle(i: np.ndarray, j: np.ndarray, p: np.ndarray, q: np.ndarray, knee: float, passes: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Ids and transforms (4 x sources) of one group in its own frame, and its rms; None where a system is singular."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n, (i, j) = len(ids), at.reshape(2, -1)
    anchor = int(np.bincount(at, minlength=n).argmax())
    if n < 2:
        return None
    w = np.ones(len(i))
    t = np.zeros((4, n))
    t[0, anchor] = 1.0
    others = np.flatnonzero(np.arange(n) != anchor)
    for _ in range(passes + 1):
        *cells, b = _system(i, j, w, p, q, n, anchor)
        x = eliminate(*cells, b[:, None])
        if x is None or not np.isfinite(x).all():
            return None
        t[:, others] = x.reshape(-1, 4).T
        (a, c, tx, ty), (d, e, ux, uy) = t[:, i], t[:, j]
        r = np.hypot(a * p[0] - c * p[1] + tx - d * q[0] + e * q[1] - ux, c * p[0] + a * p[1] + ty - e * q[0] - d * q[1] - uy)
        w = np.where(r <= knee, 1.0, knee / np.maximum(r, knee))
    rot, log = np.arctan2(t[1], t[0]).mean(), np.log(np.maximum(np.hypot(t[0], t[1]), 1e-9)).mean()
    turn = np.exp(-log - 1j * rot)
    spin, move = turn * (t[0] + 1j * t[1]), turn * (t[2] + 1j * t[3])
    return ids, np.stack([spin.real, spin.imag, move.real, move.imag]), float(np.sqrt((w * r * r).sum() / w.sum()))


def _in_tasks(obs: DataFrame, buckets: int, knee: float, passes: int) -> DataFrame:
    """Whole groups, many in a task: GROUP, source_id, t, and n and rms on one row of each group."""
    types = dict(obs.dtypes)

    def work(table: pa.Table) -> pa.Table:
        code = [np.unique(table[k].to_numpy(), return_inverse=True)[1] for k in GROUP]
        code = code[0] * (int(code[1].max()) + 1) + code[1]
        order = np.argsort(code, kind="stable")
        i, j = (table[c].to_numpy()[order] for c in "ij")
        p, q = (np.stack([table[c].to_numpy()[order] for c in names]) for names in (("px", "py"), ("qx", "qy")))
        ends = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
        out = []
        for first, end in zip(ends, ends[1:]):
            found = _settle(i[first:end], j[first:end], p[:, first:end], q[:, first:end], knee, passes)
            if found is not None:
                ids, t, rms = found
                told = np.arange(len(ids)) > 0
                out.append(pa.table([*[pa.repeat(table[k][int(order[first])], len(ids)) for k in GROUP], pa.array(ids), *map(pa.array, t),
                                     pa.array(np.full(len(ids), end - first), mask=told), pa.array(np.full(len(ids), rms), mask=told)], names=names))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], v) for k, v in kinds.items()})

    names = [*GROUP, "source_id", "a", "b", "tx", "ty", "n", "rms"]
    schema = ", ".join([f"{k} {types[k]}" for k in GROUP] + [f"source_id {types['i']}"] + [f"{c} double" for c in ("a", "b", "tx", "ty")] + ["n bigint", "rms double"])
    kinds = {f.name: f.type for f in to_arrow_schema(_parse_datatype_string(schema))}
    dealt = obs.select(*GROUP, "i", "j", *[F.col(c).cast("double") for c in ("px", "py", "qx", "qy")], F.pmod(F.xxhash64(*GROUP), F.lit(buckets)).alias("_bucket"))
    found = cut(dealt.groupBy("_bucket").applyInArrow(lambda t: work(t.drop(["_bucket"])), schema))
    return found.select(*GROUP, "source_id", sim(*[F.col(c) for c in ("a", "b", "tx", "ty")]).alias("t"), "n", "rms")


def place_similarity(pairs_obs: DataFrame, huber_knee: float = HUBER_KNEE, passes: int = IRLS_PASSES, task_entries: int = TASK_ENTRIES,
                     group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """One similarity per source into a frame shared by its group.

    ``pairs_obs``: set_id, component, i, j, px, py, qx, qy (a point of source i and its partner in
    source j).  The best-connected source is held at the identity while the others are solved
    together: one plain pass, then ``passes`` Huber-reweighted ones.  Finally the frame is turned and
    scaled so the mean rotation is 0 and the geometric mean scale 1.

    Groups of up to ``group_rows`` observations whose system fits into a task run all passes there, many groups together, so their observations are
    shuffled once; larger groups meet their observations by joins in every pass.

    Returns placements (set_id, component, source_id, t) and quality (set_id, component, n, rms).
    """
    each = pairs_obs.groupBy(*GROUP, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.count(F.col("px") + F.col("py") + F.col("qx") + F.col("qy")).alias("whole"))
    sizes = cut(each.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), 1)).alias("named"))
                .dropna(subset=GROUP)
                .withColumn("_fits", (F.col("n") <= group_rows) & (64 * F.col("pairs") <= task_entries) & (F.col("whole") == F.col("n")) & (F.col("named") == F.col("pairs"))))
    rows, beyond = sizes.agg(F.sum(F.when(F.col("_fits"), F.col("n"))), F.count(F.when(~F.col("_fits"), 1))).first()
    if beyond and not rows:
        return _place_by_joins(pairs_obs, huber_knee, passes, task_entries)
    few = pairs_obs.join(sizes.filter("_fits").select(*GROUP), GROUP, "left_semi") if beyond else pairs_obs.dropna(subset=GROUP)
    found = _in_tasks(few, max(1, -(-(rows or 0) // TOGETHER)), huber_knee, passes)
    placed, quality = found.select(*GROUP, "source_id", "t"), found.filter("n is not null").select(*GROUP, "n", "rms")
    if beyond:
        more, told = _place_by_joins(pairs_obs.join(sizes.filter("not _fits").select(*GROUP), GROUP, "left_semi"), huber_knee, passes, task_entries)
        placed, quality = placed.unionByName(more), quality.unionByName(told)
    return placed, quality


def _place_by_joins(pairs_obs: DataFrame, huber_knee: float, passes: int, task_entries: int) -> tuple[DataFrame, DataFrame]:
    """``place_similarity`` for groups of any size."""
    anchors = _anchors(pairs_obs)
    # sources are numbered densely within their group: unknowns are numbers of that count, whatever the ids are
    ends = pairs_obs.select(*GROUP, F.explode(F.array("i", "j")).alias("source_id")).distinct()
    numbered = cut(dense_index(ends, GROUP, ["source_id"], "at"))

    def number(df: DataFrame, column: str) -> DataFrame:
        known = numbered.select(*GROUP, F.col("source_id").alias(column), F.col("at").alias("_at"))
        return df.join(known, [*GROUP, column]).drop(column).withColumnRenamed("_at", column)

    # both ends of a pair are numbered on the short table of pairs
    pairs = number(number(pairs_obs.select(*GROUP, "i", "j").distinct().withColumn("i0", F.col("i")).withColumn("j0", F.col("j")), "i"), "j")
    pairs = cut(pairs.join(number(anchors, "anchor"), GROUP))
    # a pair fills 16 cells on either side of the diagonal, a source 16 on it: at most 48 cells a pair
    most = pairs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    small = 64 * most <= task_entries
    known = pairs_obs.withColumnRenamed("i", "i0").withColumnRenamed("j", "j0")
    obs = cut(known.join(pairs, [*GROUP, "i0", "j0"]).drop("i0", "j0").withColumn("w", F.lit(1.0)))
    members = numbered.select(*GROUP, F.col("at").alias("source_id")).join(number(anchors, "anchor"), GROUP)
    met = pairs.select(*GROUP, "i", "j")
    weighted = obs
    for k in range(passes + 1):
        entries, rhs = _normal_entries(weighted)
        solved = solve_spd(entries, rhs, GROUP, ["b"], task_entries, all_small=small, block=4)
        rows = (solved.select(*GROUP, F.expr("i div 4").alias("source_id"), F.expr("i % 4").alias("k"), "b")
                .groupBy(*GROUP, "source_id")
                .agg(*[F.max(F.when(F.col("k") == n, F.col("b"))).alias(c)
                       for n, c in enumerate(("a", "b_", "tx", "ty"))]))
        free = rows.select(*GROUP, "source_id",
                           sim(F.col("a"), F.col("b_"), F.col("tx"), F.col("ty")).alias("t"))
        fixed = members.filter("source_id = anchor").select(*GROUP, "source_id", sim(1.0, 0.0, 0.0, 0.0).alias("t"))
        placed = cut(free.unionByName(fixed))
        weighted = _attach(obs.drop("w"), met, placed).withColumn(
            "w", F.when(F.col("r") <= huber_knee, F.lit(1.0)).otherwise(huber_knee / F.col("r")))
        if k < passes:
            weighted = weighted.drop("ti", "tj")
    quality = weighted.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.sum(F.col("w") * F.col("r") ** 2) / F.sum("w")).alias("rms"))
    # a group whose system was singular has nobody but its anchor and is left out
    whole = placed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*GROUP)
    placed = placed.join(whole, GROUP, "left_semi")
    gauge = placed.groupBy(*GROUP).agg(
        F.avg(sim_rotation(F.col("t"))).alias("_rot"),
        F.avg(F.log(F.greatest(sim_scale(F.col("t")), F.lit(1e-9)))).alias("_log"))
    turn = sim_from_polar(F.exp(-F.col("_log")), -F.col("_rot"), F.lit(0.0), F.lit(0.0))
    named = numbered.select(*GROUP, "source_id", "at")
    final = (placed.withColumnRenamed("source_id", "at").join(gauge, GROUP).withColumn("_g", turn).join(named, [*GROUP, "at"])
             .select(*GROUP, "source_id", sim_compose(F.col("_g"), F.col("t")).alias("t")))
    return cut(final), quality


def residual_metrics(residuals: DataFrame, keys: list[str], huber: float | None = None,
                     usable: str | None = None) -> DataFrame:
    """Per group: usable count, plain RMS (infinite without any), Huber loss and mean IRLS weight.

    ``residuals`` has rx, ry.  Unusable observations (``usable`` false) cost 1e6 in the loss and
    do not enter the RMS.
    """
    ok = F.col(usable) if usable else F.lit(True)
    r = F.sqrt(F.col("rx") ** 2 + F.col("ry") ** 2)
    weight = irls_weight(r, huber) if huber is not None else F.lit(1.0)
    return residuals.groupBy(*keys).agg(
        F.count(F.when(ok, 1)).alias("n"),
        F.coalesce(F.sqrt(F.avg(F.when(ok, r * r))), F.lit(float("inf"))).alias("rms"),
        F.sum(F.when(ok, huber_loss(r, huber)).otherwise(1e6)).alias("loss"),
        F.avg(F.when(ok, weight)).alias("mean_weight"))


def camera_residuals(obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Residual of observations (a, b, centred ax, ay, bx, by) under known cameras: rx, ry, usable."""
    ca = cameras.select("set_id", F.col("source_id").alias("a"), F.col("rot").alias("ra"), F.col("focal").alias("fa"))
    cb = cameras.select("set_id", F.col("source_id").alias("b"), F.col("rot").alias("rb"), F.col("focal").alias("fb"))
    both = obs.join(ca, ["set_id", "a"]).join(cb, ["set_id", "b"])
    q = (F.col("bx") / F.col("fb"), F.col("by") / F.col("fb"), F.lit(1.0))
    world = [F.col("rb")[c] * q[0] + F.col("rb")[3 + c] * q[1] + F.col("rb")[6 + c] * q[2] for c in range(3)]
    px, py, pz = (F.col("ra")[3 * r] * world[0] + F.col("ra")[3 * r + 1] * world[1]
                  + F.col("ra")[3 * r + 2] * world[2] for r in range(3))
    z = F.when(pz > 1e-9, pz)
    return both.select(*obs.columns, (F.col("fa") * px / z - F.col("ax")).alias("rx"),
                       (F.col("fa") * py / z - F.col("ay")).alias("ry"), (pz > 1e-9).alias("usable"))


def placement_residuals(obs: DataFrame, placements: DataFrame) -> DataFrame:
    """T_i(p) - T_j(q) for observations i, j, px, py, qx, qy: rx, ry."""
    ti = placements.select(*GROUP, F.col("source_id").alias("i"), F.col("t").alias("ti"))
    tj = placements.select(*GROUP, F.col("source_id").alias("j"), F.col("t").alias("tj"))
    x1, y1 = sim_apply(F.col("ti"), F.col("px"), F.col("py"))
    x2, y2 = sim_apply(F.col("tj"), F.col("qx"), F.col("qy"))
    return (obs.join(ti, [*GROUP, "i"]).join(tj, [*GROUP, "j"])
            .select(*obs.columns, (x1 - x2).alias("rx"), (y1 - y2).alias("ry")))


# --- frames --------------------------------------------------------------------------------------

def border_samples(width: Column, height: Column, steps: int) -> Column:
    """Array of points along the four edges, ``steps`` + 1 per edge."""
    def edge(k):
        s = k.cast("double") / steps
        return F.array(F.struct((s * width).alias("x"), F.lit(0.0).alias("y")),
                       F.struct((s * width).alias("x"), height.cast("double").alias("y")),
                       F.struct(F.lit(0.0).alias("x"), (s * height).alias("y")),
                       F.struct(width.cast("double").alias("x"), (s * height).alias("y")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(steps)), edge))


def frame_extent(placements: DataFrame, width: int | Column, keys: list[str]) -> DataFrame:
    """Flat frame of similarity-placed sources: keys, origin_x, origin_y, extent_x, extent_y, scale, size.

    ``placements``: keys, t, width, height.  Frames without area are left out.
    """
    corners = placements.select(*keys, "t", F.explode(border_samples(F.col("width"), F.col("height"), 1)).alias("p"))
    x, y = sim_apply(F.col("t"), F.col("p.x"), F.col("p.y"))
    box = corners.select(*keys, x.alias("x"), y.alias("y")).groupBy(*keys).agg(
        F.min("x").alias("origin_x"), F.min("y").alias("origin_y"),
        (F.max("x") - F.min("x")).alias("extent_x"), (F.max("y") - F.min("y")).alias("extent_y"))
    return rescale_frame(box.filter("extent_x > 0 and extent_y > 0"), width)


def rescale_frame(frame: DataFrame, width: int | Column) -> DataFrame:
    """Same extent at another output width."""
    w = F.lit(width) if isinstance(width, int) else width
    return (frame.withColumn("scale", w / F.col("extent_x"))
            .withColumn("out_width", w.cast("int"))
            .withColumn("out_height", F.greatest(F.lit(1), F.floor(F.col("extent_y") * F.col("scale"))).cast("int")))


def angular_frame(cameras: DataFrame, projection: Column, width: int | Column, keys: list[str]) -> DataFrame:
    """Frame of cameras: theta, phi and plane extents from 17 border samples per edge."""
    samples = cameras.select(*keys, "rot", "focal", "width", "height",
                             F.explode(border_samples(F.col("width"), F.col("height"), 16)).alias("p"))
    cx, cy = cam_centered(F.col("width"), F.col("height"), F.col("p.x"), F.col("p.y"))
    theta, phi = ray_angles(cam_ray(F.col("rot"), F.col("focal"), cx, cy))
    angles = samples.select(*keys, theta.alias("theta"), phi.alias("phi"))
    u, v = proj_forward(projection, F.col("theta"), F.col("phi"))
    box = angles.withColumns({"u": u, "v": v}).groupBy(*keys).agg(
        F.min("theta").alias("theta_min"), F.max("theta").alias("theta_max"),
        F.min("phi").alias("phi_min"), F.max("phi").alias("phi_max"),
        F.min("u").alias("u_min"), F.max("u").alias("u_max"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    flat = (box.filter("u_max > u_min and v_max > v_min")
            .withColumn("extent_x", F.col("u_max") - F.col("u_min"))
            .withColumn("extent_y", F.col("v_max") - F.col("v_min")))
    return rescale_frame(flat, width)


def auto_projection(theta_span: Column, choice: Column | None = None) -> Column:
    """An explicit choice wins; else pannini under 160 degrees, spherical from there."""
    auto = F.when(theta_span < F.radians(F.lit(160.0)), "pannini").otherwise("spherical")
    return auto if choice is None else F.coalesce(choice, auto)


def natural_width(span: Column, px_per_unit: Column, cap: int) -> Column:
    """Output width that keeps the sources' own resolution: at least 1000, at most ``cap``.

    4000 stands in when either input is unknown.
    """
    own = F.floor(span * px_per_unit)
    return F.when(own.isNull(), 4000).otherwise(F.least(F.greatest(F.lit(1000), own), F.lit(cap))).cast("int")


def camera_widths(cameras: DataFrame, catalog: DataFrame, frame: DataFrame, cap: int = 12_000) -> DataFrame:
    """set_id, width: the output width at which a set of cameras keeps the mean resolution of its full-size sources.

    ``cameras``: set_id, source_id, focal, width (as registered); ``catalog``: set_id, source_id, full_width; ``frame``: set_id, extent_x (angular).
    """
    per = F.avg(F.col("focal") * F.col("full_width") / F.col("width"))
    return _widths(cameras.select("set_id", "source_id", "focal", "width"), catalog, frame, per, cap)


def strip_widths(placements: DataFrame, catalog: DataFrame, frame: DataFrame, cap: int = 20_000) -> DataFrame:
    """The same for sources placed by similarities (t) in a flat frame."""
    per = F.avg(F.col("full_width") / F.col("width") / sim_scale(F.col("t")))
    return _widths(placements.select("set_id", "source_id", "t", "width"), catalog, frame, per, cap)


def _widths(placed: DataFrame, catalog: DataFrame, frame: DataFrame, per: Column, cap: int) -> DataFrame:
    joined = placed.join(catalog.select("set_id", "source_id", "full_width"), ["set_id", "source_id"], "left")
    found = joined.groupBy("set_id").agg(per.alias("_per"))
    return (frame.select("set_id", "extent_x").join(found, "set_id", "left")
            .select("set_id", natural_width(F.col("extent_x"), F.col("_per"), cap).alias("width")))


def working_width(aspect: Column, base: int = 700, top: int = 2500) -> Column:
    """Width of the low-resolution pass for a flat frame with a fixed cell budget."""
    return F.greatest(F.lit(base), F.least(F.lit(top), F.floor(F.sqrt(base * base * 9 / 16 * aspect)))).cast("int")
