"""Rigid alignment of volumes under missing wedges, averaging in Fourier space, and the loops that stand on both.

A pose (angle, loc) turns a record's volume about its centre and moves it onto a template. The search is over an
explicit grid of ZYZ angles; for each, the translation comes from one Fourier correlation under the joint mask.
Records stay in Spark as arrays; templates are a checked few and travel to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as K
from ..functions import turns
from ..functions.spectra import Shape, radii, usable
from ..plans.iterate import drop, settle

MOST_TEMPLATES = 4096
#: Voxels that a task turns at once.
_VOXELS = 1 << 18


def constrained_maxima(v1: np.ndarray, m1: np.ndarray, v2: np.ndarray, m2: np.ndarray, angle, coefficients: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, locs) of the best translation onto v1 of each volume of v2 (rows, ...) under one turn: correlation of both
    spectra without their means, under the product of m1 and the turned m2 (centred masks), each of length one. Places
    beyond n / 2 are negative shifts; the score is NaN where nothing is left under the masks."""
    return _maxima(v1, m1, K.rotate_masks(m2, angle), np.fft.fftn(K.rotate_many(v2, angle, coefficients=coefficients), axes=(1, 2, 3)))


def _maxima(v1: np.ndarray, m1: np.ndarray, turned: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """constrained_maxima() from turned masks and the spectra of turned volumes."""
    axes = (1, 2, 3)
    joint = np.fft.ifftshift(m1 * turned, axes=axes)
    f1, f2 = np.fft.fftn(v1)[None] * joint, f2 * joint
    f1[:, 0, 0, 0] = f2[:, 0, 0, 0] = 0
    size = np.sqrt((np.abs(f1) ** 2).sum(axes) * (np.abs(f2) ** 2).sum(axes))
    c = np.fft.ifftn(f1 * f2.conj(), axes=axes).real.reshape(len(f2), -1) * v1.size
    c = np.round(np.where(size[:, None] > 0, c / np.where(size > 0, size, 1)[:, None], np.nan), 9)
    best = np.where(size > 0, np.nan_to_num(c, nan=-np.inf).argmax(1), 0)
    at = np.stack(np.unravel_index(best, v1.shape), 1)
    return c[np.arange(len(c)), best], np.where(at > np.array(v1.shape) // 2, at - v1.shape, at).astype(float)


def align(v1: np.ndarray, m1: np.ndarray, v2: np.ndarray, m2: np.ndarray, angles) -> list[tuple]:
    """(score, angle, loc, error) of each volume of v2 (rows, ...): the best of all turns, the first of equal ones.

    A failure has the score NaN, no move, and says why."""
    return align_each([(v1, m1)], v2, m2, angles)[0]


def align_each(known: list[tuple[np.ndarray, np.ndarray]], v2: np.ndarray, m2: np.ndarray, angles) -> list[list[tuple]]:
    """align() onto each of the known (v1, m1): a volume is turned and transformed once a turn, for all of them."""
    n = len(v2)
    best = [(np.full(n, -np.inf), np.zeros((n, 3)), np.zeros((n, 3))) for _ in known]
    coefficients = K.spline_coefficients(v2)
    for a in angles:
        turned, f2 = K.rotate_masks(m2, a), np.fft.fftn(K.rotate_many(v2, a, coefficients=coefficients), axes=(1, 2, 3))
        for (v1, m1), (score, angle, loc) in zip(known, best):
            s, l = _maxima(v1, m1, turned, f2)
            better = s > score
            score[better], angle[better], loc[better] = s[better], a, l[better]
    lost = "no signal under the masks"
    return [[(float(s), a, l, None) if np.isfinite(s) else (float("nan"), np.zeros(3), np.zeros(3), lost) for s, a, l in zip(*b)] for b in best]


def candidate_angles(score: np.ndarray, width: int | None = None, most: int | None = None, first: int | None = None) -> list[tuple[float, float, float]]:
    """Angles at the local maxima of a periodic cube of scores over (2L)^3 Euler angles, best first, each turn once; of the
    `most` best places, if given, the `first` turns."""
    n = score.shape[0]
    width = max(3, n // 8) if width is None else width
    reach = (width + (width % 2 == 0)) // 2
    top = score
    for axis in range(3):
        top = np.max([np.roll(top, s, axis) for s in range(-reach, reach + 1)], axis=0)
    at = np.argwhere(score == top)
    order = np.argsort(-score[tuple(at.T)], kind="stable")[:most]
    t = 2 * np.pi * at[order] / n
    return K.distinct([tuple(x) for x in t - [np.pi / 2, np.pi, np.pi / 2]], most=first)


def _steps(step: float) -> np.ndarray:
    """Matrices of the turns of a step about each axis of the volume, both ways."""
    return np.array([K.matrix(a) for s in (step, -step) for a in ((s, 0.0, 0.0), (0.0, s, 0.0), (np.pi / 2, s, -np.pi / 2))])


def search(v1: np.ndarray, m1: np.ndarray, v2: np.ndarray, m2: np.ndarray, *, most: int = 8, peaks: int = 24, finalists: int = 4, refine: int = 6) -> tuple:
    """(score, angle, loc, error) of one volume v2 onto v1 without a grid of turns: the spectra's absolute values are
    correlated over all turns in one transform of harmonics up to degree `most`, and only the turns at its `peaks` highest
    local maxima get a translation search. The best `finalists` are refined: `refine` times a neighbouring turn, or half the
    step."""
    return search_each(v1, m1, v2[None], m2[None], most=most, peaks=peaks, finalists=finalists, refine=refine)[0]


def search_each(v1: np.ndarray, m1: np.ndarray, v2: np.ndarray, m2: np.ndarray, *, most: int = 8, peaks: int = 24, finalists: int = 4, refine: int = 6) -> list[tuple]:
    """search() of each volume of v2 (rows, ...), the turns of many volumes tried together."""
    out: list[tuple] = []
    rows = max(1, _VOXELS // (v1.size * max(peaks, 6 * finalists)))
    for top in range(0, len(v2), rows):
        v, m = v2[top : top + rows], m2[top : top + rows]
        coefficients, means = K.spline_coefficients(v), v.mean((1, 2, 3))

        def tried(who: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            turns_of = np.array([K.matrix(a) for a in angles])
            f2 = np.fft.fftn(K.rotate_each(coefficients[who], turns_of, means[who]), axes=(1, 2, 3))
            score, loc = _maxima(v1, m1, K.rotate_masks_each(m[who], turns_of), f2)
            return np.where(np.isfinite(score), score, -np.inf), loc

        starts = [candidate_angles(np.round(c, 9), most=4 * peaks, first=peaks) or [(0.0, 0.0, 0.0)] for c in turns.constrained(v1[None], m1[None], v, m, most)]
        who, angle = np.repeat(np.arange(len(v)), [len(s) for s in starts]), np.array([a for s in starts for a in s], float)
        score, loc = tried(who, angle)
        order = np.lexsort((np.arange(len(who)), -score, who))
        begin = np.searchsorted(who[order], who[order])
        kept = order[np.arange(len(order)) - begin < finalists]
        who, angle, score, loc = who[kept], angle[kept], score[kept], loc[kept]
        step = np.full(len(who), np.pi / (2 * most + 2))
        for _ in range(refine):
            near = {s: _steps(s) for s in np.unique(step).tolist()}
            around = np.array([K.angles_of(own @ a) for own, s in zip((K.matrix(x) for x in angle), step.tolist()) for a in near[s]])
            other, place = (x.reshape(len(who), 6, *x.shape[1:]) for x in tried(np.repeat(who, 6), around))
            best = np.arange(len(who)), other.argmax(1)
            better = other[best] > score + 1e-9
            score = np.where(better, other[best], score)
            angle = np.where(better[:, None], around.reshape(-1, 6, 3)[best], angle)
            loc = np.where(better[:, None], place[best], loc)
            step = np.where(better, step, step / 2)
        order = np.lexsort((np.arange(len(who)), -score, who))
        for i in order[np.searchsorted(who[order], np.arange(len(v)))]:
            out.append((float(score[i]), angle[i], loc[i], None) if score[i] > -np.inf else (float("nan"), np.zeros(3), np.zeros(3), "no signal under the masks"))
    return out


def _onto_own(records: DataFrame, templates: DataFrame, key: str, shape: Shape, kernel) -> DataFrame:
    """(key, template_id, score, angle, loc, err) of every record (key, template_id, v, m) by kernel(template's v and m,
    volumes, masks), which sees the records of one template together. The pairs come from a join: a record meets its own
    template only, and none is held on the driver."""
    size = int(np.prod(shape))
    kind, kind_t = (records.schema[c].dataType.simpleString() for c in (key, "template_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.column("template_id").to_pylist()
            for t in dict.fromkeys(names):
                batch = whole.take(pa.array([i for i, n in enumerate(names) if n == t]))
                tv, tm = (batch.column(c)[0].values.to_numpy().reshape(shape) for c in ("_v", "_m"))
                v, m = (batch.column(c).flatten().to_numpy().reshape(-1, *shape) for c in ("v", "m"))
                bad = ~(np.isfinite(v).all((1, 2, 3)) & np.isfinite(m).all((1, 2, 3))) | (not (np.isfinite(tv).all() and np.isfinite(tm).all()))
                found = [(float("nan"), np.zeros(3), np.zeros(3), "values that are not finite")] * len(batch)
                for i, f in zip(np.flatnonzero(~bad), kernel(tv, tm, v[~bad], m[~bad]) if not bad.all() else ()):
                    found[i] = f
                lists = [pa.array([list(f[k]) for f in found], pa.list_(pa.float64())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found]), *lists, pa.array([f[3] for f in found], pa.string())], [key, "template_id", "score", "angle", "loc", "err"])

    known = templates.select("template_id", F.col("v").cast("array<double>").alias("_v"), F.col("m").cast("array<double>").alias("_m")).where(usable("_v", size) & usable("_m", size))
    rows = records.select(key, "template_id", F.col("v").cast("array<double>"), F.col("m").cast("array<double>")).where(usable("v", size) & usable("m", size))
    # the search costs far more than the rows' way: pairs are dealt out, however few the templates or the files
    dealt = rows.join(known, "template_id").select(key, "template_id", "v", "m", "_v", "_m").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"{key} {kind}, template_id {kind_t}, score double, angle array<double>, loc array<double>, err string")


def align_own(records: DataFrame, templates: DataFrame, key: str, shape: Shape, angles) -> DataFrame:
    """Every record (key, template_id, v, m) onto the template that it names, over a grid of turns."""
    return _onto_own(records, templates, key, shape, lambda tv, tm, v, m: align(tv, tm, v, m, angles))


def search_own(records: DataFrame, templates: DataFrame, key: str, shape: Shape, **options) -> DataFrame:
    """Every record (key, template_id, v, m) onto the template that it names, by search()."""
    return _onto_own(records, templates, key, shape, lambda tv, tm, v, m: search_each(tv, tm, v, m, **options))


def align_all(records: DataFrame, templates: DataFrame, key: str, shape: Shape, angles) -> DataFrame:
    """(key, template_id, score, angle, loc, err): every record (key, v, m) against every template (template_id, v, m)."""
    rows = templates.select("template_id", F.col("v").cast("array<double>"), F.col("m").cast("array<double>")).orderBy("template_id").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    size = int(np.prod(shape))
    known = [(r.template_id, np.array(r.v).reshape(shape), np.array(r.m).reshape(shape)) for r in rows]
    sent = records.sparkSession.sparkContext.broadcast((known, angles))
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, angles = sent.value
        rows = max(1, _VOXELS // size)
        for whole in batches:
            for top in range(0, len(whole), rows):
                batch = whole.slice(top, rows)
                v, m = (batch.column(i).flatten().to_numpy().reshape(-1, *shape) for i in (1, 2))
                bad = ~(np.isfinite(v).all((1, 2, 3)) & np.isfinite(m).all((1, 2, 3)))
                v, m = (np.where(bad[:, None, None, None], 0.0, x) for x in (v, m))
                for (t, _, _), found in zip(known, align_each([k[1:] for k in known], v, m, angles)):
                    lists = [pa.array([list(f[k]) for f in found], pa.list_(pa.float64())) for k in (1, 2)]
                    err = ["values that are not finite" if b else f[3] for b, f in zip(bad, found)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), t, np.int32)), pa.array([f[0] for f in found]), *lists, pa.array(err, pa.string())], [key, "template_id", "score", "angle", "loc", "err"])

    rows = records.select(key, F.col("v").cast("array<double>"), F.col("m").cast("array<double>")).where(usable("v", size) & usable("m", size))
    # a record costs turns x templates transforms: they are dealt out, however few files they come from
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"{key} {kind}, template_id int, score double, angle array<double>, loc array<double>, err string")


def best_of(alignments: DataFrame, key: str) -> DataFrame:
    """Each record's best alignment; of equal scores the later template. Failures lose against all others."""
    rank = F.struct(F.when(F.isnan("score"), float("-inf")).otherwise(F.round("score", 9)).alias("s"), "template_id")
    return alignments.groupBy(key).agg(F.max_by(F.struct("template_id", "score", "angle", "loc", "err"), rank).alias("b")).select(key, "b.*")


def _alike(angle: np.ndarray, loc: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, angle, loc) of the rows that have one pose, as many as a task turns at once."""
    poses, which = np.unique(np.concatenate((angle, loc), 1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    step = max(1, _VOXELS // size)
    for pose, rows in zip(poses, np.split(order, np.cumsum(np.bincount(which.ravel(), minlength=len(poses)))[:-1])):
        for at in range(0, len(rows), step):
            yield rows[at : at + step], pose[:3], pose[3:]


def averages(records: DataFrame, group: str, shape: Shape, *, least: float = 1.0) -> DataFrame:
    """(group, n, v, m): averages of posed records (group, v, m, angle, loc): the sum's spectrum over the sum of turned
    masks where that reaches `least`, else 0; m is the mean mask. A task sends one partial sum a group."""
    size = int(np.prod(shape))
    kind = records.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind_pa = None
        for batch in batches:
            kind_pa = batch.schema.field(0).type
            v, m = (batch.column(i).flatten().to_numpy().reshape(-1, *shape) for i in (1, 2))
            angle, loc = (batch.column(i).flatten().to_numpy().reshape(-1, 3) for i in (3, 4))
            names = np.array(batch.column(0).to_pylist(), object)
            for some, a, l in _alike(angle, loc, size):
                turned, masks = K.rotate_many(v[some], a, l), K.rotate_masks(m[some], a)
                for g in dict.fromkeys(names[some].tolist()):
                    of = names[some] == g
                    own = sums.setdefault(g, [0, np.zeros(shape), np.zeros(shape)])
                    own[0] += int(of.sum())
                    own[1] += turned[of].sum(0)
                    own[2] += masks[of].sum(0)
        for g, (n, v, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * size, kind_pa), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array(v.ravel()), pa.array(m.ravel())], ["g", "pos", "n", "v", "m"])

    def finish(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        v, m = (table.column(c).to_numpy()[order].reshape(shape) for c in ("v", "m"))
        mask = np.fft.ifftshift(m)
        f = np.where(mask >= least, np.fft.fftn(v) / np.maximum(mask, 1e-300), 0)
        n = int(table.column("n")[0].as_py())
        return pa.table([table.column("g").slice(0, 1), pa.array([n]), pa.array([np.fft.ifftn(f).real.ravel()], pa.list_(pa.float64())), pa.array([(m / n).ravel()], pa.list_(pa.float64()))], [group, "n", "v", "m"])

    rows = records.select(group, *(F.col(c).cast("array<double>") for c in ("v", "m", "angle", "loc"))).where(F.col(group).isNotNull() & usable("v", size) & usable("m", size) & usable("angle", 3) & usable("loc", 3))
    parts = rows.mapInArrow(run, f"g {kind}, pos int, n long, v double, m double").groupBy("g", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("m").alias("m"))
    return parts.groupBy("g").applyInArrow(finish, f"{group} {kind}, n long, v array<double>, m array<double>")


def smoothed(v: np.ndarray, fsc: np.ndarray, mode: str = "direct") -> np.ndarray:
    """An average with its frequencies scaled by its FSC, or by the Gaussian of zero mean fitted to it (left as it is where
    that is wider than the bands)."""
    if not fsc.max() > 0:
        return v
    if mode == "gaussian":
        a, c = zero_mean_gaussian(np.arange(len(fsc)), fsc)
        if c >= len(fsc) - 1:
            return v
        fsc = a * np.exp(-(np.arange(len(fsc)) ** 2) / (2 * c * c))
    r = np.rint(radii(v.shape)).astype(int)
    return np.fft.ifftn(np.fft.fftn(v) * np.where(r < len(fsc), fsc[np.minimum(r, len(fsc) - 1)], 0)).real


def zero_mean_gaussian(x: np.ndarray, y: np.ndarray, *, starts: int = 8, rounds: int = 200) -> tuple[float, float]:
    """(a, c) of a * exp(-x^2 / (2 c^2)) with the least squares: damped Gauss-Newton from several widths."""
    best = (np.inf, float(y.max()), 1.0)
    for c in np.linspace(0.3, 1.5, starts) * max(np.abs(x).max(), 1e-9):
        a, damp = float(y.max()), 1e-2
        error = ((y - a * np.exp(-(x**2) / (2 * c * c))) ** 2).sum()
        for _ in range(rounds):
            e = np.exp(-(x**2) / (2 * c * c))
            j = np.stack((e, a * e * x**2 / c**3), 1)
            q = j.T @ j
            da, dc = np.linalg.solve(q + damp * np.diag(np.diag(q)) + 1e-12 * np.eye(2), j.T @ (y - a * e))
            new = ((y - (a + da) * np.exp(-(x**2) / (2 * (c + dc) ** 2))) ** 2).sum() if c + dc > 1e-6 else np.inf
            if new < error:
                if error - new < 1e-14:
                    break
                a, c, error, damp = a + da, c + dc, new, damp / 3
            else:
                damp *= 4
                if damp > 1e12:
                    break
        best = min(best, (error, a, abs(c)))
    return best[1], best[2]


def iterate_average(records: DataFrame, key: str, shape: Shape, angles, *, passes: int = 3, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(records with score, average): average under the poses, align every record to the average, and again.

    records: (key, v, m, angle, loc). Each pass's poses are written; volumes are read from the records anew.
    """
    images = records.select(key, "v", "m")
    poses = settle(records.select(key, "angle", "loc", F.lit(None).cast("double").alias("score")))
    for _ in range(passes):
        average = settle(averages(images.join(poses, key).withColumn("_g", F.lit(0)), "_g", shape, least=least))
        found = best_of(align_all(images, average.select(F.lit(0).alias("template_id"), "v", "m"), key, shape, angles), key)
        new = settle(found.select(key, "angle", "loc", "score"))
        drop(poses, average)
        poses = new
    last = averages(images.join(poses, key).withColumn("_g", F.lit(0)), "_g", shape, least=least)
    return poses, last.drop("_g")


def iterate_classify(records: DataFrame, key: str, shape: Shape, angles, k: int, *, passes: int = 3, axes: int = 4, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(poses with cluster, averages): turn the records, reduce them to principal components, cluster by k-means, average
    each cluster, align every record to all averages, and again."""
    from ..functions.spectra import map_volumes
    from .regions import lloyd
    from .statistics import principal_axes

    size = int(np.prod(shape))
    images = records.select(key, "v", "m")
    poses = settle(records.select(key, "angle", "loc", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("score")))
    for _ in range(passes):
        posed = images.join(poses.select(key, "angle", "loc"), key)
        turned = settle(turn(posed, key, shape))
        _, directions = principal_axes(turned, "turned", size, axes)
        flat = map_volumes(turned, ["turned"], shape, lambda t: {"p": t.reshape(len(t), -1) @ directions.T}, ["p"]).select(key, "p")
        first = [list(r.p) for r in flat.orderBy(F.xxhash64(key), key).limit(k).collect()]
        labels, _ = lloyd(flat, first, 8, key, "p")
        clusters = settle(labels)
        average = settle(averages(posed.join(clusters, key), "cluster", shape, least=least))
        found = best_of(align_all(images, average.select(F.col("cluster").alias("template_id"), "v", "m"), key, shape, angles), key)
        new = settle(found.select(key, "angle", "loc", "score").join(clusters, key))
        drop(turned, clusters)
        poses = new
    last = averages(images.join(poses, key), "cluster", shape, least=least)
    return poses, last


def turn(posed: DataFrame, key: str, shape: Shape) -> DataFrame:
    """(key, turned): each record's volume under its pose."""
    size = int(np.prod(shape))
    kind = posed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, *shape)
            angle, loc = (batch.column(i).flatten().to_numpy().reshape(-1, 3) for i in (2, 3))
            out = np.empty((len(v), size))
            for some, a, l in _alike(angle, loc, size):
                out[some] = K.rotate_many(v[some], a, l).reshape(-1, size)
            out = out.ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size), pa.array(out, pa.float64()))], [key, "turned"])

    rows = posed.select(key, *(F.col(c).cast("array<double>") for c in ("v", "angle", "loc"))).where(usable("v", size) & usable("angle", 3) & usable("loc", 3))
    return rows.mapInArrow(run, f"{key} {kind}, turned array<double>")


def pursue(records: DataFrame, key: str, shape: Shape, angles, k: int, *, most: int = 10, patience: int = 2, overlap: float = 0.5) -> DataFrame:
    """(pass, cluster, fsc, n, v, m): patterns found by classification passes, until no pass of the last `patience` adds one.

    Every pass classifies the records anew under the poses so far; a cluster is selected, by falling sums of its FSC, if
    at most `overlap` of its members stand in clusters selected before. Records are aligned to the selected averages.
    """
    from ..functions.spectra import shell_snr, spectral_sums
    from .regions import cover

    spark = records.sparkSession
    state, members, found, last_new, number = records, None, None, 0, 0
    while number < most and number - last_new < patience:
        poses, means = iterate_classify(state, key, shape, angles, k, passes=1)
        poses = settle(poses)
        turned = turn(records.select(key, "v", "m").join(poses.select(key, "angle", "loc"), key), key, shape).join(poses.select(key, "cluster"), key)
        fsc = shell_snr(spectral_sums(turned, ["cluster"], "turned", shape), ["cluster"], shape).groupBy("cluster").agg(F.sum("fsc").alias("fsc"))
        name = F.col("cluster") + number * k
        own = settle(means.join(fsc, "cluster").select(F.lit(number).alias("pass"), name.alias("cluster"), "fsc", "n", "v", "m"))
        rows = settle(poses.select(name.alias("cluster"), F.col(key).alias("id")))
        members = rows if members is None else members.unionByName(rows)
        found = own if found is None else found.unionByName(own)
        taken = cover(members, found.select("cluster", F.col("fsc").alias("score")), overlap)
        newest = max((c // k for c in taken), default=0)
        last_new = newest if newest > last_new else last_new
        state = settle(records.select(key, "v", "m").join(poses.select(key, "angle", "loc"), key))
        number += 1
    chosen = spark.createDataFrame([(int(c),) for c in taken], "cluster int")
    return found.join(F.broadcast(chosen), "cluster").select("pass", "cluster", "fsc", "n", "v", "m")
