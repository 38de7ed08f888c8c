"""Neighbourhood operators on frames.

A frame is cut into tiles with a halo as wide as the operator reaches; one
shuffle brings a tile together, and every row pass and column pass of a
separable kernel then runs as a window inside it. Out-of-image samples are
copies made with the halo, so no pixel is exploded per kernel element and no
group is larger than a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pixelweave.operators.blocks import pad_axis
from pixelweave.operators.near import _group_numbers
from pixelweave.operators.temporal import gaussian_weights
from pixelweave.schemas import frame_keys, val
from pixelweave.session import attach, cut_lineage, spread

TILE = 256


class Tiles:
    """Tiled rows of a stack plus the row and column windows over them.

    mode: "reflect", "nearest", "mirror", or "constant" (outside reads as 0).
    """

    def __init__(self, df: DataFrame, ry: int, rx: int, mode: str = "reflect", tile: int = TILE):
        self.columns = df.columns
        self.constant = mode == "constant"
        tile = max(tile, ry, rx)
        rows = pad_axis(df, "x", F.col("w"), rx, rx, "none" if self.constant else mode, "_x")
        rows = pad_axis(rows, "y", F.col("h"), ry, ry, "none" if self.constant else mode, "_y")

        def span(u: str, r: int, size: str) -> Column:
            lo = F.floor(F.least(F.greatest(F.col(u) - r, F.lit(0)), F.col(size) - 1) / tile)
            hi = F.floor(F.greatest(F.least(F.col(u) + r, F.col(size) - 1), F.lit(0)) / tile)
            return F.sequence(lo, hi)

        keys = frame_keys(df)
        rows = (rows.withColumn("_tx", F.explode(span("_x", rx, "w"))).withColumn("_ty", F.explode(span("_y", ry, "h")))
                .withColumn("_core", (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y"))
                            & (F.col("_tx") == F.floor(F.col("_x") / tile)) & (F.col("_ty") == F.floor(F.col("_y") / tile))))
        self.rows = spread(rows, *keys, "_ty", "_tx")
        self.wx = Window.partitionBy(*keys, "_ty", "_tx", "_y").orderBy("_x")
        self.wy = Window.partitionBy(*keys, "_ty", "_tx", "_x").orderBy("_y")

    def at(self, column: str, k: int, window) -> Column:
        """The value k samples ahead (behind when negative) along a window."""
        if k == 0:
            return F.col(column)
        c = F.lead(column, k).over(window) if k > 0 else F.lag(column, -k).over(window)
        return F.coalesce(c, F.lit(0.0)) if self.constant else c

    def sum_along(self, column: str, weights, window, origin: int | None = None) -> Column:
        """Correlation with a 1-D kernel centred at ``origin``."""
        o = len(weights) // 2 if origin is None else origin
        terms = [self.at(column, i - o, window) * float(c) for i, c in enumerate(weights) if c]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

    def put(self, **columns: Column) -> "Tiles":
        self.rows = self.rows.withColumns(columns)
        return self

    def separable(self, out: str, wy, wx, source: str = "value") -> "Tiles":
        """out = column pass(wy) of row pass(wx)."""
        self.put(**{f"_r_{out}": self.sum_along(source, wx, self.wx)})
        return self.put(**{out: self.sum_along(f"_r_{out}", wy, self.wy)})

    def kernel(self, out: str, kernel, source: str = "value") -> "Tiles":
        """Correlation with any small 2-D kernel, one row pass per distinct kernel row."""
        k = np.asarray(kernel, dtype=float)
        oy, ox = k.shape[0] // 2, k.shape[1] // 2
        used = [i for i in range(k.shape[0]) if k[i].any()]
        self.put(**{f"_k{i}_{out}": self.sum_along(source, k[i], self.wx, ox) for i in used})
        terms = [self.at(f"_k{i}_{out}", i - oy, self.wy) for i in used]
        return self.put(**{out: sum(terms[1:], terms[0])})

    def extreme(self, out: str, agg, before: int, after: int, source: str = "value") -> "Tiles":
        """Box maximum or minimum as a row window and a column window."""
        self.put(**{f"_e_{out}": agg(source).over(self.wx.rowsBetween(-before, after))})
        return self.put(**{out: agg(f"_e_{out}").over(self.wy.rowsBetween(-before, after))})

    def done(self, *extra: str, value: Column | str | None = None) -> DataFrame:
        rows = self.rows.where("_core")
        if value is not None:
            rows = rows.withColumn("value", F.col(value) if isinstance(value, str) else value)
        return rows.select(*self.columns, *extra)


def convolve2d(df: DataFrame, kernel, mode: str = "reflect") -> DataFrame:
    k = np.asarray(kernel, dtype=float)
    return Tiles(df, k.shape[0] // 2, k.shape[1] // 2, mode).kernel("_v", k).done(value="_v")


def convolve_separable(df: DataFrame, wy, wx, mode: str = "reflect") -> DataFrame:
    return Tiles(df, len(wy) // 2, len(wx) // 2, mode).separable("_v", wy, wx).done(value="_v")


# -- smoothing and edges ----------------------------------------------------

def gaussian_blur(df: DataFrame, sigma: float, norm_edges: bool = False, mode: str | None = None) -> DataFrame:
    w = gaussian_weights(sigma)
    return convolve_separable(df, w, w, mode or ("constant" if norm_edges else "nearest"))


def difference_of_gaussians(df: DataFrame, sigma1: float, sigma2: float, mode: str = "nearest") -> DataFrame:
    a, b = gaussian_weights(sigma1), gaussian_weights(sigma2)
    r = max(len(a), len(b)) // 2
    t = Tiles(df, r, r, mode).separable("_a", a, a).separable("_b", b, b)
    return t.done(value=F.col("_a") - F.col("_b"))


def gaussian_derivative(sigma: float, order: int, truncate: float = 4.0) -> np.ndarray:
    """Weights of the Gaussian or its first or second derivative."""
    g = gaussian_weights(sigma, truncate)
    x = np.arange(len(g)) - len(g) // 2
    return {0: g, 1: x / sigma ** 2 * g, 2: (x ** 2 / sigma ** 4 - 1 / sigma ** 2) * g}[order]


SMOOTH, EDGE = (0.25, 0.5, 0.25), (-1.0, 0.0, 1.0)


def sobel(df: DataFrame) -> DataFrame:
    t = Tiles(df, 1, 1).separable("_gx", SMOOTH, EDGE).separable("_gy", EDGE, SMOOTH)
    return t.done(value=F.sqrt((F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")) / 2))


def laplacian(df: DataFrame) -> DataFrame:
    return convolve2d(df, [[0, -1, 0], [-1, 4, -1], [0, -1, 0]])


def _gauss_parts(t: Tiles, out: str, sigma: float, oy: int, ox: int) -> Tiles:
    return t.separable(out, gaussian_derivative(sigma, oy), gaussian_derivative(sigma, ox))


def gaussian_laplace(df: DataFrame, sigma: float) -> DataFrame:
    r = len(gaussian_weights(sigma)) // 2
    t = _gauss_parts(_gauss_parts(Tiles(df, r, r), "_a", sigma, 2, 0), "_b", sigma, 0, 2)
    return t.done(value=F.col("_a") + F.col("_b"))


def gaussian_gradient_magnitude(df: DataFrame, sigma: float) -> DataFrame:
    r = len(gaussian_weights(sigma)) // 2
    t = _gauss_parts(_gauss_parts(Tiles(df, r, r), "_a", sigma, 1, 0), "_b", sigma, 0, 1)
    return t.done(value=F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")))


def gabor_weights(frequency: float, theta: float, n_std: float = 3.0):
    """Real Gabor kernel with a round envelope of one octave as two separable parts."""
    sigma = 3 * math.sqrt(math.log(2) / 2) / (math.pi * frequency)
    rx = math.ceil(max(abs(n_std * sigma * math.cos(theta)), abs(n_std * sigma * math.sin(theta)), 1))
    x = np.arange(-rx, rx + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2) / (math.sqrt(2 * math.pi) * sigma)
    ax, ay = 2 * math.pi * frequency * math.cos(theta), 2 * math.pi * frequency * math.sin(theta)
    return (g * np.cos(ay * x), g * np.cos(ax * x)), (g * np.sin(ay * x), g * np.sin(ax * x))


def gabor(df: DataFrame, frequency: float, theta: float = 0.0) -> DataFrame:
    """Real response; cos(a + b) splits the kernel into two separable products."""
    (cy, cx), (sy, sx) = gabor_weights(frequency, theta)
    r = len(cx) // 2
    t = Tiles(df, r, r).separable("_c", cy, cx).separable("_s", sy, sx)
    return t.done(value=F.col("_c") - F.col("_s"))


# -- rank filters -----------------------------------------------------------

def _span(size: int) -> tuple[int, int]:
    return size // 2, size - 1 - size // 2


def maximum_filter(df: DataFrame, size: int) -> DataFrame:
    b, a = _span(size)
    return Tiles(df, b, b).extreme("_v", F.max, b, a).done(value="_v")


def minimum_filter(df: DataFrame, size: int) -> DataFrame:
    b, a = _span(size)
    return Tiles(df, b, b).extreme("_v", F.min, b, a).done(value="_v")


def percentile_filter(df: DataFrame, percentile: float, size: int) -> DataFrame:
    """The element of that rank among the size x size neighbours (no interpolation)."""
    b, a = _span(size)
    rank = size * size - 1 if percentile == 100 else int(float(size * size) * percentile / 100.0)
    t = Tiles(df, b, b)
    t.put(_row=F.collect_list("value").over(t.wx.rowsBetween(-b, a)))
    t.put(_box=F.flatten(F.collect_list("_row").over(t.wy.rowsBetween(-b, a))))
    return t.done(value=F.element_at(F.array_sort("_box"), rank + 1))


def median_2d(df: DataFrame, size: int) -> DataFrame:
    return percentile_filter(df, 50.0, size)


def grayscale_opening(df: DataFrame, size: int) -> DataFrame:
    return _open_close(df, size, F.min, F.max)


def grayscale_closing(df: DataFrame, size: int) -> DataFrame:
    return _open_close(df, size, F.max, F.min)


def _open_close(df: DataFrame, size: int, first, second) -> DataFrame:
    """Two rank passes. An odd window keeps reflected padding symmetric, so both
    run in one tiling of twice the reach; an even one is done in two, the second
    window mirrored as the adjoint of the first."""
    b, a = _span(size)
    if size % 2:
        return Tiles(df, 2 * b, 2 * b).extreme("_m", first, b, a).extreme("_v", second, b, a, "_m").done(value="_v")
    once = Tiles(df, b, b).extreme("_v", first, b, a).done(value="_v")
    return Tiles(once, b, b).extreme("_v", second, a, b).done(value="_v")


def morphological_gradient(df: DataFrame, size: int) -> DataFrame:
    b, a = _span(size)
    t = Tiles(df, b, b).extreme("_hi", F.max, b, a).extreme("_lo", F.min, b, a)
    return t.done(value=F.col("_hi") - F.col("_lo"))


def box_filter(df: DataFrame, size: int = 3) -> DataFrame:
    w = np.full(size, 1.0 / size)
    return convolve_separable(df, w, w)


def lowered_gaussian(df: DataFrame, sigma: float = 1.6, size: int = 3) -> DataFrame:
    g, u = gaussian_weights(sigma), np.full(size, 1.0 / size)
    r = max(len(g), size) // 2
    t = Tiles(df, r, r).separable("_a", g, g).separable("_b", u, u)
    return t.done(value=F.col("_a") - F.col("_b"))


def difference_of_averaging(df: DataFrame, size1: int = 3, size2: int = 5) -> DataFrame:
    a, b = np.full(size1, 1.0 / size1), np.full(size2, 1.0 / size2)
    r = max(size1, size2) // 2
    t = Tiles(df, r, r).separable("_a", a, a).separable("_b", b, b)
    return t.done(value=F.col("_a") - F.col("_b"))


def bspline_wavelet(df: DataFrame, scale: int = 2, order: int = 3) -> DataFrame:
    """Last a-trous plane: difference of successive B-spline smoothings, zero outside."""
    taps = (0.25, 0.5, 0.25) if order == 1 else (1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16)
    reach = (len(taps) - 1) // 2 * (2 ** scale - 1)
    t = Tiles(df, reach, reach, "constant").put(_s0=val())
    for j in range(scale):
        dilated = np.zeros((len(taps) - 1) * 2 ** j + 1)
        dilated[::2 ** j] = taps
        t.separable(f"_s{j + 1}", dilated, dilated, f"_s{j}")
    return t.done(value=F.col(f"_s{scale - 1}") - F.col(f"_s{scale}"))


FILTERS = {"none": lambda df: df, "gaussian": lambda df, sigma=1.6: gaussian_blur(df, sigma, mode="reflect"),
           "difference_of_gaussians": lambda df, sigma1=1.0, sigma2=1.6: difference_of_gaussians(df, sigma1, sigma2, "reflect"),
           "lowered_gaussian": lowered_gaussian, "difference_of_averaging": difference_of_averaging,
           "median": lambda df, size=3: median_2d(df, size), "box": box_filter, "wavelet": bspline_wavelet}


def compound_filter(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Chain named filters: [("wavelet", {"scale": 2}), ("gaussian", {"sigma": 1.0})]."""
    for name, args in steps:
        df = df.transform(FILTERS[name], **args)
    return df


# -- thresholds and binary morphology --------------------------------------

def adaptive_threshold(df: DataFrame, offset: float, block_size: int) -> DataFrame:
    """Gaussian local mean minus offset as ``surface``, and value > surface as 0/1."""
    sigma = (block_size - 1) / 6.0
    w = gaussian_weights(sigma)
    r = len(w) // 2
    t = Tiles(df, r, r).separable("_m", w, w).put(surface=F.col("_m") - offset)
    return t.done("surface", value=(F.col("value") > F.col("surface")).cast("int"))


def _structuring(t: Tiles, out: str, agg, pick, radius: int, connectivity: int, outside: float, source: str = "value"):
    """Box (connectivity 2) or diamond (connectivity 1) of a radius, outside fixed.

    A diamond is row windows of shrinking width met by one column pass.
    """
    widths = {d: radius if connectivity > 1 else radius - d for d in range(radius + 1)}
    # a window cut by the image edge misses outside samples; they only matter for erosion
    def row(width: int) -> Column:
        inner = agg(source).over(t.wx.rowsBetween(-width, width))
        if outside == 0.0 and agg is F.min:
            n = F.count(F.lit(1)).over(t.wx.rowsBetween(-width, width))
            return F.when(n < 2 * width + 1, pick(inner, F.lit(0.0))).otherwise(inner)
        return inner

    t.put(**{f"_w{d}": row(w) for d, w in widths.items()})
    parts = []
    for d, _ in widths.items():
        for k in ({d, -d} if d else {0}):
            shifted = F.col(f"_w{d}") if k == 0 else (F.lead(f"_w{d}", k).over(t.wy) if k > 0 else F.lag(f"_w{d}", -k).over(t.wy))
            parts.append(F.coalesce(shifted, F.lit(outside)))
    return t.put(**{out: pick(*parts) if len(parts) > 1 else parts[0]})


def binary_dilation(df: DataFrame, connectivity: int = 1, iterations: int = 1) -> DataFrame:
    """n repeated dilations by a cross or box equal one by a diamond or larger box."""
    t = Tiles(df.withColumn("value", (val() != 0).cast("double")), iterations, iterations, "constant")
    _structuring(t, "_v", F.max, lambda *p: F.greatest(*p), iterations, connectivity, 0.0)
    return t.done(value=F.col("_v").cast("int"))


def binary_erosion(df: DataFrame, connectivity: int = 1, iterations: int = 1) -> DataFrame:
    """Outside the image counts as 0."""
    t = Tiles(df.withColumn("value", (val() != 0).cast("double")), iterations, iterations, "constant")
    _structuring(t, "_v", F.min, lambda *p: F.least(*p), iterations, connectivity, 0.0)
    return t.done(value=F.col("_v").cast("int"))


# -- features ---------------------------------------------------------------

def structure_tensor(df: DataFrame, sigma: float = 1.0) -> DataFrame:
    """coherency and orientation of the smoothed gradient products."""
    g = gaussian_weights(sigma)
    r = len(g) // 2
    t = Tiles(df, r + 1, r + 1, "constant")
    t.separable("_gx", SMOOTH, EDGE).separable("_gy", EDGE, SMOOTH)
    t.put(_xx=F.col("_gx") * F.col("_gx"), _yy=F.col("_gy") * F.col("_gy"), _xy=F.col("_gx") * F.col("_gy"))
    for n in ("xx", "yy", "xy"):
        t.separable(f"_j{n}", g, g, f"_{n}")
    trace, diff = F.col("_jxx") + F.col("_jyy"), F.col("_jxx") - F.col("_jyy")
    root = F.sqrt(diff * diff + 4 * F.col("_jxy") * F.col("_jxy"))
    t.put(coherency=F.when(trace > 1e-10, root / trace).otherwise(0.0), orientation=0.5 * F.atan2(2 * F.col("_jxy"), diff))
    return t.done("coherency", "orientation")


LBP_OFFSETS = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def _lbp(t: Tiles, out: str, source: str) -> Tiles:
    t.put(_l=t.at(source, -1, t.wx), _c=F.col(source), _r=t.at(source, 1, t.wx))
    side = {-1: "_l", 0: "_c", 1: "_r"}
    bits = [(t.at(side[dx], dy, t.wy) >= F.col(source)).cast("int") * (1 << b) for b, (dy, dx) in enumerate(LBP_OFFSETS)]
    return t.put(**{out: sum(bits[1:], bits[0]) / 255.0})


def lbp_8(df: DataFrame) -> DataFrame:
    """8-neighbour code / 255; the edge mirrors about the border pixel."""
    return _lbp(Tiles(df, 1, 1, "mirror"), "_v", "value").done(value="_v")


#: About how many pixels of tiles make one call, and samples worked on at once in it.
TOGETHER, SAMPLES = 100_000, 2_000_000


def _passes(a: np.ndarray, wy, wx, edge: int, rim: int = 0) -> np.ndarray:
    """Row pass(wx), then column pass(wy), over frames (n, y, x) that reach ``edge`` samples beyond what is wanted; ``rim`` of these are wanted too."""
    def along(v: np.ndarray, weights, axis: int) -> np.ndarray:
        size, total = v.shape[axis] - 2 * (edge - rim), None
        for i, c in enumerate(weights):
            if c:
                start = edge - rim + i - len(weights) // 2
                term = (v[:, start:start + size] if axis == 1 else v[:, :, start:start + size]) * float(c)
                total = term if total is None else total + term
        return np.zeros([n if k != axis else size for k, n in enumerate(v.shape)]) if total is None else total

    return along(along(a, wx, 2), wy, 1)


def _mirrored(start: int, stop: int, size: int) -> np.ndarray:
    """Position in the frame that each of the positions start..stop-1 shows when the edges reflect."""
    u = np.arange(start, stop) % (2 * size)
    return np.minimum(u, 2 * size - 1 - u)


def _feature_columns(ext: np.ndarray, codes: np.ndarray, edge: int, rows: np.ndarray, columns: np.ndarray, sigmas, gabors) -> list[np.ndarray]:
    """The features of tiles (n, y, x) with ``edge`` samples around; rows and columns say which product each smoothed sample takes."""
    def at(dy: int, dx: int, a: np.ndarray = ext) -> np.ndarray:
        return a[:, edge + dy:a.shape[1] - edge + dy, edge + dx:a.shape[2] - edge + dx]

    def gauss(s: float, oy: int, ox: int, rim: int = 0) -> np.ndarray:
        return _passes(ext, gaussian_derivative(s, oy), gaussian_derivative(s, ox), edge, rim)

    def mag(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(p * p + q * q)

    here, out, hessians = at(0, 0), [at(0, 0)], []
    for s in sigmas:
        yy, xx, xy = gauss(s, 2, 0), gauss(s, 0, 2), gauss(s, 1, 1)
        out += [gauss(s, 0, 0), mag(gauss(s, 1, 0), gauss(s, 0, 1)), yy + xx]
        hessians += [yy * xx - xy * xy, yy + xx]
    for smooth in ((1, 2, 1), (3, 10, 3), (1, 1, 1)):
        out.append(mag(_passes(ext, smooth, EDGE, edge), _passes(ext, EDGE, smooth, edge)))
    out.append(mag(here - at(1, 1), at(0, 1) - at(1, 0)))
    out.append(codes)
    out += hessians
    out += [np.abs(_passes(ext, cy, cx, edge) - _passes(ext, sy, sx, edge)) for (cy, cx), (sy, sx) in gabors]
    u, log = np.full(9, 1 / 9), np.log(ext + 1e-10)
    m1, m2 = _passes(log, u, u, edge), _passes(log * log, u, u, edge)
    out.append(np.maximum(m2 - m1 * m1, 0.0))
    # edge samples of the smoothed products are copies of products, not products of copies
    window = gaussian_weights(3.0)
    wide = len(window) // 2
    ty, tx = gauss(1.0, 1, 0, wide), gauss(1.0, 0, 1, wide)
    qxx, qyy, qxy = (_passes(p[:, rows][:, :, columns], window, window, wide) for p in (tx * tx, ty * ty, tx * ty))
    trace, diff = qxx + qyy, qxx - qyy
    root = np.sqrt(diff * diff + 4 * qxy * qxy)
    return [*out, 0.5 * np.arctan2(2 * qxy, diff), np.where(trace > 1e-10, root / trace, 0.0), 0.5 * (trace + root)]


def _about_border(start: int, stop: int, size: int) -> np.ndarray:
    """Positions start-1..stop when one sample beyond the frame mirrors about the border pixel."""
    u = np.abs(np.arange(start - 1, stop + 1))
    return np.maximum(np.where(u >= size, 2 * size - 2 - u, u), 0)


def _lbp_codes(ext: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """8-neighbour codes / 255 of tiles with one sample around."""
    def at(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        return a[:, 1 + dy:a.shape[1] - 1 + dy, 1 + dx:a.shape[2] - 1 + dx]

    code = sum(((at(ext, dy, dx) >= at(ext, 0, 0)) | np.isnan(at(ext, dy, dx))) * (1 << b) for b, (dy, dx) in enumerate(LBP_OFFSETS))
    gap = at(missing, 0, 0) | np.logical_or.reduce([at(missing, dy, dx) for dy, dx in LBP_OFFSETS])
    return np.where(gap, np.nan, code / 255.0)


def _tile_features(keys: list[str], rest: list[str], tile: int, edge: int, sigmas, gabors):
    """Task code: the pixels of whole tiles with their rims to the features of the pixels that are the tiles' own."""
    wide = len(gaussian_weights(3.0)) // 2

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = _group_numbers(table, [*keys, "_ty", "_tx", "h", "w"])
        y, x, h, w, ty, tx = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "h", "w", "_ty", "_tx"))
        value, gap = table.column("value").to_numpy(zero_copy_only=False).astype(float), np.asarray(table.column("value").is_null())
        core = (y // tile == ty) & (x // tile == tx)
        count = 1 + 3 * len(sigmas) + 5 + 2 * len(sigmas) + len(gabors) + 4
        found = np.zeros((count, len(y)))
        inside = np.flatnonzero((y >= 0) & (y < h) & (x >= 0) & (x < w) & (ty >= 0) & (tx >= 0) & (ty * tile < h) & (tx * tile < w))
        shape = np.unique(np.column_stack([h, w, ty, tx])[inside], axis=0, return_inverse=True)
        for k, (high, broad, by, bx) in enumerate(shape[0].tolist()):
            at = inside[shape[1].ravel() == k]
            y0, x0, y1, x1 = by * tile, bx * tile, min((by + 1) * tile, high), min((bx + 1) * tile, broad)
            low, left = max(y0 - edge, 0), max(x0 - edge, 0)
            size = (min(y1 + edge, high) - low, min(x1 + edge, broad) - left)
            number = np.unique(group[at], return_inverse=True)[1]
            step = max(1, SAMPLES // ((y1 - y0 + 2 * edge) * (x1 - x0 + 2 * edge)))
            order = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[order], np.arange(0, number.max() + 1 + step, step))
            ry, rx = _mirrored(y0 - edge, y1 + edge, high) - low, _mirrored(x0 - edge, x1 + edge, broad) - left
            py, px = _mirrored(y0 - wide, y1 + wide, high) - y0 + wide, _mirrored(x0 - wide, x1 + wide, broad) - x0 + wide
            my, mx = _about_border(y0, y1, high) - low, _about_border(x0, x1, broad) - left
            for i, (first, last) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                part = at[order[first:last]]
                slot = number[order[first:last]] - i * step
                v = np.full((int(slot.max()) + 1, *size), np.nan)
                lost = np.ones(v.shape, bool)
                v[slot, y[part] - low, x[part] - left] = value[part]
                lost[slot, y[part] - low, x[part] - left] = gap[part]
                own = core[part]
                mine, slot = part[own], slot[own]
                with np.errstate(all="ignore"):
                    codes = _lbp_codes(v[:, my][:, :, mx], lost[:, my][:, :, mx])
                    columns = _feature_columns(v[:, ry][:, :, rx], codes, edge, py, px, sigmas, gabors)
                for f, c in zip(found, columns, strict=True):
                    got = c[slot, y[mine] - y0, x[mine] - x0]
                    f[mine] = np.where(np.isnan(got), 0.0, got)
        keep = pa.array(core)
        out = table.select(rest).filter(keep)
        for i, f in enumerate(found):
            out = out.append_column(f"f{i}", pa.array(f[core]))
        return out

    return run


def pixel_features(df: DataFrame, sigmas=(1.0, 2.0), frequencies=(0.1,), orientations: int = 2) -> DataFrame:
    """Per-pixel feature columns f0.. of the min-max scaled frame.

    Intensity; per sigma blur, gradient magnitude and Laplacian; Sobel, Scharr,
    Roberts and Prewitt magnitudes; LBP; per sigma Hessian determinant and trace;
    Gabor magnitudes; local variance of the log; tensor orientation, coherency
    and larger eigenvalue. LBP keeps its mirrored edge. A feature that needs a
    null or missing sample is 0.

    A frame is cut into tiles with a rim as wide as the features reach; tiles
    are gathered, many to a call, and worked on as arrays of one shape.
    """
    keys = frame_keys(df)
    ext = cut_lineage(df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("_n")))
    total = ext.agg(F.sum("_n")).first()[0] or 0
    flat = F.col("_hi") > F.col("_lo")
    scaled = attach(df, ext.drop("_n"), keys).withColumn("value", F.when(flat, (val() - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")
    gabors = [gabor_weights(f, o * math.pi / orientations) for f in frequencies for o in range(orientations)]
    edge = max([len(gaussian_weights(s)) // 2 for s in sigmas] + [len(g[0][0]) // 2 for g in gabors]
               + [len(gaussian_weights(1.0)) // 2 + len(gaussian_weights(3.0)) // 2, 4])
    tile = max(TILE, edge)

    def span(u: str, size: str) -> Column:
        low = F.floor(F.least(F.greatest(F.col(u) - edge, F.lit(0)), F.col(u)) / tile)
        return F.explode(F.sequence(low, F.floor(F.greatest(F.least(F.col(u) + edge, F.col(size) - 1), F.col(u)) / tile)))

    rest = [c for c in df.columns if c != "value"]
    tiles = scaled.withColumn("_ty", span("y", "h")).withColumn("_tx", span("x", "w"))
    bucket = F.pmod(F.xxhash64(*keys, "_ty", "_tx"), F.lit(max(1, total // TOGETHER)))
    names = [f"f{i}" for i in range(10 + 5 * len(sigmas) + len(gabors))]
    schema = StructType([StructField(f.name, f.dataType) for f in df.select(*rest).schema] + [StructField(n, DoubleType()) for n in names])
    run = _tile_features(keys, rest, tile, edge, list(sigmas), gabors)
    return spread(tiles.withColumn("_bucket", bucket), "_bucket").groupBy("_bucket").applyInArrow(run, schema)


def skeleton_pixels(df: DataFrame) -> DataFrame:
    """End points (one neighbour) and branch points (three or more) of a 0/1 skeleton."""
    t = Tiles(df.withColumn("value", (val() != 0).cast("double")), 1, 1, "constant").kernel("_n", [[1, 1, 1], [1, 0, 1], [1, 1, 1]])
    kind = F.when(F.col("_n") == 1, "endpoint").when(F.col("_n") >= 3, "branch")
    return t.put(kind=kind).done("kind").where("value > 0 and kind is not null")


def template_match(df: DataFrame, template) -> DataFrame:
    """Normalised cross-correlation; (y, x) is the template's top-left corner and
    only positions where the template fits are returned."""
    k = np.asarray(template, dtype=float)
    kh, kw = k.shape
    n, centred = k.size, k - k.mean()
    norm = math.sqrt((centred ** 2).sum())
    t = Tiles(df, kh - 1, kw - 1, "constant")
    t.put(_v2=val() * val())
    t.put(**{f"_t{i}": t.sum_along("value", centred[i], t.wx, 0) for i in range(kh)})
    t.put(_b1=t.sum_along("value", np.ones(kw), t.wx, 0), _b2=t.sum_along("_v2", np.ones(kw), t.wx, 0))
    terms = [t.at(f"_t{i}", i, t.wy) for i in range(kh)]
    t.put(_cross=sum(terms[1:], terms[0]), _s1=t.sum_along("_b1", np.ones(kh), t.wy, 0), _s2=t.sum_along("_b2", np.ones(kh), t.wy, 0))
    spread = F.sqrt(F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / n, F.lit(0.0))) * norm
    out = t.put(_ncc=F.when(spread > 1e-12, F.col("_cross") / spread).otherwise(0.0)).done(value="_ncc")
    return out.where((F.col("y") <= F.col("h") - kh) & (F.col("x") <= F.col("w") - kw))


# -- distance ---------------------------------------------------------------

def lower_envelope(f: np.ndarray) -> np.ndarray:
    """min over u of (x - u)^2 + f[:, u] for every row and x, in one sweep to build the parabolas' envelope and one to read it.

    A row keeps the parabolas that are lowest somewhere and where each begins;
    a new one drops those it begins before. All rows go side by side. Infinite
    entries are no parabola; a row without any stays infinite.
    """
    n, w = f.shape
    rows, top = np.arange(n), np.full(n, -1)
    apex, start = np.zeros((n, w), np.int64), np.full((n, w), -np.inf)
    for q in range(w):
        todo = rows[np.isfinite(f[:, q])]
        begins = np.full(n, -np.inf)
        while len(todo):
            todo = todo[top[todo] >= 0]
            v = apex[todo, top[todo]]
            begins[todo] = ((f[todo, q] + q * q) - (f[todo, v] + v * v)) / (2.0 * (q - v))
            todo = todo[begins[todo] <= start[todo, top[todo]]]
            top[todo] -= 1
            begins[todo] = -np.inf
        new = rows[np.isfinite(f[:, q])]
        top[new] += 1
        apex[new, top[new]], start[new, top[new]] = q, begins[new]
    out, at = np.full(f.shape, np.inf), np.zeros(n, np.int64)
    some = rows[top >= 0]
    for x in range(w):
        move = some
        while len(move):
            move = move[at[move] < top[move]]
            move = move[start[move, at[move] + 1] < x]
            at[move] += 1
        v = apex[some, at[some]]
        out[some, x] = (x - v) ** 2 + f[some, v]
    return out


def _nearest_in_lines(batches):
    for batch in batches:
        depth = batch.column(1)
        widths = np.diff(depth.offsets.to_numpy())
        flat = depth.flatten().to_numpy(zero_copy_only=False).astype(float)  # a column without a zero has no depth: NaN
        ends = np.cumsum(widths)
        far = np.empty(len(flat))
        for w in np.unique(widths):
            places = (ends[widths == w, None] - w + np.arange(w)).astype(np.int64)
            f = flat[places] ** 2
            far[places] = np.sqrt(lower_envelope(np.where(np.isnan(f), np.inf, f)))
        values = pa.array(far, mask=~np.isfinite(far))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), values)], names=["row", "far"])


def distance_transform(df: DataFrame) -> DataFrame:
    """Euclidean distance of non-zero pixels to the nearest zero pixel of the frame; null where the frame has none.

    Column windows give the vertical distance of each pixel; along a row the
    distance is the lower envelope of one parabola per column, linear in the
    width of the frame.
    """
    keys = frame_keys(df)
    w = Window.partitionBy(*keys, "x").orderBy("y")
    zero = F.when(val() == 0, F.col("y"))
    up = F.last(zero, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(zero, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    g = F.least(F.col("y") - up, down - F.col("y"))
    rest = [c for c in df.columns if c not in ("x", "value")]
    lines = (df.withColumn("_g", g).groupBy(*rest)
             .agg(F.array_sort(F.collect_list(F.struct("x", F.col("_g").alias("g")))).alias("_line")))
    lines = lines.select(F.struct(*rest).alias("row"), F.transform("_line", lambda p: p["g"].cast("double")).alias("depth"))
    far = lines.mapInArrow(_nearest_in_lines, lines.select("row").schema.add("far", ArrayType(DoubleType())))
    moved = far.select("row.*", F.posexplode("far").alias("x", "value"))
    return moved.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) if c == "x" else F.col(c) for c in df.columns))
