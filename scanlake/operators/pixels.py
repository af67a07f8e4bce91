"""Pixel operators: image features, and rules over the features.

Images are decoded (``operators.decoding``) and measured in Arrow batches, one file at a time; only numbers and small arrays
leave a batch. The rules on top are Columns, and baselines are a table joined by (modality, feature).

Undecodable pixels (any syntax but native, deflated and RLE, or too few bytes) give null features. ``squeeze``
keeps the first frame and the first channel. A single colour image has the shape (rows, columns, samples), and
with ``compatible=True`` its *first row* is taken as a frame, as older results were computed; by default it isn't.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.findings import finding, findings, first_of
from scanlake.operators.decoding import native_pixels
from scanlake.scratch import written
from scanlake.sources.walker import Parsed, parse

LEVELS = 3
EDGES = {"top": (0.00, 0.08, 0.00, 1.00), "bottom": (0.92, 1.00, 0.00, 1.00), "left": (0.08, 0.92, 0.00, 0.10), "right": (0.08, 0.92, 0.90, 1.00)}
MARK_SIZE, MARK_PART, MARKS = 4, 0.02, 5


def samples(p: Parsed) -> tuple[np.ndarray, bool] | None:
    """All samples, as ([frames,] rows, columns[, channels]), and whether there are several frames; null where they can't be read."""
    raw = native_pixels(p)
    rows, cols = p.number("Rows", 0), p.number("Columns", 0)
    channels, frames, bits = max(1, p.number("SamplesPerPixel", 1)), max(1, p.number("NumberOfFrames", 1)), p.number("BitsAllocated", 0)
    need = rows * cols * channels * frames
    if raw is None or rows <= 0 or cols <= 0 or bits not in (1, 8, 16, 32) or len(raw) * 8 < need * bits:
        return None
    if bits == 1:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=need, bitorder="little")
    else:
        flat = np.frombuffer(raw, f"<{'i' if p.number('PixelRepresentation', 0) else 'u'}{bits // 8}", need)
    shape = (*((frames,) if frames > 1 else ()), rows, cols, *((channels,) if channels > 1 else ()))
    if channels > 1 and p.number("PlanarConfiguration", 0) == 1:
        return np.moveaxis(flat.reshape(frames, channels, rows, cols), 1, -1).reshape(shape), frames > 1
    return flat.reshape(shape), frames > 1


def image(p: Parsed, compatible: bool = False) -> np.ndarray | None:
    """The first frame's first channel as doubles, or null."""
    read = samples(p)
    return read and squeeze(*read, compatible).astype(np.float64)


def squeeze(px: np.ndarray, framed: bool, compatible: bool = False) -> np.ndarray:
    """First frame, then first channel."""
    px = first_frame(px, framed, compatible)
    return px[:, :, 0] if px.ndim == 3 else px


def first_frame(px: np.ndarray, framed: bool, compatible: bool = False) -> np.ndarray:
    """The first frame; with ``compatible`` also the first row of a single colour image, as if it were one."""
    return px[0] if px.ndim > 2 and (framed or compatible) and px.shape[0] > 1 else px


def grey(px: np.ndarray, framed: bool, compatible: bool = False) -> np.ndarray:
    """The first frame in grey values: the mean of its first three channels if it has three or four."""
    px = first_frame(px, framed, compatible)
    if px.ndim == 3:
        px = px[..., :3].mean(axis=-1) if px.shape[-1] in (3, 4) else px[..., 0]
    return px.astype(np.float64)


def _entropy(counts: np.ndarray) -> float:
    p = counts / counts.sum()
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def _moments(x: np.ndarray) -> tuple[float, float]:
    """Biased skewness and excess kurtosis; NaN for a constant."""
    d = x.ravel() - x.mean()
    v = (d**2).mean()
    with np.errstate(all="ignore"):
        return float((d**3).mean() / v**1.5), float((d**4).mean() / v**2 - 3)


def _pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, 1, mode="symmetric")  # the edge pixel is repeated


def laplace(x: np.ndarray) -> np.ndarray:
    """Sum of second differences, the edge repeated."""
    p = _pad(x)
    return p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * x


def sobel(x: np.ndarray, axis: int) -> np.ndarray:
    """Sobel derivative along an axis."""
    p = _pad(x if axis == 0 else x.T)
    smooth = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    out = smooth[2:] - smooth[:-2]
    return out if axis == 0 else out.T


def haar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One Haar level: approximation, and differences between rows, between columns, and of both; odd sizes repeat the edge."""
    x = np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)), mode="edge")
    a, b, c, d = x[::2, ::2], x[::2, 1::2], x[1::2, ::2], x[1::2, 1::2]
    return (a + b + c + d) / 2, (a + b - c - d) / 2, (a - b + c - d) / 2, (a - b - c + d) / 2


def wavelet_features(x: np.ndarray, levels: int = LEVELS) -> dict[str, float]:
    """Mean magnitude, deviation, excess kurtosis and energy of each band of each level."""
    out = {}
    for level in range(1, levels + 1):
        x, lh, hl, hh = haar(x)
        for name, band in (("LH", lh), ("HL", hl), ("HH", hh)):
            key = f"level{level}_{name}"
            out |= {f"{key}_mean": float(np.abs(band).mean()), f"{key}_std": float(band.std()), f"{key}_kurtosis": _moments(band)[1], f"{key}_energy": float((band**2).sum())}
    return out


def radial_spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean magnitude of the Fourier transform in rings of width one, empty rings left out."""
    size = np.abs(np.fft.fftshift(np.fft.fft2(x)))
    h, w = size.shape
    y, z = np.ogrid[:h, :w]
    radius = np.sqrt((y - h // 2) ** 2 + (z - w // 2) ** 2)
    most = min(h // 2, w // 2)
    ring = np.floor(radius + 0.5).astype(int).ravel()
    total, n = np.bincount(ring, size.ravel(), most + 1), np.bincount(ring, minlength=most + 1)
    power = total[1:most] / np.maximum(n[1:most], 1)
    r = np.arange(1, most)
    return r[power > 0], power[power > 0]


def spectral_features(x: np.ndarray) -> dict[str, float]:
    """Power-law fit of the spectrum and the share of high frequencies; nothing with under ten rings."""
    r, power = radial_spectrum(x)
    if len(r) < 10:
        return {}
    lx, ly = np.log(r), np.log(power)
    dx, dy = lx - lx.mean(), ly - ly.mean()
    slope = float((dx * dy).sum() / (dx**2).sum())
    r2 = float((dx * dy).sum() ** 2 / ((dx**2).sum() * (dy**2).sum())) if dy.any() else 0.0
    mid = len(power) // 2
    return {"spectral_b1": float(np.exp(ly.mean() - slope * lx.mean())), "spectral_b2": -slope, "spectral_r_squared": r2, "hf_energy_ratio": float((power[mid:] ** 2).sum() / ((power[:mid] ** 2).sum() + 1e-10))}


def noise_residual(x: np.ndarray) -> np.ndarray:
    """Mean of the eight neighbours less the pixel."""
    p = _pad(x)
    ring = sum(p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
    return ring / 8 - x


def noise_features(x: np.ndarray) -> dict[str, float]:
    """Statistics of the residual, and how it differs between smooth and textured parts."""
    r = noise_residual(x)
    skew, kurt = _moments(r)
    grad = np.sqrt(sobel(x, 0) ** 2 + sobel(x, 1) ** 2)
    smooth = grad < np.median(grad)
    out = {"noise_mean": float(r.mean()), "noise_std": float(r.std()), "noise_skewness": skew, "noise_kurtosis": kurt, "noise_entropy": _entropy(np.histogram(r, 256)[0] + 1e-10), "noise_consistency": 0.0}
    if smooth.any() and not smooth.all():
        a, b = r[smooth].std(), r[~smooth].std()
        out["noise_consistency"] = float(abs(a - b) / (a + 1e-10))
    return out


def mirror_correlation(x: np.ndarray) -> float:
    """Correlation with the mirror image; NaN for a constant."""
    d = x - x.mean()
    with np.errstate(all="ignore"):
        return float((d * d[:, ::-1]).sum() / (d**2).sum())


def simple_features(x: np.ndarray, bits: int) -> dict[str, float]:
    """Statistics, noise by quadrant, block edges and gradients, as the simple rules need them."""
    out = {"mean": float(x.mean()), "std_dev": float(x.std()), "min": float(x.min()), "max": float(x.max()), "histogram_entropy": _entropy(np.histogram(x, 256)[0])}
    noise = lambda q: float(np.median(np.abs(laplace(q))) * 1.4826) if q.size else 0.0
    h, w = x.shape
    quarters = [noise(q) for q in (x[: h // 2, : w // 2], x[: h // 2, w // 2 :], x[h // 2 :, : w // 2], x[h // 2 :, w // 2 :])]
    out |= {"noise_estimate": noise(x), "noise_variation": float(np.std(quarters) / (np.mean(quarters) + 1e-10))}
    blocks = h // 8 - 1
    if min(h, w) >= 16 and blocks >= 1 and w // 8 - 1 >= 1:
        step = np.abs(np.diff(x, axis=0)).mean(1)  # step[i]: between rows i and i + 1
        at = np.arange(1, blocks + 1) * 8
        inner = at[at + 4 < h - 1] + 4
        if len(inner):
            out["block_ratio"] = float(step[at - 1].mean() / (step[inner - 1].mean() + 1e-10))
    span = x.max() - x.min()
    if span > 0 and min(h, w) >= 2:
        gy, gx = np.gradient((x - x.min()) / span)
        size = np.sqrt(gx**2 + gy**2)
        out["sharpness"] = float(size.max() / (size.mean() + 1e-10))
    out["unique_values"] = float(len(np.unique(x)))
    out["bit_utilization"] = out["unique_values"] / 2.0 ** min(max(bits, 0), 1000)
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Sizes of the 4-connected components of a mask."""
    runs, parent, size, before = [], [], [], []
    for row in mask:
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            label = len(parent)
            parent.append(label)
            size.append(b - a)
            for c, d, other in before:
                if c < b and a < d:
                    i, j = label, other
                    while parent[i] != i:
                        i = parent[i]
                    while parent[j] != j:
                        j = parent[j]
                    if i != j:
                        parent[j] = i
                        size[i] += size[j]
            now.append((a, b, label))
        before = now
        runs += now
    return np.array([s for i, s in enumerate(size) if parent[i] == i], int)


def text_regions(x: np.ndarray) -> tuple[str, list[str]]:
    """(state, edge strips with text-like marks); state is ``small``, ``flat`` or ``ok``."""
    h, w = x.shape
    if h < 64 or w < 64:
        return "small", []
    span = x.max() - x.min()
    if span < 1e-6:
        return "flat", []
    norm, found = (x - x.min()) / span, []
    for name, (y0, y1, x0, x1) in EDGES.items():
        strip = norm[int(h * y0) : int(h * y1), int(w * x0) : int(w * x1)]
        if min(strip.shape) < 4:
            continue
        bright, dark = strip > 0.85, strip < 0.15
        mask = bright if bright.mean() >= dark.mean() else dark
        if mask.sum() < MARKS:
            continue
        sizes = components(mask)
        if ((sizes >= MARK_SIZE) & (sizes <= strip.size * MARK_PART)).sum() >= MARKS:
            found.append(name)
    return "ok", found


def all_features(p: Parsed, compatible: bool = False) -> dict[str, float] | None:
    """Every measurable feature of a file; null without pixels or with fewer than 16 rows or columns."""
    x = image(p, compatible)
    return None if x is None else _features(x, simple_features(x, _bits(p)))


def _bits(p: Parsed) -> int:
    return p.number("BitsStored", p.number("BitsAllocated", 16))


def _features(x: np.ndarray, simple: dict[str, float]) -> dict[str, float] | None:
    if x.ndim != 2 or min(x.shape) < 16:
        return None
    span = x.max() - x.min() + 1e-10
    return wavelet_features(x) | spectral_features(x) | noise_features(x) | {"bilateral_ncc": mirror_correlation((x - x.min()) / span), "unique_values": simple["unique_values"], "bit_utilization": simple["bit_utilization"]}


PIXEL_COLUMNS = "pixel_state string, text_regions array<string>, simple map<string, double>, features map<string, double>"
_NUMBERS = pa.map_(pa.string(), pa.float64())
_FIELDS = [("pixel_state", pa.string()), ("text_regions", pa.list_(pa.string())), ("simple", _NUMBERS), ("features", _NUMBERS)]


@dataclass(frozen=True)
class Measure:
    """What is measured besides parsing: see ``dicom.parsed``. Marks of text are looked for only with ``marks``, features measured with ``features``."""

    marks: bool = True
    features: bool = True
    compatible: bool = False

    fields = _FIELDS
    schema = PIXEL_COLUMNS

    def __call__(self, p: Parsed | None) -> dict:
        """One row of ``PIXEL_COLUMNS``, from pixels decoded once; the state is null where they can't be read, or where measuring them fails."""
        none = {"pixel_state": None, "text_regions": [], "simple": None, "features": None}
        try:
            read = p and samples(p)
            x = read and squeeze(*read, self.compatible).astype(np.float64)
            if x is None or x.ndim != 2 or not x.size:
                return none
            state, regions = text_regions(grey(*read, self.compatible)) if self.marks else ("ok", [])
            simple = simple_features(x, _bits(p)) if self.features else None
            full = _features(x, simple) if self.features else None
        except Exception:  # noqa: BLE001  one file's pixels mustn't end the scan of the others
            return none
        return {"pixel_state": state, "text_regions": regions, "simple": simple and list(simple.items()), "features": full and list(full.items())}


def measured(files: DataFrame, features: bool = True, compatible: bool = False) -> DataFrame:
    """(file_id, ``PIXEL_COLUMNS``) of files with ``content``; the state is null where pixels can't be read."""
    measure = Measure(features=features, compatible=compatible)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [measure(parse_or_none(x)) for x in part.column(1)]
                yield pa.record_batch([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in _FIELDS]], names=["file_id", *[k for k, _ in _FIELDS]])

    return files.select("file_id", "content").mapInArrow(run, f"file_id string, {PIXEL_COLUMNS}")


def parse_or_none(content: pa.Scalar) -> Parsed | None:
    """A parsed file; null where even that fails."""
    try:
        return parse(content.as_py() or b"")
    except Exception:  # noqa: BLE001  as in ``Measure``
        return None


def _get(column: str, name: str) -> Column:
    return F.element_at(column, name)


def simple_checks() -> Column:
    """Rules of the simple features over parsed and measured files."""
    s, bits = lambda n: _get("simple", n), F.coalesce(F.element_at("attrs", "BitsStored"), F.element_at("attrs", "BitsAllocated"), F.lit("16")).try_cast("int")
    most = F.pow(F.lit(2.0), bits) - 1
    span = s("max") - s("min")
    unread, flat = F.col("simple").isNull(), s("std_dev") == 0
    stats = F.when(unread, F.array(finding("pixel_stats", "info", "Pixels can't be read"))).otherwise(
        findings(
            F.when(span < most * 0.01, finding("pixel_stats", "warn", F.format_string("The pixels span %.0f of %.0f values", span, most))),
            F.when(flat, finding("pixel_stats", "fail", "All pixels are equal")),
            F.when(~flat & (s("histogram_entropy") < 1.0), finding("pixel_stats", "warn", F.format_string("Histogram entropy %.2f is very low", s("histogram_entropy")))),
            F.when(~flat, finding("pixel_stats", "pass", F.format_string("Mean %.1f, deviation %.1f", s("mean"), s("std_dev")))),
        )
    )
    noise = first_of(
        (unread, finding("noise_analysis", "info", None)),
        (s("noise_variation") > 0.5, finding("noise_analysis", "warn", F.format_string("Noise differs between quadrants by %.2f", s("noise_variation")))),
        (s("noise_estimate") < 0.1, finding("noise_analysis", "warn", "Suspiciously smooth")),
        (None, finding("noise_analysis", "pass", F.format_string("Noise %.1f", s("noise_estimate")))),
    )
    block = first_of(
        (s("block_ratio").isNull(), finding("compression", "info", None)),
        (s("block_ratio") > 1.5, finding("compression", "warn", F.format_string("Edges of 8 by 8 blocks, ratio %.2f", s("block_ratio")))),
        (None, finding("compression", "pass", F.format_string("No block edges, ratio %.2f", s("block_ratio")))),
    )
    edge = first_of(
        (s("sharpness").isNull(), finding("edge_analysis", "info", None)),
        (s("sharpness") > 100, finding("edge_analysis", "info", F.format_string("Very sharp edges, ratio %.1f", s("sharpness")))),
        (None, finding("edge_analysis", "pass", F.format_string("Edges, ratio %.1f", s("sharpness")))),
    )
    told = F.filter(F.concat(stats, noise, block, edge), lambda f: f["message"].isNotNull())  # a rule that doesn't apply gives nothing
    return F.when(F.col("pixel_len").isNull(), F.array(finding("pixel_scan", "info", "No pixel data"))).otherwise(told)


def long_features(rows: DataFrame) -> DataFrame:
    """(file_id, modality, feature, value) of measured files that have features; ``rows`` has ``attrs`` too."""
    return rows.filter("features IS NOT NULL").select("file_id", F.coalesce(F.element_at("attrs", "Modality"), F.lit("UNKNOWN")).alias("modality"), F.explode("features").alias("feature", "value"))


def calibrate(rows: DataFrame, least: int = 3) -> DataFrame:
    """Baselines per modality and feature of modalities with at least ``least`` files, with ``_sample_count``.

    The values are written first: baselines read them three times, and pixels are measured once.
    """
    from scanlake.operators.corpus import baselines

    long = written(long_features(rows).select("modality", "feature", "value"), "features")
    # every file with features has this one, and its values are finite
    files = F.max(F.when(F.col("feature") == "noise_std", F.col("n"))).over(Window.partitionBy("modality"))
    return baselines(long, ["modality", "feature"], least=least).withColumn("_sample_count", files).filter(F.col("_sample_count") >= least)


def with_baselines(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` with ``baseline``: the features of their modality as a map of ``struct<mean, std>``; null without one.

    The table has a row per modality and feature, so one row per modality after grouping.
    """
    maps = base.groupBy(F.col("modality").alias("_m")).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("baseline"))
    return rows.join(maps, F.coalesce(F.element_at("attrs", "Modality"), F.lit("UNKNOWN")) == F.col("_m"), "left").drop("_m")


def advanced_checks() -> Column:
    """Rules of the full features, against ``baseline`` where there is one."""
    f, mod = lambda n: _get("features", n), F.coalesce(F.element_at("attrs", "Modality"), F.lit("UNKNOWN"))
    based = F.col("baseline").isNotNull()
    z = lambda n: F.abs(f(n) - F.element_at("baseline", n)["mean"]) / (F.element_at("baseline", n)["std"] + 1e-10)
    rows, cols = (F.element_at("attrs", k).try_cast("int") for k in ("Rows", "Columns"))
    waves = [f"level{i}_{b}_{k}" for i in range(1, LEVELS + 1) for b in ("LH", "HL", "HH") for k in ("mean", "std", "kurtosis", "energy")]
    far = lambda names, strict: F.filter(F.array(*[F.struct(F.when(F.lit(not strict) | (F.element_at("baseline", n)["std"] > 0), z(n)).alias("z"), F.lit(n).alias("n")) for n in names]), lambda x: x["z"] > 3)
    worst = lambda names, strict: F.array_max(far(names, strict))
    noisy = ["noise_std", "noise_kurtosis", "noise_consistency"]
    unread = F.col("features").isNull()
    wave = first_of(
        (unread, finding("wavelet_analysis", "info", "No wavelet features")),
        (based & (F.size(far(waves, True)) > 0), finding("wavelet_analysis", "warn", F.format_string("%s is %.1f deviations off", worst(waves, True)["n"], worst(waves, True)["z"]))),
        (based, finding("wavelet_analysis", "pass", F.concat(F.lit("Wavelet bands as usual for "), mod))),
        (None, finding("wavelet_analysis", "info", F.concat(F.lit("No baseline for "), mod))),
    )
    b2 = F.element_at("baseline", "spectral_b2")
    spectral = first_of(
        (unread | (rows < 32) | (cols < 32), finding("spectral_decay", "info", "No spectrum, or too small an image")),
        (f("spectral_b2").isNull(), finding("spectral_decay", "warn", "The spectrum can't be fitted")),
        (based & (z("spectral_b2") > 3), finding("spectral_decay", "warn", F.format_string("Decay %.3f is %.1f deviations off", f("spectral_b2"), z("spectral_b2")))),
        (based & b2.isNotNull(), finding("spectral_decay", "pass", F.format_string("Decay %.3f", f("spectral_b2")))),
        (~based, finding("spectral_decay", "info", F.format_string("Decay %.3f, fit %.3f", f("spectral_b2"), f("spectral_r_squared")))),
    )
    noise = first_of(
        (unread, finding("noise_residual", "info", "No noise features")),
        (based & (F.size(far(noisy, False)) > 0), finding("noise_residual", "warn", F.format_string("%s is %.1f deviations off", worst(noisy, False)["n"], worst(noisy, False)["z"]))),
        (based, finding("noise_residual", "pass", F.concat(F.lit("Noise as usual for "), mod))),
        (f("noise_consistency") > 0.5, finding("noise_residual", "warn", F.format_string("Noise differs by %.3f between smooth and textured parts", f("noise_consistency")))),
        (None, finding("noise_residual", "info", F.concat(F.lit("No baseline for "), mod))),
    )
    chest = mod.isin("CR", "DX") & F.contains(F.upper(F.coalesce(F.element_at("attrs", "BodyPartExamined"), F.lit(""))), F.lit("CHEST"))
    mirror = first_of(
        (chest & ~F.isnan(f("bilateral_ncc")) & (f("bilateral_ncc") > 0.7), finding("bilateral_symmetry", "warn", F.format_string("Too symmetrical, correlation %.3f", f("bilateral_ncc")))),
        (chest & ~F.isnan(f("bilateral_ncc")), finding("bilateral_symmetry", "pass", F.format_string("Correlation with the mirror image %.3f", f("bilateral_ncc")))),
    )
    bits = F.coalesce(F.element_at("attrs", "BitsStored"), F.element_at("attrs", "BitsAllocated")).try_cast("int")
    depth = first_of(
        (unread | bits.isNull(), finding("bit_depth", "info", None)),
        ((bits > 8) & (f("unique_values") <= 256), finding("bit_depth", "warn", F.format_string("%d bits declared, %.0f values used", bits, f("unique_values")))),
        (f("bit_utilization") < 0.01, finding("bit_depth", "info", F.format_string("%.0f values used", f("unique_values")))),
        (None, finding("bit_depth", "pass", F.format_string("%.0f values used", f("unique_values")))),
    )
    told = F.filter(F.concat(wave, spectral, noise, mirror, depth), lambda x: x["message"].isNotNull())
    return F.when(F.col("pixel_len").isNull(), F.array(finding("advanced_pixel", "info", "No pixel data"))).otherwise(told)


