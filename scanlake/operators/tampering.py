"""Image-tampering transforms for test data: seven ways to alter an image, and a table of altered copies."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian filter, cut at four deviations, the edge repeated."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(x, pad, mode="symmetric")
        x = sum(w * np.take(p, range(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
    return x


def smooth(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Blur away the noise."""
    return gaussian(x, rng.uniform(1.5, 3.0))


def replace_noise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Blur, then add uniform noise of the same deviation."""
    base = gaussian(x, 2.0)
    return base + rng.normal(0, (x - base).std() * rng.uniform(0.8, 1.2), x.shape)


def filter_frequencies(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Damp the Fourier coefficients of a band."""
    f = np.fft.fftshift(np.fft.fft2(x))
    y, z = np.ogrid[: x.shape[0], : x.shape[1]]
    r = np.hypot(y - x.shape[0] // 2, z - x.shape[1] // 2) / (min(x.shape) / 2)
    low = rng.uniform(0.3, 0.5)
    f[(r > low) & (r < low + 0.3)] *= rng.uniform(0.05, 0.3)
    return np.fft.ifft2(np.fft.ifftshift(f)).real


def copy_move(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copy a block to another place with soft edges."""
    h, w = max(4, x.shape[0] // 6), max(4, x.shape[1] // 6)
    (a, b), (c, d) = ((rng.integers(0, x.shape[0] - h), rng.integers(0, x.shape[1] - w)) for _ in range(2))
    soft = gaussian(np.pad(np.ones((h - 2, w - 2)), 1), 1.0)
    out = x.copy()
    out[c : c + h, d : d + w] = soft * x[a : a + h, b : b + w] + (1 - soft) * out[c : c + h, d : d + w]
    return out


def interpolate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Shrink and enlarge linearly."""
    factor = rng.uniform(0.4, 0.7)
    for axis in (0, 1):
        n = x.shape[axis]
        few = np.linspace(0, n - 1, max(2, int(n * factor)))
        there = np.apply_along_axis(lambda v, few=few, n=n: np.interp(few, np.arange(n), v), axis, x)
        x = np.apply_along_axis(lambda v, few=few, n=n: np.interp(np.arange(n), few, v), axis, there)
    return x


def requantize(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Reduce to 256 values."""
    low, span = x.min(), max(np.ptp(x), 1)
    return np.round((x - low) / span * 255) / 255 * span + low


def checkerboard(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Add the grid that upsampling networks leave."""
    y, z = np.ogrid[: x.shape[0], : x.shape[1]]
    return x + np.where((y + z) % 2 == 0, 1, -1) * x.std() * rng.uniform(0.02, 0.05)


TECHNIQUES: dict[str, Callable] = {
    "gaussian_smooth": smooth, "noise_replace": replace_noise, "freq_manipulate": filter_frequencies, "copy_move": copy_move, "interpolate": interpolate, "requantize": requantize, "checkerboard_inject": checkerboard,
}


def sample_files(files: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` files in a seeded hash order (a sampling operator)."""
    return files.orderBy(F.xxhash64("file_id", F.lit(seed)), "file_id").limit(most)


def altered(files: DataFrame, techniques: Iterable[str] = tuple(TECHNIQUES), seed: int = 42) -> DataFrame:
    """(file_id, filename, file_size, content, technique): each native image by each technique, as a new file that says so.

    Files whose pixels can't be read give none. The random numbers depend on file, technique and seed alone.
    """
    from scanlake.dims import EXPLICIT_LE
    from scanlake.operators.pixels import image
    from scanlake.sources.walker import PIXELS, TAGS, parse
    from scanlake.sources.writer import data_set, element, part10

    names = list(techniques)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = parse(data or b"")
                x = image(p)
                if x is None or min(x.shape) < 16 or p.number("BitsAllocated", 0) != 16:
                    continue
                low, high = (-32768, 32767) if p.number("PixelRepresentation", 0) else (0, 65535)
                for name in names:
                    rng = np.random.default_rng([seed, *file_id.encode(), *name.encode()])
                    px = np.clip(np.round(TECHNIQUES[name](x, rng)), low, high).astype("<i2" if low else "<u2")
                    gone = {PIXELS, TAGS["ImageComments"], TAGS["SOPInstanceUID"], TAGS["NumberOfFrames"], TAGS["SamplesPerPixel"]}
                    uid = "2.25." + str(int.from_bytes(rng.bytes(15), "big"))
                    xs = [e for e in p.elements if e.tag not in gone]
                    xs += [element("SOPInstanceUID", uid), element("ImageComments", f"altered: {name}"), element("SamplesPerPixel", 1), element(PIXELS, px.tobytes(), "OW")]
                    made = part10(data_set(xs), EXPLICIT_LE, sop_instance=uid)
                    out = f"{file_id}#{name}"
                    yield pa.record_batch([pa.array([out]), pa.array([out.rsplit("/", 1)[-1]]), pa.array([len(made)], pa.int64()), pa.array([made], pa.binary()), pa.array([name])], names=["file_id", "filename", "file_size", "content", "technique"])

    return files.select("file_id", "content").mapInArrow(run, "file_id string, filename string, file_size long, content binary, technique string")
