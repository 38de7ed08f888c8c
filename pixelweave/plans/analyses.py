"""Whole analyses as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.columns import apparent_fret, corrected_fret, half_time, soumpasis_diffusion
from pixelweave.operators import aggregate as A
from pixelweave.operators import components as K
from pixelweave.operators import fits, linking, masks, spectral, temporal, tracks
from pixelweave.operators.detection import detect_particles
from pixelweave.session import attach, cut_lineage


def calcium_analysis(stack: DataFrame, mask: DataFrame, smooth: str | None = "savgol", window: int = 7, threshold: float = 2.0,
                     min_duration: int = 3, min_interval: int = 5) -> dict[str, DataFrame]:
    """dF/F image, ROI trace dF/F (smoothed), its events and their statistics."""
    trace = masks.roi_trace(stack, mask).select(F.concat_ws("/", F.col("movie_id").cast("string"), "roi_id").alias("trace_id"), F.col("frame").alias("t"), "value")
    dff = temporal.dff_trace(trace).select("trace_id", "t", F.col("dff").alias("value"))
    if smooth:
        dff = {"savgol": temporal.smooth_savgol, "median": temporal.smooth_median, "gaussian": temporal.smooth_gaussian}[smooth](dff, window)
    dff = cut_lineage(dff)
    events = temporal.calcium_events(dff, threshold, min_duration, min_interval)
    return {"image": A.dff_image(stack), "trace": dff, "events": events, "stats": temporal.calcium_stats(events)}


def frap_analysis(stack: DataFrame, mask: DataFrame, pre_frames: int, bleach_frame: int, bleach_radius: float = 1.0, frame_interval: float = 1.0) -> DataFrame:
    """Recovery fit, half time and diffusion coefficient of every ROI."""
    trace = masks.roi_trace(stack, mask).select(F.concat_ws("/", F.col("movie_id").cast("string"), "roi_id").alias("trace_id"), F.col("frame").alias("t"), "value")
    norm = A.frap_normalize(trace, pre_frames, bleach_frame).where(F.col("t") >= bleach_frame)
    fit = fits.fit_exp_recovery(norm.select("trace_id", ((F.col("t") - bleach_frame) * frame_interval).alias("t"), F.col("normalized").alias("value")))
    return fit.withColumn("half_time", half_time(F.col("tau"))).withColumn("diffusion", soumpasis_diffusion(F.col("half_time"), F.lit(float(bleach_radius))))


def fret_analysis(pairs: DataFrame, keys: list[str], bins: int = 100, bleed_through: float | None = None, direct_excitation: float = 0.0,
                  gamma: float = 1.0, bg_donor: float = 0.0, bg_acceptor: float = 0.0) -> dict[str, DataFrame]:
    """Efficiency per pixel of (donor, acceptor) rows, its statistics and histogram."""
    d, a = F.col("donor"), F.col("acceptor")
    e = apparent_fret(d, a, bg_donor, bg_acceptor) if bleed_through is None else corrected_fret(d, a, bleed_through, direct_excitation, gamma, bg_donor, bg_acceptor)
    image = pairs.withColumn("e", e)
    return {"image": image, "stats": A.fret_stats(image, keys), "histogram": A.histogram(image, "e", bins, keys, (0.0, 1.0))}


def colocalization(pairs: DataFrame, keys: list[str], t1: float = 0.0, t2: float = 0.0) -> DataFrame:
    """Pearson, Manders, ICQ and Costes of (v1, v2) rows, from one materialised pair table."""
    shared = cut_lineage(pairs.select(*keys, "v1", "v2"))
    return (A.pearson(shared, keys).join(A.manders(shared, keys, t1, t2), keys).join(A.li_icq(shared, keys), keys)
            .join(A.costes_threshold(shared, keys), keys))


def morphometry_analysis(stack: DataFrame, threshold: float, texture: bool = False) -> DataFrame:
    """Threshold, label, region table; optionally the texture of the frame beside it."""
    keys = [k for k in ("movie_id", "c", "z", "frame") if k in stack.columns]
    labels = cut_lineage(K.connected_components(stack.withColumn("label", (F.col("value") > threshold).cast("int")), 2))
    table = A.region_properties(labels, keys)
    return attach(table, A.texture_glcm(stack), keys) if texture else table


def spectral_unmixing(pixels: DataFrame, spectra=None, n_components: int = 3, method: str = "nnls") -> dict[str, DataFrame]:
    """Endmembers (picked when not given), abundances and residual."""
    if spectra is None:
        spectra = [r["data"] for r in spectral.endmembers_pca(pixels, n_components).orderBy("component").collect()]
    mixed = spectral.linear_unmix(pixels, spectra, method)
    residual = spectral.unmix_residual(mixed, spectra)
    return {"abundance": residual, "rmse": spectral.residual_rmse(residual)}


def track_movies(stack: DataFrame, max_distance: float = 3.0, max_gap: int = 1, min_track_length: int = 3, classifier=None, **detection) -> dict[str, DataFrame]:
    """Detect, link, features, classes and direction autocorrelation of all movies in one job."""
    locs = cut_lineage(detect_particles(stack, **detection))
    linked = cut_lineage(linking.link_greedy(locs, max_distance, max_gap, min_track_length))
    on_tracks = linked.where("track_id >= 0")
    features = tracks.track_features(on_tracks)
    out = {"localizations": linked, "features": features, "autocorrelation": tracks.direction_autocorrelation(on_tracks)}
    if classifier is not None:
        out["classes"] = classifier.predict(features)
    return out
