"""Chroma fingerprints of recordings, and their alignment.

A recording becomes frames of twelve pitch classes.  Filters that compare sums of
rectangles of the frames, read off an integral image, are cut into four levels each and
packed into one integer of 32 bits per place.  Two recordings that share integers at one
offset more often than at any other are aligned there, if the bits of their integers
over the whole overlap agree well enough.  An excerpt may begin between two frames of the
recording it is from; so probes are fingerprinted at several phases of a hop.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialize, quoted

#: Samples of a frame of spectrum at any rate: about a quarter of a second, half overlapping.
FRAME_SECONDS, HOP_SECONDS = 0.256, 0.128
LOW_HZ, HIGH_HZ = 55.0, 1800.0
#: Frames that one integer describes.
SPAN = 16
#: Sixteen filters as (kind, first pitch class, pitch classes, frames); fixed values of this format.  Kinds: 0 sum, 1 lower
#: against higher pitches, 2 earlier against later, 3 both crossed, 4 middle pitches against outer, 5 middle times against outer.
FILTERS = (
    (0, 0, 3, 15), (0, 6, 4, 12), (1, 0, 6, 14), (1, 4, 8, 16), (2, 0, 4, 12), (2, 8, 4, 16), (2, 3, 6, 8), (3, 0, 6, 16),
    (3, 6, 6, 8), (3, 2, 10, 12), (4, 0, 6, 15), (4, 5, 6, 9), (4, 3, 9, 15), (5, 0, 6, 15), (5, 6, 6, 12), (5, 2, 8, 9),
)
#: Levels of a filter's value: below -CUT, up to 0, up to CUT, above; numbered in Gray code.
CUT = 0.25
GRAY = (0, 1, 3, 2)
#: Phases of a hop at which probes are fingerprinted.
PHASES = 4
#: Least overlap in integers, and highest share of bits that may differ.
MIN_OVERLAP, MAX_ERROR = 16, 0.2


def decode_wav(raw: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and the rate; what is no readable 16-bit WAV file is silence of no length."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0, np.float32), 0
            x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32) / 32768
            return x.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, np.float32), 0


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def pitch_frames(x: np.ndarray, rate: int, block: int = 4096) -> np.ndarray:
    """Frames of pitch classes (frames, 12), each of length 1 unless silent; long recordings in blocks."""
    if not rate:
        return np.zeros((0, 12))
    size, hop = int(rate * FRAME_SECONDS), int(rate * HOP_SECONDS)
    n = (len(x) - size) // hop + 1
    if size < 16 or n < 1:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    cls = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    to = np.zeros((len(use), 12), np.float32)
    to[np.arange(len(use)), cls] = 1
    shape = np.hanning(size).astype(np.float32)
    out = np.empty((n, 12))
    for a in range(0, n, block):
        b = min(n, a + block)
        part = np.lib.stride_tricks.sliding_window_view(x[a * hop : (b - 1) * hop + size], size)[::hop]
        s = np.fft.rfft(part * shape, axis=1)[:, use]
        out[a:b] = (s.real**2 + s.imag**2) @ to
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0.0)


def codes(frames: np.ndarray) -> np.ndarray:
    """One integer of 32 bits for every place where SPAN frames fit."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def box(a: int, b: int, c: int, d: int) -> np.ndarray:
        """Sum over frames t+a .. t+b and pitch classes c .. d (ends excluded)."""
        return image[t + b, d] - image[t + a, d] - image[t + b, c] + image[t + a, c]

    out = np.zeros(n, dtype=np.int64)
    for kind, y, h, w in FILTERS:
        z, m, k = y + h, y + h // 2, w // 2
        whole = box(0, w, y, z)
        if kind == 0:
            up, down = whole, np.full(n, w * h / 12 * 1.2)
        elif kind == 1:
            up = box(0, w, m, z)
            down = whole - up
        elif kind == 2:
            up = box(k, w, y, z)
            down = whole - up
        elif kind == 3:
            up = box(0, k, m, z) + box(k, w, y, m)
            down = whole - up
        elif kind == 4:
            a, b = y + h // 3, y + h - h // 3
            up = box(0, w, a, b) * 2
            down = (whole - up / 2)
        else:
            up = box(w // 3, w - w // 3, y, z) * 2
            down = (whole - up / 2)
        v = np.round(np.log((1 + up) / (1 + down)), 6)  # sums of the image differ in their last digits
        level = (v > -CUT).astype(np.int64) + (v > 0) + (v > CUT)
        out = (out << 2) | np.array(GRAY)[level]
    return out


#: The integer of a place without sound: no key that recordings meet under.
SILENT = int(codes(np.zeros((SPAN, 12)))[0])


def fingerprints(media: DataFrame, *, id_col: str = "id", audio_col: str = "audio", phases: int = 1) -> DataFrame:
    """id, phase, n_frames and codes (array of integers of 32 bits, as bigint) for each recording and phase.

    Phase ``i`` of ``phases`` begins ``i / phases`` of a hop into the recording.  Null, empty
    and unreadable recordings have no frames, and those shorter than SPAN frames no codes; very
    long ones are read in blocks.  Rows without id are left out; repeated rows repeat; an empty
    table gives an empty one; further columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, a in zip(part["id"].tolist(), part["audio"], strict=True):
                x, rate = decode_wav(a if isinstance(a, (bytes, bytearray)) else None)
                for k in range(phases):
                    f = pitch_frames(x[int(rate * HOP_SECONDS * k / phases) :], rate)
                    rows.append((i, k, len(f), codes(f)))
            yield pd.DataFrame(rows, columns=["id", "phase", "n_frames", "codes"])

    bounded_batches(media.sparkSession, 128)
    rows = media.filter(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("id"), quoted(audio_col).alias("audio"))
    return rows.mapInPandas(run, "id long, phase int, n_frames long, codes array<long>")


def _places(prints: DataFrame, side: str) -> DataFrame:
    """Where a run of equal integers begins in each recording; silence has no place."""
    before = lambda i: F.get("codes", i - 1)
    each = F.transform("codes", lambda c, i: F.when((c != SILENT) & ((i == 0) | (c != before(i))), F.struct(i.alias("pos"), c.alias("code"))))
    own = [F.col("id").alias(f"{side}_id")] + ([F.col("phase").alias("phase")] if side == "left" else [])
    return prints.select(*own, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("p")).select(f"{side}_id", *(["phase"] if side == "left" else []), F.col("p.pos").alias(f"{side}_pos"), F.col("p.code").alias("code"))


def align(left: DataFrame, right: DataFrame, *, min_hits: int = 2, min_overlap: int = MIN_OVERLAP, max_error: float = MAX_ERROR) -> DataFrame:
    """Aligned pairs of two tables of (id, phase, codes): left_id, right_id, phase, offset, hits, overlap, bit_error.

    offset is the place in the right recording, minus that in the left at its phase, that most
    equal integers agree on (the least such phase, then offset, in a tie).  Runs of equal
    integers count once, where they begin, and silence not at all; so a drone or a silent tail,
    however long, adds one place at most.  Null and empty codes align with nothing.
    """
    hits = _places(left, "left").join(_places(right, "right"), "code")
    histogram = hits.groupBy("left_id", "right_id", "phase", (F.col("right_pos") - F.col("left_pos")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    peak = histogram.groupBy("left_id", "right_id").agg(F.max(F.struct("hits", (-F.col("phase")).alias("p"), (-F.col("offset")).alias("o"))).alias("p")).filter(F.col("p.hits") >= min_hits)
    both = (
        peak.select("left_id", "right_id", (-F.col("p.p")).alias("phase"), (-F.col("p.o")).alias("offset"), F.col("p.hits").alias("hits"))
        .join(left.select(F.col("id").alias("left_id"), "phase", F.col("codes").alias("_l")), ["left_id", "phase"])
        .join(right.select(F.col("id").alias("right_id"), F.col("codes").alias("_r")), "right_id")
    )
    start, end = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("_l"), F.size("_r") - F.col("offset"))
    cut = lambda c, a: F.slice(c, a + 1, F.greatest(end - start, F.lit(0)))
    wrong = F.aggregate(F.zip_with(cut("_l", start), cut("_r", start + F.col("offset")), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    scored = both.select("left_id", "right_id", "phase", "offset", "hits", (end - start).alias("overlap"), (wrong / (32.0 * (end - start))).alias("bit_error"))
    return scored.filter((F.col("overlap") >= min_overlap) & (F.col("bit_error") <= max_error))


def _classes(prints: DataFrame) -> DataFrame:
    """_f, _g (hash of the integers), phase, id (the least), size and codes of each class of equal recordings with codes."""
    some = prints.filter(F.size("codes") > 0)
    return some.groupBy("_f", "_g", "phase").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.min_by("codes", "id").alias("codes"))


def _hashed(prints: DataFrame) -> DataFrame:
    """With the hash of the integers at phase 0, by which recordings are classed."""
    return prints.withColumn("_f", F.xxhash64("codes")).withColumn("_g", F.xxhash64(F.lit(1), "codes"))


def search(prints: DataFrame, probes: DataFrame, **how) -> DataFrame:
    """Align probe recordings with all recordings; both are tables of ``fingerprints``, probes at several phases.  One row per recording.

    Recordings with equal integers form a class, known by its least id; classes, not
    their members, are aligned, so that many copies cost what one does.  Returns id,
    n_frames, n_codes, class_id, class_size, n_probes (least ids of classes of probes that align) and
    best_id, best_phase, best_offset, best_error of the closest probe (least error, then least id; null if
    none).  Recordings without codes are a class each and align with nothing; without probes none does.
    Repeated rows are copies of each other; an empty table gives an empty one.
    """
    prints = materialize(_hashed(prints.filter("phase = 0")), "prints")
    classes = materialize(_classes(prints), "classes")
    # Equal probes are equal at every phase; the least id stands for them.
    pairs = align(materialize(_classes(_hashed(probes)), "probes"), classes, **how)
    nearest = F.min(F.struct("bit_error", "left_id", "phase", "offset")).alias("b")
    best = pairs.groupBy(F.col("right_id").alias("class_id")).agg(F.count_distinct("left_id").alias("n_probes"), nearest)
    found = classes.select("_f", "_g", F.col("id").alias("class_id"), F.col("size").alias("class_size")).join(best, "class_id", "left")
    out = prints.select("id", "n_frames", F.size("codes").cast("long").alias("n_codes"), "_f", "_g").join(found, ["_f", "_g"], "left")
    return out.select(
        "id", "n_frames", "n_codes", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_probes", F.lit(0)).cast("long").alias("n_probes"),
        F.col("b.left_id").alias("best_id"), F.col("b.phase").cast("long").alias("best_phase"), F.col("b.offset").cast("long").alias("best_offset"), F.col("b.bit_error").alias("best_error"),
    )


def excerpts(media: DataFrame, *, seconds: float, start_seconds: float | None = None, noise: float = 0.01, volume: float = 0.5) -> DataFrame:
    """id and audio: a part of each recording, quieter and with noise, as a microphone would hear it.

    Without ``start_seconds`` the part begins anywhere, to the sample, that leaves it whole.
    Start and noise depend on the recording's bytes, so equal recordings have equal excerpts.
    Null and unreadable recordings give null, those that end before the part an empty one; rows
    without id are left out, repeated rows repeat, an empty table gives an empty one.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            audio = []
            for raw in part["audio"]:
                x, rate = decode_wav(raw if isinstance(raw, (bytes, bytearray)) else None)
                r = np.random.default_rng(zlib.crc32(raw or b""))
                start = int(r.integers(0, max(1, len(x) - int(seconds * rate)))) if start_seconds is None else int(start_seconds * rate)
                x = x[start : start + int(seconds * rate)]
                audio.append(encode_wav(volume * x + noise * r.standard_normal(len(x)), rate) if rate else None)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "audio": audio})

    bounded_batches(media.sparkSession, 128)
    return media.filter("id IS NOT NULL").select("id", "audio").mapInPandas(cut, "id long, audio binary")


def render_vectors(table: DataFrame, *, id_col: str, vector_col: str, rate: int = 4_000, note_seconds: float = 0.128) -> DataFrame:
    """id and audio: each vector played as a melody, one note per number, as a WAV file.

    The test tables hold no media; this makes recordings of known content from vectors.
    A number's note is the nearest half tone to 48 half tones per unit around 220 Hz,
    within two octaves, with one overtone; what is no number counts as 0.  A null or empty
    vector is a recording of no length.  Rows without id are left out, repeated rows repeat,
    an empty table gives an empty one, further columns are ignored.
    """

    def play(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = int(rate * note_seconds)
        t = np.arange(n) / rate
        notes = np.array([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) * 0.6 + np.sin(4 * np.pi * 220 * 2 ** (k / 12) * t) * 0.2 for k in range(-12, 13)])
        for part in parts:
            audio = []
            for v in part["v"]:
                k = np.clip(np.round(np.nan_to_num(np.asarray(v if v is not None else [], dtype=float)) * 48), -12, 12).astype(int)
                audio.append(encode_wav(notes[k + 12].ravel(), rate))
            yield pd.DataFrame({"id": part["id"].to_numpy(), "audio": audio})

    bounded_batches(table.sparkSession, 128)
    named = table.filter(quoted(id_col).isNotNull())
    return named.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("v")).mapInPandas(play, "id long, audio binary")
