"""Media columns: audio samples read by the wave module and spectral-peak fingerprints.

A recording is a WAV of 8-bit mono samples. Its short-time Fourier transform
(Hann window, fixed frame and hop) gives magnitudes; in each frame the
strongest local maxima over a floor are peaks; each peak pairs with the next
few peaks in a target zone. A pair's hash packs both frequencies and the time
between them, and the fingerprint is the array of (time, hash) in time order.
Half a frame of silence stands before and after the recording and the last
frame is filled with it, so that every sample weighs in full over the frames it
is in. Frames are processed in blocks of a fixed number counted from the start
of the recording, so equal samples always give equal results.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_mapper, stored

RATE = 8000
FRAME, HOP = 256, 128
BLOCK = 2048  # frames transformed at once
PEAKS = 3  # most peaks kept in a frame
FAN, ZONE = 3, 16  # pairs a peak begins, and frames they may span
FLOOR = 64.0

_window = np.hanning(FRAME).astype(np.float32)


def to_wav(samples: bytes) -> bytes:
    """Samples as a WAV file: 8 bits, mono, RATE a second. Lossless for any bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text (null: none), filled with spaces to a positive multiple of 192; and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")


def framed(samples: bytes) -> np.ndarray:
    """All frames of a recording, before the window; a view of its samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    n = -(-len(x) // HOP) + 1
    x = np.pad(x, (FRAME // 2, (n - 1) * HOP + FRAME // 2 - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each spectral peak, by frame, then bin."""
    frames = framed(samples)
    when, bins = [], []
    for at in range(0, len(frames), BLOCK):
        mag = np.abs(np.fft.rfft(frames[at : at + BLOCK] * _window, axis=1))[:, 1:-1]
        mid = mag[:, 1:-1]
        top = (mid > mag[:, :-2]) & (mid >= mag[:, 2:]) & (mid > FLOOR)
        level = np.where(top, mid, -1.0)
        best = np.argpartition(-level, PEAKS, axis=1)[:, :PEAKS]
        rows = np.arange(len(level))[:, None]
        ok = level[rows, best] > 0
        t = np.broadcast_to(rows, best.shape)[ok] + at
        f = best[ok] + 2
        order = np.lexsort((f, t))
        when.append(t[order])
        bins.append(f[order])
    return np.concatenate(when), np.concatenate(bins)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and 32-bit hashes of the peak pairs: 8 bits each of both bins, 16 of the frames between."""
    t, f = peaks(samples)
    times, hashes = [], []
    for k in range(1, FAN + 1):
        if len(t) <= k:
            break
        dt = t[k:] - t[:-k]
        ok = (dt > 0) & (dt <= ZONE)
        times.append(t[:-k][ok])
        hashes.append(((f[:-k][ok] & 255) << 24) | ((f[k:][ok] & 255) << 16) | dt[ok])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order], h[order]


def recordings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a recording: doc_id, n_bytes, media (a WAV file). Null and empty texts are one block of spaces."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("media", pa.binary())]

    def make():
        def work(cols):
            made = [padded(t) for t in cols[1]]
            return [cols[0], [n for n, _ in made], [to_wav(p) for _, p in made]]

        return work

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return row_mapper(d, "doc_id long, n_bytes long, media binary", fields, make, rows=64)


def features(media: DataFrame) -> DataFrame:
    """Facts and fingerprint of each recording of (doc_id, n_bytes, media).

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, n_pairs, times and hashes (time-coded arrays).
    A null or empty text is a recording of spaces alone. No rows: none.
    """
    fields = [
        pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_sha256", pa.string()),
        pa.field("tail_crc32", pa.int64()), pa.field("media_bytes", pa.int64()), pa.field("media_sha256", pa.string()), pa.field("n_pairs", pa.int64()),
        pa.field("times", pa.list_(pa.int32())), pa.field("hashes", pa.list_(pa.int64())),
    ]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pairs long, times array<int>, hashes array<long>"

    def make():
        sha = hashlib.sha256

        def work(cols):
            out = [[] for _ in fields]
            for key, n, wav in zip(*cols, strict=True):
                back = read_wav(wav)
                t, h = fingerprint(back)
                row = key, n, len(back), sha(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), sha(wav).hexdigest(), len(t), t.astype(np.int32), h
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            return out

        return work

    return row_mapper(media.select("doc_id", "n_bytes", "media"), schema, fields, make, rows=64)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a recording in a media column of the shared folder, read back from there, with facts and fingerprint.

    Rows with equal texts get equal values; rows that repeat all stay. An empty
    table gives none; other columns of df, whatever their names, are not looked at.
    """
    return features(stored(recordings(df, id_col, text_col), "media"))
