"""Audio features of byte payloads: polyphase resampling, log-mel filterbanks, hysteresis segments, Arrow tensors.

A payload is stored losslessly as an 8-bit PCM WAV file; features are computed from the stored bytes, read back. Samples
are resampled by a polyphase low-pass filter, cut into overlapped windows, and turned into log-mel energies. Segments
are where the energy rises above one threshold and has not yet fallen under a lower one. The log-mel frames of a
document are cut into blocks of one fixed shape and stored as an Arrow fixed-shape tensor array with each block's time
span. Long payloads are worked on in pieces of fixed length, so memory is bounded and equal payloads give equal values.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

UNIT = 64
RATE_IN, RATE_OUT = 8000, 4000
#: Samples of a window and between window starts, at RATE_OUT; mel bands; frames of a tensor block.
WINDOW, HOP, MELS, BLOCK = 256, 128, 16, 32
TAPS = 16
#: Rise above the document's median energy that opens a segment, and that under which it ends, in natural log units.
OPEN, CLOSE = 0.5, 0.2
#: Windows worked on at once.
PIECE = 4096


def payload(text: bytes) -> bytes:
    """The text with bytes 0 appended up to a positive multiple of UNIT."""
    return text + b"\0" * (UNIT if not text else -len(text) % UNIT)


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """A mono 8-bit PCM WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit PCM WAV file, chunk by chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def low_pass(taps: int = TAPS, down: int = RATE_IN // RATE_OUT) -> np.ndarray:
    """A Hann-windowed sinc that cuts at half the new rate; its phases are every down-th tap."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(n / down) * np.hanning(taps + 2)[1:-1]
    return (h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, down: int = RATE_IN // RATE_OUT) -> np.ndarray:
    """x at 1/down of its rate: each phase of the filter runs over its own phase of the input."""
    h = low_pass(down=down)
    n = -(-len(x) // down)
    padded = np.zeros((n + len(h)) * down, np.float32)
    padded[len(h) // 2 : len(h) // 2 + len(x)] = x
    phases = padded.reshape(-1, down)
    out = np.zeros(n, np.float32)
    for k in range(len(h)):
        out += h[k] * phases[k // down : k // down + n, k % down]
    return out


def mel_bank(bands: int = MELS, window: int = WINDOW, rate: int = RATE_OUT) -> np.ndarray:
    """(window / 2 + 1, bands) triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(window // 2 + 1) * rate / window
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


HANN = np.hanning(WINDOW).astype(np.float32)
BANK = mel_bank()


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) log energies of half-overlapped windows; a short signal is padded to one window."""
    if len(x) < WINDOW:
        x = np.pad(x, (0, WINDOW - len(x)))
    views = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    out = []
    for at in range(0, len(views), PIECE):
        spectrum = np.fft.rfft(views[at : at + PIECE] * HANN, axis=1)
        out.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ BANK + 1e-6))
    return np.concatenate(out).astype(np.float32)


def segments(energy: np.ndarray, enter: float, leave: float) -> list[tuple[int, int]]:
    """(first, end) frames of segments: one opens at energy >= enter and goes on while energy >= leave."""
    above = energy >= leave
    edges = np.flatnonzero(np.diff(np.concatenate(([0], above.view(np.int8), [0]))))
    hot = np.flatnonzero(energy >= enter)
    out = []
    for first, end in edges.reshape(-1, 2).tolist():
        i = int(np.searchsorted(hot, first))
        if i < len(hot) and hot[i] < end:
            out.append((int(hot[i]), end))
    return out


def tensors(frames: np.ndarray) -> pa.RecordBatch:
    """Blocks of (BLOCK, MELS) float32, the last padded with its last frame, with their spans in milliseconds."""
    n = -(-len(frames) // BLOCK)
    blocks = np.pad(frames, ((0, n * BLOCK - len(frames)), (0, 0)), mode="edge").reshape(n, BLOCK, MELS)
    ms = 1000 * HOP / RATE_OUT
    starts = np.arange(n) * BLOCK * ms
    ends = np.minimum((np.arange(n) + 1) * BLOCK, len(frames)) * ms
    return pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(blocks)), pa.array(starts), pa.array(ends)], ["log_mel", "start_ms", "end_ms"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def describe(samples: bytes) -> tuple[pa.RecordBatch, list[tuple[int, int]], np.ndarray]:
    """(tensor blocks, segments in frames, frames) of 8-bit samples at RATE_IN."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    frames = log_mel(resample(x))
    energy = np.log(np.exp(frames).sum(axis=1))
    middle = float(np.median(energy))
    return tensors(frames), segments(energy, middle + OPEN, middle + CLOSE), frames


OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments_ms array<struct<start:double,end:double>>, tensors binary"


def features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload and media columns, n_frames, segments_ms, tensors[, media]) of docs(doc_id, text).

    tensors is an Arrow IPC stream of the fixed-shape blocks with their time spans; media the WAV file itself. A null
    text is an empty one: 64 bytes of silence. Repeated rows stay; extra columns are ignored.
    """
    fields = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments_ms", "tensors"] + ["media"] * keep_media
    ms = 1000 * HOP / RATE_OUT
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4_000_000):
            rows: dict[str, list] = {f: [] for f in fields}
            for text in as_bytes(b.column("text")):
                media = to_wav(payload(text))
                _, samples = from_wav(media)
                blocks, found, frames = describe(samples)
                values = (len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(frames), [{"start": s * ms, "end": e * ms} for s, e in found], to_ipc(blocks), media)
                for f, v in zip(fields, values):
                    rows[f].append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, span if f == "segments_ms" else None if f != "tensors" else pa.binary()) for f, v in rows.items())], ["doc_id", *fields])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, {OUT}{', media binary' if keep_media else ''}")


def digests(docs: DataFrame) -> DataFrame:
    """features() with the tensors and segments as one string: frames, segments, longest segment in ms, SHA-256."""
    longest = F.array_max(F.transform("segments_ms", lambda s: s["end"] - s["start"]))
    feature = F.concat_ws(":", "n_frames", F.size("segments_ms"), F.coalesce(longest, F.lit(0.0)).cast("long"), F.sha2("tensors", 256))
    return features(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
