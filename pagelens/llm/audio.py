"""Media columns: 8-bit audio in WAV form, polyphase resampling, log-mel filterbanks, hysteresis energy segments.

Samples are read in blocks with the filters' overlap, so memory does not grow with the length of a clip. Every clip is
computed by itself in blocks of fixed size: equal bytes give equal values, whatever stands beside them.

Log-mel frames are stored as rows of an Arrow file: a tensor of fixed shape (frames x mels, half precision) with its
time span, the clip's digests and segments beside its first tensor. Features of a clip are read from those files.

Defined results: null is no bytes; a clip is padded to a positive multiple of the frame unit; equal clips, equal rows;
rows that repeat a doc_id, and null doc_ids, are clips of their own; an empty table makes no files; columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import commit_file, drop, filesystem_of, new_folder, save
from .tokens import slices

#: Bytes of samples whose tensors are written as one batch (one longer clip is a batch of its own).
BATCH_BYTES = 4_000_000

RIFF = "<4sI4s4sIHHIIHH4sI"
HEADER = struct.calcsize(RIFF)


@dataclass(frozen=True)
class AudioSettings:
    """Rates in Hz, lengths in samples of the resampled signal, thresholds in decibels below the loudest frame."""

    rate: int = 16_000
    up: int = 1
    down: int = 2
    half_taps: int = 6
    window: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 40
    low_hz: float = 60.0
    open_db: float = 3.0
    close_db: float = 6.0
    block: int = 1 << 16
    tensor_frames: int = 16

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def pad(payload: bytes, unit: int, fill: int = 255) -> bytes:
    """The payload with fill bytes up to a positive multiple of the unit."""
    short = unit - len(payload) if len(payload) < unit else -len(payload) % unit
    return payload + bytes([fill]) * short


def to_wav(samples: bytes, rate: int) -> bytes:
    """One channel of unsigned 8-bit samples with a RIFF header (a pad byte closes an odd length)."""
    n = len(samples)
    head = struct.pack(RIFF, b"RIFF", HEADER - 8 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file made by :func:`to_wav`."""
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, data, n = struct.unpack_from(RIFF, media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) < HEADER + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER : HEADER + n], rate


@cache
def _phases(up: int, down: int, half: int) -> np.ndarray:
    """The windowed-sinc low-pass as one row of taps for each of the ``up`` phases."""
    wide = max(up, down)
    length = 2 * half * wide + 1
    t = np.arange(length) - half * wide
    taps = np.sinc(t / wide) * np.blackman(length + 2)[1:-1]
    taps *= up / taps.sum()
    width = -(-length // up)
    return np.pad(taps, (0, width * up - length)).reshape(width, up).T[:, ::-1].copy()


def resample(signal: Iterator[np.ndarray], s: AudioSettings) -> Iterator[np.ndarray]:
    """Blocks at the new rate: the phase and the inputs of output k follow from k * down."""
    phases = _phases(s.up, s.down, s.half_taps)
    width, centre = phases.shape[1], s.half_taps * max(s.up, s.down)
    held, base, k, seen = np.zeros(width), -width, 0, 0  # held[0] is input number base

    def outputs(stop: int) -> np.ndarray:
        """Outputs from k to stop; every phase's share is a sum of strided slices, one a tap."""
        nonlocal k
        out = np.zeros(max(0, stop - k))
        for first in range(k, min(stop, k + s.up)):
            number = first * s.down + centre
            count = -(-(stop - first) // s.up)
            begin = number // s.up - base - width + 1
            part = np.zeros(count)
            for tap, weight in enumerate(phases[number % s.up]):
                part += weight * held[begin + tap : begin + tap + (count - 1) * s.down + 1 : s.down]
            out[first - k :: s.up] = part
        k = max(k, stop)
        return out

    for block in signal:
        held = np.concatenate([held, block])
        seen += len(block)
        out = outputs(((base + len(held)) * s.up - 1 - centre) // s.down + 1)
        keep = max(0, (k * s.down + centre) // s.up - width + 1 - base)
        held, base = held[keep:], base + keep
        if len(out):
            yield out
    held = np.concatenate([held, np.zeros(centre // s.up + width + s.down)])
    yield outputs(-(-seen * s.up // s.down))


@cache
def _mel_bank(s: AudioSettings) -> tuple[np.ndarray, np.ndarray]:
    """Window and triangular filters (fft bins x mels), equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(s.low_hz), mel(s.out_rate / 2), s.mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(s.fft, 1 / s.out_rate)
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(s.window + 2)[1:-1], np.clip(np.minimum(up, down), 0, None)


def log_mel(samples: bytes, s: AudioSettings) -> Iterator[np.ndarray]:
    """Blocks of frames x mels (natural logarithm); frames overlap by window - hop."""
    window, bank = _mel_bank(s)
    data = np.frombuffer(samples, np.uint8)
    signal = ((data[a : a + s.block].astype(np.float64) - 127.5) / 127.5 for a in range(0, len(data), s.block))
    held = np.zeros(0)
    for block in resample(signal, s):
        held = np.concatenate([held, block])
        frames = (len(held) - s.window) // s.hop + 1 if len(held) >= s.window else 0
        if frames:
            view = np.lib.stride_tricks.sliding_window_view(held, s.window)[:: s.hop][:frames]
            spectrum = np.fft.rfft(view * window, s.fft)
            yield np.log((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-10)
            held = held[frames * s.hop :]


def segments(energy: np.ndarray, s: AudioSettings) -> list[tuple[float, float]]:
    """Spans in seconds: one opens where the energy rises to the upper threshold, closes where it falls below the lower."""
    if not len(energy):
        return []
    top = energy.max()
    level = np.where(energy >= top - s.open_db, 1, np.where(energy < top - s.close_db, -1, 0))
    at = np.flatnonzero(level)
    state = np.zeros(len(level), bool)
    if len(at):
        last = np.maximum.accumulate(np.where(level != 0, np.arange(len(level)), -1))
        state = (last >= 0) & (level[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(state, prepend=False, append=False))
    seconds = lambda frame: round(float(frame) * s.hop / s.out_rate, 4)
    return [(seconds(a), seconds(b)) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def features(samples: bytes, s: AudioSettings, tensors: bool = False) -> dict:
    """Frames, mean log-mel vector, energy segments and, if asked for, log-mel tensors of a fixed shape with spans."""
    total, energy, parts, frames = np.zeros(s.mels), [], [], 0
    for block in log_mel(samples, s):
        total += block.sum(axis=0)
        frames += len(block)
        energy.append(10 / np.log(10) * block.max(axis=1))
        if tensors:
            parts.append(block.astype(np.float32))
    spans = segments(np.concatenate(energy) if energy else np.zeros(0), s)
    out = {"frames": frames, "mean_mel": total / max(1, frames), "segments": spans}
    if tensors:
        flat = np.concatenate(parts) if parts else np.zeros((0, s.mels), np.float32)
        count = -(-frames // s.tensor_frames)
        full = np.zeros((count * s.tensor_frames, s.mels), np.float32)
        full[:frames] = flat
        hop = s.hop / s.out_rate
        out["tensors"] = full.reshape(count, s.tensor_frames, s.mels)
        out["spans"] = [(i * s.tensor_frames * hop, min(frames, (i + 1) * s.tensor_frames) * hop) for i in range(count)]
    return out


def tensor_array(values: np.ndarray) -> pa.ExtensionArray:
    """Fixed-shape Arrow tensors (frames x mels, half precision) of an array of them."""
    kind = pa.fixed_shape_tensor(pa.float16(), values.shape[1:], dim_names=["frame", "mel"])
    flat = pa.array(np.ascontiguousarray(values, np.float16).reshape(-1))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, values.shape[1] * values.shape[2]))


def tensor_table(samples: bytes, s: AudioSettings) -> pa.Table:
    """The tensors of a clip with their time spans."""
    got = features(samples, s, tensors=True)
    return pa.table({"start_s": pa.array([a for a, _ in got["spans"]], pa.float64()), "end_s": pa.array([b for _, b in got["spans"]], pa.float64()), "log_mel": tensor_array(got["tensors"])})


def store(docs: DataFrame, unit: int, s: AudioSettings) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as a WAV file; written to shared storage and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast("binary").to_pylist()]
            for a, b in slices(texts, 8_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([to_wav(pad(t, unit), s.rate) for t in texts[a:b]], pa.binary())], names=["doc_id", "n_bytes", "media"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(texts.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


_SEGMENTS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
#: What stands beside a clip's first tensor.
_CLIP = [
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("frames", pa.int64()), ("segments", _SEGMENTS),
]


def write_tensors(media: DataFrame, s: AudioSettings) -> DataFrame:
    """Compute stored clips and write their tensors; a row for each Arrow file: path, clips, tensors."""
    spark = media.sparkSession
    folder = new_folder(spark, "tensors")
    filesystem, inner = filesystem_of(folder)
    filesystem.create_dir(inner, recursive=True)

    def batch_of(clips: list[tuple]) -> pa.RecordBatch:
        """Rows of whole clips: doc_id, n, media."""
        own, first, spans, parts = [], [], [], []
        for doc, n, clip in clips:
            samples, _ = from_wav(clip)
            got = features(samples, s, tensors=True)
            more = len(got["spans"]) - 1
            own.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(clip), hashlib.sha256(clip).hexdigest(), got["frames"], [{"start_s": a, "end_s": b} for a, b in got["segments"]]))
            first += [len(own) - 1, *[None] * more]
            spans += got["spans"]
            parts.append(got["tensors"])
        places = pa.array(first, pa.int64())
        columns = [pa.array(c, t).take(places) for c, (_, t) in zip(zip(*own, strict=True), _CLIP, strict=True)]
        columns += [places.is_valid(), pa.array([a for a, _ in spans], pa.float64()), pa.array([b for _, b in spans], pa.float64()), tensor_array(np.concatenate(parts))]
        return pa.RecordBatch.from_arrays(columns, names=[*(n for n, _ in _CLIP), "begins", "start_s", "end_s", "log_mel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, inner = filesystem_of(folder)
        task = TaskContext.get()
        # the name holds the attempt: rows always mean the file of the attempt that wrote them
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        out = sink = None
        clips = tensors = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")]
            for a, b in slices(columns[2], BATCH_BYTES):
                made = batch_of(list(zip(*(c[a:b] for c in columns), strict=True)))
                if out is None:
                    sink = filesystem.open_output_stream(f"{inner}/.{name}", compression=None)
                    out = pa.ipc.new_file(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(made)
                clips, tensors = clips + b - a, tensors + len(made)
        if out is not None:
            out.close()
            sink.close()
            commit_file(filesystem, f"{inner}/.{name}", f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([clips], pa.int64()), pa.array([tensors], pa.int64())], names=["path", "clips", "tensors"])

    return save(media.select("doc_id", "n_bytes", "media").mapInArrow(run, "path string, clips long, tensors long"), "tensors-made")


def read_tensors(path: str) -> Iterator[pa.RecordBatch]:
    """The batches of one file of tensors; each holds whole clips."""
    filesystem, inner = filesystem_of(path)
    with filesystem.open_input_file(inner) as source, pa.ipc.open_file(source) as file:
        for i in range(file.num_record_batches):
            yield file.get_batch(i)


def clip_features(files: DataFrame, s: AudioSettings) -> DataFrame:
    """Digests, segments and features of the clips in files of tensors.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 samples), media_bytes, media_sha256,
    frames, segments (array of start and end seconds), mean_mel (array<double>).
    """
    schema = pa.schema([*_CLIP, ("mean_mel", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for rows in read_tensors(path):
                    first = np.flatnonzero(rows.column("begins").to_numpy(zero_copy_only=False))
                    # frames beyond a clip's end are zero and add nothing
                    sums = rows.column("log_mel").to_numpy_ndarray().astype(np.float64).sum(axis=1)
                    sums = np.add.reduceat(sums, first, axis=0)
                    clips = [rows.column(n).take(pa.array(first)) for n, _ in _CLIP]
                    mean = sums / np.maximum(1, clips[-2].to_numpy())[:, None]
                    yield pa.RecordBatch.from_arrays([*clips, pa.array(list(mean), pa.list_(pa.float64()))], schema=schema)

    count = max(1, files.count())
    return files.select("path").repartition(count).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments array<struct<start_s:double,end_s:double>>, mean_mel array<double>")


def describe(media: DataFrame, s: AudioSettings) -> DataFrame:
    """Write the tensors of clips that :func:`store` wrote, and their features as read back from them."""
    files = write_tensors(media, s)
    drop(media.sparkSession, media)
    return clip_features(files, s)
