"""Texts as FLAC media columns: a payload of bytes becomes one channel of 8-bit samples in a FLAC stream, and back; and
any FLAC column as rows of PCM blocks.

The coder chooses for each frame of ``BLOCK`` samples the shortest of constant, fixed linear predictors of order 0 to 2
and a general one of order ``LPC_ORDER`` fitted to the frame, with Rice-coded residuals, and plain samples. Every stream
has a seek table with one point a frame, so that frames are found without decoding those before them. The decoder reads
streams of up to 8 channels and 24 bits a sample, with or without a seek table: constant, plain, fixed (order 0-4) and
general linear predictor subframes with any Rice partitioning or escape, wasted bits and stereo in differences. It
verifies the CRC-8 of frame headers, the CRC-16 of frames and the MD5 of the samples (where it is set), and gives null
for a stream that fails. It works on all frames of many streams in lockstep: a step takes one residual of each.
``pcm_blocks`` writes a row for each frame with the offset of its first sample, which ``read_pcm`` seeks by.

Formats taken from RFC 9639. Null text counts as empty (64 zero bytes). Rows are independent of each other, so repeated
rows get equal streams; texts of any length are taken whole (a long one is alone in its slice); an empty table gives no
rows. Only doc_id and the text or media column are read, so other columns can't clash. Of two forms that take as many
bits the one with the lower order is taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import gathered, id_text, text_slices

BLOCK, RATE, ALIGN, TAIL = 4096, 8000, 64, 64
#: Order of fitted predictors, bits of their coefficients and of the fraction in them, and samples from which a frame has one.
LPC_ORDER, LPC_BITS, LPC_SHIFT, LPC_SAMPLES = 4, 12, 10, 256
#: Places at which a frame without a seek point is tried to end.
TRIES = 64
#: Bytes of text whose streams are decoded in lockstep, over several Arrow batches.
DECODED_TOGETHER = 6 << 20


@cache
def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ polynomial, table << 1) & ((1 << bits) - 1)
    return table


@cache
def _crc16_by_distance(length: int) -> np.ndarray:
    """What each byte value adds to a CRC-16 at each distance from the end."""
    step = _crc_table(16, 0x8005)
    out = np.empty((length, 256), np.uint16)
    now = step.copy()
    for i in range(length):
        out[i] = now
        now = ((now << 8) & 0xFFFF) ^ step[now >> 8]
    return out


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each byte range of ``data`` (all of them not empty)."""
    sizes = ends - starts
    table = _crc16_by_distance(1 << int(max(sizes.max(initial=1), 4200) - 1).bit_length()).reshape(-1)
    offsets = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(offsets - starts, sizes)
    left = np.repeat(ends, sizes) - 1 - at
    return np.bitwise_xor.reduceat(table[left * 256 + data[at]], offsets)


def crc8(head: bytes) -> int:
    table, out = _crc_table(8, 0x07), 0
    for b in head:
        out = int(table[out ^ b])
    return out


def coded_number(n: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more) >= 1 << (6 - more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> (6 * more), *(0x80 | n >> (6 * i) & 0x3F for i in reversed(range(more)))])


def frame_head(number: int, samples: int) -> bytes:
    head = b"\xff\xf8\x74\x02" + coded_number(number) + struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def _rice_bits(folded: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of each frame's folded residuals, and the bits that they take."""
    mean = np.add.reduceat(folded, heads, dtype=np.int64) / np.maximum(sizes, 1)
    guess = np.clip(np.log2(np.maximum(mean, 1)).astype(np.int64), 0, 13)
    best = None
    for k in (guess, guess + 1):
        bits = np.add.reduceat(folded >> np.repeat(k.astype(np.int32), sizes), heads, dtype=np.int64) + sizes * (k + 1)
        best = (k, bits) if best is None else tuple(np.where(bits < best[1], (k, bits), best))
    return best


def fitted(data: np.ndarray, place: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Coefficients (in fractions of 2 ** LPC_SHIFT) of each frame's linear predictor, by autocorrelation and Levinson's
    recursion over all frames at once."""
    x = data.astype(np.float64)
    r = [np.add.reduceat(x * x, begins)]
    for j in range(1, LPC_ORDER + 1):
        product = np.zeros_like(x)
        product[j:] = x[j:] * x[:-j]
        product[place < j] = 0
        r.append(np.add.reduceat(product, begins))
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((LPC_ORDER, len(sizes)))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / error
        a[:i] -= k * a[:i][::-1].copy()
        a[i] = k
        error = error * (1 - k * k)
    most = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most, most - 1).astype(np.int64).T


def encode(payloads: list[bytes], lpc: tuple[int, ...] | None = None, shift: int = 0) -> list[bytes]:
    """A FLAC stream of each payload (not empty). ``lpc``: use this linear predictor in each frame with enough samples."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    totals = np.array([len(p) for p in payloads])
    per = -(-totals // BLOCK)
    stream = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(per) - per, per)
    begins = np.repeat(np.cumsum(totals) - totals, per) + number * BLOCK
    sizes = np.minimum(BLOCK, np.repeat(totals, per) - number * BLOCK)
    place = (np.arange(len(data)) - np.repeat(begins, sizes)).astype(np.int32)
    bits_of, shift_of = (15, shift) if lpc else (LPC_BITS, LPC_SHIFT)
    factors = np.tile(np.array(lpc), (len(sizes), 1)) if lpc else fitted(data, place, begins, sizes)
    # the plain form (-1), then each predictor that takes fewer bits: fixed ones by their order, the general one as GENERAL
    form, rice, bits = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64), 8 * sizes
    general = 9 + bits_of * factors.shape[1]
    residual = {}
    for f in (GENERAL,) if lpc else (0, 1, 2, GENERAL):
        o = factors.shape[1] if f == GENERAL else f
        if f == GENERAL:
            ahead = np.zeros(len(data), np.int64 if lpc else np.int32)
            for j in range(o):
                ahead[j + 1 :] += np.repeat(factors[:, j].astype(ahead.dtype), sizes)[j + 1 :] * data[: -j - 1]
            e = data - (ahead >> shift_of).astype(np.int32)
        else:
            e = np.diff(data, n=o, prepend=np.zeros(o, np.int32)) if o else data
        residual[f] = np.where(place >= o, (e << 1) ^ (e >> 31), 0).astype(np.int32)
        k, cost = _rice_bits(residual[f], begins, sizes)
        cost = cost - o * (k + 1) + 8 * o + 10 + (general if f == GENERAL else 0)
        better = (sizes > o) if lpc else (cost < bits) & (sizes > o) & ((f != GENERAL) | (sizes >= LPC_SAMPLES))
        form, rice, bits = np.where(better, f, form), np.where(better, k, rice), np.where(better, cost, bits)
    flat = np.minimum.reduceat(data, begins) == np.maximum.reduceat(data, begins)
    form = np.where(flat & (lpc is None), -2, form)

    heads = [frame_head(int(n), int(s)) for n, s in zip(number, sizes)]
    head_sizes = np.array([len(h) for h in heads])
    lead = 8 + np.where(form >= 0, 10, 0) + np.where(form == GENERAL, general, 0)  # subframe head, and what stands before the codes
    warm = np.where(form == GENERAL, factors.shape[1], np.maximum(form, 0))
    chosen, k = np.repeat(form.astype(np.int32), sizes), np.repeat(rice.astype(np.int32), sizes)
    plain = (chosen == -1) | (place < np.repeat(warm, sizes)) | ((chosen == -2) & (place == 0))
    folded = np.zeros(len(data), np.int32)
    for f, e in residual.items():
        if (form == f).any():
            folded = np.where(chosen == f, e, folded)
    value = np.where(plain, data & 0xFF, folded)
    width = np.where(plain, 8, np.where(chosen == -2, 0, (folded >> k) + 1 + k))
    after = np.cumsum(width)
    body_bits = np.add.reduceat(width, begins) + lead
    frame_sizes = head_sizes + (body_bits + 7) // 8 + 2
    frame_at = np.cumsum(frame_sizes) - frame_sizes
    # where each sample's code begins, in bits
    base = (frame_at + head_sizes) * 8 + 8 - (after[begins] - width[begins])
    at = np.repeat(base, sizes) + after - width
    # the predictor and the residual's head stand between the warm-up and the codes
    at += np.where(plain, 0, np.repeat(lead - 8, sizes))
    out = _write_codes(int(frame_sizes.sum()), at + np.where(plain, 0, value >> k), *_codes(value, width, plain, k))
    for i, head in enumerate(heads):
        a = int(frame_at[i])
        out[a : a + len(head)] = np.frombuffer(head, np.uint8)
        f = int(form[i])
        out[a + len(head)] = {-2: 0, -1: 1, GENERAL: 31 + factors.shape[1]}.get(f, 8 + f) << 1
        if f >= 0:
            extra = [(bits_of - 1, 4), (shift_of, 5), *((c & ((1 << bits_of) - 1), bits_of) for c in factors[i].tolist())] if f == GENERAL else []
            _put(out, (a + len(head) + 1) * 8 + 8 * int(warm[i]), [*extra, (0, 6), (int(rice[i]), 4)])
    ends = frame_at + frame_sizes - 2
    sums = crc16(out, frame_at, ends)
    out[ends], out[ends + 1] = sums >> 8, sums & 0xFF
    whole = out.tobytes()

    streams, first = [], np.cumsum(per) - per
    for s, payload in enumerate(payloads):
        mine = slice(first[s], first[s] + per[s])
        audio = whole[frame_at[mine][0] : frame_at[mine][-1] + frame_sizes[mine][-1]]
        blocks, lengths = sizes[mine], frame_sizes[mine]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        seek = np.zeros(len(blocks), POINT)
        seek["sample"], seek["offset"], seek["size"] = number[mine] * BLOCK, frame_at[mine] - frame_at[mine][0], blocks
        streams.append(b"fLaC" + b"\0\0\0\x22" + info + b"\x83" + (18 * len(blocks)).to_bytes(3, "big") + seek.tobytes() + audio)
    return streams


GENERAL = 99
POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])


def _codes(value: np.ndarray, width: np.ndarray, plain: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code from its first 1 bit on (plain samples: whole), and its bits; 14 at most."""
    size = np.where(plain, 8, np.where(width > 0, k + 1, 0))
    return np.where(plain, value, np.where(width > 0, (1 << k) | (value & ((1 << k) - 1)), 0)), size


def _write_codes(n_bytes: int, at: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes with each code at its bit position. Codes don't overlap, so adding a byte's parts is joining them."""
    word = np.bincount(at >> 3, weights=code << (24 - (at & 7) - size), minlength=n_bytes + 2).astype(np.uint32)
    out = word >> 16
    out[1:] |= word[:-1] >> 8 & 0xFF
    out[2:] |= word[:-2] & 0xFF
    return out[:n_bytes].astype(np.uint8)


def _put(out: np.ndarray, at: int, fields: list[tuple[int, int]]) -> None:
    for value, width in fields:
        for j in range(width):
            if value >> (width - 1 - j) & 1:
                out[(at + j) >> 3] |= 0x80 >> ((at + j) & 7)
        at += width


class Corrupt(ValueError):
    """A stream that isn't FLAC of a kind that is read here, or whose checksums don't hold."""


class Head(NamedTuple):
    """A frame's header: samples, channels, how two channels are differences (1: left, side; 2: side, right; 3: mid, side),
    bits a sample (0: the stream's), the frame's number or its first sample's, and the header's own bytes."""

    samples: int
    channels: int
    mode: int
    bits: int
    number: int
    by_sample: bool
    size: int


# Bits a sample, and bytes of a sample rate in the header, by their codes.
_SAMPLE_BITS, _RATE_BYTES = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}, {12: 1, 13: 2, 14: 2}


def read_head(b: bytes) -> Head | None:
    """The header that begins a run of bytes, None if none does."""
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8 or b[3] & 1:
        return None
    blocks, rate, channels, width = b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
    ones = 8 - (~b[4] & 0xFF).bit_length()
    at = 4 + max(1, ones)
    if not blocks or rate == 15 or channels > 10 or width not in _SAMPLE_BITS or ones in (1, 8) or any(x & 0xC0 != 0x80 for x in b[5:at]):
        return None
    number = b[4] & (0x7F >> ones)
    for x in b[5:at]:
        number = number << 6 | x & 0x3F
    more = {6: 1, 7: 2}.get(blocks, 0)
    samples = int.from_bytes(b[at : at + more], "big") + 1 if more else 192 if blocks == 1 else 576 << (blocks - 2) if blocks < 6 else 256 << (blocks - 8)
    at += more + _RATE_BYTES.get(rate, 0)
    if at >= len(b) or crc8(b[:at]) != b[at]:
        return None
    return Head(samples, 2 if channels > 7 else channels + 1, max(0, channels - 7), _SAMPLE_BITS[width], number, bool(b[1] & 1), at + 1)


class Stream(NamedTuple):
    rate: int
    channels: int
    bits: int
    total: int  # samples; 0: not said
    md5: bytes
    offsets: np.ndarray  # of frames
    stops: np.ndarray
    sizes: np.ndarray  # in samples
    heads: list[Head]


def read_stream(stream: bytes) -> Stream:
    """What the metadata say, and the frames: by the seek table if it names each of them, else found by their headers."""
    if stream[:4] != b"fLaC":
        raise Corrupt("no marker")
    at, last, points, info = 4, False, None, b""
    while not last:
        if at + 4 > len(stream):
            raise Corrupt("metadata ends early")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3 and size % 18 == 0:
            points = np.frombuffer(block, POINT)
        at += 4 + size
    if len(info) != 34:
        raise Corrupt("no stream info")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, bits, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    if bits > 24:
        raise Corrupt("more than 24 bits a sample")
    offsets = sizes = np.zeros(0, np.int64)
    if points is not None:
        points = points[points["sample"] != (1 << 64) - 1]
        offsets, sizes = points["offset"].astype(np.int64) + at, points["size"].astype(np.int64)
    if sizes.sum() != total or not total or (points["sample"].astype(np.int64) != np.cumsum(sizes) - sizes).any() or (np.diff(offsets) <= 0).any() or offsets[0] != at or offsets[-1] >= len(stream):
        offsets = np.array(frame_offsets(stream, at), np.int64)
    heads = [read_head(stream[o : o + 20]) for o in offsets.tolist()]
    if not all(heads) or any(h.channels != channels or h.bits not in (0, bits) for h in heads):
        raise Corrupt("frames of another kind than the stream")
    sizes = np.array([h.samples for h in heads], np.int64)
    if total and sizes.sum() != total:
        raise Corrupt("samples are missing")
    return Stream(rate, channels, bits, total, info[18:], offsets, np.append(offsets[1:], len(stream)), sizes, heads)


def frame_offsets(stream: bytes, at: int) -> list[int]:
    """Where frames begin, without a seek table: at headers that go on counting, where the frame before ends in its checksum."""
    data = np.frombuffer(stream, np.uint8)
    marks = np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] & 0xFE == 0xF8)) + at
    out, i = [], 0
    while at < len(stream):
        head = read_head(stream[at : at + 20])
        if not head:
            raise Corrupt("no frame where one should begin")
        out.append(at)
        follows, tries = head.number + (head.samples if head.by_sample else 1), 0
        i = int(np.searchsorted(marks, at + head.size))
        while tries < TRIES:
            end = int(marks[i]) if i < len(marks) else len(stream)
            after = read_head(stream[end : end + 20]) if end < len(stream) else None
            if end == len(stream) or after and after.number == follows and after.by_sample == head.by_sample:
                tries += 1
                if end - at > head.size + 2 and crc16(data, np.array([at]), np.array([end - 2]))[0] == int.from_bytes(stream[end - 2 : end], "big"):
                    break
                if end == len(stream):
                    raise Corrupt("a frame's checksum does not hold")
            i += 1
        else:
            raise Corrupt("a frame has no end")
        at = end
    return out


class Audio(NamedTuple):
    """Samples by (sample, channel)."""

    rate: int
    bits: int
    samples: np.ndarray
    sizes: np.ndarray  # of the frames


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Samples interleaved, signed, the least byte first."""
    width = -(-bits // 8)
    return np.ascontiguousarray(samples, "<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


class Block(NamedTuple):
    """The PCM of a frame, and which samples of its stream it holds."""

    first_sample: int
    n_samples: int
    pcm: bytes


def blocks_of(audio: Audio) -> list[Block]:
    starts = np.cumsum(audio.sizes) - audio.sizes
    return [Block(a, n, pcm(audio.samples[a : a + n], audio.bits)) for a, n in zip(starts.tolist(), audio.sizes.tolist())]


def payload_from(blocks: list[Block]) -> bytes:
    """The bytes that the blocks of one channel with 8 bits hold, each block put where its offset says."""
    out = np.empty(sum(b.n_samples for b in blocks), np.uint8)
    for b in blocks:
        out[b.first_sample : b.first_sample + b.n_samples] = np.frombuffer(b.pcm, np.uint8)
    return (out ^ np.uint8(128)).tobytes()


def decode_audio(streams: list[bytes]) -> list[Audio | None]:
    """The samples of each stream, None where it is corrupt."""
    parsed, out, base = [], [None] * len(streams), 0
    for i, stream in enumerate(streams):
        try:
            parsed.append((i, base, read_stream(stream)))
        except Corrupt:
            pass
        base += len(stream)
    if not parsed:
        return out
    data = np.frombuffer(b"".join(streams), np.uint8)
    starts, stops = (np.concatenate([getattr(s, c) + b for _, b, s in parsed]) for c in ("offsets", "stops"))
    rows = _frames(data, starts, stops, [h for *_, s in parsed for h in s.heads], np.repeat([s.bits for *_, s in parsed], [len(s.heads) for *_, s in parsed]))
    at = 0
    for i, _, s in parsed:
        own = rows[at : at + len(s.heads)]
        at += len(s.heads)
        if any(r is None for r in own):
            continue
        samples = np.concatenate(own) if own else np.zeros((0, s.channels), np.int32)
        if not any(s.md5) or hashlib.md5(pcm(samples, s.bits)).digest() == s.md5:
            out[i] = Audio(s.rate, s.bits, samples, s.sizes)
    return out


def _payload(samples: np.ndarray) -> bytes:
    return (samples[:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def decode(streams: list[bytes]) -> list[bytes | None]:
    """The payload of each stream of one channel with 8 bits, None for others and where it is corrupt."""
    return [_payload(a.samples) if a and a.bits == 8 and a.samples.shape[1] == 1 else None for a in decode_audio(streams)]


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """``count`` bytes of the payload from ``sample`` on, decoding only the frames that hold them."""
    s = read_stream(stream)
    ends = np.cumsum(s.sizes)
    hold = np.flatnonzero((ends > sample) & (ends - s.sizes < sample + count))
    if not len(hold):
        return b""
    rows = _frames(np.frombuffer(stream, np.uint8), s.offsets[hold], s.stops[hold], [s.heads[i] for i in hold], np.full(len(hold), s.bits))
    if any(r is None for r in rows):
        raise Corrupt("a frame's checksum does not hold")
    start = sample - int(ends[hold[0]] - s.sizes[hold[0]])
    return _payload(np.concatenate(rows)[start : start + count])


#: 0 bits before the first 1 of a 16-bit number.
_ZEROS = np.concatenate([[16], 15 - np.log2(np.arange(1, 1 << 16)).astype(np.int64)])


class _Bits:
    """Reads at many bit positions at once."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.n = 8 * len(data)
        self.words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Count of 0 bits before the next 1."""
        count = _ZEROS[self.read(at, 16)]
        far = np.flatnonzero(count == 16)
        while len(far):
            more = _ZEROS[self.read(at[far] + count[far], 16)]
            count[far] += more
            far = far[(more == 16) & (at[far] + count[far] < self.n)]
        return count

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Up to 25 bits from each position."""
        at = np.minimum(at, self.n)
        return (self.words[at >> 3].astype(np.int64) >> (32 - (at & 7) - width)) & ((1 << width) - 1)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        """A number of up to 50 bits in two's complement from each position."""
        if np.max(width, initial=0) > 25:
            high = np.minimum(width, 25)
            x = self.read(at, high) << (width - high) | self.read(at + high, width - high)
        else:
            x = self.read(at, width)
        return np.where(x >> np.maximum(width - 1, 0) & 1, x - (np.int64(1) << width), x)


def _frames(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, heads: list[Head], stream_bits: np.ndarray) -> list[np.ndarray | None]:
    """Samples (by sample and channel) of each frame (bytes [start, stop) of ``data``), None where a checksum or the
    format doesn't hold."""
    bits, n = _Bits(data), len(starts)
    channels, mode, sizes, head = (np.array([getattr(h, c) for h in heads], np.int64) for c in ("channels", "mode", "samples", "size"))
    good = stops - starts > head + 2
    sums = np.zeros(n, np.int64)
    sums[good] = crc16(data, starts[good], stops[good] - 2)
    good &= sums == bits.read((stops - 2) * 8, np.int64(16))
    at = (starts + head) * 8
    out = []
    for c in range(int(channels.max(initial=1))):
        samples = np.zeros((n, int(sizes.max(initial=0))), np.int32)
        # a side channel, the difference of two, takes one bit more
        side = (mode == 2) if c == 0 else ((mode == 1) | (mode == 3)) & (c == 1)
        _subframes(bits, data, at, np.flatnonzero(good & (channels > c)), stream_bits + side, sizes, samples, good)
        out.append(samples)
    if mode.any():
        a, b = out[:2]
        for m in (1, 2, 3):
            x, y = a[mode == m], b[mode == m]
            whole = x << 1 | y & 1  # the sum of two channels is odd where their difference is
            a[mode == m], b[mode == m] = {1: (x, x - y), 2: (x + y, y), 3: ((whole + y) >> 1, (whole - y) >> 1)}[m]
    return [np.stack([s[i, : sizes[i]] for s in out[: channels[i]]], axis=1) if good[i] else None for i in range(n)]


def _subframes(bits: _Bits, data: np.ndarray, at: np.ndarray, live: np.ndarray, width: np.ndarray, sizes: np.ndarray, samples: np.ndarray, good: np.ndarray) -> None:
    """One subframe of each frame ``live``, from the bits ``at``, which then stand at its end."""
    n = len(at)
    kind = np.full(n, 1)
    kind[live] = bits.read(at[live] + 1, np.int64(6))
    good[live] &= bits.read(at[live], np.int64(1)) == 0
    wasted = np.zeros(n, np.int64)
    waste = live[bits.read(at[live] + 7, np.int64(1)) == 1]
    at[live] += 8
    wasted[waste] = bits.zeros(at[waste]) + 1
    at[waste] += wasted[waste]
    width = width - wasted
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    good[live] &= ((kind <= 1) | fixed | lpc)[live] & (width > 0)[live]
    live = live[good[live]]
    flat = live[kind[live] == 0]
    samples[flat] = bits.signed(at[flat], width[flat])[:, None]
    at[flat] += width[flat]
    for i in live[kind[live] == 1]:
        if width[i] == 8 and at[i] & 7 == 0:
            a = at[i] >> 3
            samples[i, : sizes[i]] = data[a : a + sizes[i]].view(np.int8)
        else:
            samples[i, : sizes[i]] = bits.signed(at[i] + np.arange(sizes[i]) * width[i], width[i])
        at[i] += sizes[i] * width[i]
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    good[live] &= (order <= sizes)[live]
    rest = live[(good & (fixed | lpc))[live]]
    if len(rest):
        for j in range(int(order[rest].max())):
            own = rest[order[rest] > j]
            samples[own, j] = bits.signed(at[own], width[own])
            at[own] += width[own]
        factors, shift = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)
        own = rest[lpc[rest]]
        if len(own):
            precision = bits.read(at[own], np.int64(4)) + 1
            shift[own] = bits.read(at[own] + 4, np.int64(5))
            good[own] &= (precision < 16) & (shift[own] < 16)
            at[own] += 9
            for j in range(int(order[own].max())):
                use = order[own] > j
                factors[own[use], j] = bits.signed(at[own[use]], precision[use])
                at[own[use]] += precision[use]
        _residuals(bits, at, rest, order, sizes, samples, good)
        _restore(rest, order, lpc, factors, shift, sizes, samples)
    if len(waste):
        samples[waste] <<= wasted[waste][:, None].astype(np.int32)


def _residuals(bits: _Bits, at, rest, order, sizes, samples, good) -> None:
    """Rice codes of the frames ``rest``, one code of each at a time; the longest frames first, so that those still at work stand together."""
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    method, parts = bits.read(at[rest], np.int64(2)), bits.read(at[rest] + 2, np.int64(4))
    good[rest[method > 1]] = False
    place = at[rest] + 6
    first, size = order[rest], sizes[rest]
    each = size >> parts
    head = np.where(method == 1, 5, 4)
    k, raw = np.zeros(len(rest), np.int64), np.full(len(rest), -1)
    out = np.zeros((int(size.max()), len(rest)), np.int32)
    simple = bool((parts == 0).all() and (first == first[0]).all())
    for i in range(int(first.min()), int(size.max())):
        live = int(np.searchsorted(-size, -i, side="left"))
        now = slice(0, live)
        if not simple or i == int(first[0]):
            new = np.flatnonzero((i >= first[now]) & ((i == first[now]) | (i % np.maximum(each[now], 1) == 0)))
            if len(new):
                k[new] = bits.read(place[new], head[new])
                place[new] += head[new]
                escape = k[new] == (1 << head[new]) - 1
                raw[new] = np.where(escape, bits.read(place[new], np.int64(5)), -1)
                place[new] += np.where(escape, 5, 0)
        p = place[now]
        if simple and (i > int(first[0]) or (raw < 0).all()):
            kk = k[now]
            zeros = bits.zeros(p)
            p += zeros + 1
            folded = (zeros << kk) | bits.read(p, kk)
            out[i, now] = (folded >> 1) ^ -(folded & 1)
            p += kk
            continue
        simple = False
        begun = i >= first[now]
        stop = p + bits.zeros(p)
        kk = np.where(raw[now] < 0, k[now], 0)
        folded = ((stop - p) << kk) | bits.read(stop + 1, kk)
        width = np.maximum(raw[now], 1)
        plain = np.where(raw[now] == 0, 0, bits.signed(p, width))
        value = np.where(raw[now] < 0, (folded >> 1) ^ -(folded & 1), plain)
        out[i, now] = np.where(begun, value, 0)
        place[now] = np.where(begun, np.where(raw[now] < 0, stop + 1 + kk, p + np.maximum(raw[now], 0)), p)
    at[rest] = place
    rows = np.ascontiguousarray(out.T)
    for j in range(int(first.max())):
        rows[:, j] = np.where(first > j, samples[rest, j], rows[:, j])
    samples[rest, : rows.shape[1]] = rows


def _restore(rest, order, lpc, factors, shift, sizes, samples) -> None:
    """Add the predictions: fixed ones by running sums, others step by step."""
    for o in range(1, 5):
        own = rest[(order[rest] == o) & ~lpc[rest]]
        if not len(own):
            continue
        block = samples[own]
        edges = [np.diff(block[:, :o], n=j, axis=1)[:, -1] if j < o else None for j in range(o)]
        now = block[:, o:]
        for j in reversed(range(o)):  # the j-th differences from those one order higher
            now = edges[j][:, None] + np.cumsum(now, axis=1)
        block[:, o:] = now
        samples[own] = block
    own = rest[lpc[rest]]
    if len(own):
        own = own[np.argsort(-sizes[own], kind="stable")]
        most, first, size = int(order[own].max()), order[own], sizes[own]
        block, f = np.ascontiguousarray(samples[own].T).astype(np.int64), np.ascontiguousarray(factors[own].T)
        for i in range(int(first.min()), int(size[0])):
            live = int(np.searchsorted(-size, -i, side="left"))
            ahead = np.zeros(live, np.int64)
            for j in range(min(most, i)):
                ahead += f[j, :live] * block[i - 1 - j, :live]
            ahead >>= shift[own[:live]]
            block[i, :live] += ahead if i >= most else np.where(first[:live] <= i, ahead, 0)
        samples[own] = block.T


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0")


def features(payload: bytes) -> str:
    """Sample count, mean and root mean square in thousandths, peak, and sign changes of the signal."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rate={RATE};samples={len(x)};mean={int(x.sum()) * 1000 // len(x)};rms={int(np.sqrt((x * x).mean()) * 1000)};peak={int(np.abs(x).max())};changes={changes}"


def media_columns(df: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media of every row.

    The payload's columns come from the PCM blocks of the stored stream, which are those of ``pcm_blocks``; they are null
    if that is corrupt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", DECODED_TOGETHER):
            texts = part.column(1).to_pylist()
            media = [m for own in text_slices(part, "text") for m in encode([payload_of(t) for t in own.column(1).to_pylist()])]
            back = [payload_from(blocks_of(a)) if a and a.bits == 8 and a.samples.shape[1] == 1 else None for a in decode_audio(media)]
            sha = lambda b: None if b is None else hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([None if b is None else len(b) for b in back], pa.int64()),
                    pa.array([sha(b) for b in back], pa.string()),
                    pa.array([None if b is None else zlib.crc32(b[-TAIL:]) for b in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([sha(m) for m in media], pa.string()),
                    pa.array([None if b is None else features(b) for b in back], pa.string()),
                    pa.array(media if keep_media else [None] * len(media), pa.binary()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    return id_text(df).select("doc_id", F.col("text")).mapInArrow(run, schema)


def pcm_blocks(df: DataFrame, media: str = "media") -> DataFrame:
    """(doc_id, block, first_sample, n_samples, rate, channels, bits, pcm): a row for each frame of a column of FLAC streams,
    its samples interleaved, signed, least byte first. A null or corrupt stream has one row, with nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "media"):
                rows = []
                for doc, audio in zip(part.column(0).to_pylist(), decode_audio([m or b"" for m in part.column(1).to_pylist()])):
                    if audio is None:
                        rows.append((doc, *[None] * 7))
                        continue
                    for k, b in enumerate(blocks_of(audio)):
                        rows.append((doc, k, b.first_sample, b.n_samples, audio.rate, audio.samples.shape[1], audio.bits, b.pcm))
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
                names = ["doc_id", "block", "first_sample", "n_samples", "rate", "channels", "bits", "pcm"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    schema = "doc_id long, block long, first_sample long, n_samples long, rate int, channels int, bits int, pcm binary"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, schema)


def read_pcm(blocks: DataFrame, sample: int, count: int) -> DataFrame:
    """The parts of ``pcm_blocks`` that hold ``count`` samples from ``sample`` on, in the same columns: a filter on offsets,
    which stored blocks push down, and a cut."""
    first, end = F.greatest(F.col("first_sample"), F.lit(sample)), F.least(F.col("first_sample") + F.col("n_samples"), F.lit(sample + count))
    width = F.col("channels") * F.ceil(F.col("bits") / 8)
    held = blocks.filter((F.col("first_sample") < sample + count) & (F.col("first_sample") + F.col("n_samples") > sample))
    cut = F.substring("pcm", ((first - F.col("first_sample")) * width + 1).cast("int"), ((end - first) * width).cast("int"))
    return held.withColumns({"pcm": cut, "first_sample": first, "n_samples": end - first})


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id and payload (null: corrupt or null) of a column of FLAC streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "media"):
                out = decode([m or b"" for m in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "payload"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, "doc_id long, payload binary")
