"""Fill-in-the-middle transformation over seekable compressed frames.

``store_frames`` keeps each text as independent zstandard frames of about ``FRAME_BYTES``,
each with the number of units that end up to its end and the code points up to its end
(both cumulative). A unit is white space followed by a word; white space that ends a text
is a unit of its own. A cut after u units then needs one frame: the first whose cumulative
count reaches u is found by binary search and is the only one decompressed.

``transform`` chooses form and cuts from the hash of the seed and the id, and returns the
transformed text as frames again: whole frames are handed on as they are, and only the cut
frames are split and compressed anew. ``digests`` streams these frames in order, so no text
longer than a frame's share is ever expanded at once; ``restored`` gives the frames of the
original order back from output and form alone.

Nothing is shuffled. The frames of a row are one written Parquet row; a lost executor costs
the tasks it ran.

Edge cases: null text is an empty one (0 units, plain); a text that holds a sentinel is
plain; a unit longer than a frame spans several, all but the last of which end no unit; a
null id hashes like an empty one and is reported as null; rows that repeat an id are
transformed one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import textops as X
from feedlake.session import materialize

FRAME_BYTES = 1 << 16
LEVEL = 3
SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these in the form suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
#: Frames of one document that are handed from task to task in one row: output of ``store_frames``.
FRAMES = "doc_id long, n long, marked boolean, frames array<binary>, units array<long>, chars array<long>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte positions at which a unit of ``data`` (UTF-8) ends."""
    if not len(data):
        return np.empty(0, np.int64)
    white = _WHITE[data]
    inner = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.r_[inner, len(data)]


def frame_cuts(data: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Frame bounds 0 ... len(data): after the last unit that fits ``size`` bytes, or inside a longer unit between characters."""
    cuts = [0]
    while cuts[-1] < len(data):
        at = cuts[-1]
        if len(data) - at <= size:
            cut = len(data)
        else:
            fit = int(np.searchsorted(ends, at + size, "right")) - 1
            cut = int(ends[fit]) if fit >= 0 and ends[fit] > at else at + size
            while cut < len(data) and data[cut] & 0xC0 == 0x80:          # not inside a character
                cut += 1
        cuts.append(cut)
    return np.array(cuts, np.int64)


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The ``FRAMES`` columns of every row of ``docs``, to be written as a table.

    units, chars: cumulative counts at the end of each frame."""
    sentinels = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            ids = batch.column(0)
            data, offs = X.utf8(batch.column(1))
            for a, b, d, o in X.chunks(data, offs):
                rows = []
                for x, y in zip(o[:-1].tolist(), o[1:].tolist()):
                    own = d[x:y]
                    raw = own.tobytes()
                    ends = unit_ends(own)
                    cuts = frame_cuts(own, ends, frame_bytes)
                    first = np.r_[0, np.cumsum(own & 0xC0 != 0x80)][cuts[1:]]
                    rows.append((len(ends), any(m in raw for m in sentinels),
                                 [packer.compress(raw[i:j]) for i, j in zip(cuts[:-1], cuts[1:])],
                                 np.searchsorted(ends, cuts[1:], "right").tolist(), first.tolist()))
                kinds = [pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                                                 names=["doc_id", "n", "marked", "frames", "units", "chars"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(X.lean(run), FRAMES)


def with_plan(frames: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Adds form and the two cuts (in units) to frame rows; four numbers per id come from its salted hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    return frames.withColumns({"form": form, "first_cut": F.least(a, b), "second_cut": F.greatest(a, b)})


def find_cut(units: list[int], u: int) -> int:
    """The frame that holds the end of unit ``u`` (1-based)."""
    return int(np.searchsorted(units, u))


class FrameText:
    """One document's frames; only frames asked for are decompressed."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], packer, opener):
        self.frames, self.units, self.chars, self.packer, self.opener = frames, units, chars, packer, opener
        self.opened: dict[int, bytes] = {}

    def frame(self, i: int) -> bytes:
        if i not in self.opened:
            self.opened[i] = self.opener.decompress(self.frames[i])
        return self.opened[i]

    def place(self, u: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the end of unit ``u``; 0 is the start of the text."""
        if u == 0:
            return 0, 0, 0
        i = find_cut(self.units, u)
        body = np.frombuffer(self.frame(i), np.uint8)
        before = self.units[i - 1] if i else 0
        ends = unit_ends(body)
        at = int(ends[u - before - 1])
        chars = (self.chars[i - 1] if i else 0) + int((body[:at] & 0xC0 != 0x80).sum())
        return i, at, chars

    def piece(self, low: tuple[int, int, int], high: tuple[int, int, int]) -> list[bytes]:
        """Frames of the text between two places: whole ones as stored, cut ones compressed anew."""
        (i, x, _), (j, y, _) = low, high
        if i == j:
            return [self.packer.compress(self.frame(i)[x:y])] if y > x else []
        out = [self.frames[i]] if x == 0 else [self.packer.compress(self.frame(i)[x:])] if x < len(self.frame(i)) else []
        out += self.frames[i + 1:j]
        if j < len(self.frames) and y:
            out.append(self.packer.compress(self.frame(j)[:y]))
        return out


def transform(frames: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The ``OUTPUT`` columns: form, lengths in code points (null if plain) and the frames of the transformed text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        mark = {m: packer.compress(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                form, own = (batch.column(c)[r].as_py() for c in ("form", "frames"))
                if form == "plain":
                    rows.append((None, None, own))
                    continue
                units, chars, u, v = (batch.column(c)[r].as_py() for c in ("units", "chars", "first_cut", "second_cut"))
                text = FrameText(own, units, chars, packer, opener)
                start, low, high, end = (0, 0, 0), text.place(u), text.place(v), (len(own), 0, chars[-1])
                prefix, middle, suffix = text.piece(start, low), text.piece(low, high), text.piece(high, end)
                out = ([mark[SUFFIX], *suffix, mark[PREFIX], *prefix, mark[MIDDLE], *middle] if form == "spm"
                       else [mark[PREFIX], *prefix, mark[SUFFIX], *suffix, mark[MIDDLE], *middle])
                rows.append((low[2], high[2] - low[2], out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n"), batch.column("form"), pa.array([x[0] for x in rows], pa.int64()),
                 pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.binary()))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    plan = with_plan(frames, seed, rate, spm_rate)
    return plan.select("doc_id", "n", "form", "first_cut", "second_cut", "frames", "units", "chars").mapInArrow(X.lean(run), OUTPUT)


def marker_places(frames: list[bytes], form: str, opener) -> list[tuple[int, int]]:
    """(first byte, end) of the three sentinels in the output's bytes, in their order.

    The pieces hold no sentinel, and none can overlap one, so the first match of each counts."""
    wanted = [m.encode() for m in ((SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE))]
    found, base, tail = [], 0, b""
    for frame in frames:
        body = tail + opener.decompress(frame)
        at = 0
        while len(found) < 3 and (hit := body.find(wanted[len(found)], at)) >= 0:
            at = hit + len(wanted[len(found)])
            found.append((base + hit, base + at))
        keep = max(at, len(body) - max(map(len, wanted)) + 1)
        base, tail = base + keep, body[keep:]
    return found


def _stream(frames: list[bytes], ranges: list[tuple[int, int]], opener) -> Iterator[bytes]:
    """The bytes of each range of the expanded text, ranges in the given order, a frame at a time."""
    size = np.r_[0, np.cumsum([zstandard.frame_content_size(f) for f in frames])]
    for low, high in ranges:
        i = max(0, int(np.searchsorted(size, low, "right")) - 1)
        while i < len(frames) and size[i] < high:
            body = opener.decompress(frames[i])
            yield body[max(0, low - int(size[i])):high - int(size[i])]
            i += 1


def original_ranges(frames: list[bytes], form: str, opener) -> list[tuple[int, int]]:
    """Byte ranges of the output that make up the original text, in its order."""
    total = sum(zstandard.frame_content_size(f) for f in frames)
    if form == "plain":
        return [(0, total)]
    (_, a), (b, c), (d, e) = marker_places(frames, form, opener)
    first, second, middle = (a, b), (c, d), (e, total)
    return [second, middle, first] if form == "spm" else [first, middle, second]


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text of an output, a frame at a time."""
    opener = zstandard.ZstdDecompressor()
    return _stream(frames, original_ranges(frames, form, opener), opener)


def digests(outputs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out, back = [], []
            for form, frames in zip(batch.column("form").to_pylist(), batch.column("frames")):
                own, one, two = frames.as_py(), hashlib.sha256(), hashlib.sha256()
                for frame in own:
                    one.update(opener.decompress(frame))
                for body in _stream(own, original_ranges(own, form, opener), opener):
                    two.update(body)
                out.append(one.hexdigest())
                back.append(two.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string()), pa.array(back, pa.string())],
                                             names=[*kept, "output_sha256", "restored_sha256"])

    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return outputs.select(*kept, "frames").mapInArrow(X.lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The transformed texts (``OUTPUT`` columns) of all documents, over a written table of frames."""
    return transform(materialize(store_frames(docs, frame_bytes), "fim-frames"), seed, rate, spm_rate)
