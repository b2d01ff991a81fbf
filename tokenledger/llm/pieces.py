"""SentencePiece encoding with byte offsets, and decoding, from the model file's own tables.

A text is first normalised: at each place the longest key of the compiled character map (a double-array trie) that
matches is replaced by its value, white space is treated as the model says, and every normalised byte keeps the place
in the source that it came from. The normalised text is cut where no piece can reach across, each part is merged by the
pieces' ranks, and each piece is projected back to a span of source bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: the size of a double-array trie in bytes, the trie, then values that end in a zero byte."""

    def __init__(self, blob: bytes = b""):
        self.units, self.values = [], b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.values = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at this place."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node ^= _offset(units[0])
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.values[start : self.values.index(b"\0", start)]
        return found


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """A BPE model with its normaliser. cached: parts of texts whose encoding is kept in memory at most."""

    def __init__(self, data: bytes, cached: int = 400_000):
        self.pieces, self.scores, self.kinds = [], [], []
        self.unknown, self.byte_fallback, kind = 0, False, 1
        blob, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for key, value in _fields(data):
            if key == 1:
                piece, score, of = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        of = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(of)
            elif key == 2:
                for k, v in _fields(value):
                    if k == 3:
                        kind = v
                    elif k == 35:
                        self.byte_fallback = bool(v)
            elif key == 3:
                for k, v in _fields(value):
                    if k == 2:
                        blob = v
                    elif k == 3:
                        self.prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        if kind != 2:
            raise ValueError("the model isn't a BPE model")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.map = CharacterMap(blob)
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.size_of = [len(p.encode()) for p in self.pieces]
        self.score_of = {p: self.scores[i] for p, i in self.id_of.items()}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has a word start inside; parts of texts can't be encoded alone")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.byte_n = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_first = np.cumsum(self.byte_n) - self.byte_n
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.cached, self.parts = cached, Parts(self)

    # --- normalising -------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes and its end the source byte it comes from.

        A byte of a replacement comes from the start of what was replaced.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        data = text.encode("utf-8", "surrogatepass")
        if not self.map.units and not self.squeeze and self.escape and self.prefix:  # each byte stays, but that a space becomes three
            spaces = np.frombuffer(data, np.uint8) == 0x20
            return MARK + text.replace(" ", MARK), np.concatenate(([0, 0, 0], np.repeat(np.arange(len(data)), 1 + 2 * spaces), [len(data)]))
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            step, new = hit if hit else (_width(data[at]), data[at : at + _width(data[at])])
            parts.append((new, at))
            at += step
        end = len(data)
        if self.squeeze:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
        mark = MARK.encode() if self.escape else b" "
        out, source, spaced = bytearray(), [], self.squeeze
        if self.prefix and parts:
            out += mark
            source += [parts[0][1]] * len(mark)
            spaced = True if self.squeeze else spaced
        for new, place in parts:
            while self.squeeze and spaced and new[:1] == b" ":
                new = new[1:]
            if new:
                spaced = False
                for byte in new:
                    some = mark if byte == 0x20 else bytes([byte])
                    out += some
                    source += [place] * len(some)
                spaced = new[-1:] == b" " and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                end = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return out.decode("utf-8", "surrogatepass"), np.array([*source, end], np.int64)

    # --- merging -----------------------------------------------------------------------------------

    def merge(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of a part of a normalised text, and their lengths in its bytes: the neighbours of the highest score are
        joined, the leftmost first."""
        signs = self._merged_short(part) if len(part) <= 64 else self._merged_long(part)
        try:
            ids = [self.id_of[x] for x in signs]
            return ids, [self.size_of[i] for i in ids]
        except KeyError:
            pass
        ids, sizes = [], []
        for x in signs:
            data = x.encode("utf-8", "surrogatepass")
            i = self.id_of.get(x)
            if i is None and self.byte_fallback:
                ids += [self.byte_id[k] for k in data]
                sizes += [1] * len(data)
            else:
                ids.append(self.unknown if i is None else i)
                sizes.append(len(data))
        return ids, sizes

    def _merged_short(self, part: str) -> list[str]:
        """By a scan over all neighbours for each join."""
        signs, score, none = list(part), self.score_of.get, float("-inf")
        best = [score(part[i : i + 2], none) for i in range(len(part) - 1)]
        while best and (most := max(best)) > none:
            i = best.index(most)
            signs[i] += signs.pop(i + 1)
            del best[i]
            if i:
                best[i - 1] = score(signs[i - 1] + signs[i], none)
            if i < len(best):
                best[i] = score(signs[i] + signs[i + 1], none)
        return signs

    def _merged_long(self, part: str) -> list[str]:
        """By a queue of neighbours, for parts that a scan would make slow."""
        signs = list(part)
        after, before = list(range(1, len(signs) + 1)), list(range(-1, len(signs) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(signs):
                both = signs[a] + signs[b]
                if both in self.score_of:
                    heapq.heappush(queue, (-self.score_of[both], a, b, both))

        for k in range(len(signs) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if not signs[a] or not signs[b] or after[a] != b or signs[a] + signs[b] != both:
                continue
            signs[a], signs[b] = both, ""
            after[a] = after[b]
            if after[a] < len(signs):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in signs if x]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after the other: the number of ids of each text, the ids, and the source byte spans' starts and ends.

        A byte piece of a longer character has that byte's own span; a word start put before the text has an empty one.
        """
        if len(self.parts) > self.cached:
            self.parts = Parts(self)
        found: list[int] = []
        in_text, sources = [], []
        for text in texts:
            normal, source = self.normalise(text or "")
            parts = PARTS.findall(normal)
            found += map(self.parts.__getitem__, parts)
            in_text.append(len(parts))
            sources.append(source)
        of = np.array(found, np.int64)
        first, n, flat_ids, flat_sizes = self.parts.tables()
        tokens = n[of]
        ends = np.cumsum(tokens)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[of] - (ends - tokens), tokens)
        ids, sizes = flat_ids[at], flat_sizes[at].astype(np.int64)
        counts = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(in_text))).astype(np.int64)])
        stop = np.cumsum(sizes) + np.repeat(np.arange(len(texts)), counts)  # each text's places are one more than its bytes
        places = np.concatenate(sources) if sources else np.zeros(1, np.int64)
        return counts, ids, places[stop - sizes], places[stop]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[1:]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids: byte pieces joined to characters (a byte that is none becomes U+FFFD),
        word starts as spaces, the first one dropped."""
        n = self.byte_n[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.byte_first[ids] - (ends - n), n)
        data = self.flat_bytes[at].tobytes()
        stops = np.cumsum(counts)
        bounds = np.concatenate(([0], ends))
        texts = []
        for start, stop in zip(stops - counts, stops, strict=True):
            try:
                text = data[bounds[start] : bounds[stop]].decode()
            except UnicodeDecodeError:
                text = self._lenient(ids[start:stop].tolist())
            lead = next((i for i in ids[start:stop] if self.kinds[i] != CONTROL), None)
            texts.append(text[1:] if self.prefix and lead is not None and self.pieces[lead].startswith(MARK) else text)
        return pa.array(texts, pa.string())

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.decode_all(np.array(ids, np.int32), np.array([len(ids)]))[0].as_py()

    def _lenient(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.bytes_of[i]
            else:
                flush()
                out.append(self.bytes_of[i].decode())
        flush()
        return "".join(out)


class Parts(dict):
    """Part of a text -> its place in flat tables of ids and of the ids' lengths in normalised bytes; filled as parts come."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.first, self.n = model, array("q"), array("q")
        self.ids, self.sizes = array("i"), array("i")

    def __missing__(self, part: str) -> int:
        ids, sizes = self.model.merge(part)
        self[part] = place = len(self.n)
        self.first.append(len(self.ids))
        self.n.append(len(ids))
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        return place

    def tables(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, x.typecode) for x in (self.first, self.n, self.ids, self.sizes))


#: A word with its word starts, or word starts alone at the end: no piece has a word start after another sign.
PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_models: dict[str, PieceModel] = {}


def _model(name: str) -> PieceModel:
    """The model that the driver has sent with the job's files; one for each Python worker."""
    if name not in _models:
        with open(SparkFiles.get(name), "rb") as f:
            _models[name] = PieceModel(f.read())
    return _models[name]


def _sent(df: DataFrame, model_path: str) -> str:
    df.sparkSession.sparkContext.addFile(model_path)
    return model_path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """doc_id, ids, and starts and ends (source byte spans of each id) of every document's whole text.

    With digests, in place of the spans: covered_bytes, the bytes of the text that they cover, and spans_sha256, the
    SHA-256 in hex of all starts and ends in turn as 32-bit little-endian numbers.

    Null counts as empty, and has no ids. Repeated rows get equal results. An empty table gives no rows. Other columns
    are ignored.
    """
    name = _sent(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for batch in slices(batches, 128):
            counts, *flat = model.encode_all(batch.column(1).to_pylist())
            stops = np.concatenate(([0], np.cumsum(counts)))
            bounds = pa.array(stops.astype(np.int32))
            if digests:
                ids, starts, ends = flat
                covered = np.diff(np.concatenate(([0], np.cumsum(ends - starts)))[stops])
                spans = np.stack([starts, ends], axis=1).astype("<i4")
                found = [hashlib.sha256(spans[a:b]).hexdigest() for a, b in zip(stops, stops[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))), pa.array(covered), pa.array(found, pa.string())], names=["doc_id", "ids", "covered_bytes", "spans_sha256"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in flat)], names=["doc_id", "ids", "starts", "ends"])

    spans = "covered_bytes long, spans_sha256 string" if digests else "starts array<int>, ends array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, ids array<int>, {spans}")


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """encoded (doc_id, ids and the columns to keep) with the decoded text in column text. Null ids count as none."""
    name = _sent(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for batch in slices(batches, 128):
            ids = batch.column(1)
            counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, model.decode_all(ids.flatten().to_numpy(), counts)], names=[*batch.schema.names, "text"])

    rows = encoded.select("doc_id", "ids", *keep)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))
