"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by the longest prefixes of the model's compiled character map; every normalised character
records the bytes it comes from, so each piece is a span of the original text. BPE merges never cross
into a new word in models whose pieces have the word mark only in front, so words are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from atlasweave.llm.frames import plain

MARK = "▁"
#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000
_NEVER = float("-inf")


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose values point to replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest prefix of ``data[at:]`` in the map."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with plain pieces are supported")
        self.spec, self.map = model.normalizer_spec, CharacterMap(model.normalizer_spec.precompiled_charsmap)
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.fallback = model.trainer_spec.byte_fallback
        self.surface = model.trainer_spec.unk_surface
        # words are independent if no piece has the mark behind another character
        self.by_word = self.spec.escape_whitespaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.direct = self.by_word and self.fallback and not self.map.units and self.spec.add_dummy_prefix and not self.spec.remove_extra_whitespaces
        # characters that stand side by side in no piece never merge, nor does what lies on their two sides
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.runs: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.names = [str(i) for i in range(len(self.pieces))]
        self.surfaces = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else (self.surface if i == self.unknown else p.replace(MARK, " ")).encode() for i, p in enumerate(self.pieces)]

    def normalize(self, text: str, begins: bool = True) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters and its end, the byte of the original where it begins.

        A text that does not begin here gets no dummy prefix.
        """
        extra, space = self.spec.remove_extra_whitespaces, MARK if self.spec.escape_whitespaces else " "
        if not self.map.units and not extra:  # the longest prefix in an empty map is always the character itself
            source = list(range(len(text) + 1)) if text.isascii() else list(accumulate([len(c.encode()) for c in text], initial=0))
            dummy = bool(text) and begins and self.spec.add_dummy_prefix
            return space * dummy + text.replace(" ", space), [0] * dummy + source
        data, at, out, source = text.encode(), 0, [], []
        read = []
        while at < len(data):
            used, new = self.map.longest(data, at) or (0, b"")
            if not used:
                used = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + used]
            read.append((at, new.decode(errors="replace")))
            at += used
        if extra:
            while read and read[0][1] == " ":
                read.pop(0)
        if read and begins and self.spec.add_dummy_prefix:
            out.append(space), source.append(read[0][0])
        before = extra
        for start, new in read:
            if before and extra:
                new = new.lstrip(" ")
            for c in new:
                out.append(space if c == " " else c), source.append(start)
            before = new.endswith(" ") if new else before
        if extra:
            while out and out[-1] == space:
                at = source[-1]
                out.pop(), source.pop()
        return "".join(out), [*source, at]

    def merge(self, word: str) -> list[str]:
        """BPE: the adjacent pair with the best score merges first, the leftmost of equals."""
        parts, score = list(word), self.scores.get
        if len(parts) > 40:
            return self._merge_long(parts)
        ranked = [score(a + b, _NEVER) for a, b in pairwise(parts)]
        while ranked and (best := max(ranked)) > _NEVER:
            at = ranked.index(best)
            parts[at : at + 2] = [both := parts[at] + parts[at + 1]]
            del ranked[at]
            if at:
                ranked[at - 1] = score(parts[at - 1] + both, _NEVER)
            if at < len(ranked):
                ranked[at] = score(both + parts[at + 1], _NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        scores, n = self.scores, len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[c], i, c) for i in range(n - 1) if (c := parts[i] + parts[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if parts[i] else n
            if j >= n or not parts[i] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], right[i] = both, "", right[j]
            if right[j] < n:
                left[right[j]] = i
                if (c := both + parts[right[j]]) in scores:
                    heapq.heappush(heap, (-scores[c], i, c))
            if left[i] >= 0 and (c := parts[left[i]] + both) in scores:
                heapq.heappush(heap, (-scores[c], left[i], c))
        return [p for p in parts if p]

    def word_ids(self, word: str) -> list[int]:
        out, unknown = [], False
        for part in self.merge(word):
            i = self.ids.get(part)
            if i is None and self.fallback:
                out += [self.bytes[b] for b in part.encode()]
            elif i is not None or not unknown:  # neighbouring unknown characters are one piece
                out.append(self.unknown if i is None else i)
            unknown = i is None and not self.fallback
        return out

    def _runs(self, word: str) -> list[str]:
        """``word`` cut wherever two neighbours can't merge."""
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                out.append(word[start:i])
                start = i
        return [*out, word[start:]]

    def _word_spans(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The ids of a word that begins with its mark, and how many source bytes each piece covers."""
        ids, widths, runs = [], [], self.runs
        if len(runs) > REMEMBERED:
            runs.clear()
        for run in self._runs(word):
            if (one := runs.get(run)) is None:
                one = runs[run] = self._run_spans(run)
            ids += one[0]
            widths += one[1]
        return tuple(ids), tuple(widths)

    def _run_spans(self, run: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        normal, source = self.normalize(run.replace(MARK, " "), begins=False)
        ids, widths, at, known = [], [], 0, self.ids.get
        for part in self.merge(normal):
            end = at + len(part)
            i, width = known(part), source[end] - source[at]
            if i is not None:
                ids.append(i), widths.append(width)
            else:  # a character of no piece: its bytes
                ids += [self.bytes[b] for b in part.encode()]
                widths += [1] * width
            at = end
        return tuple(ids), tuple(widths)

    def _words(self, normal: str) -> list[str]:
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", normal) if self.by_word else [normal] * bool(normal)

    def encode(self, text: str) -> list[int]:
        return [i for word in self._words(self.normalize(text)[0]) for i in self.word_ids(word)]

    def _project(self, normal: str, source: list[int]) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece of a normalised text, in bytes of its source."""
        out, at = [], 0
        for word in self._words(normal):
            for part in self.merge(word):
                begin, end, i = source[at], source[at + len(part)], self.ids.get(part)
                at += len(part)
                if i is None and self.fallback:
                    data = part.encode()
                    exact = end - begin == len(data)
                    out += [(self.bytes[b], begin + k if exact else begin, begin + k + 1 if exact else end) for k, b in enumerate(data)]
                elif i is None and out and out[-1][0] == self.unknown and out[-1][2] == begin:
                    out[-1] = (self.unknown, out[-1][1], end)
                else:
                    out.append((self.unknown if i is None else i, begin, end))
        return out

    def spans(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(ids, begins, ends) of the pieces, in bytes of the original text; a byte piece is one byte of its character.

        Where no rule of the character map can reach across a blank, words are normalised, merged and projected one by one, and
        those that come again are remembered with the widths of their pieces; a text's spans are the sums of these widths.
        """
        if not text or not self.direct or MARK in text:
            found = self._project(*self.normalize(text))
            return tuple(map(list, zip(*found))) if found else ([], [], [])
        words = text.split(" ")
        words = words if "" not in words else [w[1:] for w in self._words(MARK + text.replace(" ", MARK))]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            pairs = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word_spans(MARK + w)
            pairs = [known[w] for w in words]
        ids = list(chain.from_iterable([p[0] for p in pairs]))
        # the blank before the first word is no byte of the text
        ends = list(accumulate(chain.from_iterable([p[1] for p in pairs]), initial=-1))
        return ids, [0, *ends[1:-1]], ends[1:]

    def _decoded(self, ids: list[int]) -> str:
        """Text of the pieces, the mark that a beginning of a text loses still in front."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i >= 0 and i not in self.control:
                out.append(self.surface if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.control), None)
        drop = first is not None and self.pieces[first].startswith(MARK) and (self.spec.add_dummy_prefix or self.spec.remove_extra_whitespaces)
        try:
            text = b"".join(map(self.surfaces.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # byte pieces that are no characters
            text = self._decoded(ids)
        return text[1:] if drop else text


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that is no part of a character is one replacement character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as error:
            out += [data[: error.start].decode(), "\ufffd"]
            data = data[error.start + 1 :]
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends): the pieces of each whole text with their spans in its UTF-8 bytes.

    Null and empty texts have no pieces; repeated rows stay. ``model`` is a path that every executor can open.
    """
    source = plain(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, kind = _model(model), pa.list_(pa.int32())
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                found = [pieces.spans(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([spans[k] for spans in found], kind) for k in range(3))], ["id", "ids", "begins", "ends"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts of id lists; null lists count as empty."""
    source = plain(encoded, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            texts = [pieces.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, covered): the pieces that ``encode_texts`` finds and the text that their ids decode to, as
    digests, and the number of source bytes that the spans cover without gap or overlap; nulls as in ``encode_texts``."""
    source = plain(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        name = pieces.names.__getitem__
        for batch in batches:
            counts, listed, texts, covered = [], [], [], []
            for text in batch.column(1):
                ids, begins, ends = pieces.spans(text.as_py())
                counts.append(len(ids)), listed.append(sha(",".join(map(name, ids)))), texts.append(sha(pieces.decode(ids)))
                covered.append(ends[-1] if ids and begins[0] == 0 and begins[1:] == ends[:-1] else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(texts, pa.string()), pa.array(covered, pa.int64())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "covered"],
            )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered long")
