"""Token packing by minimum bin slack over the histogram of remaining lengths.

Whole windows are cut off each document first; what remains is a length below the window size. Only the
histogram of these lengths matters for packing, and it has fewer entries than a window has tokens, however
many documents there are. A subset-sum over bit sets picks the multiset of lengths that fills a window
closest to its capacity; backtracking gives its counts, and the pattern repeats as often as the histogram
allows. Documents then take the slots of their length in the order of a distributed numbering.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from atlasweave.llm.frames import numbered, plain, saved

WINDOW = 1024
END = 0
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 300_000


class TokenBytes:
    """Ids of a byte-level BPE as little-endian unsigned 32-bit words, remembered word by word.

    The pre-tokenizer always starts a token at a blank that precedes another character than white
    space, so a text is the sum of its words there. Texts with white space after a blank, or with
    the text of a special token, go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(_BYTE[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split(" ")
        if any(not w or w[0].isspace() or w[0] in "\x1c\x1d\x1e\x1f" for w in words[1:]):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return b"".join([self._word(words[0]), *[known[w] for w in words[1:]]])
        except KeyError:
            for w in words[1:]:
                if w not in known:
                    known[w] = self._word(" " + w)
            return b"".join([self._word(words[0]), *[known[w] for w in words[1:]]])

    def _word(self, word: str) -> bytes:
        return np.array(self.fast.encode_ordinary(word), "<u4").tobytes()


#: The split of byte-level BPE vocabularies of this family.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Vocabulary files write printable bytes as themselves and the others as characters from 256 on, in order.
_BYTE = {chr(b): b for b in _PRINTED} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(row, id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and the end id, cut at every ``window``-th.

    A null text counts as empty and gives one piece with the end id. ``tokenizer`` is a path that every executor can
    open; ``row`` tells repeated rows apart.
    """
    source = plain(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    fields = "start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                take, start, length, crc, total, ids = [], [], [], [], [], []
                for k, text in enumerate(part.column(1)):
                    data = encode(text.as_py()) + END.to_bytes(4, "little")
                    n = len(data) // 4
                    for s in range(0, n, window):
                        piece = data[4 * s : 4 * (s + window)]
                        take.append(k), start.append(s), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] * with_ids)], ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {fields}")


_ENCODERS: dict[str, TokenBytes] = {}


def _encoder(path: str) -> TokenBytes:
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenBytes(path)
    return _ENCODERS[path]


def fullest(counts: dict[int, int], capacity: int, largest: int | None = None) -> dict[int, int]:
    """The multiset of available lengths (with ``largest`` in it, if given) whose sum is the greatest up to ``capacity``.

    Reachable sums are the bits of an integer; each length joins in binary portions of its count. Going back over
    the portions whose bit sets were kept yields how often each length is used.
    """
    need = largest or 0
    mask = (1 << (capacity - need + 1)) - 1
    sums, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == largest), (capacity - need) // length)
        portion = 1
        while left > 0:
            times = min(portion, left)
            steps.append((sums, length, times))
            sums = (sums | sums << length * times) & mask
            left, portion = left - times, portion * 2
        if sums >> (capacity - need) & 1:
            break
    at, used = sums.bit_length() - 1, defaultdict(int)
    if largest:
        used[largest] = 1
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            used[length] += times
    return dict(used)


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a window with their counts, repetitions)]: all of ``histogram`` in few, full windows.

    Each step packs the longest remaining length with the multiset that leaves least slack, and repeats that window
    until one of its lengths runs out. The steps are a few per distinct length, whatever the counts are.
    """
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        one = fullest(counts, window, max(counts))
        times = min(counts[length] // n for length, n in one.items())
        for length, n in one.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        out.append((one, times))
    return out


def pack(pieces: DataFrame, window: int = WINDOW, bucket_rows: int = 20_000) -> DataFrame:
    """``pieces`` (id, start, length, ...) with ``sequence_id`` and ``offset``; lengths are 1 to ``window``.

    The histogram of lengths, at most ``window`` rows, is all that the driver sees. Slots of a length are numbered
    over as many buckets as keep ``bucket_rows`` rows each, so a length that very many documents share is spread.
    """
    pieces = saved(pieces)
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    starts: dict[int, list[tuple]] = defaultdict(list)  # per length: first slot, slots per sequence, first sequence, offset
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for one, times in patterns(histogram, window):
        offset = 0
        for length in sorted(one, reverse=True):
            starts[length].append((taken[length], one[length], sequence, offset))
            taken[length] += one[length] * times
            offset += length * one[length]
        sequence += times
    firsts = {length: [x[0] for x in runs] for length, runs in starts.items()}
    out = numbered(pieces, "length", F.struct("id", "start", "ids_crc32"), "_slot", max(16, sum(histogram.values()) // bucket_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            slots, lengths = batch.column(names.index("_slot")).to_pylist(), batch.column(names.index("length")).to_pylist()
            where = []
            for slot, length in zip(slots, lengths, strict=True):
                first, per, seq, offset = starts[length][bisect_right(firsts[length], slot) - 1]
                where.append((seq + (slot - first) // per, offset + (slot - first) % per * length))
            keep = [i for i, n in enumerate(names) if n != "_slot"]
            columns = [batch.column(i) for i in keep] + [pa.array([w[k] for w in where], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*(names[i] for i in keep), "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return out.select(*pieces.columns, "_slot").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document with its place; every id lies in exactly one piece. See ``token_pieces`` and ``pack``.

    Null and empty texts are one piece with the end id; repeated rows are packed as often as they occur, and rows
    with a null id like any other. An empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, id_col, text_col, window, with_ids), window)
