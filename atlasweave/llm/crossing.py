"""Alignment of two tokenizers' tokens over the same bytes, and counts of the pairs they form.

Where tokens of both end at one byte, the text is cut. Cuts are found by divide and conquer: bisection locates the shared end
nearest behind the middle of an interval, and both halves are searched in turn; an interval without a shared end inside is a
group. All intervals of one depth, of all texts of a batch, take their bisections together. Tokens that share bytes are
linked. How many documents hold a pair of ids linked is counted over all of them.

Documents are read once, in chunks of bounded size. A chunk keeps its distinct pairs in a dictionary and each document as numbers of
that dictionary, so what is shuffled for the counts is dictionaries, and the counts come back to a chunk
by its own dictionary, not by a table of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atlasweave.llm.frames import plain, saved
from atlasweave.llm.packing import _BYTE, PRETOKENS

MARK = "▁"
#: Characters of texts that are aligned together, unless one text has more.
BATCH_CHARACTERS = 300_000
#: A chunk ends with the batch that brings it to so many pairs of documents and ids.
CHUNK_ENTRIES = 2_000_000


def shared_cuts(one: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The positions of both ascending arrays of ends that lie inside one of the intervals (low, high), in order.

    An interval is held as the ends of both that lie inside, [a, a_to) and [b, b_to).
    """
    found = []
    a, a_to, b, b_to = np.searchsorted(one, low, "right"), np.searchsorted(one, high), np.searchsorted(other, low, "right"), np.searchsorted(other, high)
    while len(a):
        inside = (a < a_to) & (b < b_to)
        a, a_to, b, b_to = a[inside], a_to[inside], b[inside], b_to[inside]
        middle = (a + a_to) // 2
        middle_b = np.searchsorted(other, one[middle])
        # from the middle on, bisections leap from array to array until both have the same end
        cut, cut_b, open_ = middle.copy(), middle_b.copy(), np.arange(len(a))
        shared = np.zeros(len(a), bool)
        while len(open_):
            open_ = open_[cut_b[open_] < b_to[open_]]
            there = other[cut_b[open_]]
            cut[open_] = back = np.searchsorted(one, there)
            same = one[back] == there
            shared[open_[same]] = True
            open_ = open_[~same & (back < a_to[open_])]
            cut_b[open_] = np.searchsorted(other, one[cut[open_]])
        found.append(one[cut[shared]])
        # nothing shared lies between the middle and the cut: what is left stands before the one or behind the other
        a, a_to, b, b_to = (np.concatenate(x) for x in ((a, cut[shared] + 1), (middle, a_to[shared]), (b, cut_b[shared] + 1), (middle_b, b_to[shared])))
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass
class Aligned:
    """Counts and digests of the texts of a batch, and the distinct pairs of each: (text, pair, times), by text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers: a byte-level BPE of the tokenizers library and a sentencepiece model.

    The first one's ids come from the tiktoken form of its vocabulary, which is faster; the two libraries take the same
    characters for letters, digits and white space.
    """

    def __init__(self, first: str, second: str):
        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        a_bytes = {i: p.encode() if p in special else bytes(_BYTE[c] for c in p) for p, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(self.b.vocab_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        # each id as text twice: followed by another of its side, and as the last of its side
        self.names = [f"{i}{end}" for end in ",|" for i in range(len(self.a_bytes))] + [f"{i}{end}" for end in ",;" for i in range(len(self.b_bytes))]
        self.fast = tiktoken.Encoding("byte-level", pat_str=PRETOKENS, mergeable_ranks={t: i for i, t in a_bytes.items() if t.decode("utf-8", "replace") not in special}, special_tokens={})

    def align(self, texts: list[str]) -> Aligned:
        """The alignment of each text; no tokens for an empty one and for one whose tokens' bytes are not blank + text."""
        a, b = [self.fast.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1)
        for k, text in enumerate(texts):
            if not b"".join([self.a_bytes[i] for i in a[k]]) == b"".join([self.b_bytes[i] for i in b[k]]) == (b" " + text.encode() if text else b""):
                a[k] = b[k] = []
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in ((a, n_a), (b, n_b)))
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        # the texts stand one behind the other: each ends where the last token of both sides does
        ends = np.concatenate([[0], a_ends])[np.cumsum(n_a)]
        filled = n_a > 0
        starts = np.concatenate([[0], ends[:-1]])
        cuts = np.sort(np.concatenate([shared_cuts(a_ends, b_ends, starts[filled], ends[filled]), ends[filled]]))
        a_to, b_to = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        n_groups = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)
        digests = self._digests(a_ids, b_ids, a_to, b_to, n_a, n_b)
        # every stretch between ends of either side is one token of each, and no other stretch is these two
        stretches = _united(a_ends, b_ends)
        links = a_ids[np.searchsorted(a_ends, stretches)] << _SHIFT | b_ids[np.searchsorted(b_ends, stretches)]
        text = np.searchsorted(ends, stretches)
        order = np.lexsort((links, text))
        text, links = text[order], links[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (links[1:] != links[:-1])])) if len(links) else np.empty(0, np.int64)
        return Aligned(n_a, n_b, n_groups, np.bincount(text, minlength=len(texts)), digests, text[new], links[new], np.diff(new, append=len(links)))

    def _digests(self, a_ids: np.ndarray, b_ids: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """The SHA-256 of each text's groups, which end before the tokens ``a_to`` and ``b_to``; '' for a text without tokens."""
        a_from, b_from = (np.concatenate([[0], to[:-1]]) for to in (a_to, b_to))
        a_last, b_last = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_last[a_to - 1] = b_last[b_to - 1] = 1
        names, words = np.empty(len(a_ids) + len(b_ids), np.int64), len(self.a_bytes)
        names[np.arange(len(a_ids)) + np.repeat(b_from, a_to - a_from)] = a_ids + a_last * words
        names[np.arange(len(b_ids)) + np.repeat(a_to, b_to - b_from)] = b_ids + b_last * len(self.b_bytes) + 2 * words
        out, at, name = [], 0, self.names.__getitem__
        for n in (n_a + n_b).tolist():
            listed = "".join(map(name, names[at : at + n].tolist()))[:-1]
            out.append(hashlib.sha256(listed.encode()).hexdigest() if n else "")
            at += n
        return out


def _united(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([one, other]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


_SHIFT = 32
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers binary, times binary, number int, a int, b int, docs long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def chunked_links(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """The alignment of every document, in chunks. Rows with a null ``number`` are documents: their counts, and the pairs of ids they
    hold (``numbers``) with how often (``times``). The others name the pair (a, b) of a number and the documents of the chunk that hold it."""
    source = plain(docs, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    names, kinds = zip(*(field.split() for field in _FIELDS.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task, n, held, entries = _aligner(first, second), TaskContext.get().partitionId(), 0, [], 0

        def record(ids: pa.Array, **columns) -> pa.RecordBatch:
            size = len(ids)
            arrays = [pa.array(columns[c], _ARROW[k]) if c in columns else pa.nulls(size, _ARROW[k]) for c, k in zip(names, kinds)]
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"] * size, pa.string()), ids, *arrays], ["chunk", "id", *names])

        def chunk() -> Iterator[pa.RecordBatch]:
            pairs, numbers = np.unique(np.concatenate([one.pair for _, one in held]), return_inverse=True)
            at = 0
            for ids, one in held:
                begins = np.searchsorted(one.text, np.arange(len(ids) + 1)).tolist()
                own, times = numbers[at : at + len(one.pair)].astype("<i4"), one.times.astype("<i4")
                at += len(one.pair)
                cut = lambda values: [values[x:y].tobytes() for x, y in zip(begins, begins[1:])]
                yield record(ids, n_a=one.n_a, n_b=one.n_b, n_groups=one.n_groups, n_links=one.n_links, groups_sha256=one.digests, numbers=cut(own), times=cut(times))
            none = pa.nulls(len(pairs), held[0][0].type)
            yield record(none, number=np.arange(len(pairs)), a=pairs >> _SHIFT, b=pairs & (1 << _SHIFT) - 1, docs=np.bincount(numbers, minlength=len(pairs)))

        for batch in batches:
            texts, start = [t.as_py() or "" for t in batch.column(1)], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BATCH_CHARACTERS):
                    size, stop = size + len(texts[stop]), stop + 1
                held.append((batch.column(0).slice(start, stop - start), aligner.align(texts[start:stop])))
                entries, start = entries + len(held[-1][1].pair), stop
                if entries >= chunk_entries:
                    yield from chunk()
                    n, held, entries = n + 1, [], 0
        if held:
            yield from chunk()

    return source.mapInArrow(run, f"chunk string, id {id_type}, {_FIELDS}")


def align_tokenizers(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", **chunks: int) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    ``first`` is a byte-level BPE of the tokenizers library and encodes a blank and the text; ``second`` is a sentencepiece model
    with byte fallback and encodes the text, before which it puts a blank itself. Both are paths that every executor can open.
    Null and empty texts, and texts whose pieces are not the bytes of the text, have zeros and an empty digest.
    ``n_best`` counts the links whose pair no other pair of the same first id exceeds in documents, ``count_sum`` adds the
    documents of the pairs over all links. Repeated rows and rows with a null id count as documents of their own. An empty table gives no rows.
    """
    links = saved(chunked_links(docs, first, second, id_col, text_col, **chunks))
    numbered = links.where("number is not null").select("chunk", "number", "a", "b", "docs")
    counted = numbered.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # a window holds the pairs of one first id, no more than the second vocabulary has ids
    counted = counted.select("a", "b", "count", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).alias("best"))
    looked_up = numbered.join(counted, ["a", "b"]).select(F.col("chunk").alias("of"), "number", "count", "best")
    documents = links.where("number is null").drop("number", "a", "b", "docs")
    out = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def judge(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        number = pairs.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        n_best, sums = [], []
        for numbers, times in zip(docs.column("numbers"), docs.column("times")):
            k, t = np.frombuffer(numbers.as_py(), "<i4"), np.frombuffer(times.as_py(), "<i4").astype(np.int64)
            n_best.append(int(t[best[k]].sum())), sums.append(int((t * count[k]).sum()))
        table = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
        return table.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))

    return documents.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(judge, f"id {links.schema['id'].dataType.simpleString()}, {out}")
