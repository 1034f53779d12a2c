"""Byte-level BPE by dynamic programming over byte prefixes.

The encoding of a prefix never changes when bytes follow, except for its last token. So one number tells all about a
prefix: the last token of its encoding. It is the only token ending there that *fits* the last token of the prefix
before it, that is, no merge across their border comes before both are complete. An Aho-Corasick automaton
over the vocabulary names the tokens ending at each byte; following the last tokens backwards gives the ids. A text may
grow at no cost for what stands there already, and after an edit only the bytes around it are computed again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm.frames import plain

#: Texts between blanks, and matches of the pattern, that a worker remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48
#: Characters behind a match that the pattern may look at before it decides for this match.
LOOKAHEAD = 4
_NEVER = 1 << 40
_SHIFT = 32
_BLANK = re.compile(r" (?=\S)")


class ByteVocabulary:
    """Tokens by rank, which pairs fit, and the split of a text into matches that are encoded separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.longest = max(self.lengths.values())
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        single = {bytes([b]): b for b in range(256)}
        self._classes = [(tiktoken.Encoding(c, pat_str=c, mergeable_ranks=single, special_tokens={}), regex.compile(c)) for c in (r"\p{L}", r"\p{N}")]
        self._same: set[str] = set()
        self._odd: dict[str, str] = {}
        self._borders: dict[int, tuple[list, list] | None] = {}
        self._fits: dict[int, bool] = {}
        self._units: dict[str, tuple[int, ...]] = {}
        self._matches: dict[str, tuple[int, ...]] = {}

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """Where the matches from ``start`` on begin and end.

        Letters and digits count as in the Unicode version of the tiktoken library, which knows fewer than ``regex``.
        """
        if not self._agree(text):
            text = "".join([self._odd.get(c, c) for c in text])
        return (m.span() for m in self.pattern.finditer(text, start))

    def _agree(self, text: str) -> bool:
        """Whether ``regex`` sees every character of the text as the tiktoken library does; the others get a stand-in of their class."""
        if text.isascii() or self._same.issuperset(text):
            return True
        for c in set(text) - self._same - self._odd.keys():
            if all(bool(ours.encode_ordinary(c)) == bool(r.match(c)) for ours, r in self._classes):
                self._same.add(c)
            else:
                self._odd[c] = next((s for (ours, _), s in zip(self._classes, "a0") if ours.encode_ordinary(c)), "§")
        return self._same.issuperset(text)

    def borders(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """The parts that stand at the left and the right end while the token merges, each with the rank of the merge that
        takes it up; None for a token that its own bytes do not merge into."""
        if token in self._borders:
            return self._borders[token]
        ranks, parts = self.ranks, [bytes([b]) for b in self.tokens[token]]
        left, right, time = [], [], -1
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
            if rank == _NEVER:
                break
            time = max(time, rank)
            if at == 0:
                left.append((ranks[parts[0]], time))
            if at == len(parts) - 2:
                right.append((ranks[parts[-1]], time))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = ([*left, (token, _NEVER)], [*right, (token, _NEVER)]) if len(parts) == 1 else None
        self._borders[token] = found
        return found

    def fits(self, first: int, second: int) -> bool:
        """Whether the encoding of the bytes of both tokens is just these two."""
        pair = first << _SHIFT | second
        if pair not in self._fits:
            self._fits[pair] = self._compare(first, second)
        return self._fits[pair]

    def _compare(self, first: int, second: int) -> bool:
        one, other, tokens, ranks = self.borders(first), self.borders(second), self.tokens, self.ranks
        if one is None or other is None:
            return False
        a, b, i, j = one[1], other[0], 0, 0
        while True:
            (x, x_taken), (y, y_taken) = a[i], b[j]
            across = ranks.get(tokens[x] + tokens[y], _NEVER)
            if across < x_taken and across <= y_taken and across < _NEVER:  # of equal merges the left one comes first
                return False
            if x_taken == y_taken == _NEVER:
                return True
            i, j = (i + 1, j) if x_taken <= y_taken else (i, j + 1)

    def _table(self, data: bytes) -> list[int]:
        """``last_tokens`` of new bytes, in which most tokens and pairs have been seen before."""
        last, fits, known = [-1] * (len(data) + 1), self._fits, self._fits.get
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1
            if last[at] >= 0:
                continue
            if length == at:
                if self.borders(token) is not None:
                    last[at] = token
            elif (before := last[at - length]) >= 0:
                pair = before << _SHIFT | token
                if (fit := known(pair)) is None:
                    fit = fits[pair] = self._compare(before, token)
                if fit:
                    last[at] = token
        if len(fits) > 4 * REMEMBERED:
            fits.clear()
        return last

    def last_tokens(self, data: bytes, known: list[int] | None = None, tail: tuple[list[int], int] | None = None) -> tuple[list[int], int]:
        """(last token of each prefix of ``data``, number of prefixes computed).

        ``known`` holds those of a prefix, itself included from 0 on. ``tail`` is (those of an older version, how many bytes at the
        end both share): as soon as the last ``longest`` prefixes agree with it, the rest must agree too and is taken over.
        """
        last = list(known or [-1])
        start, n = len(last), len(data) + 1
        last += [-1] * (n - start)
        old, shared = tail or ([], 0)
        shift, agree, done, fits, at = len(old) - n, 0, 0, self.fits, start
        text = data.decode("latin-1")
        found = self.automaton.iter(text, max(0, start - self.longest)) if start < n else ()
        for end, (token, length) in found:
            if end + 1 < start:
                continue
            if end + 1 != at:  # all tokens that end at ``at`` are seen
                agree = agree + 1 if at > n - 1 - shared and last[at] == old[at + shift] else 0
                at, done = end + 1, done + 1
                if agree >= self.longest:
                    last[at:] = old[at + shift :]
                    return last, done
            if last[at] < 0 and (self.borders(token) is not None if length == at else last[at - length] >= 0 and fits(last[at - length], token)):
                last[at] = token
        return last, done + (start < n)

    def follow(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens holds."""
        out, at, lengths = [], len(last) - 1, self.lengths
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        return out[::-1]

    def match_ids(self, match: str) -> tuple[int, ...]:
        """The ids of one match; a match that is a token is that token."""
        ids = self._matches.get(match)
        if ids is None:
            data = match.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.follow(self._table(data)))
            if len(match) <= LONGEST_REMEMBERED:
                if len(self._matches) > REMEMBERED:
                    self._matches.clear()
                self._matches[match] = ids
        return ids

    def _unit(self, unit: str) -> tuple[int, ...]:
        matches = self.pattern.findall(unit) if self._agree(unit) else [unit[a:b] for a, b in self.spans(unit)]
        return self.match_ids(unit) if len(matches) == 1 else tuple(chain.from_iterable(map(self.match_ids, matches)))

    def encode(self, text: str) -> list[int]:
        """The ids of a text. A match starts at every blank before another character than white space, so the stretches
        between such blanks are encoded one by one, and those that come again are remembered."""
        units = text.split(" ")
        if any(not u or u[0].isspace() for u in units[1:]):
            units = _BLANK.split(text)
        known, rest = self._units, units[1:]
        if len(known) > REMEMBERED:
            known.clear()
        try:
            ids = [known[u] for u in rest]
        except KeyError:
            ids = []
            for u in rest:
                if (one := known.get(u)) is None:
                    one = self._unit(" " + u)
                    if len(u) <= LONGEST_REMEMBERED:
                        known[u] = one
                ids.append(one)
        return list(chain(self._unit(units[0]), chain.from_iterable(ids)))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))


class GrowingText:
    """A text with its matches and their tables, kept right through appends and edits."""

    def __init__(self, vocabulary: ByteVocabulary, text: str = ""):
        self.vocabulary, self.text, self.starts, self.tables = vocabulary, "", [], []
        #: Prefixes computed by the last change.
        self.computed = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of the code points from ``start`` to ``stop``, both cut to the text."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        before, old_starts, old_tables = self.text, self.starts, self.tables
        self.text = text = before[:start] + new + before[stop:]
        shift, ends, self.computed = len(text) - len(before), [*old_starts[1:], len(before)], 0
        kept = bisect_left(ends, start - LOOKAHEAD + 1)  # these matches saw nothing that has changed
        at = old_starts[kept] if kept < len(old_starts) else (ends[kept - 1] if kept else 0)
        starts, tables, old = old_starts[:kept], old_tables[:kept], kept
        for a, b in self.vocabulary.spans(text, at):
            if a >= start + len(new):
                k = bisect_left(old_starts, a - shift)
                if k < len(old_starts) and old_starts[k] == a - shift:  # from here on the text is cut as before
                    starts, tables = starts + [s + shift for s in old_starts[k:]], tables + old_tables[k:]
                    break
            data = text[a:b].encode()
            known, tail = None, None
            if old < len(old_starts):  # an older match in this place may share its beginning and its end
                was = before[old_starts[old] : ends[old]].encode()
                begin = _common(was, data)
                tail = (old_tables[old], min(_common(was[::-1], data[::-1]), len(data) - begin, len(was) - begin))
                known, old = old_tables[old][: begin + 1], old + 1
            table, done = self.vocabulary.last_tokens(data, known, tail)
            self.computed += done
            starts.append(a), tables.append(table)
        self.starts, self.tables = starts, tables

    def ids(self) -> list[int]:
        out = []
        for start, end, table in zip(self.starts, [*self.starts[1:], len(self.text)], self.tables):
            whole = self.vocabulary.ranks.get(self.text[start:end].encode()) if end - start <= self.vocabulary.longest else None
            out += [whole] if whole is not None else self.vocabulary.follow(table)
        return out


def _common(one: bytes, other: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(one), len(other))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == other[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


_VOCABULARIES: dict[tuple[str, str], ByteVocabulary] = {}


def _vocabulary(path: str, pattern: str) -> ByteVocabulary:
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = ByteVocabulary(path, pattern)
    return _VOCABULARIES[path, pattern]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text; null and empty texts have none, repeated rows stay.

    ``ranks`` is a path that every executor can open; ``pattern`` cuts texts into matches.
    """
    source = plain(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vocabulary.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], ["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes of id lists, which need not be text; null lists count as empty."""
    source = plain(encoded, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocabulary.decode(ids.as_py() or []) for ids in batch.column(1)], pa.binary())], ["id", "bytes"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, bytes binary")


def encode_versions(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, version, ids, computed): the ids of a text (version 0) and after each of its edits, in their order.

    ``edits_col`` is an array of (start, stop, text): ``text`` takes the place of these code points of the version before; positions
    outside are cut to the text, null positions mean its end, a null text means an empty one. ``computed`` counts the byte
    prefixes that were computed for this version. A null text counts as empty, a null array as no edit.
    """
    source = plain(docs, id=id_col, text=text_col, edits=edits_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                text = GrowingText(vocabulary, batch.column(1)[k].as_py() or "")
                rows = [(0, text.ids(), text.computed)]
                for edit in batch.column(2)[k].as_py() or []:
                    start, stop, new = (edit or {"start": None, "stop": None, "text": None}).values()
                    end = len(text.text)
                    text.replace(end if start is None else start, end if stop is None else stop, new or "")
                    rows.append((len(rows), text.ids(), text.computed))
                number, ids, computed = zip(*rows)
                same = pa.array([batch.column(0)[k].as_py()] * len(rows), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([same, pa.array(number, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(computed, pa.int64())], ["id", "version", "ids", "computed"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, version int, ids array<int>, computed long")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids of a text and the bytes they decode to, as digests; nulls as in ``encode_texts``."""
    source = plain(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        name = vocabulary.names.__getitem__
        for batch in batches:
            counts, listed, decoded = [], [], []
            for text in batch.column(1):
                ids = vocabulary.encode(text.as_py())
                counts.append(len(ids))
                listed.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
