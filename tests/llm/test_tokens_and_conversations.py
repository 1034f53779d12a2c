"""Prefix encoding, conversation repair and token alignment against the libraries and against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from atlasweave.llm import conversations, crossing, prefixes

RANKS, JSON, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABETS = ["ab aabbab'sll re  \n\n\t\x1c\x85", "éèüß漢字かな😀՘\U0003fc3ff ", "0123456789 .,;!?-_=\0", "thequickbrownfoxjumps "]
SCHEMA = "doc_id long, text string, ids string, id string, chunk string, a long, number int"


def text(rng, longest, alphabets=ALPHABETS):
    return "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, longest)))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    texts = [text(rng, 60, [*ALPHABETS, "▁ a"]) for _ in range(200)] + [None, "", " ", " lead", "trail ", "\n", "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 5000, "word " * 20_000, "hello hello", "hello hello"]
    rows = [(n, t, "i", "j", "c", 1, 2) for n, t in enumerate(texts)] + [(None, "hello there", "i", "j", "c", 1, 2), (3, texts[3], "i", "j", "c", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return prefixes.ByteVocabulary(RANKS, public_tokenizers.PATTERN)


# --- prefixes


def test_pairs_fit_as_merging_says(vocabulary):
    def merge(data):
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            rank, k = min((vocabulary.ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [vocabulary.ranks[p] for p in parts]

    rng, both = random.Random(1), Counter()
    for _ in range(6000):
        a, b = rng.randrange(2000), rng.randrange(2000)
        expected = merge(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b]
        assert vocabulary.fits(a, b) == expected
        both[expected] += 1
    assert min(both.values()) > 50


def test_prefix_encoding_equals_the_library(vocabulary, library):
    rng = random.Random(3)
    for _ in range(3000):
        one = text(rng, 40)
        assert vocabulary.encode(one) == library.encode_ordinary(one)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    ids = vocabulary.encode(long)
    assert ids == library.encode_ordinary(long) and vocabulary.decode(ids).decode() == long


def test_each_prefix_has_one_valid_last_token(vocabulary):
    data = b"unbelievable reindeer"
    last, _ = vocabulary.last_tokens(data)
    for end in range(1, len(data) + 1):
        fitting = [t for t, token in vocabulary.tokens.items() if data[:end].endswith(token) and (len(token) == end or vocabulary.fits(last[end - len(token)], t))]
        assert fitting == [last[end]]


def test_edits_equal_encoding_anew_and_stay_near(vocabulary, library):
    rng = random.Random(4)
    for _ in range(400):
        growing = prefixes.GrowingText(vocabulary, text(rng, 60))
        for _ in range(4):
            a = rng.randint(0, len(growing.text))
            b, new = rng.randint(a, min(len(growing.text), a + 6)), text(rng, 6)
            expected = growing.text[:a] + new + growing.text[b:]
            growing.replace(a, b, new)
            assert growing.text == expected and growing.ids() == library.encode_ordinary(expected)
    growing = prefixes.GrowingText(vocabulary, "abcdefg" * 5000)
    growing.replace(10_000, 10_003, "xyzzy")
    assert growing.computed < 500 and growing.ids() == library.encode_ordinary(growing.text)
    growing.append("hi")
    assert growing.computed < 5 and growing.ids() == library.encode_ordinary(growing.text)


def test_encode_decode_and_versions(spark, docs, library):
    source = Counter((r.doc_id, r.text or "") for r in docs.collect())
    got = prefixes.encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.id, tuple(r.ids)) for r in got) == Counter({(i, tuple(library.encode_ordinary(t))): n for (i, t), n in source.items()})
    frame = spark.createDataFrame([(1, [464, 3290]), (2, []), (3, None)], "id long, ids array<int>")
    decoded = {r.id: bytes(r.bytes) for r in prefixes.decode_ids(frame, RANKS, public_tokenizers.PATTERN).collect()}
    assert decoded == {1: library.decode_bytes([464, 3290]), 2: b"", 3: b""}
    for r in prefixes.round_trip(docs.where("doc_id > 190"), RANKS, public_tokenizers.PATTERN).collect():
        one = next(t for i, t in source if i == r.id)
        ids = library.encode_ordinary(one)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(one.encode()).hexdigest())
    edits = spark.createDataFrame([(1, "one two", [(4, 7, "three"), (None, None, " four"), (99, 3, None), None]), (2, None, None)], "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    versions = {(r.id, r.version): list(r.ids) for r in prefixes.encode_versions(edits, RANKS, public_tokenizers.PATTERN).collect()}
    steps = ["one two", "one three", "one three four", "one three four", "one three four"]
    assert versions == {(1, n): library.encode_ordinary(t) for n, t in enumerate(steps)} | {(2, 0): []}
    assert prefixes.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


# --- conversations

FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit) of all edit sequences of (role, fault) rows, least first; the roles that come out, with their rows."""

    def options(i, state, inserted):
        best = None

        def offer(cost, letter, rest):
            nonlocal best
            if rest is not None and (best is None or (cost + rest[0], letter + rest[1]) < best):
                best = (cost + rest[0], letter + rest[1])

        if i == len(rows) and state in ("", "a"):
            best = (0, "")
        if inserted < 3:
            offer(5, "I", found(i, FOLLOWS[state], inserted + 1))
        if i < len(rows):
            (role, fault), follows = rows[i], FOLLOWS[state]
            offer(2, "D", found(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] == follows or (role[:1] == "s" and state == ""):
                    offer(extra, "K", found(i + 1, role[:1], 0))
                offer(1 + extra, "R", found(i + 1, follows, 0))
        return best

    found = lru_cache(None)(options)
    for i in range(len(rows), -1, -1):
        for state in FOLLOWS:
            found(i, state, 0)
    cost, audit = found(0, "", 0)
    state, row, out = "", 0, []
    for letter in audit:
        if letter in "IR":
            state = FOLLOWS[state]
            out.append((NAMES[state], row if letter == "R" else None))
        elif letter == "K":
            state = rows[row][0][:1]
            out.append((rows[row][0], row))
        row += letter != "I"
    return cost, audit, out


def repaired_by_hand(table):
    space, conversations_, out = (lambda x: " " if x is None else x), {}, {}
    for conv, turn, role, one in table:
        rows = conversations_.setdefault(conv, [])
        kind, role, one = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(one)
        one = "" if kind == 1 else one.translate({ord(c): None for c in ".!?"}) if kind == 2 else one
        rows += [(turn, "user" if kind == 4 else role, one)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rows in conversations_.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, one in rows:
            bare = one.rstrip(" \t\n\x0b\x0c\r")
            faults.append((role, "blank" if not bare else "duplicate" if (role, one) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, one))
        cost, audit, kept = cheapest(faults)
        turns = [t for t, _, _ in rows if t is not None]
        lines = "\n".join(f"{role}:{'' if k is None else rows[k][2]}" for role, k in kept)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        counts = [sum(f == kind for _, f in faults) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, place int, state int"


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_repairs_are_the_cheapest(spark, block_rows):
    rng, table = random.Random(7), []
    for conv in [None, *range(120)]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 9, 30]) + (conv is None)):
            table.append((conv, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", "system", "tool", None, "", "u"]), rng.choice(["Hi.", "Yes", "", "  ", "No! ", None, "x\n", "Ok?\t", "long. text"])))
    table += [(500, 1, "user", "Same.")] * 300 + [(501, k, "user", "Same again.") for k in range(200)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in table], CONVERSATIONS)
    repair = conversations.repair_conversations(conversations.damaged(frame), frame.select("conv_id"), block_rows=block_rows)
    found = repair.conversations.join(conversations.row_digests(repair.rows), "key", "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256 or none) for r in found}
    assert len(found) == len(got) and got == repaired_by_hand(table)


def test_repairs_of_nothing(spark):
    frame = spark.createDataFrame([], CONVERSATIONS)
    repair = conversations.repair_conversations(conversations.damaged(frame))
    assert repair.conversations.collect() == [] and conversations.row_digests(repair.rows).collect() == []


def test_checkpoints_and_matrices_agree_with_plain_walks():
    rng = random.Random(9)
    for _ in range(300):
        symbols = [rng.randrange(12) for _ in range(rng.randint(1, 30))]
        cut = rng.randint(1, len(symbols))
        end = (0, 10, 5, 0)
        whole = conversations.walk(symbols, end, 0)
        vector = conversations.through(conversations.block_matrix(symbols[cut:]), list(end)) if cut < len(symbols) else list(end)
        first, state, cost = conversations.walk(symbols[:cut], tuple(vector), 0)
        second, last, more = conversations.walk(symbols[cut:], end, state)
        assert (first + second, last, cost + more) == whole


# --- crossing


def aligned_by_hand(rows):
    a_lib, b_lib = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    spelled = dict(crossing._BYTE)
    found, count = [], Counter()
    for doc, one in rows:
        a, b = (a_lib.encode(" " + one, add_special_tokens=False).ids, b_lib.encode(one)) if one else ([], [])
        a_parts = [bytes(spelled[c] for c in a_lib.id_to_token(i)) for i in a]
        b_parts = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not one or not b"".join(a_parts) == b"".join(b_parts) == (" " + one).encode():
            found.append((doc, None))
            continue
        a_ends, b_ends = np.cumsum([len(p) for p in a_parts]).tolist(), np.cumsum([len(p) for p in b_parts]).tolist()
        groups, x, y = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(cut) + 1, b_ends.index(cut) + 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        links, first = [], 0
        for i, (end, part) in enumerate(zip(a_ends, a_parts)):
            while b_ends[first] <= end - len(part):
                first += 1
            k = first
            while k < len(b) and b_ends[k] - len(b_parts[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        count.update(set(links))
        found.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = defaultdict(int)
    for (first, _), n in count.items():
        best[first] = max(best[first], n)
    return sorted(((doc, *((0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[p] == best[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]))) for doc, r in found), key=str)


@pytest.mark.parametrize("chunks", [{}, {"chunk_entries": 50}])
def test_alignment_equals_brute_force(docs, chunks):
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 9000]
    small = docs.where("text is null or length(text) < 9000")
    assert sorted((tuple(r) for r in crossing.align_tokenizers(small, JSON, PIECES, **chunks).collect()), key=str) == aligned_by_hand(rows)
    assert crossing.align_tokenizers(docs.limit(0), JSON, PIECES).collect() == []


def test_alignment_of_a_long_text(docs):
    (row,) = crossing.align_tokenizers(docs.where("length(text) > 9000"), JSON, PIECES).collect()
    assert row.n_a == row.n_groups and row.n_links == row.n_b and row.n_best <= row.n_links


def test_shared_cuts():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randint(1, 80)
        one, other = (np.array(sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n - 1))})) for _ in range(2))
        cuts = crossing.shared_cuts(one, other, np.array([0]), np.array([n]))
        assert cuts.tolist() == sorted(set(one.tolist()) & set(other.tolist()) - {n})


def test_both_libraries_cut_alike():
    """The alignment takes ids from one library for the vocabulary of the other: both must hold every character for the same class."""
    cut = Tokenizer.from_file(JSON).pre_tokenizer.pre_tokenize_str
    single = {bytes([b]): b for b in range(256)}
    classes = {p: tiktoken.Encoding(p, pat_str=p, mergeable_ranks=single, special_tokens={}) for p in (r"\p{L}", r"\p{N}", r"\s")}
    for code in [*range(0x80, 0x2000), *range(0x2000, 0xD800, 7), *range(0xE000, 0x20000, 11)]:
        c = chr(code)
        lengths = tuple(b - a for _, (a, b) in cut("a" + c + "0"))
        got = [bool(classes[p].encode_ordinary(c)) for p in (r"\p{L}", r"\p{N}")]
        assert got == [lengths == (2, 1), lengths == (1, 2)]
        assert bool(classes[r"\s"].encode_ordinary(c)) == (len(cut("a" + c * 2 + "b")) == 4)


# --- pieces


def test_spans_tile_each_text_and_ids_decode(docs):
    from atlasweave.llm import pieces

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(6)
    model = pieces.PieceModel(PIECES)
    for _ in range(1500):
        one = text(rng, 40, [*ALPHABETS, "▁ a"])
        ids, begins, ends = model.spans(one)
        data = one.encode()
        assert ids == library.encode(one) and model.decode(ids) == library.decode(ids)
        assert [0, *ends] == [*begins, len(data)] if ids else not one
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randint(0, 10))]
        assert model.decode(ids) == library.decode(ids)
    assert model.decode([model.bytes[0xFF]] * 5000) == "�" * 5000
    covered = {(r.id, r.covered) for r in pieces.round_trip(docs, PIECES).collect()}
    assert covered == {(r.doc_id, len((r.text or "").encode())) for r in docs.collect()}
