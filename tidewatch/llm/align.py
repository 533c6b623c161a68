"""Tokens of two tokenizers over the same bytes: links, shared cuts, and how common each pair of ids is.

Every text is cut into chunks in front of a space, at places where both tokenizers are
sure to end a token, and each distinct chunk is encoded once. Runs of chunks of all
documents of a batch become lanes. One state vector holds for every lane where it stands
in A's and in B's tokens; each step links the two tokens, marks a cut where both end
together, advances whichever ends first, and drops the lanes that are finished. So a step
costs a few numpy calls whatever the number of documents, and a long document is many lanes.

How many documents hold a pair is summed over the whole corpus by Spark. The blocks that
the batches leave hold a pair once with its documents, and get the totals back by a join
on the pair; nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Bytes of text a batch aligns at a time; a longer text is aligned in such parts.
PART_BYTES = 1 << 20
#: Bytes of text whose documents share a block of the written table (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: What a document counts for beside its text.
_DOC_BYTES = 64
#: Tokens of A in a lane; a chunk of more is a lane of its own.
LANE = 96
#: Chunks whose tokens a task remembers.
REMEMBERED = 200_000

#: Bits of a pair's number: A's id times the ids of B, plus B's id; the document stands above them.
_CODE_BITS = 40

#: How byte-level tokenizers of this kind find words (fixed value).
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: First bytes of characters among which are white space outside ASCII.
_MAYBE_BLANK = np.zeros(256, bool)
_MAYBE_BLANK_BYTES = frozenset([0xC2, 0xE1, 0xE2, 0xE3])
_MAYBE_BLANK[sorted(_MAYBE_BLANK_BYTES)] = True


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes follow in order from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def merge_ranks(byte_json: str) -> dict[bytes, int] | None:
    """Tokens of a byte-level vocabulary with their ids, where an id is also the place of the token's merge.

    Then the ids alone say how to encode, several times faster. None where they do not, or
    where words are found in another way than by ``_BYTE_WORDS``.
    """
    held = json.loads(byte_json)
    vocab, merges, before = held["model"]["vocab"], held["model"]["merges"], held.get("pre_tokenizer") or {}
    letters = byte_letters()
    plain = held.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
    if not plain or any(vocab.get(token) != 256 + n for n, token in enumerate(joined)):
        return None
    by_id = sorted(vocab, key=vocab.get)[: 256 + len(merges)]
    return {bytes(letters[c] for c in token): vocab[token] for token in by_id}


def _decimals(size: int, ends: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (padded) and their number of ``<id><end>`` for every id, once per end."""
    width = len(str(max(size - 1, 0))) + 1
    said = [f"{i}{e}".encode() for e in ends for i in range(size)]
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in said), np.uint8).reshape(len(said), width)
    return table, np.array([len(s) for s in said], np.int64)


def _bundles(chunks: list[bytes], most: int = 64) -> Iterator[list[bytes]]:
    """Chunks in order, in runs between whose members both tokenizers are sure to end a token."""
    run: list[bytes] = []
    for c in chunks:
        fits = len(c) > 1 and 0x20 < c[1] and c[-1] > 0x20 and c[1] not in _MAYBE_BLANK_BYTES
        if run and (len(run) == most or not fits):
            yield run
            run = []
        if fits:
            run.append(c)
        else:
            yield [c]
    if run:
        yield run


class Pair:
    """Both tokenizers, from the content of their files, and the tokens of chunks met before."""

    def __init__(self, byte_json: str, piece_proto: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_proto)
        letters = byte_letters()
        self.a_ranks = None
        if ranks := merge_ranks(byte_json):
            self.a_ranks = tiktoken.Encoding("a", pat_str=_BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << _CODE_BITS:
            raise ValueError("the vocabularies have more than 2^40 pairs of ids")
        self.a_spelling, self.b_spelling = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.a_from, self.b_from = (np.r_[0, np.cumsum(x)] for x in (self.a_size, self.b_size))
        self.a_said, self.a_long = _decimals(len(self.a_bytes), ",|")
        self.b_said, self.b_long = _decimals(len(self.b_bytes), ",;")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.a_flat = self.b_flat = np.zeros(0, np.int32)
        self.a_at = self.b_at = np.zeros(1, np.int64)
        self.sound = np.zeros(0, bool)

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.a_ranks:
            return [self.a_ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of chunks that begin with the space that B adds by itself."""
        texts = [c.decode() for c in chunks]
        return self._encode_a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)

    def spells(self, chunk: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join([self.a_bytes[i] for i in a]) == chunk == b"".join([self.b_bytes[i] for i in b])

    def _learn(self, new: list[bytes]) -> None:
        """Encode new chunks, for A many in one text where they may stand side by side."""
        want, lengths = np.frombuffer(b"".join(new), np.uint8), np.array([len(c) for c in new], np.int64)
        a = [part for some in _bundles(new) for part in self._a_of(some)]
        b = self.b.encode([c[1:].decode() for c in new], num_threads=1)
        held_b = np.fromiter(chain.from_iterable(b), np.int32), np.array([len(x) for x in b], np.int64)
        held_a = np.concatenate([x for x, _ in a]), np.concatenate([x for _, x in a])
        sound = np.ones(len(new), bool)
        for name, (flat, size), spelling, begins in (("a", held_a, self.a_spelling, self.a_from), ("b", held_b, self.b_spelling, self.b_from)):
            sound &= _spelled(flat, size, spelling, begins, want, lengths)
            at = getattr(self, f"{name}_at")
            setattr(self, f"{name}_flat", np.r_[getattr(self, f"{name}_flat"), flat])
            setattr(self, f"{name}_at", np.r_[at, at[-1] + np.cumsum(size)])
        self.sound = np.r_[self.sound, sound]

    def _a_of(self, some: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A's ids of some chunks and their number by chunk."""
        flat = np.array(self._encode_a([b"".join(some).decode()])[0], np.int32)
        ends = np.cumsum([len(c) for c in some])
        at = np.cumsum(self.a_size[flat])
        place = np.searchsorted(at, ends) + 1
        if len(at) and at[-1] == ends[-1] and (at[place - 1] == ends).all():
            return [(flat, np.diff(place, prepend=0))]
        return [(np.array(x, np.int32), np.array([len(x)])) for x in self._encode_a([c.decode() for c in some])]

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The number of each chunk; those not met before are encoded first."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        first = len(known)
        out = np.array([known.setdefault(c, len(known)) for c in chunks], np.int64)
        if len(known) > first:
            self._learn(list(islice(reversed(known), len(known) - first))[::-1])
        return out


def safe_cuts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places from ``low`` up to ``high`` where a chunk of a text begins: spaces between solid characters.

    A's words take a space to their left, B has no piece with a space after anything else,
    so both end a token in front of such a space. After white space other than a space this
    needs a solid character to follow, hence the care with characters outside ASCII.
    """
    low, high = max(low, 1), min(high, len(data) - 1)
    if low >= high:
        return np.zeros(0, np.int64)
    before, here, after = data[low - 1 : high - 1], data[low:high], data[low + 1 : high + 1]
    safe = (here == 0x20) & (before > 0x20) & (after > 0x20) & ~((before >= 0x80) & _MAYBE_BLANK[after])
    return np.flatnonzero(safe) + low


def lockstep(
    a_end: np.ndarray, a_at: np.ndarray, b_end: np.ndarray, b_at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All linked token pairs of all lanes, and which of them end a group.

    Lane ``k`` has A's tokens ``a_at[k]`` to ``a_at[k + 1]`` and B's likewise, with the bytes
    they end at; both fill the same bytes, and no token is empty.
    """
    lanes = np.flatnonzero(np.diff(a_at) > 0)
    i, j, stop = a_at[lanes].copy(), b_at[lanes].copy(), a_at[lanes + 1]
    left, right, cuts = [], [], []
    while len(i):
        ea, eb = a_end[i], b_end[j]
        left.append(i)
        right.append(j)
        cuts.append(ea == eb)
        i, j = i + (ea <= eb), j + (eb <= ea)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(left), np.concatenate(right), np.concatenate(cuts)


def _ragged(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of the ranges ``which`` end to end, and where each range begins among them."""
    size = at[which + 1] - at[which]
    begins = np.r_[0, np.cumsum(size)]
    return np.arange(begins[-1]) + np.repeat(at[which] - begins[:-1], size), begins


def _spelled(
    flat: np.ndarray, size: np.ndarray, spelling: np.ndarray, begins: np.ndarray, want: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """Which chunks (``want`` end to end, of these lengths) their tokens spell byte by byte."""
    token_at, chunk_at = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(lengths)]
    byte_at = np.r_[0, np.cumsum(begins[flat + 1] - begins[flat])][token_at]
    sound = np.diff(byte_at) == lengths
    if sound.all():
        wrong = np.flatnonzero(spelling[_ragged(begins, flat)[0]] != want)
        sound[np.searchsorted(chunk_at, wrong, "right") - 1] = False
        return sound
    for n in np.flatnonzero(sound):
        ids = flat[token_at[n] : token_at[n + 1]]
        sound[n] = (spelling[_ragged(begins, ids)[0]] == want[chunk_at[n] : chunk_at[n + 1]]).all()
    return sound


@dataclass
class Part:
    """Aligned tokens of a run of documents: flat ids, links by position, the document of each token."""

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cut: np.ndarray


def aligned(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lane_doc: np.ndarray, pair: Pair) -> Part:
    """Link the tokens of lanes; ``lane_doc`` ascends."""
    a_end = np.cumsum(pair.a_size[a])
    b_end = np.cumsum(pair.b_size[b])
    left, right, cut = lockstep(a_end, a_at, b_end, b_at)
    return Part(a, b, np.repeat(lane_doc, np.diff(a_at)), np.repeat(lane_doc, np.diff(b_at)), left, right, cut)


def align_chunks(numbers: np.ndarray, docs: np.ndarray, pair: Pair) -> Part:
    """Lanes are runs of a document's chunks of about ``LANE`` tokens."""
    a_pos, a_begin = _ragged(pair.a_at, numbers)
    b_pos, b_begin = _ragged(pair.b_at, numbers)
    new_doc = np.r_[True, docs[1:] != docs[:-1]]
    since = a_begin[:-1] - np.repeat(a_begin[:-1][new_doc], np.diff(np.r_[np.flatnonzero(new_doc), len(docs)]))
    lane = since // LANE
    heads = np.flatnonzero(new_doc | np.r_[True, lane[1:] != lane[:-1]])
    return aligned(
        pair.a_flat[a_pos], np.r_[a_begin[heads], a_begin[-1]], pair.b_flat[b_pos], np.r_[b_begin[heads], b_begin[-1]], docs[heads], pair
    )


def spelled_groups(part: Part, pair: Pair) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all documents end to end, and where each token's end falls, A's before B's of a group."""
    a_last = np.zeros(len(part.a), bool)
    b_last = np.zeros(len(part.b), bool)
    a_last[part.left[part.cut]] = True
    b_last[part.right[part.cut]] = True
    a_group = np.cumsum(a_last) - a_last  # groups that end before this token
    b_group = np.cumsum(b_last) - b_last
    a_ends = np.flatnonzero(a_last) + 1  # tokens of A up to and with each group
    b_ends = np.r_[0, np.flatnonzero(b_last) + 1]  # tokens of B before each group
    a_place = np.arange(len(part.a)) + b_ends[a_group]
    b_place = np.arange(len(part.b)) + a_ends[b_group]
    total = len(part.a) + len(part.b)
    width = max(pair.a_said.shape[1], pair.b_said.shape[1])
    said = np.zeros((total, width), np.uint8)
    long = np.zeros(total, np.int64)
    a_code = part.a + len(pair.a_bytes) * a_last.astype(np.int64)
    b_code = part.b + len(pair.b_bytes) * b_last.astype(np.int64)
    said[a_place, : pair.a_said.shape[1]] = pair.a_said[a_code]
    said[b_place, : pair.b_said.shape[1]] = pair.b_said[b_code]
    long[a_place] = pair.a_long[a_code]
    long[b_place] = pair.b_long[b_code]
    doc = np.empty(total, np.int64)
    doc[a_place], doc[b_place] = part.a_doc, part.b_doc
    return said[np.arange(width) < long[:, None]].tobytes(), np.c_[doc, np.cumsum(long)]


@dataclass
class Held:
    """What is known of a document so far."""

    doc_id: int | None
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    sound: bool = True
    #: Another entry holds this document's figures.
    replaced: bool = False


class Block:
    """Documents whose figures and pairs are written together."""

    def __init__(self) -> None:
        self.docs: list[Held] = []
        self.raw: list[bytes | None] = []
        self.bytes = 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, part: Part, pair: Pair) -> None:
        """Count a part's links for its documents and go on with their digests."""
        if not len(part.a):
            return
        low, high = int(part.a_doc[0]), int(part.a_doc[-1])
        count = lambda x: np.bincount(x - low, minlength=high - low + 1)
        link_doc = part.a_doc[part.left]
        n_a, n_b, n_links, n_groups = count(part.a_doc), count(part.b_doc), count(link_doc), count(link_doc[part.cut])
        said, ends = spelled_groups(part, pair)
        last = np.flatnonzero(np.r_[ends[1:, 0] != ends[:-1, 0], True])
        start = 0
        for n, end in ends[last]:
            doc = self.docs[n]
            if doc.n_groups:
                doc.digest.update(b";")
            doc.digest.update(said[start : end - 1])
            start = int(end)
            doc.n_a += int(n_a[n - low])
            doc.n_b += int(n_b[n - low])
            doc.n_links += int(n_links[n - low])
            doc.n_groups += int(n_groups[n - low])
        code = part.a[part.left].astype(np.int64) * len(pair.b_bytes) + part.b[part.right]
        keys, times = np.unique(link_doc << _CODE_BITS | code, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def row(self, number: int) -> dict:
        """The block as one row: figures by document; distinct pairs with their number of documents; entries by document."""
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        sound = np.array([d.sound for d in self.docs], bool)
        keep = sound[keys >> _CODE_BITS]
        keys, times = keys[keep], times[keep]
        # A long text leaves a pair once a part.
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        keys, times = keys[head], np.add.reduceat(times, head) if len(head) else times
        pairs, place, holders = np.unique(keys & ((1 << _CODE_BITS) - 1), return_inverse=True, return_counts=True)
        live = [n for n, d in enumerate(self.docs) if not d.replaced]
        figure = lambda name: [getattr(self.docs[n], name) if self.docs[n].sound else 0 for n in live]
        pack = lambda x: pa.compress(np.ascontiguousarray(x, np.int32).tobytes(), "zstd", asbytes=True)
        step = np.diff(place, prepend=0)  # small numbers, which deflate well
        return {
            "block": number, "doc_ids": [self.docs[n].doc_id for n in live],
            **{n: figure(n) for n in ("n_a", "n_b", "n_groups", "n_links")},
            "sha": [d.digest.hexdigest() if d.sound and d.n_a else "" for d in map(self.docs.__getitem__, live)],
            "pairs": pairs, "holders": holders,
            "entries": np.bincount(keys >> _CODE_BITS, minlength=len(self.docs))[live],
            "place": pack(step), "times": pack(times), "n": len(place),
        }


SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    *[(n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links")], ("sha", pa.list_(pa.string())),
    ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())), ("entries", pa.list_(pa.int64())),
    ("place", pa.binary()), ("times", pa.binary()), ("n", pa.int64()),
])
DDL = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
    "pairs array<long>, holders array<long>, entries array<long>, place binary, times binary, n long"
)


def parts_of(docs: list[bytes | None], pair: Pair) -> Iterator[tuple[Part | None, set[int]]]:
    """Aligned parts of texts in order, and the documents found to have no tokens.

    ``docs`` are the UTF-8 bytes of texts. A text one of whose chunks is not spelled by its
    tokens is encoded whole and compared whole.
    """
    chunks: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0

    def flush():
        numbers, of = pair.numbers(chunks), np.repeat(*np.array(owners, np.int64).T)
        odd = set(of[~pair.sound[numbers]].tolist())
        if odd:
            keep = ~np.isin(of, list(odd))
            numbers, of = numbers[keep], of[keep]
        return (align_chunks(numbers, of, pair) if len(of) else None), odd

    for n, raw in enumerate(docs):
        if not raw:
            continue
        text = b" " + raw
        data, start = np.frombuffer(text, np.uint8), 0
        for low in range(0, len(text), PART_BYTES):
            ends = safe_cuts(data, low, low + PART_BYTES).tolist()
            if low + PART_BYTES >= len(text):
                ends.append(len(text))
            if not ends:
                continue
            chunks += [text[s:e] for s, e in zip([start, *ends], ends)]
            owners.append((n, len(ends)))
            size += ends[-1] - start
            start = ends[-1]
            if size >= PART_BYTES:
                yield flush()
                chunks, owners, size = [], [], 0
    if chunks:
        yield flush()


def whole(raw: bytes, pair: Pair) -> Part | None:
    """A text encoded in one go; None if the tokens do not spell it."""
    text = b" " + raw
    (a,), (b,) = pair.encode([text])
    if not pair.spells(text, a, b):
        return None
    none, end = np.zeros(1, np.int64), lambda x: np.array([0, len(x)], np.int64)
    return aligned(np.array(a, np.int32), end(a), np.array(b, np.int32), end(b), none, pair)


def fill(block: Block, pair: Pair) -> None:
    """Align the texts of a block."""
    odd: set[int] = set()
    for part, bad in parts_of(block.raw, pair):
        odd |= bad
        if part is not None:
            block.add(part, pair)
    for n in sorted(odd):
        # What its sound chunks have left is dropped with the whole document.
        block.docs[n].sound = False
        if (part := whole(block.raw[n], pair)) is not None:
            block.docs[n].replaced = True
            block.docs.append(Held(block.docs[n].doc_id))
            again = len(block.docs) - 1
            part.a_doc, part.b_doc = part.a_doc + again, part.b_doc + again
            block.add(part, pair)
    block.raw = []


def _rows(doc_ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int | None, bytes | None]]:
    for i, text in zip(doc_ids, texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else None
        yield i.as_py(), raw


def _aligner(files):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files.value)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        block = Block()

        def close():
            fill(block, pair)
            return pa.RecordBatch.from_pylist([block.row(number)], SCHEMA)

        for batch in batches:
            for doc_id, raw in _rows(batch.column(0), batch.column(1)):
                block.docs.append(Held(doc_id))
                block.raw.append(raw)
                block.bytes += len(raw or b"") + _DOC_BYTES
                if block.bytes >= BLOCK_BYTES:
                    yield close()
                    number, block = number + 1, Block()
        if block.docs:
            yield close()

    return blocks


def _files(spark, byte_bpe: str, piece_bpe: str):
    """Both files as a broadcast: a few MB, whatever the documents."""
    with open(byte_bpe, encoding="utf-8") as a, open(piece_bpe, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def blocks_of(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """The aligned blocks of ``doc_id, text``, written to the shared folder: figures, pairs and entries of each document."""
    files = _files(docs.sparkSession, byte_bpe, piece_bpe)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = stored(slim.mapInArrow(_aligner(files), DDL), "aligned")
    files.destroy()
    return made


def pair_counts(blocks: DataFrame, b_ids: int) -> DataFrame:
    """``pair, a, b, n_docs, best`` of every linked pair of ids; ``best`` where no pair of the same A id is in more documents."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    total = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n_docs"))
    total = stored(total.withColumn("a", F.expr(f"pair div {b_ids}")).withColumn("b", F.col("pair") % b_ids), "pair-counts")
    most = total.groupBy("a").agg(F.max("n_docs").alias("most"))
    return total.join(most, "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


_OUT = ["n_a", "n_b", "n_groups", "n_links"]
REPORT = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in [*_OUT, "n_best", "count_sum"]], ("groups_sha256", pa.string())])


def _weighed(block: pa.Table, totals: pa.Table) -> pa.Table:
    """Figures of a block's documents from the totals of its pairs."""
    if not block.num_rows:
        return REPORT.empty_table()
    row = {c: block.column(c)[0] for c in block.column_names}
    order = np.argsort(totals.column("pair").to_numpy())
    count = totals.column("n_docs").to_numpy()[order]
    best = totals.column("best").to_numpy(zero_copy_only=False)[order]

    def unpack(name):
        return np.frombuffer(pa.decompress(row[name].as_buffer(), row["n"].as_py() * 4, "zstd", asbytes=True), np.int32).astype(np.int64)

    place, times = np.cumsum(unpack("place")), unpack("times")
    ends = np.r_[0, np.cumsum(row["entries"].values.to_numpy())]
    summed = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
    figures = [row[n].values for n in _OUT]
    sums = [pa.array(summed(np.where(best[place], times, 0)), pa.int64()), pa.array(summed(count[place] * times), pa.int64())]
    return pa.Table.from_arrays([row["doc_ids"].values, *figures, *sums, row["sha"].values], schema=REPORT)


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``doc_id, text``.

    Null and empty texts, and texts that the tokens of one side do not spell (for instance
    with U+2581, which B reads as a space), have no tokens: zeros and an empty digest.
    Repeated rows are documents of their own, rows without a doc_id too. Other columns are
    not read. An empty table gives an empty result.
    """
    import sentencepiece

    blocks = blocks_of(docs, byte_bpe, piece_bpe)
    counts = pair_counts(blocks, sentencepiece.SentencePieceProcessor(model_file=piece_bpe).get_piece_size())
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    told = asked.join(counts.select("pair", "n_docs", "best"), "pair")
    ddl = "doc_id long, " + ", ".join(f"{n} long" for n in [*_OUT, "n_best", "count_sum"]) + ", groups_sha256 string"
    return blocks.drop("pairs", "holders").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_weighed, ddl)


def alignment(raw: bytes, pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A's ids, B's ids, the linked positions (two columns) and the links that end a group, of one text's bytes."""
    found = list(parts_of([raw], pair))
    if any(bad for _, bad in found):
        part = whole(raw, pair)
        parts = [part] if part is not None else []
    else:
        parts = [p for p, _ in found if p is not None]
    empty = np.zeros(0, np.int64)
    links, cuts, n_a, n_b = [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)], 0, 0
    for p in parts:
        order = np.lexsort((p.right, p.left))
        links.append(np.c_[p.left[order] + n_a, p.right[order] + n_b])
        cuts.append(p.cut[order])
        n_a, n_b = n_a + len(p.a), n_b + len(p.b)
    return (
        np.concatenate([empty, *[p.a for p in parts]]), np.concatenate([empty, *[p.b for p in parts]]),
        np.concatenate(links), np.concatenate(cuts),
    )


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_linked, b_linked, ends_group``: the alignment itself, token positions from 0.

    Ids are empty where ``align`` counts zeros.
    """
    files = _files(docs.sparkSession, byte_bpe, piece_bpe)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files.value)
        for batch in batches:
            for doc_id, raw in _rows(batch.column(0), batch.column(1)):
                a, b, links, cuts = alignment(raw, pair) if raw else (*[np.zeros(0, np.int64)] * 2, np.zeros((0, 2), np.int64), [])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id], pa.int64()),
                    **{n: pa.array([x], pa.list_(pa.int32())) for n, x in (("a_ids", a), ("b_ids", b), ("a_linked", links[:, 0]), ("b_linked", links[:, 1]))},
                    "ends_group": pa.array([cuts], pa.list_(pa.bool_())),
                })

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(
        rows, "doc_id long, a_ids array<int>, b_ids array<int>, a_linked array<int>, b_linked array<int>, ends_group array<boolean>"
    )
