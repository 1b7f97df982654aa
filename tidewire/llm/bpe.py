"""BPE encoding and decoding with a backtracking encoder.

A text is cut into words by the pattern of byte-level tokenizers.  For each word an
Aho-Corasick automaton finds the longest token at every byte.  The encoder walks through the
word with these longest tokens; a token may follow its neighbour only if the merge rules, run on the
two tokens' bytes, would leave exactly these two.  Where it may not, the next shorter token that
is a prefix is tried, and where none is left the encoder steps back.  A byte that is once found to be a
dead end is never tried again, so the work is linear in the word's length, and the result is that of
the merges in their order.

Decoding copies each id's bytes out of one table of all tokens' bytes through offsets.

Results for odd input: a null or empty text has no ids and decodes to the empty text; a null id
column decodes to the empty text; repeated rows give repeated results; an empty table gives an empty
table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm.shared import slices, text_of

# Fixed value: the published word pattern of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Outside these blocks releases of Unicode differ between libraries; such texts are cut by the tokenizer file's own pre-tokenizer.
RARE = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]")
#: The compiled library gives up on runs of about a million white-space characters; texts with runs of this length go through this module.
LONG_BLANK = 100_000
BLANKS = regex.compile(r"\s{%d}" % LONG_BLANK)
CACHED_WORDS = 200_000
CACHED_PAIRS = 400_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class BpeModel:
    """The tables of one tokenizer file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, spec: bytes) -> None:
        parsed = json.loads(spec)
        model = parsed["model"]
        plain = parsed.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or parsed.get("normalizer") or plain.get("type") != "ByteLevel" or plain.get("add_prefix_space"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        self.spec = spec
        self._library: Tokenizer | None = None
        self.to_byte = {ord(c): b for b, c in enumerate(byte_characters())}
        vocab = {self._bytes(token): i for token, i in model["vocab"].items()}
        special = [t for t in parsed.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that take in neighbouring text are not supported")
        self.special = {t["content"]: t["id"] for t in special}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(WORDS).findall
        self._rank_tables(model["merges"], vocab)
        self._offset_table(vocab)
        self.cache = WordCache(self)
        self._pairs: dict[int, bool] = {}

    def _bytes(self, token: str) -> bytes:
        return bytes(self.to_byte[ord(c)] for c in token)

    def _rank_tables(self, merges: list, vocab: dict[bytes, int]) -> None:
        parts = [tuple(self._bytes(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in merges]
        tokens = [bytes([b]) for b in range(256)] + list(dict.fromkeys(a + b for a, b in parts))
        rank = {token: r for r, token in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.packed = [vocab[t].to_bytes(4, "little") for t in tokens]
        self.halves = [(r, r) for r in range(256)]
        self.merged: dict[int, int] = {}
        for a, b in parts:
            if rank[a + b] == len(self.halves):
                self.halves.append((rank[a], rank[b]))
            self.merged.setdefault(rank[a] << 32 | rank[b], rank[a + b])
        self.shorter = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in tokens]
        self.rank = rank
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t) - 1))
        self.automaton.make_automaton()

    def _offset_table(self, vocab: dict[bytes, int]) -> None:
        by_id = {i: t for t, i in vocab.items()} | {i: c.encode() for c, i in self.special.items()}
        ordered = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.sizes = np.array([len(t) for t in ordered], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by the rules ends in exactly these two tokens.

        The last merges of the two tokens are undone, latest first; the pair fits unless somewhere along the seam
        a merge across it would have come before the merge that hides it.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # `bound`: a merge across the seam wins if its rank is lower.  Merges of one rank go from left to right.
        merged, halves, bound = self.merged, self.halves, 1 << 60
        while True:
            across = merged.get(left << 32 | right)
            if across is not None and across < bound:
                return False
            undo_left = left > right or right < 256
            if undo_left and left >= 256:
                bound, left = left, halves[left][1]
            elif right >= 256:
                bound, right = right + 1, halves[right][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ranks of the tokens of a word."""
        if not word:
            return []
        n, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        longest = [0] * n
        for end, (r, back) in self.automaton.iter(word.decode("latin-1")):
            longest[end - back] = r
        alive, out, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while True:
            end = at + length[token]
            if alive[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]

    def _plain(self, text: str) -> bytes:
        if RARE.search(text):
            if self._library is None:
                self._library = Tokenizer.from_str(self.spec.decode())
            parts = [piece for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]
            encoded = (self.encode_word(self._bytes(p)) for p in parts)
            return b"".join(self.packed[r] for word in encoded for r in word)
        return b"".join(map(self.cache.__getitem__, self.words(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.special_split.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in parts)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[take].tobytes().decode("utf-8", "replace")


class WordCache(dict):
    """Packed ids by word, in two generations of bounded size: what an old generation held and is asked for again moves on."""

    def __init__(self, model: BpeModel) -> None:
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = b"".join(map(self.model.packed.__getitem__, self.model.encode_word(word.encode())))
            if len(word) > 64:
                return found
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=2)
def model_of(spec: bytes) -> BpeModel:
    """The tables, built once in each Python worker."""
    return BpeModel(spec)


def read_spec(path: str) -> bytes:
    """A tokenizer file, read by the driver: a few MB, which go to the executors as they are."""
    with open(path, "rb") as f:
        return f.read()


def spec_digest(spec: bytes) -> str:
    return hashlib.sha256(spec).hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary) of every whole text; ``ids`` are packed little-endian unsigned 32-bit integers.

    One pass without a shuffle: each task encodes its own rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model_of(spec.value).encode
        for b in slices(batches):
            ids = [encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    chosen = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, n_tokens long, ids binary").withColumnRenamed("id", key)


def decode_documents(encoded: DataFrame, tokenizer: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The input with ``ids`` kept and the decoded text beside it.  Ids beyond the vocabulary are an error."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model_of(spec.value).decode
        for b in slices(batches):
            texts = pa.array([decode(x or b"") for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, into])

    return encoded.mapInArrow(run, encoded.withColumn(into, F.lit("")).schema)


class LibraryEncoder:
    """The same ids through a compiled library, for operators that only need the ids and not this module's method."""

    def __init__(self, spec: bytes) -> None:
        import tiktoken

        self.model = model_of(spec)
        ranks = {t: int.from_bytes(self.model.packed[r], "little") for t, r in self.model.rank.items()}
        self.coder = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.model.special)

    def ids(self, text: str) -> list[int]:
        if RARE.search(text) or (len(text) >= LONG_BLANK and BLANKS.search(text)):
            return np.frombuffer(self.model.encode(text), "<u4").tolist()
        return self.coder.encode(text, allowed_special="all")


@lru_cache(maxsize=2)
def library_encoder(spec: bytes) -> LibraryEncoder:
    return LibraryEncoder(spec)
