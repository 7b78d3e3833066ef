"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to the 256 Latin-1 characters, so that pyahocorasick (which takes str keys) can hold the tokens of a rank
file. A piece is encoded from left to right with the longest token that matches; a token is kept only if it may stand
beside the one before it, otherwise the next shorter match is tried and, if none is left, the last token is taken back.
Whether two tokens may stand side by side is decided from their merges and memoised. Every position of a piece is entered
at most once per length, so the work is linear in the piece for a fixed vocabulary, and the result is that of applying
all merges by rank.

Edge cases: a null text is the empty text (no ids); texts of any length are encoded whole; repeated rows are encoded
alike; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stimfuse.llm.common import map_batches, slices

#: Fixed value: the characters with the Unicode property White_Space, which the split patterns take as white space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: White space decides where a split pattern can cut: a run of other characters, with one space before it, is always cut the same way.
CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

#: Entries that the memo of a worker may hold before it is emptied.
MEMO = 250_000


class ByteBPE:
    """Encoder and decoder for one rank file; pattern cuts a text into pieces that are merged separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.piece = regex.compile(pattern)
        self.names = {t.decode("latin-1"): i for t, i in self.ranks.items()}
        by_id = sorted((i, t) for t, i in self.ranks.items())
        top = by_id[-1][0] + 1
        self.lengths = np.zeros(top, np.int64)
        for i, t in by_id:
            self.lengths[i] = len(t)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self._merges(by_id)
        self.follows: dict[int, int] = {}
        self.starting: dict[str, int] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _merges(self, by_id: list[tuple[int, bytes]]) -> None:
        """The two parts of every token, the merge of two tokens, and the automaton of the tokens that merges can reach."""
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        reached = {}
        for i, t in by_id:
            if len(t) == 1:
                self.parts[i] = (i, i)
            else:
                got = self._by_rank(t, i)
                if len(got) != 2:  # merges never make it: it is only taken for a whole piece
                    continue
                self.parts[i] = (got[0], got[1])
                self.merge[got[0], got[1]] = i
            reached[t.decode("latin-1")] = i
        self.auto = ahocorasick.Automaton()
        for name, i in reached.items():
            self.auto.add_word(name, i)
        self.auto.make_automaton()
        self.shorter = {i: next((reached[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in reached), -1) for name, i in reached.items()}
        self.length = {i: len(name) for name, i in reached.items()}
        self.most = max(self.length.values(), default=1)
        self.reached = reached

    def _by_rank(self, t: bytes, below: int) -> list[int]:
        """Merges of rank under `below`, applied one after another: used for the tokens themselves, which are short."""
        p = [t[k : k + 1] for k in range(len(t))]
        while len(p) > 2:
            best, at = below, -1
            for k in range(len(p) - 1):
                m = self.ranks.get(p[k] + p[k + 1], below)
                if m < best:
                    best, at = m, k
            if at < 0:
                break
            p[at : at + 2] = [p[at] + p[at + 1]]
        return [self.ranks.get(x, -1) for x in p]

    def beside(self, last: int, token: int) -> int:
        """The longest of token and its prefixes that may follow last, or -1; memoised."""
        known = self.follows.get(last << 32 | token)
        if known is None:
            if len(self.follows) > MEMO:
                self.follows.clear()
            known = token
            while known >= 0 and not self._may_stand(last, known):
                known = self.shorter[known]
            self.follows[last << 32 | token] = known
        return known

    def _may_stand(self, a: int, b: int) -> bool:
        """Undo the last merges of a and b, the latest first: none of the merges across the border may come before the one undone."""
        limit = 1 << 60
        while True:
            if self.merge.get((a, b), limit) < limit:
                return False
            inner_a, inner_b = self.parts[a][1], self.parts[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (inner_a != a and a > b):
                limit, a = a, inner_a
            else:
                limit, b = b + 1, inner_b

    def merge_piece(self, name: str) -> list[int]:
        """The ids of one piece, given as Latin-1 characters."""
        whole = self.names.get(name)
        if whole is not None:
            return [whole]
        length, reach, starting, follows, shorter = self.length, self.auto.longest_prefix, self.starting, self.follows, self.shorter
        n, at, last, out, closed = len(name), 0, -1, [], ()  # closed: positions from which the rest can't be encoded
        rest = name
        while rest:
            k = reach(rest)
            token = starting.get(rest[:k])
            if token is None:
                token = self.longest(rest, k)
            while True:
                if token >= 0 and last >= 0:
                    fit = follows.get(last << 32 | token)
                    token = self.beside(last, token) if fit is None else fit
                if token < 0:  # nothing fits here: take the last token back and try its prefixes
                    if not out:
                        raise ValueError("the vocabulary lacks a byte of this piece")
                    closed = closed or set()
                    closed.add(at)
                    token = out.pop()
                    at -= length[token]
                    last = out[-1] if out else -1
                elif not closed or at + length[token] not in closed:
                    break
                token = shorter[token]
            out.append(token)
            at += length[token]
            rest, last = name[at : at + self.most] if n > 64 else name[at:], token
        return out

    def longest(self, rest: str, k: int = -1) -> int:
        """The longest token that the string starts with; k: how far the automaton's trie goes."""
        k = self.auto.longest_prefix(rest) if k < 0 else k
        key = rest[:k]
        token = self.starting.get(key)
        if token is None:
            if len(self.starting) > MEMO:
                self.starting.clear()
            while k and rest[:k] not in self.reached:
                k -= 1
            if not k:
                raise ValueError("the vocabulary lacks a byte of this piece")
            token = self.starting[key] = self.reached[rest[:k]]
        return token

    def _encode_piece(self, piece: str) -> bytes:
        name = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        return array("I", self.merge_piece(name)).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # letters only, maybe after a space: one piece
            return self._encode_piece(chunk)
        pieces = self.pieces
        out = []
        for piece in self.piece.findall(chunk):
            known = pieces.get(piece)
            if known is None:
                if len(pieces) > MEMO // 4:
                    pieces.clear()
                known = self._encode_piece(piece)
                if len(piece) <= 64:
                    pieces[piece] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        keys = CHUNK.findall(text)
        chunks = self.chunks
        try:
            return b"".join([chunks[k] for k in keys])
        except KeyError:
            pass
        if len(chunks) > MEMO:
            chunks.clear()
        out = []
        for k in keys:
            ids = chunks.get(k)
            if ids is None:
                ids = self._encode_chunk(k)
                if len(k) <= 64:
                    chunks[k] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        t = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(t):
            return b""
        n = self.lengths[t]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.starts[t] - (ends - n), n) + np.arange(int(ends[-1]))].tobytes()


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process and vocabulary."""
    return ByteBPE(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, ids array<bigint>)."""

    def run(b: pa.RecordBatch):
        bpe, texts = encoder(path, pattern), b.column(1).to_pylist()
        for lo, hi in slices(texts):
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int64) for t in texts[lo:hi]]
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` bigint, ids array<bigint>")


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: (id, bytes binary); null ids give null."""

    def run(b: pa.RecordBatch):
        bpe = encoder(path, pattern)
        out = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return map_batches(df.select(id_col, ids_col), run, f"`{id_col}` bigint, bytes binary")


def encode_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and the decoded-again text."""

    def run(b: pa.RecordBatch):
        bpe, texts = encoder(path, pattern), b.column(1).to_pylist()
        n, ids_sha, decoded_sha = [], [], []
        for t in texts:
            ids = bpe.encode(t or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(df.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
