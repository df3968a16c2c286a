"""Byte-level BPE encoding and decoding.

The ranks of a public vocabulary are the merges. Each match of the split pattern is encoded separately:
its bytes are read as Latin-1 characters, an Aho-Corasick automaton over the vocabulary gives every token
that ends at each place, and the encoder walks from the longest match, steps back to the next shorter one
whenever two adjacent tokens could not both come out of the merges, and never tries a place twice. Whether
two tokens may stand side by side is worked out once and remembered. This yields what merging in the
order of the ranks yields, in time linear in the length.

Rows are independent: there is no shuffle, and memory is bounded by the automaton and two bounded caches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import slices

#: Entries that each cache of a Python worker may hold before it starts anew, and the longest piece that is kept.
CACHE, PIECE = 500_000, 64


class Pieces(dict):
    """The ids of pieces, as decimals joined by spaces; encodes what is not there yet."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(str, self.bpe.encode_piece(piece.encode("utf-8"))))
        if len(piece) <= PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """A vocabulary of byte strings with ranks, as tiktoken files hold them; pattern splits the text."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)
        self.text_of = {str(rank): token for rank, token in self.token.items()}

    def split(self, rank: int) -> tuple[int, int]:
        """The two tokens that a token is merged from; a single byte is its own halves."""
        got = self.parts.get(rank)
        if got is None:
            parts = self._merged(self.token[rank], rank)
            got = self.parts[rank] = parts if len(parts) == 2 else (rank, rank)
        return got

    def _merged(self, piece: bytes, below: int) -> tuple[int, ...]:
        """The plain merge loop, with the ranks under `below` only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.rank[x] for x in parts)

    def fits(self, left: int, right: int) -> bool:
        """Whether `left` followed by `right` survives the merges: no token across their border is made earlier."""
        key = (left, right)
        if (known := self.beside.get(key)) is not None:
            return known
        if len(self.beside) >= CACHE:
            self.beside.clear()
        limit, a, b, answer = 1 << 62, left, right, None
        while answer is None:
            joined = self.rank.get(self.token[a] + self.token[b], limit)
            if joined < limit:
                answer = False
                break
            # undo the later merge of the two, or the other if that one is a single byte: the border held before it, too
            for side in (0, 1) if a > b else (1, 0):
                inner = self.split(b)[0] if side else self.split(a)[1]
                if inner != (b if side else a):
                    limit, a, b = (b + 1, a, inner) if side else (a, inner, b)
                    break
            else:
                answer = True
        self.beside[key] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        choices: list[list[tuple[int, int]]] = [[] for _ in range(len(piece))]
        for last, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            choices[last + 1 - length].append((length, rank))
        for tokens in choices:
            tokens.sort(reverse=True)
        dead: set[int] = set()
        out: list[tuple[int, int, int]] = []  # place, number of the choice, rank
        at, pick = 0, 0
        while at < len(piece):
            for k in range(pick, len(choices[at])):
                length, rank = choices[at][k]
                if at + length not in dead and (not out or self.fits(out[-1][2], rank)):
                    out.append((at, k, rank))
                    at, pick = at + length, 0
                    break
            else:
                if not out:
                    return list(self._merged(piece, 1 << 62))
                dead.add(at)
                at, k, _ = out.pop()
                pick = k + 1
        return [rank for _, _, rank in out]

    def encode(self, text: str) -> str:
        """The ids as decimals joined by spaces."""
        return " ".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> ByteBpe:
    """One for all tasks of a Python worker."""
    return ByteBpe(path, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns per row of docs: id_col, ids (array of int; left out if ids is False), n_tokens long,
    ids_sha256 of the decimal ids joined by one space, decoded (binary; left out with ids), and
    decoded_sha256. A null text counts as empty: no ids, and the digests of nothing. Repeated rows and
    repeated ids give a row each; a null id stays null; columns other than id_col and text_col are not
    looked at. path is a tiktoken file that every machine has; pattern is its split pattern.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                n, sha, back, full, raw = [], [], [], [], []
                for text in part.column(1):
                    joined = bpe.encode(text.as_py() or "")
                    decoded = bpe.decode(joined)
                    n.append(joined.count(" ") + 1 if joined else 0)
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if ids:
                        full.append(np.fromstring(joined, np.int32, sep=" "))
                        raw.append(decoded)
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if ids:
                    arrays += [pa.array(full, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))
