"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is one token with which the encoding of
that prefix ends. The table of these last tokens is filled from left to right:
a token that ends at a position is the one if the BPE of its own bytes is itself
and if it may follow the last token of the prefix before it. Two tokens may be
neighbours if the BPE of their joined bytes is just these two. Walking the table
backwards gives the encoding; appending bytes only adds entries; an edit leaves
the entries before it as they are.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remember, slices

#: Pieces, byte prefixes and pairs of tokens remembered by a worker, characters of a piece worth remembering; beyond that the memory starts anew. Results don't depend on it.
PIECES, PREFIXES, NEIGHBOURS, LONG = 200_000, 200_000, 300_000, 64
#: Lengths that are always worth a look.
SHORT = (3, 2, 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class _Pieces(dict):
    """Encodings of pieces, (decimal ids, their bytes as int32), made when first asked for."""

    def __init__(self, owner: PrefixBPE):
        self.owner, self.older = owner, {}

    def __missing__(self, piece: str):
        if (got := self.older.get(piece)) is None:
            ids = self.owner.encode_piece(piece.encode())
            got = ",".join(map(str, ids)), array("i", ids).tobytes()
        if len(piece) <= LONG:
            self[piece] = got
        return got

    def age(self) -> None:
        """When full, what was made or used since the last time stays within reach."""
        if len(self) > PIECES:
            self.older = dict(self)
            self.clear()


class PrefixBPE:
    """Encoder and decoder for one vocabulary of ranks and one pre-split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.sizes: dict[bytes, set[int]] = {}
        for t in ranks:  # lengths of tokens by their last four bytes: few are worth a look at any position
            if len(t) > 3:
                self.sizes.setdefault(t[-4:], set()).add(len(t))
        self.sizes = {k: (*sorted(v, reverse=True), *SHORT) for k, v in self.sizes.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.prefixes: dict[bytes, int] = {}
        self.pieces = _Pieces(self)

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: the best-ranked neighbours first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's left and right end while its bytes merge.

        Two lists of (bytes, rank of the merge that swallows them), from the
        single byte to the token. None if the BPE of its bytes isn't the token.
        """
        if token not in self.edges:
            data, left, right = self.bytes_of[token], [], []
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.edges[token] = (left + [(data, 1 << 60)], right + [(data, 1 << 60)]) if len(parts) == 1 else None
        return self.edges[token]

    def may_follow(self, left: int, right: int) -> bool:
        """The BPE of the joined bytes is these two tokens: no merge across the border comes first.

        Of the tokens at the border the one with the better-ranked merge grows
        next, unless the pair across the border ranks better still (among equals
        the leftmost merge goes first).
        """
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) > NEIGHBOURS:
                self.fits.clear()
            a, b, rank = self.edge(left), self.edge(right), self.ranks.get
            known = a is not None and b is not None
            if known:
                xs, ys, i, j = a[1], b[0], 0, 0
                while True:
                    (x, rx), (y, ry) = xs[i], ys[j]
                    across = rank(x + y, 1 << 60)
                    if across < rx and across <= ry:
                        known = False
                        break
                    if rx == ry == 1 << 60:
                        break
                    if rx <= ry:
                        i += 1
                    else:
                        j += 1
            self.fits[left, right] = known
        return known

    def last_token(self, data: bytes, end: int, before) -> int:
        """The token that ends the encoding of ``data[:end]``; before(k): that of ``data[:k]``."""
        rank, known = self.ranks.get, self.fits.get
        for size in self.sizes.get(data[end - 4 : end], SHORT) if end > 3 else SHORT:
            if size < end:
                if (t := rank(data[end - size : end])) is not None:
                    p = before(end - size)
                    good = known((p, t))
                    if good or good is None and self.may_follow(p, t):
                        return t
            elif size == end and (t := rank(data[:end])) is not None and self.edge(t) is not None:
                return t
        raise ValueError("no token can end this prefix")

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (one token a prefix of ``data``) from where it ends; earlier entries stay."""
        for end in range(len(last) + 1, len(data) + 1):
            last.append(self.last_token(data, end, lambda k: last[k - 1]))
        return last

    def back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Encoding of one piece. Short pieces share their prefixes' entries in one table."""
        if (t := self.ranks.get(data)) is not None:
            return [t]
        if len(data) > 48:
            return self.back(self.extend(data, []))
        table, n = self.prefixes, len(data)
        if len(table) > PREFIXES:
            table.clear()
        have = n
        while have and data[:have] not in table:
            have -= 1
        # last_token() for each new prefix, written out: nearly all of the time goes here
        rank, known, sizes = self.ranks.get, self.fits.get, self.sizes.get
        for end in range(have + 1, n + 1):
            for size in sizes(data[end - 4 : end], SHORT) if end > 3 else SHORT:
                if size < end:
                    if (t := rank(data[end - size : end])) is not None:
                        p = table[data[: end - size]]
                        good = known((p, t))
                        if good or good is None and self.may_follow(p, t):
                            break
                elif size == end and (t := rank(data[:end])) is not None and self.edge(t) is not None:
                    break
            else:
                raise ValueError("no token can end this prefix")
            table[data[:end]] = t
        out, end, bytes_of = [], n, self.bytes_of
        while end:
            out.append(table[data[:end]])
            end -= len(bytes_of[out[-1]])
        return out[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Table of a piece after bytes are added to it; exact, and only the new prefixes cost."""
        return data + more, self.extend(data + more, list(last))

    def edit(self, data: bytes, last: list[int], at: int, size: int, new: bytes) -> tuple[bytes, list[int]]:
        """Table of a piece after ``data[at:at+size]`` became ``new``.

        Entries before ``at`` stay. After the edit an entry depends on the bytes
        and entries in reach of the longest token only; once that many in a row
        agree with the old ones, the old rest is taken over.
        """
        out, fresh, shift = data[:at] + new + data[at + size :], list(last[:at]), len(new) - size
        agree = 0
        while len(fresh) < len(out):
            self.extend(out[: len(fresh) + 1], fresh)
            old = len(fresh) - 1 - shift
            agree = agree + 1 if len(fresh) > at + len(new) and fresh[-1] == last[old] else 0
            if agree > 2 * self.longest:
                fresh += last[old + 1 :]
        return out, fresh

    def encode(self, text: str) -> list[int]:
        return [t for p in self.pattern.findall(text) for t in self.encode_piece(p.encode())]

    def by_pieces(self, text: str) -> list[tuple[str, bytes]]:
        """Encodings of the text's pieces: (decimal ids, their bytes as int32)."""
        known = self.pieces
        known.age()
        return list(map(known.__getitem__, self.pattern.findall(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def engine(path: str, pattern: str) -> PrefixBPE:
    """One engine a process, as long as the process serves this operator."""
    known = remember("bpe")
    if (path, pattern) not in known:
        known[path, pattern] = PrefixBPE(read_ranks(path), pattern)
    return known[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Encode whole texts, decode the ids again, and digest both.

    Columns: the id, those of ``keep``, n_tokens, ids (unless ``ids`` is False),
    ids_sha256 (hex of the decimal ids joined by commas), decoded_sha256 (hex of the
    decoded bytes). A null text counts as empty and has no tokens. Rows pass one
    by one: repeated rows give repeated results, other columns are ignored. The
    vocabulary file must be at ``path`` on every machine.
    """
    kinds = dict(docs.select(id_col, *keep).dtypes)
    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "n_tokens bigint", *(["ids array<int>"] if ids else []), "ids_sha256 string", "decoded_sha256 string"])
    names = [*kinds, "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches):
        e = engine(path, pattern)
        sha = hashlib.sha256
        for b in slices(batches):
            n, flat, sums, back = [], [], [], []
            for text in b.column(len(kinds)).to_pylist():
                got = e.by_pieces(text or "")
                own = array("i", b"".join([x[1] for x in got]))
                n.append(len(own))
                if ids:
                    flat.append(own.tobytes())
                sums.append(sha(",".join([x[0] for x in got]).encode()).hexdigest())
                back.append(sha(e.decode(own)).hexdigest())
            cols = [b.column(i) for i in range(len(kinds))] + [pa.array(n, pa.int64())]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32))))
            yield pa.RecordBatch.from_arrays(cols + [pa.array(sums, pa.string()), pa.array(back, pa.string())], names=names)

    return docs.select(id_col, *keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


__all__ = ["PrefixBPE", "bpe_encode", "engine", "read_ranks"]
