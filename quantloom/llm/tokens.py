"""Encoding of texts with a public byte-level BPE vocabulary.

Prefix dynamic programming: of every byte prefix of a piece the last token of its encoding is stored.
It is the only token that ends there, starts where another prefix's encoding ends, and may follow
that encoding's last token. The encoding is read off backwards; appending bytes leaves the
stored tokens as they are.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern, which cuts text into pieces that are encoded by themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes beyond the end of a piece that the pattern may look at.
LOOK_AHEAD = 3
#: Pieces a task remembers, and the longest of them.
CACHE, CACHE_BYTES = 200_000, 64


class Encoder:
    """Exact encodings by one vocabulary of ranked byte strings."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        self.suffixes = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one (a single byte: itself twice)."""
        found = self._halves.get(token)
        if found is None:
            whole = self.tokens[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                ranked = [(self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)]
                rank, i = min(ranked)
                if rank >= token:
                    raise ValueError(f"token {token} is not made by merges of lower rank")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[-1]])
            self._halves[token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side: no merge across the border comes before one inside them."""
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            known = self._follows[left, right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        # Undo merges from the last (highest rank) backwards; at each stage a merge across the border
        # of a lower rank than the merge just undone would have come first.
        limit = 1 << 62
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            single_left, single_right = len(self.tokens[left]) == 1, len(self.tokens[right]) == 1
            if not single_left and (single_right or left > right):
                limit, left = left, self.halves(left)[1]
            elif not single_right:
                limit, right = right + 1, self.halves(right)[0]  # at equal rank the leftmost merge comes first
            else:
                return True

    def last_tokens(self, piece: bytes, known: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """For each prefix of ``piece`` (from one byte on) its encoding's last token and that token's length.

        ``known`` holds the result for a shorter beginning of ``piece``, which is carried on.
        """
        last = list(known or [])
        done = len(last)
        reach = 128 if done else 0  # matches may begin in the part that is known
        offset = max(0, done - reach)
        while offset and done - offset < self.longest:
            offset = max(0, offset - reach)
        ending: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.suffixes.iter(piece[offset:].decode("latin-1")):
            if end + offset >= done:
                ending.setdefault(end + offset, []).append(found)
        for end in range(done, len(piece)):
            for token, length in sorted(ending.get(end, ()), key=lambda x: -x[1]):
                start = end - length
                if start == -1 or (start >= 0 and last[start] and self.may_follow(last[start][0], token)):
                    last.append((token, length))
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return last

    @property
    def longest(self) -> int:
        if not hasattr(self, "_longest"):
            self._longest = max(map(len, self.ranks))
        return self._longest

    def encode_piece(self, piece: str) -> list[int]:
        known = self._known.get(piece)
        if known is None:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            known = [whole] if whole is not None else self.read_off(self.last_tokens(raw))
            if len(raw) <= CACHE_BYTES:
                if len(self._known) >= CACHE:
                    self._known.clear()
                self._known[piece] = known
        return known

    @staticmethod
    def read_off(last: list[tuple[int, int]]) -> list[int]:
        out, end = [], len(last)
        while end > 0:
            token, length = last[end - 1]
            out.append(token)
            end -= length
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        known, encode = self._known, self.encode_piece
        out: list[int] = []
        for piece in self.split(text):
            out += known.get(piece) or encode(piece)
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class Encoding:
    """A text with its encoding, which follows appends and edits without starting anew."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.pieces: list[tuple[int, int, list[int]]] = []  # start, end, ids
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for _, _, ids in self.pieces for i in ids]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]``; pieces well before the edit, and those after it from where borders agree again, are kept."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        kept = [p for p in self.pieces if p[1] + LOOK_AHEAD <= start]
        behind = {p[0] + shift: i for i, p in enumerate(self.pieces) if p[0] >= end}
        pieces, at = kept, kept[-1][1] if kept else 0
        for m in self.encoder.matches(self.text, at):
            if m.start() >= start + len(new) and m.start() in behind:
                pieces += [(a + shift, b + shift, ids) for a, b, ids in self.pieces[behind[m.start()] :]]
                break
            pieces.append((m.start(), m.end(), self.encoder.encode_piece(m[0])))
        self.pieces = pieces


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def _texts(array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in array.to_pylist()]


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The ids of a text as ``array<int>``, without special tokens; empty for null and empty texts.

    Bytes that are not UTF-8 are read as the replacement character. Special tokens' names in a text are
    ordinary text. Texts are encoded whole, in time that grows with their length only.
    """

    @F.arrow_udf("array<int>")
    def ids(texts):
        import pyarrow as pa

        own = encoder(vocabulary)
        flat: list[int] = []
        ends = [0]
        for t in _texts(texts):
            flat += own.encode(t)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text.cast("binary"))


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of ids of a text; 0 for null and empty texts."""

    @F.arrow_udf("int")
    def counts(texts):
        import pyarrow as pa

        own = encoder(vocabulary)
        return pa.array([own.count(t) for t in _texts(texts)], pa.int32())

    return counts(text.cast("binary"))


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: one row per document. A map over the scan; nothing is shuffled."""
    return documents.select(F.col(id_col).alias("doc_id"), token_ids(F.col(text), vocabulary).alias("ids"))
