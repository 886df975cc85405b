"""Ids of texts by the tokenizers library.

Byte-level BPE merges only inside the pieces that its pattern splits a text
into.  A worker has the library's BPE model encode each distinct piece and keeps the
ids of up to ``CACHE_PIECES`` pieces, fewer between tasks; ids of a text are those of its pieces
in order.  As in the library, the tokenizer's added tokens are found first, each
gives its one id, and the texts between them are encoded by themselves.  Tests hold this
against the library's encoding of whole texts.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
from collections.abc import Callable

import regex

END_ID = 0
CACHE_PIECES = 400_000
#: What a worker keeps from one task to the next: the pieces that it met first, which are mostly the frequent ones.
KEPT_PIECES = 60_000


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


#: Texts of characters below this are split by a pattern of the standard library, which is faster.
NARROW = 0x250
_IS_WIDE = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of narrow characters, with its properties written out; none if it does not split all of them alike."""
    known = {x: "".join(re.escape(chr(c)) for c in range(NARROW) if regex.match(x, chr(c))) for x in (r"\p{L}", r"\p{N}", r"\s")}
    letters, numbers, spaces = known.values()
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, members in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
        out = out.replace(name, members)
    if r"\p" in out:
        return None
    found = re.compile(out)
    every = [chr(c) for c in range(NARROW)]
    samples = ["".join(every), *("".join(f"{a}{x}{b}" for x in every) for a in ("", " ", "a", "1", "'") for b in ("", " ", "  ", "z", "9", "!"))]
    return found if all(found.findall(x) == regex.findall(pattern, x) for x in samples) else None


class _Pieces(dict):
    """The ids of pieces, which are encoded when they are first asked for; when it is full, the half that was met first stays."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.keep(CACHE_PIECES // 2)
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def keep(self, most: int) -> None:
        first = list(itertools.islice(self.items(), most))
        self.clear()
        self.update(first)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        added = whole.get_added_tokens_decoder()
        # Tokens that take blanks or word bounds into account, or match normalised text, need the library's own matching.
        plain = {t.content: struct.pack("<I", i) for i, t in added.items() if not (t.single_word or t.lstrip or t.rstrip)}
        if len(plain) < len(added):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        self.added = plain
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(plain, key=len, reverse=True))) + ")").split if plain else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        narrow = narrow_pattern(public_tokenizers.PATTERN)
        self.split_narrow = narrow.findall if narrow else self.split
        self.letters = _byte_letters()
        self.cache = _Pieces(self._encode)

    def trim(self) -> None:
        """Called at the end of a task, so that idle workers hold little."""
        if len(self.cache) > KEPT_PIECES:
            self.cache.keep(KEPT_PIECES)

    def _encode(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def whole(self, text: str) -> bytes:
        """The ids that the library gives a text, added tokens among them, as little-endian unsigned 32-bit integers."""
        if self.parts is None or not any(t in text for t in self.added):
            return self.raw(text)
        return b"".join(self.added[x] if k % 2 else self.raw(x) for k, x in enumerate(self.parts(text)))

    def raw(self, text: str) -> bytes:
        """The ids of a text in which added tokens are ordinary text."""
        return b"".join(map(self.cache.__getitem__, (self.split if _IS_WIDE(text) else self.split_narrow)(text)))


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One encoder for each path and worker."""
    return PieceEncoder(path)
