"""Batched encoding with the tokenizers library, cut at safe boundaries.

A pre-token of the byte-level pattern never ends in a space unless it is all white space. So between a visible
character and a single space before another visible character there is always a pre-token boundary, and the
encoding of a text is the concatenation of the encodings of what lies between such places. Texts are cut there,
every distinct piece is encoded once (in batches), and results are joined in text order. Pieces that recur are kept
in a table of bounded size. Special strings contain no space and so are never cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

#: Pieces kept; about 150 bytes each.
KEPT = 1_200_000
#: Pieces longer than this are encoded but not kept.
KEPT_CHARS = 48
#: Bytes of text (UTF-8) handled at once, and characters after which a text is cut.
BLOCK_BYTES = 1 << 20

CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: Between letters and digits, and between ideographs or kana and their punctuation, there is always a boundary, too.
CUT_WITHIN = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])(?=[\u3001\u3002\uff01\uff0c\uff1f])")
UNSAFE = re.compile(r" (?:(?![!-~\w])|(?<![!-~\w] ))")


def blocks(text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[bool, str]]:
    """text in parts of about `most` characters: (whether a space that was cut off stood before the part, the part).

    Parts begin at safe spaces, or where there is none for as long again at the other safe places; a text has no other
    part than itself only if it is all one pre-token, which no cut could keep.
    """
    start, spaced = 0, False
    while len(text) - start > most:
        m = CUT.search(text, start + most, start + 2 * most) or CUT_WITHIN.search(text, start + most) or CUT.search(text, start + 2 * most)
        if not m:
            break
        yield spaced, text[start : m.start()]
        start, spaced = m.end(), m.end() > m.start()
    yield spaced, text[start:]


def pieces(block: str) -> tuple[str, list[str]]:
    """The first piece as it stands, and the others without their leading space."""
    first, *rest = block.split(" ") if not UNSAFE.search(block) else CUT.split(block)
    return first, rest


#: Letters, then punctuation: two pre-tokens, or one.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-^`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others in order from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class ChunkEncoder:
    """Encodes texts; `make` turns a list of ids into a piece's value, `fold` joins the values of a text.

    Pieces that the table lacks are learned together, once for each block of text: words of letters by the tokenizer's
    own model, whose input they are but for the spelling of bytes, all others as one batch of its whole encoding.
    """

    def __init__(self, path: str, make, fold) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        self.make, self.fold, self.kept, self.tails, self.letters = make, fold, {}, {}, byte_letters()
        self.encode_batch = getattr(t, "encode_batch_fast", t.encode_batch)
        self.plain = isinstance(t.model, models.BPE) and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and t.normalizer is None

    def encoded(self, raw: list[str]) -> list:
        return [self.make(e.ids) for e in self.encode_batch(raw, add_special_tokens=False)] if raw else []

    def learn(self, words: list[str]) -> dict:
        """The value of each word with a space before it; a line feed before a word stands for none."""
        out, others, kept, make, tokenize = {}, [], self.kept, self.make, self.tokenizer.model.tokenize
        for word in words if self.plain else ():
            if word.isascii() and word.isalpha():
                out[word] = make([t.id for t in tokenize("\u0120" + word)])
            elif m := PLAIN.fullmatch(word):
                base, tail = m.groups()
                value = out.get(base) or kept.get(base)
                if value is None:
                    spelled = base if base.isascii() else base.encode().decode("latin-1").translate(self.letters)
                    value = out[base] = make([t.id for t in tokenize("\u0120" + spelled)])
                if tail:
                    if tail not in self.tails:
                        self.tails = self.tails if len(self.tails) < KEPT // 8 else {}
                        self.tails[tail] = self.encoded([tail])[0]
                    value = value + self.tails[tail]
                out[word] = value
            else:
                others.append(word)
        others = others if self.plain else words
        out.update(zip(others, self.encoded([w[1:] if w[:1] == "\n" else f" {w}" for w in others]), strict=True))
        return out

    def folded(self, texts: list[str]) -> list:
        """The folded values of each text."""
        out, held, size = [[] for _ in texts], [], 0
        for i, text in enumerate(texts):
            for spaced, block in blocks(text):
                first, rest = pieces(block)
                held.append((i, [first if spaced else f"\n{first}", *rest]))  # no piece after a space begins with a line feed
                size += len(block) if block.isascii() else len(block.encode())
                if size >= BLOCK_BYTES:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return list(map(self.fold, out))

    def _add(self, held: list[tuple[int, list[str]]], out: list[list]) -> None:
        words: set[str] = set()
        for _, pieces_ in held:
            words.update(pieces_)
        new = self.learn(list(words.difference(self.kept)))
        self.kept.update(new)
        value = self.kept.__getitem__
        for i, pieces_ in held:
            out[i].append(self.fold(map(value, pieces_)))
        for word in new:
            if len(word) > KEPT_CHARS:
                del self.kept[word]
        if len(self.kept) > KEPT:
            self.kept = {}


@lru_cache(maxsize=4)
def lengths(path: str) -> ChunkEncoder:
    """One encoder a Python worker: the worker is reused by later tasks."""
    return ChunkEncoder(path, len, sum)


@lru_cache(maxsize=4)
def id_bytes(path: str) -> ChunkEncoder:
    """Values are ids as little-endian unsigned 32-bit integers."""
    from array import array

    return ChunkEncoder(path, lambda ids: array("I", ids).tobytes(), b"".join)
