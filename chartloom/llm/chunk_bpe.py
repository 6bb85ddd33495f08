"""Exact BPE over white-space chunks, memoised, with token counts at every prefix.

The vocabulary file's pre-tokeniser never matches across white space and its normaliser never
composes across it, so a text's ids are the concatenation of its chunks' ids, and those of a chunk
of Latin characters are the concatenation of its pieces' ids. Each distinct piece goes through the
``tokenizers`` library's model once, each other distinct chunk through the whole library, while a memo, bounded in bytes,
holds it.

Prefix counts come from dynamic programming. Let ``open[i]`` be the last token of the encoding of a
piece's first i bytes without its word end, and ``close[i]`` the last token when the word ends
there. A BPE encoding is valid exactly when each neighbouring token pair is, so ``open[i]`` is the
one vocabulary token t ending at i whose pair (open[i-|t|], t) re-encodes to itself, and the count
at i is the count at i-|t| plus one.

Chunks that normalising reshapes, that hold a special string or a very long piece are walked
character by character (``_Walk``): the state is the last piece's end, as far back as a token can
reach, so time is linear in the chunk and memory is a few numbers per character. Only a base
character with very many combining marks costs the square of the number of its marks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import regex

from .common import worker_memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed values of the vocabulary file: its pre-tokeniser pattern, its contractions and its word-end mark.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = "stmd", {"'r": "e", "'v": "e", "'l": "l"}
WORD_END = "</w>"
#: Unicode white space besides blank and line feed.
ODD_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Characters that composing may touch, or that versions of Unicode or kinds of white space treat unlike: chunks with one stay whole.
ODD = re.compile("[^\t\n\r -~\xa1-\u012f\u0131-\u024f]")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind) for kind in "LN")
#: PIECES for text without odd characters, with the classes spelled out.
PLAIN_PIECES = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

#: Bytes that the memos of a Python worker may hold (ids; or steps of chunks and of pieces), and token pairs remembered.
IDS_BYTES, STEPS_BYTES, PIECES_BYTES, PAIRS_MEMO = 80 << 20, 96 << 20, 96 << 20, 300_000
#: Characters that are worked on at a time, and of a piece that is still worked on in whole.
SLICE_CHARS, LONG_PIECE = 1 << 20, 4096


class Memo:
    """Two generations of entries: a full one becomes the old one, and what is asked for again moves on."""

    def __init__(self, limit: int):
        self.new, self.old, self.size, self.limit = {"": b""}, {}, 0, limit // 2

    def missing(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that have to be put; all others can be read from ``new`` until the next call."""
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {"": b""}, 0
        keys, old = keys.difference(self.new), self.old
        for key in [k for k in keys if k in old]:
            self.put(key, old[key])
            keys.discard(key)
        return keys

    def put(self, key: str, value) -> None:
        self.new[key] = value
        self.size += 190 + len(key) + (len(value) if value else 0)


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE_CHARS characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _byte_alphabet() -> list[str]:
    """Byte-level BPE's printable stand-ins: printable bytes stay, the rest go above U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 0
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + spare)
            spare += 1
    return table


class ChunkBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab = spec["model"]["vocab"]
        #: Numbers of tokens by their symbols: those that end a word, and the others.
        self.final = {t.removesuffix(WORD_END): i for t, i in vocab.items() if t.endswith(WORD_END)}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(WORD_END)}
        self.tokens = {i: t for t, i in vocab.items()}
        self.start = (max(self.tokens) + 1) << 16  # what stands before the first token
        self.tokens[self.start >> 16] = ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.longest = max(map(len, [*self.final, *self.inner]))
        self.alphabet = _byte_alphabet()
        self.ids, self.steps, self.pieces = Memo(IDS_BYTES), Memo(STEPS_BYTES), Memo(PIECES_BYTES)
        self.pairs: dict[int, bool] = {}

    @cached_property
    def ending(self) -> tuple[dict[str, tuple[int | None, int | None]], dict[str, tuple[int, ...]]]:
        """Numbers of tokens that do not and that do end a word, by their symbols; and by what tokens end with (three
        symbols, or all of a shorter one), the lengths that a token ending there may have, the longest first."""
        symbols = self.inner.keys() | self.final.keys()
        numbers = {s: (self.inner.get(s), self.final.get(s)) for s in symbols}
        lengths: dict[str, set[int]] = {}
        for s in symbols:
            lengths.setdefault(s[-3:], set()).add(len(s))
        for tail in [t for t in lengths if len(t) == 3]:
            lengths[tail] |= {n for n in (1, 2) if tail[-n:] in symbols}
        for tail in [t for t in lengths if len(t) == 2]:
            lengths[tail].add(1)
        return numbers, {t: tuple(sorted(own, reverse=True)) for t, own in lengths.items()}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if ODD_SPACE.search(text):
            text = ODD_SPACE.sub(" ", text)
        return text.replace("\n", " ").split(" ")

    def _encoded(self, strings: list[str]):
        return self.lib.encode_batch_fast(strings, add_special_tokens=False)

    # ---- ids -----------------------------------------------------------------
    def text_ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return next(self.all_ids([text]))

    def all_ids(self, texts: list[str]) -> Iterator[bytes]:
        for own in self._known(texts):
            yield b"".join(own)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each whole text."""
        return [sum(map(len, own)) // 4 for own in self._known(texts)]

    def _known(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """The ids of each text's units."""
        for part in slices(texts):
            units = [self._units(t) for t in part]
            self._learn_ids(self.ids.missing(set().union(*units)))
            known = self.ids.new.__getitem__
            for own in units:
                yield map(known, own)

    def _units(self, text: str) -> list[str]:
        """Lower-cased pieces and whole odd chunks whose ids, one after the other, are those of the text."""
        if not ODD.search(text) and "<|" not in text:
            return PLAIN_PIECES.findall(text.lower())
        out, plain = [], []
        for chunk in self.chunks(text):
            if ODD.search(chunk) or "<|" in chunk:
                out += PLAIN_PIECES.findall(" ".join(plain).lower())
                out.append(chunk)
                plain = []
            else:
                plain.append(chunk)
        return out + PLAIN_PIECES.findall(" ".join(plain).lower())

    def _learn_ids(self, units: set[str]) -> None:
        whole, one, put = [], self.lib.model.tokenize, self.ids.put
        for unit in units:
            if ODD.search(unit) or "<|" in unit:
                whole.append(unit)
            else:
                tokens = one(unit if unit.isascii() else "".join([self.alphabet[b] for b in unit.encode()]))
                put(unit, struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens]))
        for chunk, e in zip(whole, self._encoded(whole), strict=True):
            put(chunk, np.array(e.ids, dtype="<u4").tobytes())

    # ---- prefix counts ---------------------------------------------------------
    def prefix_table(self, text: str) -> tuple[int, bytes]:
        return next(self.prefix_tables([text]))

    def prefix_tables(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(width, table) of each text: one signed step per character; a running sum gives the count at every prefix."""
        for part in slices(texts):
            chunks = [self.chunks(t) for t in part]
            new = self.steps.missing(set().union(*chunks))
            wide = self._learn_steps(new) if new else {}
            known = self.steps.new.__getitem__
            for own in chunks:
                if wide and not wide.keys().isdisjoint(own):
                    steps = [wide[c] if c in wide else np.frombuffer(known(c), "i1") for c in own]
                    yield 4, b"\0\0\0\0".join(s.astype("<i4").tobytes() for s in steps)
                else:
                    yield 1, b"\0".join(map(known, own))

    def _learn_steps(self, chunks: set[str]) -> dict[str, np.ndarray]:
        """Put the steps of these chunks into the memo; those that are no signed bytes come back instead."""
        split = [(chunk, self._split(chunk)) for chunk in chunks]
        new = list(self.pieces.missing({piece for _, own in split if own for piece in own}))
        counts = self._piece_counts(new)
        for piece, n in zip(new, self._totals(new), strict=True):
            own = counts[piece]
            self.pieces.put(piece, _steps(own if own[-1] == n else self._library_counts(piece)))
        wide, known = {}, self.pieces.new.__getitem__
        for chunk, own in split:
            got = own and list(map(known, own))
            if got and None not in got:
                self.steps.put(chunk, b"".join(got))
                continue
            steps = np.diff(self._walked_counts(chunk), prepend=0)
            if -128 <= steps.min() and steps.max() < 128:
                self.steps.put(chunk, steps.astype("i1").tobytes())
            else:
                wide[chunk] = steps
        return wide

    def _split(self, chunk: str) -> list[str] | None:
        """Pieces that tile a chunk; None if normalising reshapes it, or it holds a special string or a very long piece."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha() and len(low) <= LONG_PIECE:
                return [low]
        elif not unicodedata.is_normalized("NFC", chunk):
            return None
        else:
            low = "".join([c.lower() for c in chunk])  # a final sigma is no case of its own
            if len(low) != len(chunk):
                return None
        if "<|" in chunk and self.special and self.special.search(chunk):
            return None
        own = PIECES.findall(low)
        return own if sum(map(len, own)) == len(chunk) and max(map(len, own)) <= LONG_PIECE else None

    def _totals(self, pieces: list[str]) -> list[int]:
        """The library's number of tokens of each piece; the model alone tells those of plain letters, which nothing reshapes."""
        one, rest = self.lib.model.tokenize, [p for p in pieces if not (p.isascii() and p.isalpha())]
        whole = {p: len(e.ids) for p, e in zip(rest, self._encoded(rest), strict=True)}
        return [whole[p] if p in whole else len(one(p)) for p in pieces]

    def _library_counts(self, piece: str) -> list[int]:
        return [len(e.ids) for at in range(1, len(piece) + 1, 64) for e in self._encoded([piece[:k] for k in range(at, min(at + 64, len(piece) + 1))])]

    def _walked_counts(self, chunk: str) -> np.ndarray:
        """Tokens of chunk[:k] for k = 1..len(chunk), one character after the other."""
        out, total, at = [], 0, 0
        for m in self.special.finditer(chunk) if self.special else ():
            # up to its last character, a special string is ordinary text
            own = self._plain_counts(chunk[at : m.end() - 1])
            out += [total + c for c in own]
            total += (own[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(total)
            at = m.end()
        out += [total + c for c in self._plain_counts(chunk[at:])]
        return np.array(out, np.int64)

    def _plain_counts(self, text: str) -> list[int]:
        out, walk, at = [], _Walk(self), 0
        while at < len(text):
            end = at + 1
            while end < len(text) and _joins(text[end]):
                end += 1
            for k in range(at + 1, end):  # what comes next may change the last characters
                trial = walk.copy()
                trial.feed(text[at:k])
                out.append(trial.count())
            walk.feed(text[at:end])
            out.append(walk.count())
            at = end
        return out

    def _piece_counts(self, pieces: list[str]) -> dict[str, list[int]]:
        """Tokens of piece[:k] for k = 1..len(piece). In sorted order, neighbours share their common prefix's states."""
        jobs = []
        for piece in pieces:
            if piece.isascii() and piece.isprintable():
                jobs.append((piece, None, piece))
            else:
                marks = ["".join(self.alphabet[b] for b in c.encode()) for c in piece]
                jobs.append(("".join(marks), np.cumsum([len(m) for m in marks]).tolist(), piece))
        jobs.sort(key=lambda j: j[0])
        known, fits = self.pairs.get, self._fits
        numbers, lengths = (table.get for table in self.ending)
        out, before = {}, ""
        last, count, close = [self.start], [0], [0]  # by bytes of the prefix; filled up to len(before), open states to one less
        for sym, ends, piece in jobs:
            n, same = len(sym), 0
            top = min(n, len(before))
            while same < top and sym[same] == before[same]:
                same += 1
            ready = min(same, len(before) - 1) if before else 0
            del last[ready + 1 :], count[ready + 1 :], close[same + 1 :]
            stops = ends and set(ends)
            for i in range(ready + 1, n + 1):
                going, ending = i < n, i > same
                if ending:
                    close.append(0)
                    ending = stops is None or i in stops
                for size in lengths(sym[i - 3 : i] if i > 3 else sym[:i], (2, 1)):
                    j = i - size
                    two = numbers(sym[j:i]) if j >= 0 else None
                    if two is None:
                        continue
                    t, closing = two
                    if going and t is not None:
                        ok = known(last[j] + t)
                        if fits(last[j], t) if ok is None else ok:
                            last.append(t << 16)
                            count.append(count[j] + 1)
                            going = False
                    if ending and closing is not None:
                        ok = known(last[j] + closing)
                        if fits(last[j], closing) if ok is None else ok:
                            close[i] = count[j] + 1
                            ending = False
                    if not going and not ending:
                        break
            before = sym
            out[piece] = close[1:] if ends is None else [close[e] for e in ends]
        for cut in ("'re", "'ve", "'ll"):  # a cut contraction falls apart: "'r" of "'re" is two pieces
            if cut in out:
                out[cut] = [1, 2, out[cut][-1]]
        return out

    def _fits(self, left: int, t: int) -> bool:
        """Whether token ``t`` may follow the token whose number, 16 bits up, is ``left``; remembered."""
        if len(self.pairs) > PAIRS_MEMO:
            self.pairs.clear()
        a, b = self.tokens[left >> 16], self.tokens[t]
        ended = b.endswith(WORD_END)
        if ended and a:
            found = self.lib.model.tokenize(a + b.removesuffix(WORD_END))
            ok = self.pairs[left + t] = len(found) == 2 and found[0].id == left >> 16 and found[1].id == t
            return ok
        ok = self.pairs[left + t] = self._merge(a + b.removesuffix(WORD_END), ended) == ([a, b] if a else [b])
        return ok

    def _merge(self, sym: str, ended: bool) -> list[str]:
        parts = list(sym)
        if ended:
            parts[-1] += WORD_END
        rank, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            best = none
            for k, pair in enumerate(zip(parts, parts[1:])):
                r = rank(pair, none)
                if r < best:
                    best, at = r, k
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def _steps(counts: list[int]) -> bytes | None:
    """Differences as signed bytes, or None if one does not fit."""
    steps = [b - a for a, b in zip([0, *counts], counts)]
    return bytes([s & 255 for s in steps]) if min(steps) >= -128 and max(steps) < 128 else None


def _joins(c: str) -> bool:
    """Whether a character may compose or change places with those before it."""
    return c > "\u02ff" and (unicodedata.category(c) in ("Mn", "Mc") or unicodedata.combining(c) != 0 or "\u1160" <= c <= "\u11ff")


class _Walk:
    """A text read so far: tokens of its closed pieces, and the end of its last piece.

    ``sym`` holds the last piece's byte symbols as far back as a token reaches; ``last`` and ``held`` the last
    token and the number of tokens at each place between them. ``mark``: an apostrophe that began a piece,
    with the letter after it, while both may still be a contraction; ``before``: the tokens before it.
    """

    def __init__(self, bpe: ChunkBpe):
        self.bpe, self.closed, self.kind, self.mark, self.before = bpe, 0, "", "", 0
        self._begin("")

    def copy(self) -> _Walk:
        out = object.__new__(_Walk)
        out.__dict__.update(self.__dict__)
        out.last, out.held = list(self.last), list(self.held)
        return out

    def _begin(self, kind: str) -> None:
        self.kind, self.sym, self.last, self.held = kind, "", [self.bpe.start], [0]

    def count(self) -> int:
        return self.closed + (self._ended() if self.sym else 0)

    def _ended(self) -> int:
        """Tokens of the last piece if it ends here."""
        return self.held[self._place(self.bpe.final.get)[0]] + 1

    def _place(self, number) -> tuple[int, int]:
        """(start, token) of the last token up to here."""
        bpe, sym, n = self.bpe, self.sym, len(self.sym)
        for j in range(max(0, n - bpe.longest), n):
            t = number(sym[j:])
            if t is not None:
                ok = bpe.pairs.get(self.last[j] + t)
                if bpe._fits(self.last[j], t) if ok is None else ok:
                    return j, t
        raise ValueError("the vocabulary lacks a byte")

    def feed(self, text: str) -> None:
        for c in unicodedata.normalize("NFC", text):
            for low in c.lower():
                self._feed(low)

    def _feed(self, c: str) -> None:
        if self.mark == "'" and c in SHORT_CONTRACTIONS or LONG_CONTRACTIONS.get(self.mark) == c:
            whole = self.mark + c
            self._begin("")
            for x in whole:
                self._extend(x)
            self.closed, self.mark = self.before + self._ended(), ""
            self._begin("")
            return
        kind = unicodedata.category(c)[0]
        kind = kind if kind in "LN" else "O"
        mark = ""
        if kind != self.kind or kind == "N":
            if c == "'":
                mark = c
            elif self.mark == "'" and "'" + c in LONG_CONTRACTIONS:
                mark = "'" + c
            self.closed = self.count()
            self._begin(kind)
        if mark == "'":
            self.before = self.closed
        self.mark = mark
        self._extend(c)

    def _extend(self, c: str) -> None:
        for b in c.encode():
            self.sym += self.bpe.alphabet[b]
            j, t = self._place(self.bpe.inner.get)
            self.last.append(t << 16)
            self.held.append(self.held[j] + 1)
        back = self.bpe.longest
        if len(self.sym) > 4 * back:
            self.sym, self.last, self.held = self.sym[-back:], self.last[-back - 1 :], self.held[-back - 1 :]


def count_at(width: int, table: bytes, prefix: int) -> int:
    """Exact token count of the text's first ``prefix`` characters, from its stored table."""
    return int(np.frombuffer(table, "i1" if width == 1 else "<i4")[:prefix].sum())


def longest_prefix(width: int, table: bytes, budget: int) -> int:
    """Most characters whose token count stays within ``budget`` (counts may dip, so the last such prefix)."""
    counts = np.cumsum(np.frombuffer(table, "i1" if width == 1 else "<i4"), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if fits.size else 0


def loaded(path: str) -> ChunkBpe:
    """One instance, with its memos, per Python worker and vocabulary file, until another operator needs the room."""
    return worker_memo(("bpe", path), lambda: ChunkBpe(path))
