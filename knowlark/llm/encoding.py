"""Token ids of many texts by public tokenizers. Texts are cut into pieces that the tokenizer encodes independently of each other; each
different piece is encoded once by the tokenizer's own library and then looked up, and all the rest is array work."""

from __future__ import annotations

import codecs
import functools
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa

from knowlark.llm.token_counts import Transducer, byte_names, compiled

#: Pieces that a worker's table may hold, and a sixteenth of the ids, before it is thinned out.
MEMO = 300_000
#: Characters that are encoded at a time.
BLOCK = 1 << 18
#: White space to every tokenizer; no special string holds any.
BLANK = re.compile("[\t\n\r ]")


class Numbers(dict):
    """Pieces to their numbers, in the order in which they are first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Ids:
    """The ids of each number from 0, one number's after another's, and a mark."""

    def __init__(self) -> None:
        self.n, self.used, self.ids = 0, 0, np.zeros(1 << 16, np.uint32)
        self.begin, self.size, self.marked = (np.zeros(1 << 14, t) for t in (np.int64, np.int64, bool))

    def add(self, ids: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> None:
        n, total = self.n, len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(sizes) > len(self.begin):
            self.begin, self.size, self.marked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.marked))
        some = slice(n, n + len(sizes))
        self.size[some], self.begin[some], self.marked[some] = sizes, self.used + np.cumsum(sizes) - sizes, marks
        self.ids[self.used : self.used + total] = ids
        self.n, self.used = n + len(sizes), self.used + total

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of numbers one after another, how many each has, and their marks."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(total)], sizes, self.marked[at]

    def of(self, at: np.ndarray) -> Ids:
        made = Ids()
        made.add(*self.take(at))
        return made


class Memo:
    """A worker's table of pieces and their ids, on one side or more. Once it is full, the pieces that were met most since it last was stay,
    in half of it at most."""

    def __init__(self, sides: int = 1) -> None:
        self.number, self.met, self.sides = Numbers(), np.zeros(0, np.int64), [Ids() for _ in range(sides)]

    def numbers(self, cut: list[list[str]], encode: Callable[[list[str]], list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of texts' pieces, and where each text's begin and end. New pieces are encoded: ids, sizes and marks of each side."""
        edges = np.append(0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))
        return self.found(chain.from_iterable(cut), int(edges[-1]), encode), edges

    def found(self, pieces: Iterable, n: int, encode: Callable[[list], list[tuple]], which: np.ndarray | None = None) -> np.ndarray:
        """The numbers of n pieces; if `which` is given, of the pieces at these places, each piece looked up once."""
        if len(self.number) > MEMO or any(x.used > 16 * MEMO for x in self.sides):
            self._shrink()
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, n)
        if which is not None:
            at = at[which]
        if new := list(islice(reversed(self.number), len(self.number) - known))[::-1]:
            for side, made in zip(self.sides, encode(new), strict=True):
                side.add(*made)
        met = np.bincount(at, minlength=len(self.number))
        met[:known] += self.met
        self.met = met
        return at

    def _over_half(self, at: np.ndarray) -> bool:
        return 2 * len(at) > MEMO or any(2 * int(x.size[at].sum()) > 16 * MEMO for x in self.sides)

    def _shrink(self) -> None:
        least = 2
        while self._over_half(kept := np.flatnonzero(self.met >= least)):
            least *= 2
        names = list(self.number)
        self.number = Numbers((names[k], n) for n, k in enumerate(kept.tolist()))
        self.sides, self.met = [x.of(kept) for x in self.sides], np.zeros(len(kept), np.int64)


class Encoder:
    """Texts to ids. A tokenizer says how texts fall into pieces and how pieces are encoded; pieces must not depend on their neighbours."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self._start()

    def __getstate__(self) -> dict:
        return {"content": self.content}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._start()

    def _start(self) -> None:
        raise NotImplementedError

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def marks(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A fact about each piece that is kept beside its ids."""
        return np.zeros(len(pieces), bool)

    def made(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces' ids one after another, how many each has, and their marks."""
        rows = self.encode(pieces)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum()))
        return ids, sizes, self.marks(pieces, ids, sizes)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: their ids one after another, each text's number of ids, the pieces' sizes in ids, their marks, and each text's number of
        pieces."""
        at, edges = self.memo.numbers(list(map(self.pieces, texts)), lambda new: [self.made(new)])
        ids, sizes, marks = self.memo.sides[0].take(at)
        return ids, sums(sizes, edges), sizes, marks, np.diff(edges)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between edges, of which the first is 0 and the last the end."""
    return np.diff(np.append(0, np.cumsum(values))[edges])


def byte_sizes(texts: list[str]) -> np.ndarray:
    return np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts are held as strings beside their batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[slice]:
    """Slices of texts of about `most` characters; a longer text is alone."""
    begin = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def spaced(text: str, most: int = BLOCK) -> Iterator[str]:
    """A text in parts between white space, which they lack, of `most` characters and what is left of a word there."""
    begin = 0
    while len(text) - begin > most and (m := BLANK.search(text, begin + most)):
        yield text[begin : m.start()]
        begin = m.end()
    yield text[begin:]


#: The printable characters of the bytes in byte-level vocabularies, in the bytes' order.
NAMES = "".join(sorted(byte_names(), key=byte_names().get))


def merged(tokenizer: object, pieces: list[str]) -> list[list[int]]:
    """Ids of pieces by the library's own merges, without its splitting and normalising, which are done."""
    tokenize = tokenizer.model.tokenize
    # No text in UTF-8 holds the byte 255, which parts them.
    named = codecs.charmap_decode(b"\xff".join([p.encode("utf-8", "surrogatepass") for p in pieces]), "strict", NAMES)[0]
    return [[t.id for t in tokenize(p)] for p in named.split(NAMES[255])] if pieces else []


class WordEncoder(Encoder):
    """BPE with word ends over lower-cased text, with special strings inside texts as its library has them by default. Pieces are words; they
    are marked where a sentence ends.

    The texts of a block are cut together: the classes of their characters are looked up in a table, words begin where the class changes, and
    of the block's words the different ones alone are looked up."""

    SENTENCE = re.compile("[.!?…。！？]")
    SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)

    def __init__(self, rules: Transducer) -> None:
        self.rules = rules
        self._start()

    def __getstate__(self) -> dict:
        return {"rules": self.rules}

    def _start(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.rules.content)
        self.special = {s: self.tokenizer.token_to_id(s) for s in self.rules.special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kinds = np.full(sys.maxunicode + 1, self.OTHER, np.uint8)
        for kind, some in ((self.SPACE, self.rules.space), (self.LETTER, self.rules.letters), (self.NUMBER, self.rules.numbers)):
            for a, b in re.findall(r"\\?(.)-\\?(.)", some, re.DOTALL):
                self.kinds[ord(a) : ord(b) + 1] = kind
        self.memo = Memo()

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of texts in UTF-8, and where each text's begin and end among them."""
        parts, first, special = [], [], []
        for t in texts:
            first.append(len(parts))
            for k, part in enumerate(self.cut.split(t) if self.cut is not None and "<|" in t else (t,)):
                if k % 2:
                    special.append(len(parts))
                parts.append(part if k % 2 else self.rules._normal(part))
        joined = "\n".join([*parts, ""])  # what is beside a line end is cut as at a text's end
        edges = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[points]
        for k in special:
            kind[edges[k] : edges[k + 1] - 1] = self.SPECIAL
        begins = kind == self.NUMBER
        begins[:1] = True
        begins[1:] |= kind[1:] != kind[:-1]
        self._shorten(points, kind, begins)
        at = np.flatnonzero(begins)
        raw = joined.encode("utf-8", "surrogatepass")
        place = at
        if len(raw) > len(points):
            wide = (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            place = at + (np.cumsum(wide, dtype=np.int64) - wide)[at]
        runs = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(place, len(raw))), pa.py_buffer(raw)])
        word = kind[at] != self.SPACE
        return runs.filter(pa.array(word)), np.searchsorted(at[word], edges[[*first, -1]])

    def _shorten(self, points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
        """'s, 't, 're, 've, 'm, 'll and 'd are words where the apostrophe begins one."""
        at = np.flatnonzero((points == ord("'")) & (kind == self.OTHER) & begins)
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        begins[at + 1] = False
        begins[at + size] = True

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [list(spaced(t)) for t in texts]
        every = list(chain.from_iterable(parts))
        made = [self._short(every[some]) for some in blocks(every)] or [self._short([])]
        ids, tokens, sizes, marks, counts = made[0] if len(made) == 1 else map(np.concatenate, zip(*made, strict=True))
        first = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        return ids, sums(tokens, first), sizes, marks, sums(counts, first)

    def _short(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, edges = self.words(texts)
        found = words.dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self.memo.found(different, len(different), lambda new: [self.made([p.decode("utf-8", "surrogatepass") for p in new])], found.indices.to_numpy())
        ids, sizes, marks = self.memo.sides[0].take(at)
        return ids, sums(sizes, edges), sizes, marks, np.diff(edges)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        made = iter(merged(self.tokenizer, [p for p in pieces if p not in self.special]))
        return [[self.special[p]] if p in self.special else next(made) for p in pieces]

    def marks(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.fromiter((self.SENTENCE.search(p) is not None for p in pieces), bool, len(pieces))


class ByteEncoder(Encoder):
    """Byte-level BPE, special strings as plain text. Pieces are those of its splitting; marked where their tokens' bytes are not the piece's."""

    #: What texts of the quick pattern hold: printable ASCII, white space of it, Latin letters, general punctuation without spaces.
    QUICK = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-ɏ‐-‧]*")
    LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
    QUICK_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

    def _start(self) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.content.decode())
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        names = byte_names()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [bytes(names[c] for c in t) if all(c in names for c in t) else t.encode() for t in tokens]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.memo = Memo()

    def pieces(self, text: str) -> list[str]:
        return (self.QUICK_PIECE if self.QUICK.fullmatch(text) else self.pattern).findall(text)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return merged(self.tokenizer, pieces)

    def marks(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merging only joins bytes, so they are the piece's unless some are missing."""
        return sums(self.lengths[ids], np.append(0, np.cumsum(sizes))) != byte_sizes(pieces)


class PieceEncoder(Encoder):
    """Sentencepiece BPE over text with a space before it, which the library adds. Texts are cut before each run of spaces and around line
    ends, and between Latin letters and other characters, where no token of the vocabulary crosses; marked where the tokens' bytes are not
    the piece's. Texts begin with the space."""

    LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"

    def _start(self) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=self.content)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in names):
            raise ValueError("only vocabularies whose tokens hold spaces at their begin alone, and no line ends, are encoded in pieces")
        mixed = re.compile(f"[{self.LATIN}][^{self.LATIN}]|[^▁{self.LATIN}][{self.LATIN}]")
        whole = any(mixed.search(p) for i, p in enumerate(names) if not self.model.is_byte(i) and not self.model.is_control(i) and not self.model.is_unknown(i))
        self.split = re.compile(" *[^ \n]+|\n| +" if whole else f" *[{self.LATIN}]+| *[^ \n{self.LATIN}]+|\n| +")
        self.space = self.model.piece_to_id("▁")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.memo = Memo()

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text.replace("▁", " "))  # the same to the library; the bytes then aren't the text's

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """A piece that doesn't begin with a space is encoded behind a line end, whose two tokens and that of the space are dropped."""
        pieces = [p.replace("▁", " ") for p in pieces]
        made = self.model.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        return [[self.space] if p == " " else x if p[0] == " " else x[2:] for p, x in zip(pieces, made, strict=True)]

    def marks(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        tokens, edges = [self.bytes[i] for i in ids.tolist()], np.append(0, np.cumsum(sizes))
        wrong = sums(self.lengths[ids], edges) != byte_sizes(pieces)
        if wrong.any() or b"".join(tokens) != "".join(pieces).encode("utf-8", "surrogatepass"):
            ends = edges.tolist()
            return np.array([b"".join(tokens[s:e]) != p.encode("utf-8", "surrogatepass") for p, s, e in zip(pieces, ends, ends[1:], strict=False)])
        return wrong


class Joint:
    """Texts to ids of a byte-level encoder and a sentencepiece one at once, over texts that begin with a space. They are cut before the spaces and
    line ends that follow other characters than white space, where both encoders cut, and each piece is looked up once for both."""

    # What either encoder may take for white space: a cut is only where both agree. It is not given back, so that long texts take no stack.
    CUT = re.compile(r"[\s▁]*[^\s▁]++(?:(?![ \n])[\s▁]++[^\s▁]*+)*+|[\s▁]+")

    def __init__(self, a: ByteEncoder, b: PieceEncoder) -> None:
        self.a, self.b, self.memo = a, b, Memo(2)

    def __getstate__(self) -> dict:
        return {"a": self.a, "b": self.b}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _made(self, new: list[str]) -> list[tuple]:
        """A's ids by its own pieces, whose words come again with other signs around them; B's by whole pieces."""
        ids, tokens, _, marks, counts = self.a.block(new)
        return [(ids, tokens, sums(marks, np.append(0, np.cumsum(counts))) > 0), self.b.made(new)]

    def block(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of each side the ids, and where each text's begin and end; whether the tokens of both have a text's bytes."""
        at, edges = self.memo.numbers(list(map(self.CUT.findall, texts)), self._made)
        sides, wrong = [], np.zeros(len(texts), np.int64)
        for side in self.memo.sides:
            ids, sizes, marks = side.take(at)
            sides.append((ids, np.append(0, np.cumsum(sizes))[edges]))
            wrong += sums(marks, edges)
        return sides, wrong == 0


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(compiled(path))


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    with open(path, "rb") as file:
        return ByteEncoder(file.read())


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    with open(path, "rb") as file:
        return PieceEncoder(file.read())
