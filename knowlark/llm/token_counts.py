"""Token counts by a compiled tokenizer: a deterministic transducer whose transitions carry emitted-token counts.

A BPE encoding is valid exactly if each pair of neighbouring tokens is (merging their symbols gives them back), so the last
token of every prefix is determined by the prefix tokens before it. A state of the transducer is therefore what later bytes can still
depend on: for each begin from which some token could still be running, its place in the vocabulary's trie, the last token before it, and how
many tokens the present count is ahead of the count there. States are finite; their transitions, (state, byte) to (state, change of the
count), are determinised when first met and kept in one table, as are those of a word's last byte, which ends the run.

White space resets the state. A long text is cut into chunks, counted by different tasks; a chunk's state map is what it does to the
states at its edges (the open head and tail, and the count between), and maps compose associatively, in a tree for each text.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import bound_for, checkpointed, join_unique, text_of

#: Characters of a chunk, and of a text from which chunks are counted by different tasks.
CHUNK, LONG = 1 << 16, 1 << 18
#: Entries that a worker's tables may hold before they are emptied.
MEMO = 1_000_000
#: Planes of Unicode that hold assigned characters other than private ones.
PLANES = (0, 1, 2, 3, 14)


def _ranges(points: list[int]) -> str:
    """Sorted code points as ranges of a character class."""
    out, k = [], 0
    while k < len(points):
        e = k
        while e + 1 < len(points) and points[e + 1] == points[e] + 1:
            e += 1
        out.append(f"{re.escape(chr(points[k]))}-{re.escape(chr(points[e]))}")
        k = e + 1
    return "".join(out)


def classes(tokenizer) -> tuple[str, str, str]:
    """Letters, numbers and white space as the tokenizer's own Unicode tables have them: how it splits `a` and each character twice."""
    letters, numbers, space = [], [], []
    points = [c for p in PLANES for c in range(p << 16, (p + 1) << 16) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 1 << 15):
        some = points[begin : begin + (1 << 15)]
        sizes: dict[int, list[int]] = {}
        for _, (b, e) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}{chr(c)} " for c in some)):
            sizes.setdefault(b // 4, []).append(e - b)
        for k, c in enumerate(some):
            found = sizes.get(k)
            if found == [3]:
                letters.append(c)
            elif found == [1, 1, 1]:
                numbers.append(c)
            elif found == [1]:
                space.append(c)
    return _ranges(letters), _ranges(numbers), _ranges(space)


@functools.cache
def newer() -> re.Pattern[str]:
    """Characters that Python's Unicode tables don't have yet: texts with any are normalised by the tokenizer's library."""
    return re.compile(f"[{_ranges([c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == 'Cn'])}]")


#: Characters up to the first that Python's tables lack; a text of these alone needn't be searched for newer ones.
OLD = re.compile("[\x00-\u0377]*")
#: Lower-cased ASCII, Latin-1 and Latin Extended letters, all of them letters of one block after another; texts of these and
#: ASCII alone take a pattern with short classes, which is several times as fast.
LATIN = "a-z\xdf-\xf6\xf8-\u024f"
LATIN_ONLY = re.compile(f"[\x00-\x7f{LATIN}]*")
LATIN_WORD = re.compile(f"[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r 0-9{LATIN}]+")


@functools.cache
def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes for the characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memo(dict):
    """Counts of words, found on demand; emptied when full."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.find(key)
        return value


class Transducer:
    """Compiled from a tokenizer file of merges with word ends. Other kinds of model or normaliser are refused."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.content, spec = content, json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
            raise ValueError("only BPE models with the word end </w> are compiled")
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only the normaliser NFC, white space, lower case is compiled")
        names, vocab = byte_names(), model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        skip = set(self.special)
        for name, i in vocab.items():
            if name not in skip:
                end = name.endswith("</w>") and len(name) > 4
                table = self.final if end else self.inner
                table[bytes(names[c] for c in (name[:-4] if end else name))] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = {made: pair for pair, (_, made) in self.merges.items()}
        if len(self.split) < len(self.merges):
            raise ValueError("only vocabularies in which each token is made by one merge are compiled")
        self.symbols = {i: (b, False) for b, i in self.inner.items()} | {i: (b, True) for b, i in self.final.items()}
        # The trie of all tokens: (node, byte) to node, and the token that ends at a node inside a word and at its end.
        self.child: dict[int, int] = {}
        self.ends: list[list[int]] = [[-1], [-1]]
        for kind, table in enumerate((self.inner, self.final)):
            for raw, i in table.items():
                node = 0
                for x in raw:
                    key = node << 8 | x
                    if key not in self.child:
                        self.child[key] = len(self.ends[0])
                        self.ends[0].append(-1)
                        self.ends[1].append(-1)
                    node = self.child[key]
                self.ends[kind][node] = i
        self.branches = {key >> 8 for key in self.child}  # nodes that some token goes on from
        self.letters, self.numbers, self.space = classes(Tokenizer.from_str(content))
        self._start()

    def _start(self) -> None:
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.letters}]+|[{self.numbers}]|[^{self.space}{self.letters}{self.numbers}]+")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pairs = Memo(self._stand)  # by first token << 20 | second token; the first of a word has no token before it
        self.edges = Memo(self._edge)
        self.words = Memo(self.count_word)
        self.normaliser = None
        self._empty()

    def _empty(self) -> None:
        """The transition table without any transition; state 0 begins a word."""
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.last: dict[int, int] = {}

    def __getstate__(self) -> dict:
        made = ("pattern", "cut", "pairs", "edges", "words", "normaliser", "states", "number", "moves", "last")
        return {k: v for k, v in vars(self).items() if k not in made}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._start()

    def _letters(self, token: int) -> list[int]:
        raw, end = self.symbols[token]
        out = [self.inner[raw[k : k + 1]] for k in range(len(raw))]
        if end:
            out[-1] = self.final[raw[-1:]]
        return out

    def _edge(self, key: int) -> list[int] | None:
        """Of a token << 1 | side: the symbols that stand at its right (side 1) or left edge while its letters are merged; None if they don't
        merge to it. Each token is made by one merge alone."""
        token, side = key >> 1, key & 1
        if self._merged(self._letters(token)) != [token]:
            return None
        out = [token]
        while out[-1] in self.split:
            out.append(self.split[out[-1]][side])
        return out

    def _stand(self, pair: int) -> bool:
        """Whether two tokens may stand together: their letters merge to these two again. Without a merge across their edges they do."""
        a, b = pair >> 20, pair & 0xFFFFF
        right = self.edges[b << 1]
        if a < 0 or right is None:
            return right is not None
        left = self.edges[a << 1 | 1]
        if left is None:
            return False
        if any((x, y) in self.merges for x in left for y in right):
            return self._merged(self._letters(a) + self._letters(b)) == [a, b]
        return True

    def _merged(self, tokens: list[int]) -> list[int]:
        """Plain merging, to compile the pairs that may stand together."""
        while len(tokens) > 1:
            best = min(((self.merges[p][0], k) for k in range(len(tokens) - 1) if (p := (tokens[k], tokens[k + 1])) in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            tokens = [*tokens[:k], self.merges[tokens[k], tokens[k + 1]][1], *tokens[k + 2 :]]
        return tokens

    def _ended(self, state: int, byte: int, kind: int) -> tuple[int, int]:
        """The last token after a byte from a state, and the change of the count; exactly one of the running tokens may end here."""
        for node, before, ahead in reversed(self.states[state]):  # the longest first: it mostly is the one
            at = self.child.get(node << 8 | byte)
            token = -1 if at is None else self.ends[kind][at]
            if token >= 0 and self.pairs[before << 20 | token]:
                return token, 1 - ahead
        raise ValueError("the vocabulary lacks a byte")

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Determinise one transition."""
        token, change = self._ended(state, byte, 0)
        child, inner = self.child, self.branches
        running = [(at, before, ahead + change) for node, before, ahead in self.states[state] if (at := child.get(node << 8 | byte)) is not None and at in inner]
        new = ((0, token, 0), *running)
        target = self.number.get(new)
        if target is None:
            target = self.number[new] = len(self.states)
            self.states.append(new)
        found = self.moves[state << 8 | byte] = target, change
        return found

    def count_word(self, word: str) -> int:
        """Tokens of one word: the transducer's run over its bytes."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(self.moves) + len(self.last) > MEMO:
            self._empty()
        state = count = 0
        moves = self.moves
        for x in raw[:-1]:
            state, change = moves.get(state << 8 | x) or self._move(state, x)
            count += change
        key = state << 8 | raw[-1]
        if key not in self.last:
            self.last[key] = self._ended(state, raw[-1], 1)[1]
        return count + self.last[key]

    def _normal(self, text: str) -> str:
        """NFC and lower case, as the tokenizer has them."""
        if text.isascii():
            return text.lower()
        if not OLD.fullmatch(text) and newer().search(text):
            if self.normaliser is None:
                from tokenizers import Tokenizer

                self.normaliser = Tokenizer.from_str(self.content).normalizer
            return self.normaliser.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count_plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        text = self._normal(text)
        words = (LATIN_WORD if LATIN_ONLY.fullmatch(text) else self.pattern).findall(text)
        return sum(map(self.words.__getitem__, words))

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """What a chunk does in any state: (open head, tokens between, open tail), or the chunk if it has no blank."""
        first = chunk.find(" ")
        if first < 0:
            return chunk
        end = chunk.rfind(" ")
        return chunk[:first], self.count_plain(chunk[first:end]), chunk[end + 1 :]

    def compose(self, a, b):
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.count_plain(a[2] + b[0]) + b[1], b[2]

    def composed(self, maps: list) -> int:
        """Tokens of the text whose chunks have these maps in this order."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        whole = maps[0]
        return self.count_plain(whole) if isinstance(whole, str) else self.count_plain(whole[0]) + whole[1] + self.count_plain(whole[2])

    def parts(self, text: str) -> list[str]:
        """The text between special strings, each of which is one token."""
        return self.cut.split(text) if self.cut is not None and "<|" in text else [text]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        parts = self.parts(text or "")
        return len(parts) - 1 + sum(map(self.count_plain, parts))


@functools.cache
def compiled(path: str) -> Transducer:
    with open(path, encoding="utf-8") as file:
        return Transducer(file.read())


def _counted(batches: Iterator[pa.RecordBatch], transducer: object, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        tokens = [transducer.value.count(t) for t in texts]
        sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def _pieces(batches: Iterator[pa.RecordBatch], transducer: object, chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunks of long texts: (key, part, piece, chunk). Parts lie between special strings."""
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [(key, p, k, part[k : k + chunk]) for p, part in enumerate(transducer.value.parts(text)) for k in range(0, max(1, len(part)), chunk)]
            columns = zip(pa.schema([("key", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("chunk", pa.string())]), zip(*rows, strict=True), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in columns], ["key", "part", "piece", "chunk"])


def _mapped(batches: Iterator[pa.RecordBatch], transducer: object) -> Iterator[pa.RecordBatch]:
    """The chunks' state maps; a chunk without a blank has a head alone and no count."""
    for batch in batches:
        maps = [transducer.value.chunk_map(c) for c in batch.column(3).to_pylist()]
        head, count, tail = zip(*((m, None, None) if isinstance(m, str) else m for m in maps), strict=True) if maps else ((),) * 3
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(head, pa.string()), pa.array(count, pa.int64()), pa.array(tail, pa.string())], ["key", "part", "piece", "head", "count", "tail"])


def _composed(maps: pa.Table, transducer: object) -> pa.Table:
    """One row: the tokens of a text, from its chunks' maps in order."""
    parts: dict[int, list] = {}
    for r in maps.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist():
        parts.setdefault(r["part"], []).append(r["head"] if r["count"] is None else (r["head"], r["count"], r["tail"]))
    total = len(parts) - 1 + sum(map(transducer.value.composed, parts.values()))
    return pa.table({"key": [maps.column("key")[0].as_py()], "n_tokens": pa.array([total], pa.int64())})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path names a tokenizer file that the driver reads; executors get the compiled transducer by broadcast. Null texts count as empty: no
    bytes, no tokens. Each row is counted for itself, so repeated rows repeat; an empty table gives an empty result; other columns
    are ignored. Workers keep bounded tables of transitions, words and pairs that they met. Nothing is shuffled but texts of over `long`
    characters, once each, in chunks; their repeated rows share one count.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(compiled(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.char_length("_text") <= long)
    counted = short.mapInArrow(partial(_counted, transducer=shared, limit=limit), f"doc_id {kind}, n_bytes long, n_tokens long")
    keyed = rows.where(F.char_length("_text") > long).select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("key"), "_text")
    slim = checkpointed(keyed.drop("_text"))
    if n := slim.count():
        once = keyed.select("key", "_text").dropDuplicates(["key"])
        pieces = once.mapInArrow(partial(_pieces, transducer=shared, chunk=chunk), "key string, part long, piece long, chunk string")
        maps = pieces.repartition("key", "part", "piece").mapInArrow(partial(_mapped, transducer=shared), "key string, part long, piece long, head string, count long, tail string")
        totals = checkpointed(maps.groupBy("key").applyInArrow(lambda t: _composed(t, shared), "key string, n_tokens long"))
        counted = counted.unionByName(join_unique(slim, totals, "key", bound_for(n, spark), "inner").drop("key"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
