"""Toxicity by a fuzzy lexicon: Levenshtein automata intersected with the lexicon's trie catch misspelled terms, and
context windows tell quotation from abuse.

The lexicon is learned from labelled rows: words, and stems with several endings, that keep turning up in toxic rows in new
contexts and never in clean ones. Contexts are counted instead of occurrences, so that copies of one text count once.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import checkpointed, text_of
from knowlark.llm.quality import held_out, training_rows

TOKEN = re.compile(r"\w+")
STEMS = range(4, 9)
#: Words around a hit that tell what it is. Fixed values.
REPORTING = {"said", "says", "called", "calling", "quote", "quoted", "quotes", "term", "word", "phrase", "slur", "reported", "wrote", "writes", "dijo", "llamó", "palabra", "sagte", "nannte", "wort", "dit", "appelé", "mot"}
ADDRESS = {"you", "your", "youre", "u", "ur", "tu", "usted", "ustedes", "vosotros", "du", "dich", "dein", "ihr", "euch", "toi", "vous", "ton", "votre"}
QUOTES = "\"“”«»„‟‘’‹›「」『』"
SPAN = 6
#: What a hit weighs: a misspelled term as the term, but a little less than a sure one, and more than a quoted one; a word that only begins
#: as terms do is as sure as a quoted one, so that one alone decides nothing. Where another letter stands first, which is rarely a slip
#: and often another word, a misspelling counts by this share.
EXACT, FUZZY, QUOTED, STEM, FIRST = 1.0, 0.95, 0.625, 0.6, 0.5
#: Shortest term whose misspellings count, and how many clean words may be an edit from the beginning of a stem's words.
LOOSE, CROWD = 4, 3
#: Entries of a worker's memo of words before it is emptied.
MEMO = 1_000_000


State = frozenset[tuple[int, int, bool]]


@functools.cache
def _step(state: State, matches: tuple[bool, ...], edits: int) -> tuple[int, State]:
    """One transition of the parametric Levenshtein automaton: how far its base moves, and the state after a letter.

    A state holds positions (letters of the word after the base, edits so far, whether the first of two swapped letters was read);
    matches says which of the next letters from the base, at most 2 x edits + 2, are the one read. There are finitely many of both whatever
    the word, so the table of transitions is bounded.
    """
    out: set[tuple[int, int, bool]] = set()
    n = len(matches)
    for at, used, swapped in state:
        if swapped:
            if at < n and matches[at]:
                out.add((at + 2, used, False))
            continue
        if at < n and matches[at]:
            out.add((at + 1, used, False))
        if used < edits:
            out.add((at, used + 1, False))
            if at < n:
                out.add((at + 1, used + 1, False))
            for skip in range(1, edits - used + 1):
                if at + skip < n and matches[at + skip]:
                    out.add((at + skip + 1, used + skip, False))
            if at + 1 < n and matches[at + 1]:
                out.add((at, used + 1, True))
    base = min((at for at, _, _ in out), default=0)
    return base, frozenset((at - base, used, swapped) for at, used, swapped in out)


class Trie:
    """Terms by letter; whole words end in a node's `word`, stems match any word that begins with them."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.root: dict = {}
        for term, kind in [*((w, "word") for w in words), *((s, "stem") for s in stems)]:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[kind] = term

    def exact(self, word: str) -> str | None:
        """The whole word if it is a term, else the shortest stem that it begins with."""
        node, stem = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return stem
            stem = stem or node.get("stem")
        return node.get("word", stem)

    def fuzzy(self, word: str, edits: int = 1) -> set[str]:
        """Whole words of the trie within `edits` insertions, deletions, substitutions or swaps of neighbours of `word`, and stems
        within as many of a beginning of it: the trie's paths are read by the word's Levenshtein automaton, and a branch is left
        when no position is alive."""
        found: set[str] = set()
        size, window = len(word), 2 * edits + 2

        def walk(node: dict, base: int, state: State) -> None:
            for c, child in node.items():
                if len(c) != 1:
                    continue
                moved, after = _step(state, tuple(x == c for x in word[base : base + window]), edits)
                if not after:
                    continue
                at = base + moved
                if "word" in child and any(not swapped and used + size - at - k <= edits for k, used, swapped in after if at + k <= size):
                    found.add(child["word"])
                if "stem" in child and any(not swapped and at + k <= size for k, _, swapped in after):
                    found.add(child["stem"])
                walk(child, at, after)

        walk(self.root, 0, frozenset({(0, 0, False)}))
        return found


@dataclass
class Lexicon:
    """Terms with what their hits weigh, and the memo of words met. loose are the words whose misspellings count, roots the
    beginnings of words for which an edit in them does, known the clean words that look like a misspelling."""

    words: dict[str, float]
    stems: list[str]
    loose: list[str]
    bias: float = -4.0
    slopes: tuple[float, float] = (6.0, 0.0)
    roots: list[str] = field(default_factory=list)
    known: set[str] = field(default_factory=set)
    memo: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = Trie(list(self.words), self.stems)
        self.near = Trie(self.loose, self.roots)
        # Words an edit apart are equal after a letter is taken from one or both: what isn't in here needn't be read by the automaton.
        self.around = {w[:k] + w[k + 1 :] for w in self.loose for k in range(len(w))} | set(self.loose)
        self.sizes = {n for w in self.loose for n in (len(w) - 1, len(w), len(w) + 1)}
        # An edit leaves the first half of a root as it is, or what is beyond the letter after it; that is there or one letter off.
        self.begins = {r[: len(r) // 2] for r in self.roots}
        self.parts = {(len(r) // 2 + 1 + d, r[len(r) // 2 + 1 :]) for r in self.roots for d in (-1, 0, 1)}
        self.firsts, self.places = sorted({len(b) for b in self.begins}), sorted({(k, k + len(t)) for k, t in self.parts})

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "stems", "loose", "bias", "slopes", "roots", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def weight(self, word: str) -> float:
        """A term's own weight, STEM for a word that a stem or a misspelled one begins, for a misspelled term its weight up to FUZZY, else 0."""
        if (term := self.trie.exact(word)) is not None:
            return self.words.get(term, STEM)
        if word in self.known:
            return 0.0
        like_word = len(word) in self.sizes and (word in self.around or any(word[:k] + word[k + 1 :] in self.around for k in range(len(word))))
        like_root = any(word[:n] in self.begins for n in self.firsts) or any((k, word[k:e]) in self.parts for k, e in self.places)
        near = self.near.fuzzy(word) if like_word or like_root else ()
        return max((self._misspelled(word, t) for t in near), default=0.0)

    def _misspelled(self, word: str, term: str) -> float:
        own = min(FUZZY, self.words[term]) if term in self.words else STEM
        kept = word[0] == term[0] or word == term[1:] or word[:2] == term[1::-1]  # the first letter stays, is missing, or swapped
        return own if kept else own * FIRST

    def weights(self, words: list[str]) -> list[float]:
        memo = self.memo
        out = list(map(memo.get, words))
        if None in out:
            if len(memo) > MEMO:
                memo.clear()
            for k, w in enumerate(out):
                if w is None:
                    word = words[k]
                    if word not in memo:
                        memo[word] = self.weight(word)
                    out[k] = memo[word]
        return out

    def inputs(self, text: str | None) -> tuple[float, float, int]:
        """log(1 + weight of hits), their share among the words, and the number of hits."""
        lower = (text or "").lower()
        words = TOKEN.findall(lower)
        weights = self.weights(words)
        if not any(weights):
            return 0.0, 0.0, 0
        spans = [m.span() for m in TOKEN.finditer(lower)]
        total, hits = 0.0, 0
        for k, w in enumerate(weights):
            if w:
                total += w * _context(lower, words, spans, k)
                hits += 1
        return float(np.log1p(total)), total / len(words) ** 0.5, hits

    def score(self, text: str | None) -> float:
        x, y, _ = self.inputs(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slopes[0] * x + self.slopes[1] * y, -40, 40))))


def _context(lower: str, words: list[str], spans: list[tuple[int, int]], k: int) -> float:
    """What a hit counts where it stands: less in quotation marks or beside a reporting word, more in address."""
    near = words[max(0, k - SPAN) : k + SPAN + 1]
    before = lower[spans[max(0, k - SPAN)][0] : spans[k][0]]
    after = lower[spans[k][1] : spans[min(len(spans) - 1, k + SPAN)][1]]
    factor = 1.0
    if any(c in QUOTES for c in before) and any(c in QUOTES for c in after):
        factor *= 0.5
    if any(w in REPORTING for w in near):
        factor *= 0.6
    if any(w in ADDRESS for w in near):
        factor *= 1.25
    return factor


def _words(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """(word, before, toxic, row) of training rows, each once in a row; about `most` at a time."""

    def made(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["word", "before", "y", "row"])

    held: list[tuple[str, str, int, int]] = []
    for batch in batches:
        for y, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = TOKEN.findall(text.lower())
            held.extend((w, b, 1, row) for b, w in set(zip(["", *words], words, strict=False))) if y else held.extend((w, "", 0, row) for w in set(words))
            if len(held) >= most:
                yield made(held)
                held = []
    yield made(held)


def _guarded(batches: Iterator[pa.RecordBatch], words: list[str], stems: list[str], roots: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, word): terms and roots that are an edit from a word of clean rows, or from its beginning."""
    lexicon = Lexicon(dict.fromkeys(words, EXACT), stems, words, roots=roots)
    for batch in batches:
        near = [(t, w) for w in batch.column(0).to_pylist() if lexicon.trie.exact(w) is None and lexicon.weight(w) for t in lexicon.near.fuzzy(w)]
        term, word = zip(*near, strict=True) if near else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(word, pa.string())], ["term", "word"])


def learn(training: DataFrame, rows: int = 2, endings: int = 3, impure: float = 0.01, stray: float = 0.2, doubt: float = 0.2, family: int = 5) -> Lexicon:
    """A lexicon from (label, _text, doc_id).

    Contexts of a word are the different words before it. A word in toxic rows, at least `rows` of them, and in few clean ones
    (at most the share `stray` of its contexts) is a term if chance gives less than `doubt` of the words with its number of contexts:
    of N words in n rows, toxic rows being the share p of all words, N p^n would be in toxic rows alone. A term weighs the less the more
    of `doubt` that share and its share in clean rows use up. Where `endings` terms begin with the same `family` letters, further pure words of toxic rows that do are terms. A stem
    begins `endings` such words and is in clean rows for at most the share `impure`. What reaches the driver is the terms, which the sample of
    rows bounds. All terms of LOOSE letters and more count misspelled too, with what they weigh themselves; a clean word beside a term is
    no misspelling of it. Then the slopes are fitted.
    """
    tokens = training.select("label", "_text", F.xxhash64("doc_id").alias("row")).mapInArrow(_words, "word string, before string, y int, row long")
    toxic = tokens.groupBy("word", "before", "y").agg(F.min("row").alias("row"), F.count_distinct("row").alias("n"))
    counts = toxic.groupBy("word").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("contexts"),
        F.count_distinct(F.when(F.col("y") == 1, F.col("row"))).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("clean"),
    )
    counts = checkpointed(counts)
    pure = (F.col("contexts") > 0) & (F.col("clean") <= impure * F.col("contexts"))
    bad, good = counts.agg(F.sum("contexts"), F.sum("clean")).first()
    share = (bad or 0) / max(1, (bad or 0) + (good or 0))
    once = 64  # numbers of contexts beyond it count as one
    seen = {r["n"]: r["count"] for r in counts.where(pure).groupBy(F.least("contexts", F.lit(once)).alias("n")).count().collect()}
    all_ = {r["n"]: r["count"] for r in counts.groupBy(F.least(F.col("contexts") + F.col("clean"), F.lit(once)).alias("n")).count().collect()}
    weights = {n: 1 - min(1.0, all_.get(n, 0) * share**n / seen[n]) for n in seen}
    least = min((n for n in weights if all(weights[m] > 1 - doubt for m in weights if m >= n)), default=once)
    # A few clean rows may hold a term too: each must be made up for by two more contexts.
    mostly = (F.col("contexts") >= least + 2 * F.col("clean")) & (F.col("clean") <= stray * F.col("contexts"))
    chosen = counts.where(mostly & (F.col("rows") >= rows))
    # A term of doubtful purity weighs less than its purity: nothing where the doubt is all that is allowed.
    sure = lambda x: max(0.0, 1 - (1 - x) / doubt)
    words = {r["word"]: sure(weights.get(min(once, r["contexts"]), 1.0) * (1 - r["clean"] / r["contexts"])) for r in chosen.collect()}
    begin = Counter(w[:family] for w in words if len(w) > family)
    kin = [k for k, n in begin.items() if n >= endings]
    if kin:
        more = counts.where(pure & F.substring("word", 1, family).isin(kin) & (F.length("word") > family))
        words = {r["word"]: sure(1 - doubt / 2) for r in more.collect()} | words
    prefixes = F.explode(F.array(*(F.substring("word", 1, n) for n in STEMS))).alias("stem")
    grown = counts.where(F.length("word") >= STEMS[0]).select("word", "contexts", "rows", "clean", prefixes).distinct()
    by_stem = grown.groupBy("stem").agg(F.sum("contexts").alias("contexts"), F.sum("rows").alias("rows"), F.count(F.when(F.col("contexts") > 0, 1)).alias("endings"), F.sum("clean").alias("clean"))
    # Prefixes are as many as words, and each is tried once more: a little more evidence than for a word.
    found = by_stem.where(pure & (F.col("contexts") >= least + 2) & (F.col("rows") >= rows + 1) & (F.col("endings") >= endings))
    stems: list[str] = []
    for stem in sorted((r["stem"] for r in found.collect()), key=lambda s: (len(s), s)):
        if not any(stem.startswith(t) for t in stems):
            stems.append(stem)
    words = {w: x for w, x in words.items() if x > 0}
    loose = {w for w in words if len(w) >= LOOSE}
    roots: list[str] = []
    if stems:
        # A stem's pure words may be misspelled as any other, and so may what all of them begin with, whatever follows it.
        spark = training.sparkSession
        begun = grown.where(pure).join(F.broadcast(spark.createDataFrame([(t,) for t in stems], "stem string")), "stem")
        family_of: dict[str, list[str]] = defaultdict(list)
        for row in begun.select("stem", "word").collect():
            family_of[row["stem"]].append(row["word"])
        loose.update(w for ws in family_of.values() for w in ws if len(w) >= LOOSE)
        # With a letter missing it must still be as long as a stem.
        roots = sorted({t for ws in family_of.values() if len(t := commonprefix(ws)) > STEMS[0]})
    loose, known = sorted(loose), set()
    if loose:
        clean = counts.where("contexts = 0 or clean > 0").select("word")
        near = checkpointed(clean.mapInArrow(partial(_guarded, words=loose, stems=stems, roots=roots), "term string, word string").distinct())
        sizes = near.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        crowded = {r["term"] for r in sizes.where(F.col("n") >= CROWD).collect()}
        roots = [t for t in roots if t not in crowded]
        # Clean words of the sample, whose rows bound them.
        known = {r["word"] for r in near.where(F.col("term").isin(loose + roots)).select("word").distinct().collect()}
    lexicon = Lexicon(words, stems, loose, roots=roots, known=known)
    shared = training.sparkSession.sparkContext.broadcast(lexicon)
    fitted = training.select("label", "_text").mapInArrow(partial(_inputs, lexicon=shared), "y int, a double, b double").collect()
    lexicon.bias, lexicon.slopes = _slopes(np.array(sorted(tuple(r) for r in fitted), dtype=float).reshape(-1, 3))
    return lexicon


def _inputs(batches: Iterator[pa.RecordBatch], lexicon: object) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [lexicon.value.inputs(t)[:2] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], ["y", "a", "b"])


def _slopes(rows: np.ndarray, ridge: float = 0.02, steps: int = 50) -> tuple[float, tuple[float, float]]:
    """Bias and slopes of a logistic fit by Newton steps, slopes not below 0; without both labels, the defaults."""
    if not len(rows) or rows[:, 0].min() == rows[:, 0].max():
        return Lexicon.bias, Lexicon.slopes
    # Weak prior: one sure hit is abuse, misspelled or not and however long the text, and one in quotation isn't. Else, where every toxic
    # row of the sample has many hits, the bound would lie far above one.
    rows = np.concatenate([rows, [[1, np.log1p(0.9), 0.0], [0, np.log1p(QUOTED), 0.03]] * 5])
    y, x = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]])
    w = np.array([-2.0, 1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * ridge
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), (float(w[1]), float(w[2]))


def _scored(batches: Iterator[pa.RecordBatch], lexicon: object, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.array([lexicon.value.score(t) for t in batch.column(2).to_pylist()], dtype=float)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= threshold).

    The lexicon is learned from at most about `most` labelled rows outside the held-out fifth (parameter; their word counts
    stay distributed, and the terms reach the driver). Very long texts count whole. Null texts count as empty; a text without a hit
    gets the bias alone. Labels that are null or not 0 or 1 teach nothing; without toxic labels nothing is toxic.
    Repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    training = checkpointed(training_rows(docs, labels, label, most, id_col, text_col))
    lexicon = spark.sparkContext.broadcast(learn(training))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scored, lexicon=lexicon, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _clean(batches: Iterator[pa.RecordBatch], lexicon: object, threshold: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([lexicon.value.score(t) < threshold for t in batch.column(column).to_pylist()], pa.bool_()))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """docs without the rows that toxicity() predicts; rows and columns of the rest stay as they are, whatever the columns are called: null
    and empty texts stay, repeated rows stay or go together, and an empty table stays empty."""
    training = checkpointed(training_rows(docs, labels, label, most, id_col, text_col))
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(training))
    names = docs.columns
    own = docs.toDF(*(f"_column{k}" for k in range(len(names))))
    return own.mapInArrow(partial(_clean, lexicon=lexicon, threshold=threshold, column=names.index(text_col)), own.schema).toDF(*names)
