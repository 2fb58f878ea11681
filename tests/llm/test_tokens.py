"""Packing and alignment against the tokenizers' own libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from knowlark.llm import alignment, encoding, packing
from knowlark.llm import queries as registered
from knowlark.llm.encoding import blocks, byte_encoder, piece_encoder, word_encoder
from knowlark.llm.token_counts import byte_names
from tests.conftest import SF

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n", "a", "  x\ty <|endoftext|> <s> it's 12x", "数据库索引 12½ ²", "a\x1cb\x85c\xa0 d e", "▁x", "x\x00y", "Σας ΣΑΣ <|startoftext|>a", "é é  İstanbul 😀👍🏽 'S 's 'll",
    "a\n\nb  c\n d   ", "ﬁ ａ ｂ", "l'été. d’accord!!! $$$ abc###def", "word " * 9000, "nobreak" * 9000, "数" * 3000, "x" * 70, "🙂" * 500,
]


def texts():
    rnd = random.Random(9)
    letters = "abcé ß.,!?'\"\n\t 12数据Σ▁<|>_-🙂\xa0"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(300)]


@pytest.fixture(scope="module")
def libraries():
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    return word, byte, SentencePieceProcessor(model_file=PIECE)


def test_encoders(libraries):
    """Ids are the libraries', whether pieces are new or known."""
    word, byte, piece = libraries
    some = [t or "" for t in texts()]
    for encoder, given, want in (
        (word_encoder(WORD), some, [word.encode(t, add_special_tokens=False).ids for t in some]),
        (byte_encoder(BYTE), [" " + t for t in some], [byte.encode(" " + t, add_special_tokens=False).ids for t in some]),
        (piece_encoder(PIECE), [" " + t if t else "" for t in some], piece.encode(some)),
    ):
        for _ in range(2):
            got = []
            for part in blocks(given, 500):
                ids, tokens, sizes, _, counts = encoder.block(given[part])
                assert sizes.sum() == len(ids) == tokens.sum() and counts.sum() == len(sizes)
                got += np.split(ids, np.cumsum(tokens)[:-1])
            assert [g.tolist() for g in got] == want


def test_known_pieces(libraries, monkeypatch):
    """Pieces that come again are encoded once, also where the table is full time and again; ids stay the library's."""
    monkeypatch.setattr(encoding, "MEMO", 100)
    with open(BYTE, "rb") as file:
        encoder = encoding.ByteEncoder(file.read())
    asked, encode = Counter(), encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda pieces: asked.update(pieces) or encode(pieces))
    common = [f" {x}{y}" for x in "abcde" for y in "wxyz"]
    for k in range(40):
        some = ["".join(common + [f" {x}q{chr(97 + k % 26)}{chr(97 + k // 26)}" for x in "ghijklmnop"])] * 2
        ids, tokens, *_ = encoder.block(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(tokens)[:-1])] == [libraries[1].encode(t, add_special_tokens=False).ids for t in some]
    assert {asked[p] for p in common} == {1}


def test_looked_up(libraries):
    """The different words of a block are looked up once each, however often they stand in it."""
    encoder, asked = encoding.WordEncoder(word_encoder(WORD).rules), Counter()

    class Counted(encoding.Numbers):
        def __getitem__(self, piece):
            asked[piece] += 1
            return super().__getitem__(piece)

    encoder.memo.number = Counted()
    some = ["One two, three; it's two! 12 数 é " * 500, "two", ""]
    for _ in range(2):
        asked.clear()
        ids, tokens, *_ = encoder.block(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(tokens)[:-1])] == [libraries[0].encode(t, add_special_tokens=False).ids for t in some]
        assert len(asked) == 12 and set(asked.values()) == {1}


def test_words(libraries):
    """Texts that are cut together fall into the words of the tokenizer's pattern, for every character, apostrophes and special strings."""
    encoder, rnd = word_encoder(WORD), random.Random(4)
    given = texts() + ["".join(rnd.choice("'strevmldST !1é数\n") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    given += ["<|endoftext|><|startoftext|>'s", "'<|endoftext|>'ll<|endoftext|", "'", "''s'", "'l", "'r", "a'", "'LL'Re've", "<|ENDOFTEXT|>'t"]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    given += ["".join(f"a{chr(c)}'s{chr(c)}{chr(c)} " for c in points[k : k + 4096]) for k in range(0, len(points), 4096)]
    given = [t or "" for t in given]
    want = []
    for t in given:
        parts = encoder.cut.split(t)
        want.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else encoder.rules.pattern.findall(encoder.rules._normal(p)))])
    words, edges = encoder.words(given)
    words = [w.decode() for w in words.to_pylist()]
    assert [words[b:e] for b, e in zip(edges, edges[1:])] == want
    some = [t for t in given if len(t) < 100]
    ids, tokens, *_ = encoder.block(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(tokens)[:-1])] == [libraries[0].encode(t, add_special_tokens=False).ids for t in some]
    assert [len(x) for x in encoder.block([])] == [0] * 5 and [len(x) for x in encoder.block([""])] == [0, 1, 0, 0, 1]


@pytest.mark.parametrize("memo", [encoding.MEMO, 60])
def test_joint(libraries, monkeypatch, memo):
    """Both sides' ids are the libraries', by one cut and look-up, and texts whose tokens lack their bytes are told."""
    monkeypatch.setattr(encoding, "MEMO", memo)
    byte, piece = libraries[1:]
    joint, names = encoding.Joint(byte_encoder(BYTE), piece_encoder(PIECE)), byte_names()
    odd = ["a\tb \n c\x1cd\x85 \xa0e", "1\t2\t ", "x▁ y ▁z", " \n", "it's 'll\n's", "a\t" * 200_000, "\u3000 a\u3000b"]
    given = [" " + t if t else "" for t in [*texts(), *odd, *texts()]]
    assert all("".join(joint.CUT.findall(t)) == t for t in given)
    for part in blocks(given, 500):
        (a, b), good = joint.block(given[part])
        for k, t in enumerate(given[part]):
            want = byte.encode(t, add_special_tokens=False).ids, piece.encode(t[1:])
            raw = b"".join(bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i in want[1] for p in [piece.id_to_piece(i)])
            same = raw == t.encode() == b"".join(bytes(names[c] for c in byte.id_to_token(i)) for i in want[0])
            assert good[k] == same
            if same:
                assert tuple(ids[first[k] : first[k + 1]].tolist() for ids, first in (a, b)) == want


def test_long(libraries, monkeypatch):
    """A long text is cut at white space, so that a block's arrays stay small; ids stay the library's."""
    encoder, held = encoding.WordEncoder(word_encoder(WORD).rules), []
    words = encoder.words
    monkeypatch.setattr(encoder, "words", lambda some: held.append(sum(map(len, some))) or words(some))
    long = "It's <|endoftext|> \u0301 n\u0303 数据 x!\n" * 60_000
    given = ["short 's", long, "", long[:-1] + "end" * 200_000 + " 'll"]
    for some in ([given[0]], [given[1]], given):
        ids, tokens, sizes, _, counts = encoder.block(some)
        assert len(tokens) == len(counts) == len(some) and counts.sum() == len(sizes)
        for x, t in zip(np.split(ids, np.cumsum(tokens)[:-1]), some, strict=True):
            assert np.array_equal(x, libraries[0].encode(t, add_special_tokens=False).ids)
    assert len(held) > 10 and sorted(held)[-2] <= encoding.BLOCK + 100 and max(held) < 600_000 + encoding.BLOCK


def brute_cost(at, price, size, costs):
    """Least cost up to every edge, over all edges before it."""
    least = [0]
    for j in range(1, len(at)):
        ways = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= size:
                ways.append(least[i] + (0 if n.bit_count() == 1 else size - n))
        least.append(min(ways) + price[j] + costs.sequence)
    return least


def test_chosen():
    """The windows cost as little as any choice of edges does."""
    rnd = random.Random(2)
    for _ in range(300):
        size, costs = rnd.choice([8, 16, 21]), packing.Costs(sequence=rnd.randint(0, 4), sentence=rnd.randint(0, 3), word=5, stride=4, near=1)
        at = np.cumsum([0] + [rnd.randint(1, 4) for _ in range(rnd.randint(1, 40))])
        price = np.array([rnd.choice([0, costs.sentence, costs.word]) for _ in at])
        least = brute_cost(at.tolist(), price.tolist(), size, costs)
        cuts = packing.chosen(at, price, size, costs, True)
        assert cuts[0] == 0 and cuts[-1] == at[-1] and np.diff(cuts).max() <= size and np.diff(cuts).min() > 0
        kept = [c for c in cuts.tolist() if c in set(at.tolist())]
        want = min(least[j] + packing._rest(int(at[-1] - at[j]), size, costs)[0] for j in range(len(at)) if at[-1] - at[j] <= size)
        cost = 0
        for b, e in zip(cuts, cuts[1:]):
            n = int(e - b)
            cost += costs.sequence + (0 if n.bit_count() == 1 else size - n)
            if e in kept and e != cuts[-1]:
                cost += int(price[np.searchsorted(at, e)])
        # Edges of the rest need no place of their own and cost as cuts inside sentences do.
        assert cost <= want + int(price[-1]) + costs.word * len(cuts) and want <= least[-1]
        part = packing.chosen(at, price, size, costs, False)
        assert at[-1] - part[-1] <= size and set(part.tolist()) <= set(at.tolist()) and (len(part) == 1 or np.diff(part).max() <= size)
    ends, breaks = np.array([10, 300, 301]), np.array([3, 5, 10, 40, 300])
    every, price = packing.edges(ends, breaks, packing.Costs(near=1, stride=64))
    assert every.tolist() == [0, 3, 5, 10, 40, 104, 168, 232, 296, 300, 301] and price[[0, 3, -1]].tolist() == [0, 0, 0] and price[1] == 8 and price[5] == 64


def checked(pieces, docs, word, size):
    """Every document's ids lie in its pieces, and sequences are gapless."""
    ids = [word.encode(t or "", add_special_tokens=False).ids + [2] for _, t in docs]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for (i, _), x in zip(docs, ids):
        want[i].append(x)
    for i, rows in by_doc.items():
        tokens = sum(map(len, want[i]))
        assert sum(r["length"] for r in rows) == tokens
        if len(want[i]) == 1:
            at, whole = 0, []
            for r in sorted(rows, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == tokens and r["length"] > 0
                whole += np.frombuffer(r["ids"], "<u4").tolist()
                at += r["length"]
            assert whole == want[i][0]
    assert set(by_doc) == set(want)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at.bit_count() == 1 else size - at
    return padding / sum(map(len, ids))


@pytest.mark.parametrize("size,block", [(64, 1000), (4096, packing.BLOCK), (100, 5000)])
def test_pack(spark, libraries, size, block):
    """Odd and long texts, nulls, repeated rows and null ids; blocks that end inside documents."""
    docs = [(k if k % 7 else None, t) for k, t in enumerate(texts())] + [(5, "again")] * 20
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, start int, ids string").repartition(3)
    got = packing.pack(df, WORD, size=size, block=block)
    assert checked(got.collect(), docs, libraries[0], size) < 0.08
    whole = packing.sequences(got, size)
    for r in whole.collect():
        assert len(r["ids"]) == len(r["segments"]) == (r["n_tokens"] if r["n_tokens"].bit_count() == 1 else size)
        assert all(s == 0 for s in r["segments"][r["n_tokens"] :]) and 0 not in r["segments"][: r["n_tokens"]]
    assert whole.agg(F.sum("n_tokens")).first()[0] == got.agg(F.sum("length")).first()[0]
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_pack_query(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), WORD).collect()
    assert checked(got, docs, libraries[0], 4096) < 0.02
    found = registered.op11_packing(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    # Partitions differ between the two calls, and with them the cuts; whole documents have the same ids.
    whole = {r["doc_id"]: zlib.crc32(np.array(libraries[0].encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r, (_, t) in zip([{"doc_id": i} for i, _ in docs], docs)}
    assert all(r["ids_crc32"] == whole[r["doc_id"]] for r in found.where("start = 0 and length = doc_tokens").collect())


def brute_alignment(given, byte, piece):
    names, out, count = byte_names(), [], Counter()
    for text in given:
        a, b = (byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)) if text else ([], [])
        raw_a = [bytes(names[c] for c in byte.id_to_token(i)) for i in a]
        raw_b = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
        groups, x, y = [], 0, 0
        for c in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(c, x) + 1, ends_b.index(c, y) + 1
            groups.append(",".join(map(str, a[x:k])) + "|" + ",".join(map(str, b[y:m])))
            x, y = k, m
        links, x, y = [], 0, 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            x, y = x + (ends_a[x] <= ends_b[y]), y + (ends_b[y] <= ends_a[x])
        count.update(set(links))
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if o is None else (*o[:3], len(o[3]), sum(count[p] == most[p[0]] for p in o[3]), sum(count[p] for p in o[3]), o[4])
        for o in out
    ]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.mark.parametrize("window,records", [(alignment.WINDOW, 10_000), (7, 3), (64, 1), (1, 2)])
def test_align(spark, libraries, monkeypatch, window, records):
    """Odd texts in whole rows and in windows of few bytes and small batches, where documents and groups cross from one to the next."""
    monkeypatch.setattr(alignment, "WINDOW", window)
    monkeypatch.setattr(alignment, "DOCUMENTS", 512 if window > 99 else 5)
    given = [t if t is None or len(t) < 3000 or window > 9 else t[:400] for t in texts()]
    docs = spark.createDataFrame([(k if k % 5 else None, t, "x", 1) for k, t in enumerate(given)] + [(9000, "same text", "x", 1)] * 30, "doc_id long, text string, key string, block int").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        found = alignment.counted(docs, BYTE, PIECE).collect()
        plain = alignment.align(docs, BYTE, PIECE).collect()
        empty = alignment.counted(docs.limit(0), BYTE, PIECE).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = brute_alignment([*given, *["same text"] * 30], *libraries[1:])
    assert sorted((tuple(r[c] for c in NUMBERS), r["groups"]) for r in found) == sorted((w[:6], w[6]) for w in want)
    assert empty == 0 and sorted(r["groups"] for r in plain) == sorted(w[6] for w in want)
    for r in plain:
        assert sum(x["times"] for x in r["links"]) == r["n_links"] and len({(x["a"], x["b"]) for x in r["links"]}) == len(r["links"])


def test_align_memory(spark, monkeypatch):
    """No task holds two Python workers, and a block is bounded in documents and in characters."""
    docs = spark.createDataFrame([(k, "one two three " * (1000 if k % 50 == 7 else k % 9)) for k in range(1500)], "doc_id long, text string")
    stages = [[]]

    def walk(node, stage):
        if "Exchange" in node.nodeName():
            stages.append(stage := [])
        elif "InArrow" in node.nodeName():
            stage.append(node.nodeName())
        for k in range(node.children().size()):
            walk(node.children().apply(k), stage)

    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        walk(alignment.counted(docs, BYTE, PIECE)._jdf.queryExecution().executedPlan(), stages[0])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(map(len, stages)) >= 3 and max(map(len, stages)) == 1
    monkeypatch.setattr(alignment, "DOCUMENTS", 100)
    monkeypatch.setattr(alignment, "SPAN", 20_000)
    sizes, n = Counter(), Counter()
    for r in alignment.align(docs, BYTE, PIECE).join(docs, "doc_id").select("block", F.length("text").alias("size")).collect():
        sizes[r["block"]] += r["size"]
        n[r["block"]] += 1
    assert sum(n.values()) == 1500 and max(n.values()) <= 100 and max(sizes.values()) <= 20_000


def test_align_query(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute_alignment([r["text"] for r in docs], *libraries[1:]))}
    for r in registered.op12_alignment(spark, SF).collect():
        w = want[r["doc_id"]]
        assert tuple(r[c] for c in NUMBERS) == w[:6] and r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[2] else "")
