"""Chunking as built-in expressions: fixed size with sentence cuts, paragraphs, parent and child, table rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowlark.functions.text import blank, strip, unix_lines
from knowlark.operators.layout import numbered
from knowlark.operators.tiles import by_size

LOOKBACK = 120
#: Characters after which a chunk may end. Fixed values.
BOUNDARY = "。！？；.!?;\n"


def _filled(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def fixed_spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) from 0. A span ends after the last boundary among its last LOOKBACK characters if there is one, and
    the next begins `overlap` before that end, at least one later."""
    size = max(50, size)
    overlap = min(max(0, overlap), size // 2)
    n = F.length(text)
    step = size - LOOKBACK - overlap + 1
    rounds = (F.ceil(n / F.lit(step)) + 2).cast("int") if step > 0 else n
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def next_span(state: Column, _: Column) -> Column:
        start = state["start"]
        stop = F.least(start + size, n)
        look = F.greatest(start, stop - LOOKBACK)
        tail = F.substr(text, look + 1, stop - look)
        cut = F.length(F.regexp_extract(tail, "(?s)^.*[" + BOUNDARY + "]", 0))
        end = F.when((stop < n) & (cut > 0), look + cut).otherwise(stop)
        done = F.struct(n.alias("start"), state["spans"].alias("spans"))
        moved = F.struct(
            F.when(end >= n, n).otherwise(F.greatest(end - overlap, start + 1)).alias("start"),
            F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"),
        )
        return F.when(start >= n, done).otherwise(moved)

    first = F.struct(F.lit(0).alias("start"), empty.alias("spans"))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), first, next_span)
    return F.when(n > 0, walked["spans"]).otherwise(empty)


def _cut(clean: Column, size: int, overlap: int) -> Column:
    """Trimmed, non-empty chunks of a text with plain line feeds. clean should be a column or a lambda's variable: it is used
    in every step."""
    return _filled(F.transform(fixed_spans(clean, size, overlap), lambda s: F.substr(clean, s["start"] + 1, s["end"] - s["start"])))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def fixed(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Array of trimmed, non-empty chunks; none for a blank text."""
    return F.when(blank(text), F.array().cast("array<string>")).otherwise(_once(unix_lines(text), lambda c: _cut(c, size, overlap)))


def paragraphs(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Paragraphs (apart by blank lines) packed up to `size` characters, joined by a line feed; longer ones are cut by fixed()."""
    size = max(100, size)
    overlap = min(max(0, overlap), size // 2)
    parts = _filled(F.split(unix_lines(text), r"\n\s*\n"))
    none = F.array().cast("array<string>")

    def flushed(state: Column) -> Column:
        return F.when(state["buffer"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["buffer"])))

    def pack(state: Column, p: Column) -> Column:
        long_ = F.struct(F.concat(flushed(state), _cut(p, size, overlap)).alias("out"), F.lit("").alias("buffer"))
        apart = F.struct(flushed(state).alias("out"), p.alias("buffer"))
        joined = F.struct(state["out"].alias("out"), F.when(state["buffer"] == "", p).otherwise(F.concat_ws("\n", state["buffer"], p)).alias("buffer"))
        return F.when(F.length(p) > size, long_).when(F.length(state["buffer"]) + F.length(p) + 1 > size, apart).otherwise(joined)

    packed = F.aggregate(parts, F.struct(none.alias("out"), F.lit("").alias("buffer")), pack, flushed)
    return F.when(blank(text), none).otherwise(packed)


def parent_child(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Array of (child, parent): parents are fixed chunks, children a third of their size."""
    child = max(120, size // 3)
    inner = min(overlap, child // 2)
    return F.flatten(F.transform(fixed(text, size, overlap), lambda p: F.transform(_cut(p, child, inner), lambda c: F.struct(c.alias("child"), p.alias("parent")))))


STRATEGIES = {"fixed": fixed, "paragraph": paragraphs}
#: Characters from which a text is chunked by a plain loop: built-in strings are counted from their begin for each chunk, which takes time by
#: the square of a text's length, and many times the loop's already for texts of a few chunks.
LONG = 600
#: Characters of chunks, about, that a batch holds.
HELD = 1 << 21
_BLANK = "".join(map(chr, range(33)))


def _cut_long(text: str, size: int, overlap: int) -> list[str]:
    """fixed() for text with plain line feeds, in time by its length."""
    size = max(50, size)
    overlap = min(max(0, overlap), size // 2)
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = max(text.rfind(c, max(start, end - LOOKBACK), end) for c in BOUNDARY)
            end = cut + 1 if cut >= 0 else end
        if piece := text[start:end].strip(_BLANK):
            out.append(piece)
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def _long_chunks(text: str, name: str, size: int, overlap: int) -> list[tuple[str, str | None]]:
    """(content, parent) of a long text by strategy; the same as the built-in expressions give."""
    plain = re.sub("\r\n?", "\n", text)
    if name == "parent_child":
        child = max(120, size // 3)
        return [(c, p) for p in _cut_long(plain, size, overlap) for c in _cut_long(p, child, min(overlap, child // 2))]
    if name != "paragraph":
        return [(p, None) for p in _cut_long(plain, size, overlap)]
    size = max(100, size)
    overlap = min(max(0, overlap), size // 2)
    out: list[str] = []
    buffer = ""
    for p in filter(None, (x.strip(_BLANK) for x in re.split(r"\n[ \t\n\x0b\f\r]*\n", plain))):
        if len(buffer) + len(p) + 1 > size:
            out += [buffer] if buffer else []
            buffer = ""
        if len(p) > size:
            out += _cut_long(p, size, overlap)
        else:
            buffer = f"{buffer}\n{p}" if buffer else p
    return [(p, None) for p in [*out, *([buffer] if buffer else [])]]


def chunked(docs: DataFrame, strategy: str = "fixed", size: int = 600, overlap: int = 100, long: int = LONG) -> DataFrame:
    """(doc_id, position, content, parent) of docs (doc_id, text); parent is null but for parent_child. Unknown strategies
    are fixed. Texts of over `long` characters are cut by a loop in slices of Arrow batches, others by built-in expressions."""
    name = strategy.lower()
    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= long)
    if name == "parent_child":
        out = short.select("doc_id", F.posexplode(parent_child(F.col("text"), size, overlap)).alias("position", "c"))
        out = out.select("doc_id", "position", F.col("c.child").alias("content"), F.col("c.parent").alias("parent"))
    else:
        parts = STRATEGIES.get(name, fixed)(F.col("text"), size, overlap)
        out = short.select("doc_id", F.posexplode(parts).alias("position", "content")).withColumn("parent", F.lit(None).cast("string"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            made: list[tuple] = []
            places: list[int] = []
            ids: list[int] = []
            held = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                some = _long_chunks(text, name, size, overlap)
                made += some
                places += range(len(some))
                ids += [k] * len(some)
                held += sum(len(c) + len(p or "") for c, p in some)
                if made and (held > HELD or k + 1 == batch.num_rows):
                    content, parent = zip(*made, strict=True)
                    columns = [batch.column(0).take(pa.array(ids)), pa.array(places, pa.int32()), pa.array(content, pa.string()), pa.array(parent, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "content", "parent"])
                    made, places, ids, held = [], [], [], 0

    beyond = docs.where(F.char_length("text") > long).select("doc_id", "text")
    return out.unionByName(beyond.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, position int, content string, parent string"))


def table_markdown(rows: DataFrame, sheet: str, order: list[str], batch: int = 1000, columns: list[str] | None = None) -> DataFrame:
    """(batch, content): Markdown tables of `batch` rows each, with the header repeated; cells lose line feeds, `|` is escaped. order names
    columns without ties."""
    names = columns or rows.columns
    cell = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n", " "), r"\|", "\\\\|") for c in names]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |"))
    placed = numbered(rows.select(*(F.col(c).alias(f"_order{k}") for k, c in enumerate(order)), line.alias("line")), *(f"_order{k}" for k in range(len(order))))
    head = f"### Sheet: {sheet}\n\n| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
    grouped = placed.groupBy(((F.col("n") - 1) / batch).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return grouped.select("batch", F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("content"))


def table_json(rows: DataFrame, sheet: str) -> DataFrame:
    """One JSON object per row: the sheet, then every cell as a string, null cells empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns]
    return rows.select("*", F.to_json(F.struct(F.lit(sheet).alias("sheet"), *cells)).alias("content"))
