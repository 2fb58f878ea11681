"""Text functions as built-in column expressions: tokenizer, names, files, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Function characters and two-character function words that retrieval ignores. Fixed values.
STOP_CHARS = "的一是在了有和与就这那也都而及或把被很个中上下为等对从到于之以其所者能会可要还但并"
STOP_BIGRAMS = (
    "可以 我们 你们 他们 它们 这个 那个 一个 没有 进行 以及 但是 因为 所以 如果 就是 什么 怎么 时候 自己 "
    "现在 已经 通过 对于 还有 不是 一些 相关 然后 这样 那样 起来 下来 出来 过去 东西 地方 事情 情况 需要 "
    "使用 能够 更加 非常 主要 包括 关于 由于 因此 其中"
).split()
#: File name extensions of media, and of documents by parser. Fixed values.
IMAGE_EXT = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "ico", "tiff")
VIDEO_EXT = ("mp4", "mov", "avi", "mkv", "webm", "flv", "wmv", "m4v", "ts")
PARSERS = {
    "text": ("txt", "md", "markdown"),
    "pdf": ("pdf",),
    "docx": ("docx", "doc"),
    "table": ("xlsx", "xls", "csv"),
    "pptx": ("pptx",),
    "html": ("html", "htm"),
    "epub": ("epub",),
}


def blank(c: Column) -> Column:
    """Null or white space only."""
    return c.isNull() | (F.regexp_replace(c, r"[\x00-\x20]+", "") == "")


def strip(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def round4(c: Column) -> Column:
    """Half up on the number line, to four places."""
    return F.floor(c * 10000 + F.lit(0.5)) / 10000


def tokens(c: Column) -> Column:
    """Prefixed tokens of a text, repeats kept: `w` words of ASCII letters and digits, lower-cased; over the text's Han characters
    alone, `c1` characters and `c2` pairs that aren't function words, and `c3` triples. Null has none."""
    text = F.coalesce(c, F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), 0), lambda w: F.concat(F.lit("w"), F.lower(w)))
    han = F.regexp_replace(text, "[^\\u4e00-\\u9fa5]", "")
    n = F.length(han)
    each = F.split(han, "")  # once: a substring counts characters from the begin

    def at(i: Column) -> Column:
        some = [F.get(each, i - 1 + k) for k in range(3)]
        one, two, three = some[0], F.concat(*some[:2]), F.concat(*some)
        return F.array(
            F.when(~F.lit(STOP_CHARS).contains(one), F.concat(F.lit("c1"), one)),
            F.when((i < n) & ~two.isin(STOP_BIGRAMS), F.concat(F.lit("c2"), two)),
            F.when(i + 1 < n, F.concat(F.lit("c3"), three)),
        )

    grams = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n), at)), lambda t: t.isNotNull())
    return F.concat(words, F.when(n > 0, grams).otherwise(F.array().cast("array<string>")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 with null, 1 for equal strings."""
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def fold_names(c: Column) -> Column:
    """Compatibility forms (full-width letters, ligatures) as plain ones: NFKC, which has no built-in. Where no name holds a character
    beyond ASCII, none travels to Python but an empty string."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(plain, c).otherwise(_folded(F.when(plain, "").otherwise(c)))


def normalize_name(c: Column) -> Column:
    """Lower-cased without white space and ASCII punctuation, compatibility forms folded."""
    return F.lower(F.regexp_replace(fold_names(F.coalesce(c, F.lit(""))), r"[\s\p{Punct}]+", ""))


def safe_file_name(c: Column) -> Column:
    return F.when(blank(c), "unnamed").otherwise(F.regexp_replace(c, r'[\\/:*?"<>|\s]+', "_"))


def file_ext(c: Column) -> Column:
    """Lower-cased text after the last dot; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"\.([^.]*)$", 1))


def parser_of(name: Column) -> Column:
    """The parser for a file name; null for unsupported files."""
    ext, out = file_ext(name), F.lit(None).cast("string")
    for parser, extensions in PARSERS.items():
        out = F.when(ext.isin(*extensions), parser).otherwise(out)
    return out


def media_kind(name: Column) -> Column:
    ext = file_ext(name)
    return F.when(ext.isin(*IMAGE_EXT), "image").when(ext.isin(*VIDEO_EXT), "video").otherwise("other")


def garbage_ratio(c: Column, head: int = 4000) -> Column:
    """Share of U+FFFD and control characters (but line feeds, returns and tabs) among the first characters."""
    text = F.substring(F.coalesce(c, F.lit("")), 1, head)
    bad = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f�]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(bad / F.length(text))


def mask_secret(c: Column) -> Column:
    """First and last four characters; **** alone for eight or fewer."""
    return F.when(c.isNull() | (c == ""), "").when(F.length(c) <= 8, "****").otherwise(F.concat(F.left(c, F.lit(4)), F.lit("****"), F.right(c, F.lit(4))))


def encrypt(c: Column, key: Column) -> Column:
    """A secret by AES-256-GCM with a nonce of 12 bytes before it, in Base64; null stays."""
    return F.base64(F.aes_encrypt(c.cast("string"), key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    """What encrypt() made; a wrong key fails the job, as tampering does."""
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def lenient_json(c: Column) -> Column:
    """From the first `{` to the last `}`, without trailing commas; null if there is no such span."""
    span = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(span != "", F.regexp_replace(F.regexp_replace(span, r",\s*\}", "}"), r",\s*\]", "]"))
