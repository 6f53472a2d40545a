"""Large texts into pieces at natural boundaries, by a bounded-quantifier pattern.

Each token of a text becomes one sign that tells how strong the boundary after it is: P paragraph, L
line, S sentence, w word, o inside a word, x inside a character. On this string one pattern, whose
alternatives go from strong to weak boundaries and consume up to the limit, yields the pieces; array
functions turn their lengths into token offsets, look back by the overlap, and cut the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filament.llm.tokens import TOKENIZER, encoder

LIMIT, OVERLAP = 512, 64
#: A character has at most 4 bytes, so a look-back that would cut one goes back 3 tokens at most.
_SLACK = 3

# Abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = {"M", "MM", "Mme", "Mlle", "Dr", "Pr", "Me", "art", "Art", "cf", "Cf", "n", "p", "St", "Mr", "Mrs", "Nr", "Sr", "Sra"}
_SENTENCE = re.compile(r"[.!?…]+[\"»”’)\]*]*(?=\s+[\"«“(\[*–—-]*\s*[A-ZÀ-ÞŒ0-9])|[。！？]+")
_LINE = re.compile("(?:\r\n|\n|\r|\u2028)[^\\S\r\n\u2028\u2029]*")
_PARAGRAPH = re.compile("(?:\r\n|\n|\r)[^\\S\r\n]*(?:\r\n|\n|\r)\\s*|\u2029\\s*")
_LAST_WORD = re.compile(r"\w*\Z")


def boundary_signs(text: str, ends: np.ndarray, safe: np.ndarray) -> str:
    """One sign per token; ``ends`` are character offsets after the tokens, ``safe`` whether one ends there."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    space = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0) | ((code >= 0x2000) & (code <= 0x200B)) | (code == 0x202F) | (code == 0x3000)
    word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | ((code >= 0xAA) & (code < 0x2000) & (code != 0xAB) & (code != 0xBB)) | (code >= 0x3040)
    kind = np.where(space, 0, np.where(word, 1, 2))
    mark = np.full(n + 1, ord("o"), np.uint8)
    mark[1:n][(kind[1:] != kind[:-1]) & (kind[:-1] != 0)] = ord("w")
    mark[n] = ord("w")
    for m in _SENTENCE.finditer(text):
        at = m.start()
        if text[at] == "." and _LAST_WORD.search(text[max(0, at - 6) : at]).group() in _ABBREVIATIONS:
            continue
        mark[m.end()] = ord("S")
    for m in _LINE.finditer(text):
        mark[m.end() - len(m.group()) + 1 : m.end() + 1] = ord("L")
    for m in _PARAGRAPH.finditer(text):
        mark[m.start() + 2 if len(m.group()) > 1 else m.end() : m.end() + 1] = ord("P")
    signs = mark[ends]
    signs[~safe] = ord("x")
    return signs.tobytes().decode("ascii")


def piece_pattern(limit: int, overlap: int) -> str:
    """The pattern whose successive matches are the pieces without what they repeat.

    Whatever is left goes whole if it fits. Else the longest match that ends at a paragraph, line or
    sentence end wins if it fills half the room, then any such end, then a word end, then any whole
    character. Matches have at least ``overlap`` tokens, so that the next piece can repeat these.
    """

    def cut(most: int, at: str) -> list[str]:
        low, half = min(overlap, most - 1), max(min(overlap, most - 1), most // 2)
        strong = [f"{at}.{{{half - 1 if half else 0},{most - 1}}}{s}" for s in "PLS"] + [f"{at}.{{{max(low - 1, 0)},{most - 1}}}{s}" for s in "PLS"]
        return [f"{at}.{{1,{most}}}$", *strong, f"{at}.{{{max(low - 1, 0)},{most - 1}}}w", f"{at}.{{{max(low - 1, 0)},{most - 1}}}[^x]"]

    return "|".join(cut(limit, "^") + cut(limit - overlap - _SLACK, ""))


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_no, text, n_tokens, first_token, last_token) of texts of more than ``limit`` tokens.

    Pieces count from 0; their token offsets are those of the whole text as it stands. Each piece but
    the first begins with the last ``overlap`` tokens of the one before (up to three more where a
    token boundary there would cut a character), and no piece has more than ``limit``. Joined without
    what they repeat, the pieces are the text. Texts within the limit, empty and null ones give no
    rows; repeated rows are split each; extra columns are ignored. A text whose bytes are within the
    limit cannot have more tokens and is not tokenized.
    """
    if overlap + _SLACK + 4 >= limit:
        raise ValueError("the overlap leaves no room")
    kind = documents.schema[key].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoder(tokenizer)
        for b in batches:
            at, signs, offsets = [], [], []  # offsets in bytes
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.encode_ordinary(t)
                if len(ids) <= limit:
                    continue
                raw = np.frombuffer(t.encode(), np.uint8)
                begins = np.append((raw & 0xC0) != 0x80, True)
                before = np.concatenate([[0], np.cumsum(begins[:-1])])
                stop = np.cumsum(sizes[ids])
                ends = before[stop]
                at.append(i)
                signs.append(boundary_signs(t, ends, begins[stop]))
                offsets.append(stop.astype(np.int32))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(signs, pa.string()), pa.array(offsets, pa.list_(pa.int32()))], names=["key", "text", "signs", "ends"])

    large = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > limit)
    marked = large.mapInArrow(mark, f"key {kind}, text string, signs string, ends array<int>")
    sizes = F.transform(F.regexp_extract_all("signs", F.lit(piece_pattern(limit, overlap)), F.lit(0)), lambda s: F.length(s))
    cut = marked.withColumn("sizes", sizes).withColumn("cuts", running("sizes"))
    # All pieces of a text as one array, from the text's bytes, so that only pieces leave this step.
    near = lambda i: F.get("cuts", i) - overlap
    back = lambda i: F.length(F.regexp_extract(F.substring(F.col("signs"), near(i) - _SLACK, F.lit(_SLACK + 1)), "x*$", 0))
    spans = F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda i: F.struct(i.alias("piece_no"), F.when(i == 0, 0).otherwise(near(i) - back(i)).alias("first_token"), F.get("cuts", i + 1).alias("last_token")))
    cut = cut.withColumn("spans", spans).withColumn("raw", F.col("text").cast("binary"))
    begin = lambda x: F.when(x["first_token"] == 0, 0).otherwise(F.get("ends", x["first_token"] - 1))
    stop = lambda x: F.get("ends", x["last_token"] - 1)
    pieces = F.transform("spans", lambda x: F.struct(x["piece_no"].alias("piece_no"), F.substring(F.col("raw"), begin(x) + 1, stop(x) - begin(x)).cast("string").alias("text"), (x["last_token"] - x["first_token"]).alias("n_tokens"), x["first_token"].alias("first_token"), x["last_token"].alias("last_token")))
    # No text here has no pieces; as an outer one the generator gets no filter that would compute them twice.
    return cut.select("key", pieces.alias("pieces")).select(F.col("key").alias(key), F.inline_outer("pieces"))


def running(sizes: str, block: int = 256) -> Column:
    """0 and the running sums of an array, in blocks, so that it costs n x block and not n x n."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    grow = lambda start, xs: F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    starts = grow(F.lit(0), F.transform(blocks, total))
    inner = F.transform(blocks, lambda xs, i: F.slice(grow(F.get(starts, i), xs), 2, F.size(xs)))
    return F.concat(F.array(F.lit(0)), F.flatten(inner))
