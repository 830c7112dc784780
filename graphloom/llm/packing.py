"""Best-fit packing planned on the histogram of lengths.

Texts become token pieces of at most ``CAPACITY`` tokens. Only the number of pieces of
each length (at most CAPACITY numbers) reaches the driver, which packs counts instead
of documents: best-fit decreasing, many equal sequences at a time. The plan says, for
each length, which ranks go to which sequences and offsets; pieces take their slots by
joining on (length, rank within length). Ranks come from counts per (length, bucket)
and a row number inside a bucket, so that a very common length is not one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import shared as S

CAPACITY = 2048
#: Pieces in a rank bucket, about.
BUCKET = 200_000
#: Tokens that the word cache of a task holds.
CACHE = 150_000
#: Plan rows that are broadcast at most.
PLAN_ROWS = 200_000

_LETTER, _NUMBER = "a-zA-Z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F", "0-9\xB2\xB3\xB9\xBC-\xBE"
#: How the vocabulary splits a lower-cased text of plain characters into words, each encoded on its own.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
#: Characters that are their own normal form and whose classes are those of the pattern above.
_PLAIN = re.compile("[\t\n\v\f\r\x20-\x7E\xA0-\u012F\u0131-\u024F\u2010-\u2027\u2030-\u203E\u20AC]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Words(dict):
    """Ids of words, as bytes; a word that is asked for the first time is encoded."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        self[word] = ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids


class WordEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, by a cache of words.

    Texts with characters outside the plain ones go through the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(known.__getitem__, _WORDS.findall(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = WordEncoder(path or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            _, offsets = S.text_bytes(batch.column("text"))
            for i, j in S.slices_of(offsets):
                part = batch.slice(i, j - i)
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + b"\0\0\0\0"
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((doc, p, at // 4, len(own) // 4, zlib.crc32(own)))
                d, p, s, n, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns rows (length, first rank, end rank, pieces per sequence, first sequence,
    offset) and the number of sequences: the piece of a length with rank r takes
    sequence ``first + (r - first rank) // pieces`` at ``offset + (r - first rank) %
    pieces * length``.
    """
    room: dict[int, list[list[int]]] = {}  # free tokens -> [first sequence, sequences]
    free = 0  # bit r is set where room[r] has sequences
    rows, n_seq = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = free >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                first, many = room[r].pop()
                if not room[r]:
                    free &= ~(1 << r)
            else:
                r, first, many = capacity, n_seq, -(-left // (capacity // length))
                n_seq += many
            m = min(r // length, left)
            take = min(many, left // m)
            rows.append((length, rank, rank + take * m, m, first, capacity - r))
            rank, left = rank + take * m, left - take * m
            for rest, a, n in ((r - m * length, first, take), (r, first + take, many - take)):
                if n and rest:
                    room.setdefault(rest, []).append([a, n])
                    free |= 1 << rest
    return rows, n_seq


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its ids in the vocabulary file ``tokenizer`` and an end
    token 0 (a null or empty text: the end token alone). Only documents of more than
    ``capacity`` tokens are cut, into pieces of ``capacity`` and a rest. Pieces of a
    sequence stand gapless from offset 0. Other columns are ignored; rows that repeat a
    doc_id, or have none, are packed like any other.
    """
    spark = docs.sparkSession
    made = S.cut(pieces(docs, tokenizer, capacity))
    histogram = made.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))
    slots = spark.createDataFrame(rows, "length long, first long, end long, many long, sequence long, at long")
    slots = F.broadcast(slots) if len(rows) <= PLAN_ROWS else slots
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    nth = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("many"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("many") * ranked["length"]).cast("long").alias("offset"))
