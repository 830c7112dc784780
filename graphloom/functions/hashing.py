"""Hashes, positions in texts, and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_json(*fields: Column) -> Column:
    """Hash of a row as JSON with its fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def site_id(*parts: Column) -> Column:
    """Twenty hex digits of the hash of the parts."""
    return F.left(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), F.lit(20))


def line_of(text: Column, byte: Column) -> Column:
    """1-based line of a byte offset."""
    head = F.substr(F.encode(text, "UTF-8"), F.lit(1), byte)
    return F.octet_length(head) - F.octet_length(F.replace(F.decode(head, "UTF-8"), F.lit("\n"), F.lit(""))) + 1


def line_starts(text: Column) -> Column:
    """Byte offset of the start of each line."""
    sizes = F.transform(F.split(text, "\n"), lambda s: F.octet_length(s) + 1)
    first = F.array(F.lit(0))
    return F.aggregate(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))), first, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def utf16_of_byte(line: Column, byte: Column) -> Column:
    """UTF-16 column of a byte offset inside a line."""
    head = F.decode(F.substr(F.encode(line, "UTF-8"), F.lit(1), byte), "UTF-8")
    return F.octet_length(F.encode(head, "UTF-16BE")) / 2


def contains(start: Column, end: Column, point: Column) -> Column:
    return (start <= point) & (point < end)


def encloses(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (start <= inner_start) & (inner_end <= end)


def symbol_uid(path: Column, qualified: Column, occurrence: Column) -> Column:
    """path:qualified, with #k for the k-th declaration of the name."""
    return F.concat(path, F.lit(":"), qualified, F.when(occurrence > 1, F.concat(F.lit("#"), occurrence.cast("string"))).otherwise(""))
