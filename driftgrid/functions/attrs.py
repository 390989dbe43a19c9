"""Attribute maps: dict-literal text, key filters, canonical keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The attribute keys that identify a resource.
RESOURCE_KEYS = (
    "host.name",
    "os.type",
    "process.command_line",
    "process.runtime.description",
    "process.runtime.name",
    "service.instance.id",
    "service.name",
)

# Bare words of a dict literal and their JSON spelling.
_BARE_WORDS = (("None", "null"), ("True", "true"), ("False", "false"))


def _outside_quotes(word: str) -> str:
    """Pattern for the next bare ``word``, passing over quoted text; group 1 is what precedes it."""
    quoted = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\""
    return rf"\G((?:[^'\"{word[0]}]++|{quoted}|{word[0]}(?!{word[1:]}\b))*+){word}\b"


def parse_attrs(text: Column) -> Column:
    """Dict-literal text to a map of strings; null where the text does not parse.

    Bare ``None``, ``True`` and ``False`` are respelled first; quoted text is left alone.
    """
    respelled = text
    for word, json_word in _BARE_WORDS:
        respelled = F.regexp_replace(respelled, _outside_quotes(word), f"$1{json_word}")
    has_word = text.rlike("|".join(word for word, _ in _BARE_WORDS))
    return F.from_json(F.when(has_word, respelled).otherwise(text), "map<string,string>")


def strip_backslash(text: Column) -> Column:
    """Remove backslashes from both ends."""
    return F.trim(text, F.lit("\\"))


def filter_attrs(attrs: Column, keys: Sequence[str] = RESOURCE_KEYS) -> Column:
    """Strip backslashes from keys and values, then keep the listed keys."""
    wanted = F.array(*[F.lit(k) for k in keys])
    clean = F.transform_keys(attrs, lambda k, _: strip_backslash(k))
    clean = F.transform_values(clean, lambda _, v: strip_backslash(v))
    return F.map_filter(clean, lambda k, _: F.array_contains(wanted, k))


def sort_attrs(attrs: Column) -> Column:
    """The same map with its entries in key order."""
    return F.map_from_entries(F.array_sort(F.map_entries(attrs)))


def slice_key(attrs: Column) -> Column:
    """A map as one text key, equal for equal maps whatever their entry order."""
    return F.to_json(sort_attrs(attrs), {"ignoreNullFields": "false"})


def canonical_attrs(text: Column) -> Column:
    """Attribute text in key order; text that does not parse is left as it is."""
    return F.coalesce(slice_key(parse_attrs(text)), text)


def resource_key(text: Column, keys: Sequence[str] = RESOURCE_KEYS) -> Column:
    """Slice key of a resource text: its listed attributes in key order, the raw text where it does not parse."""
    return F.coalesce(slice_key(filter_attrs(parse_attrs(text), keys)), text)


def short_key(key: Column) -> Column:
    """A fixed-length stand-in for long slice keys (command lines run to thousands of characters)."""
    return F.sha2(key, 256)


def join_key(*parts: Column) -> Column:
    """Composite text key ``a_b``."""
    return F.concat_ws("_", *parts)
