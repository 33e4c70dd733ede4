"""Localized values: maps from language tag to text, and messages made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def broadcast_tags(value: Column, tags: list[str]) -> Column:
    """MP1: one value under every tag."""
    return F.map_from_arrays(F.array(*map(F.lit, tags)), F.array_repeat(value, len(tags)))


def filled(m: Column, tags: list[str], main: str) -> Column:
    """MP1: every tag, missing ones from the main tag, else from the least tag that is there."""
    any_ = F.get(F.map_values(F.map_from_entries(F.slice(F.array_sort(F.map_entries(m)), 1, 1))), 0)
    return F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*[F.coalesce(F.try_element_at(m, F.lit(t)), F.try_element_at(m, F.lit(main)), any_) for t in tags]))


def get(m: Column, tag: Column | str) -> Column:
    """MP4: '' without an entry."""
    return F.coalesce(F.try_element_at(m, F.lit(tag) if isinstance(tag, str) else tag), F.lit(""))


def concat(a: Column, b: Column) -> Column:
    """MP2: a's tags only; what b lacks counts as empty."""
    return F.transform_values(a, lambda k, v: F.concat(v, F.coalesce(F.try_element_at(b, k), F.lit(""))))


def joined(a: Column, b: Column, by: str) -> Column:
    """MP3: all tags of both; the separator only between two texts."""
    return F.map_zip_with(a, b, lambda k, x, y: F.concat_ws(by, x, y))


def merge_docs(docs: Column, other: Column, tag: str) -> Column:
    """MP5: docs struct<abstract, discussion, params array<struct<name, text>>> of maps, with other's texts (plain
    strings) set under ``tag``. Parameters are matched by name; other's unknown names are ignored."""
    def put(m: Column, v: Column) -> Column:
        return F.when(v.isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != tag), F.create_map(F.lit(tag), v)))

    def param(p: Column) -> Column:
        new = F.get(F.filter(other["params"], lambda q: q["name"] == p["name"]), 0)["text"]
        return F.struct(p["name"].alias("name"), put(p["text"], new).alias("text"))

    return F.struct(put(docs["abstract"], other["abstract"]).alias("abstract"), put(docs["discussion"], other["discussion"]).alias("discussion"),
                    F.transform(docs["params"], param).alias("params"))


def reduce_by_key(entries: Column, add) -> Column:
    """MP6: array<struct<key, value>> folded into a map, values of one key by ``add``; keys in first-seen order."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def total(k: Column) -> Column:
        own = F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])
        return F.reduce(F.slice(own, 2, F.size(own)), F.get(own, 0), add)

    return F.map_from_arrays(keys, F.transform(keys, total))


def message(template: Column, *args: Column) -> Column:
    """MP7: %1 .. %n replaced by the arguments, the highest number first."""
    for i in range(len(args), 0, -1):
        template = F.replace(template, F.lit(f"%{i}"), F.coalesce(args[i - 1], F.lit("")))
    return template


def localized_message(bundle: Column, tag: Column, main: str) -> Column:
    """MP7: the template for a tag: the tag's, else the main tag's, else English, else ''."""
    return F.coalesce(F.try_element_at(bundle, tag), F.try_element_at(bundle, F.lit(main)), F.try_element_at(bundle, F.lit("en")), F.lit(""))
