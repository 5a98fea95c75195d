"""Constructed trees: elements with attributes, text, nested elements and copies of nodes, one tree for each binding."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.sources.forest import FIELDS


@dataclass(frozen=True)
class Attribute:
    """Its atoms are joined by spaces; without any text there is no attribute."""

    name: str
    atoms: tuple[Column, ...]


@dataclass(frozen=True)
class Text:
    """Neighbouring atoms are joined by spaces; texts follow each other without."""

    atoms: tuple[Column, ...]


@dataclass(frozen=True)
class Copy:
    """The subtree of the node that a variable is bound to, under new ids."""

    var: str


class Element:
    """``Element(name, attribute, .., content, ..)``; attributes come first and have different names."""

    def __init__(self, name: str, *content: Attribute | Text | Copy | Element) -> None:
        self.name = name
        self.attributes = [c for c in content if isinstance(c, Attribute)]
        self.content = [c for c in content if not isinstance(c, Attribute)]
        names = [a.name for a in self.attributes]
        if len(set(names)) < len(names):
            raise ValueError(f"XQDY0025: duplicate attribute in {name}: {', '.join(names)}")
        if list(content[: len(names)]) != self.attributes:
            raise ValueError(f"XQTY0024: attribute after other content in {name}")


def joined(atoms: tuple[Column, ...], by: str = " ") -> Column:
    """Atoms as one text; empty ones (null) leave nothing behind."""
    return F.concat_ws(by, *[a.cast("string") for a in atoms])


def _attrs(e: Element) -> Column:
    pairs = [x for a in sorted(e.attributes, key=lambda a: a.name) for x in (F.lit(a.name), joined(a.atoms))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "") if pairs else F.create_map().cast("map<string,string>")


def _merged(content: list) -> list:
    """Content with neighbouring texts as one; in an element that holds no other content they are its value."""
    out: list = []
    for c in content:
        if isinstance(c, Text) and out and isinstance(out[-1], list):
            out[-1].append(c)
        else:
            out.append([c] if isinstance(c, Text) else c)
    return out


def _places(e: Element, mixed: bool, names: tuple[str, ...] = (), pos: tuple[int, ...] = ()) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], Element | Copy | list]]:
    """Each item with the names and the positions that lead to it. Texts count for positions, not for names, so that what
    is between them keeps its id."""
    yield names, pos, e
    content, i = _merged(e.content) if mixed else [c for c in e.content if not isinstance(c, Text)], 0
    for at, child in enumerate(content):
        if isinstance(child, list):
            if len(content) > 1:
                yield (*names, f"t{at}"), (*pos, at), child
            continue
        if isinstance(child, Element):
            yield from _places(child, mixed, (*names, str(i)), (*pos, at))
        else:
            yield (*names, str(i)), (*pos, at), child
        i += 1


def constructed(bound: DataFrame, key: Column, doc: Column, tree: Element, nodes: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    """The nodes of ``tree`` for each row of ``bound``: ids are ``key`` and the places that lead to the node.

    Every element of the tree is one projection; copies join the forest (``nodes``) on the copied node's document and id.
    ``mixed``: texts beside elements are nodes of kind ``text`` where they stand, none where they are empty; else an
    element's texts are gathered as its value. ``key`` must name each row. An empty ``bound`` gives no nodes.
    """
    null, parts = F.lit(None).cast("string"), []
    name_of = lambda p: F.concat(key, *[F.lit(f".{i}") for i in p]) if p else key
    for names, places, item in _places(tree, mixed):
        ids = [name_of(names[:n]) for n in range(len(names) + 1)]
        pos = [F.lit(0).cast("long"), *[F.lit(i).cast("long") for i in places]]
        if not isinstance(item, Copy):
            text = isinstance(item, list)
            texts = item if text else [c for c in item.content if isinstance(c, Text)] if not mixed or len(_merged(item.content)) == 1 else []
            value = F.nullif(F.concat(*[joined(t.atoms) for t in texts]), F.lit("")) if texts else null
            made = bound.select(
                doc.alias("doc"), ids[-1].alias("id"), (ids[-2] if names else null).alias("parent_id"), F.array(*ids).alias("path"), F.array(*pos).alias("pos"), pos[-1].alias("ord"),
                F.lit("text" if text else "element").alias("kind"), F.lit("#text" if text else item.name).alias("name"), (F.create_map().cast("map<string,string>") if text else _attrs(item)).alias("attrs"), value.alias("value"),
            )
            parts.append(made.where("value is not null") if text else made)
            continue
        at = F.col(item.var)
        own = bound.select(doc.alias("_doc"), F.array(*ids[:-1]).alias("_up"), F.array(*pos[:-1]).alias("_pos"), pos[-1].alias("_ord"), ids[-1].alias("_own"), at["doc"].alias("_in"), at["id"].alias("_of"), F.size(at["path"]).alias("_depth"))
        inside = nodes.select("*", F.explode("path").alias("_up_to"))
        found = own.join(inside, (F.col("_in") == F.col("doc")) & (F.col("_of") == F.col("_up_to")))
        new = lambda i: F.concat(F.col("_own"), F.lit("."), i)
        below = F.slice("path", F.col("_depth"), F.size("path"))
        top = F.col("id") == F.col("_of")
        parts.append(found.select(
            F.col("_doc").alias("doc"), new(F.col("id")).alias("id"), F.when(top, F.element_at("_up", -1)).otherwise(new(F.col("parent_id"))).alias("parent_id"),
            F.concat("_up", F.transform(below, new)).alias("path"), F.concat("_pos", F.array("_ord"), F.slice("pos", F.col("_depth") + 1, F.size("pos"))).alias("pos"),
            F.when(top, F.col("_ord")).otherwise(F.col("ord")).alias("ord"), "kind", "name", "attrs", "value",
        ))
    return reduce(DataFrame.unionByName, [p.select(*FIELDS) for p in parts])


def direct(text: str, values: Mapping[str, Column]) -> Element:
    """A tree from markup with ``{name}`` where values go, in attributes and in text."""

    def atoms(s: str) -> tuple[Column, ...]:
        found = [values[p] if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", s)) if p]
        return (F.concat(*[F.coalesce(f.cast("string"), F.lit("")) for f in found]),) if found else ()

    def build(e: ElementTree.Element) -> Element:
        content: list = [Attribute(k, atoms(v)) for k, v in e.attrib.items()]
        if (e.text or "").strip():
            content.append(Text(atoms(e.text)))
        for child in e:
            content.append(build(child))
            if (child.tail or "").strip():
                content.append(Text(atoms(child.tail)))
        return Element(e.tag, *content)

    return build(ElementTree.fromstring(text))


def atomised(nodes: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, atom): an element's own text, and the empty text for one that holds elements or nothing."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select("doc", F.col("parent_id").alias("id")).distinct().withColumn("_holds", F.lit(True))
    found = nodes.select("doc", "id", "value").join(parents, ["doc", "id"], "left")
    return found.select(*keys, F.when(F.col("_holds").isNull(), F.coalesce("value", F.lit(""))).otherwise("").alias("atom"))


def prefixes_in_scope(nodes: DataFrame) -> DataFrame:
    """(doc, id, prefixes): the namespaces that a node's ancestors and itself declare by ``xmlns`` attributes, the nearest
    winning; the default namespace has the empty prefix."""
    declared = nodes.select("doc", F.col("id").alias("_at"), F.explode("attrs").alias("_k", "uri")).where("_k = 'xmlns' or _k like 'xmlns:%'")
    declared = declared.select("doc", "_at", F.when(F.col("_k") == "xmlns", "").otherwise(F.substring("_k", 7, 1000)).alias("prefix"), "uri")
    above = nodes.select("doc", "id", F.posexplode("path").alias("_depth", "_at"))
    nearest = above.join(declared, ["doc", "_at"]).groupBy("doc", "id", "prefix").agg(F.max_by("uri", "_depth").alias("uri"))
    maps = nearest.groupBy("doc", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "uri")))).alias("prefixes"))
    return nodes.select("doc", "id").join(maps, ["doc", "id"], "left").withColumn("prefixes", F.coalesce("prefixes", F.create_map().cast("map<string,string>")))
