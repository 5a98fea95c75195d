"""Loading and writing documents: XML and HTML to nodes, GXL graphs, history logs, code units, exports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from fnmatch import fnmatchcase
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.functions.scalars import escape_html, expand
from grovewise.operators.bindings import joined_text
from grovewise.sources.forest import FIELDS, NODE

SHRED = NODE + ", error string"
#: Nodes in one batch of the result: they take many times the bytes of their texts.
SHREDDED = 1 << 12
#: Characters of text in one batch of rendered documents.
RENDERED = 1 << 22
_WRITTEN = ("id", "parent_id", "kind", "name", "attrs", "value")
TEXT = "#text"  # what text nodes have for a name
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Shredder:
    """Events to node rows; ids are paths of positions, so the same document gives the same ids.

    An element without elements in it holds its text as its value. Where texts and elements are mixed, texts are nodes of
    kind ``text`` between them, so that their order is kept; those of white space alone are left out. Without ``mixed``
    texts around elements are gathered in the value instead. ``own_ids``: ids that elements name are theirs.
    """

    def __init__(self, doc: str, mixed: bool, own_ids: bool) -> None:
        self.doc, self.mixed, self.own_ids, self.rows, self.stack, self.counts = doc, mixed, own_ids, [], [], [0]

    def _add(self, kind: str, name: str, attrs: dict[str, str], value: str | None) -> list:
        pos = [*(self.stack[-1][1] if self.stack else []), self.counts[-1]]
        self.counts[-1] += 1
        id_ = self.own_ids and (attrs.get("xml:id") or attrs.get("id")) or f"{self.doc}#{'.'.join(map(str, pos))}"
        path = [*(self.stack[-1][2] if self.stack else []), id_]
        self.rows.append([self.doc, id_, path[-2] if len(path) > 1 else None, path, pos, pos[-1], kind, name, attrs, value])
        return self.rows[-1]

    def open(self, name: str, attrs: dict[str, str]) -> None:
        if self.stack:
            self.stack[-1][5] = True
        row = self._add("element", name, attrs, None)
        self.stack.append([name, row[4], row[3], row, [], False])
        self.counts.append(0)

    def text(self, data: str) -> None:
        if not self.stack or not data:
            return
        texts, row = self.stack[-1][4], self.stack[-1][3]
        if not self.mixed:
            if data.strip():
                row[9] = f"{row[9]} {data.strip()}" if row[9] else data.strip()
        elif texts and texts[-1] is self.rows[-1]:
            texts[-1][9] += data
        elif data.strip():
            texts.append(self._add("text", TEXT, {}, data))

    def _leave(self) -> str:
        name, _, _, row, texts, mixed = self.stack.pop()
        self.counts.pop()
        if texts and not mixed:
            row[9] = " ".join(t[9].strip() for t in texts)
            # Texts of an element without elements come right after it.
            del self.rows[-len(texts) :]
        return name

    def close(self, name: str) -> None:
        while self.stack:  # tolerant: an end tag closes what was left open inside
            if self._leave() == name:
                return

    def done(self) -> list[list]:
        while self.stack:
            self._leave()
        return self.rows


def shred_xml(doc: str, text: str, mixed: bool = True) -> list[list]:
    """Strict: a document that isn't well-formed raises."""
    out = _Shredder(doc, mixed, True)

    def walk(e: ElementTree.Element) -> None:
        name = re.sub(r"^\{.*\}", "", e.tag)
        out.open(name, {re.sub(r"^\{.*namespace\}", "xml:", k): v for k, v in e.attrib.items()})
        out.text(e.text or "")
        for child in e:
            walk(child)
            out.text(child.tail or "")
        out.close(name)

    walk(ElementTree.fromstring(text))
    return out.done()


def shred_html(doc: str, text: str, mixed: bool = False) -> list[list]:
    """Tolerant: unclosed and stray tags don't lose content. Pages repeat ids, so these are attributes only."""
    out = _Shredder(doc, mixed, False)

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            out.open(tag, {k: v or "" for k, v in attrs})
            if tag in VOID:
                out.close(tag)

        def handle_endtag(self, tag):
            if any(s[0] == tag for s in out.stack):
                out.close(tag)

        def handle_data(self, data):
            out.text(data)

    parser = Parser(convert_charrefs=True)
    parser.feed(text)
    parser.close()
    return out.done()


def shredded_batches(batches: Iterator[pd.DataFrame], shred: Callable[[str, str, bool], list[list]], mixed: bool) -> Iterator[pd.DataFrame]:
    """Nodes of documents (doc, text) in batches of about ``SHREDDED``, however many documents came in one."""
    names = [*FIELDS, "error"]
    for pdf in batches:
        out = []
        for d, t in zip(pdf["doc"], pdf["text"], strict=True):
            try:
                out += [[*r, None] for r in shred(d, t or "", mixed)]
            except (ElementTree.ParseError, ValueError) as e:
                out.append([d, *[None] * (len(FIELDS) - 1), str(e)])
            if len(out) >= SHREDDED:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)


def shredded(rows: DataFrame, doc: str, text: str, html: bool = False, mixed: bool | None = None) -> DataFrame:
    """Nodes of each row's document, and a row with ``error`` for each that can't be read: one bad file stops nothing.

    ``mixed`` makes nodes of the texts that stand between elements; by default so for XML, while texts of an HTML element
    are gathered in its value.
    """
    shred, mixed = shred_html if html else shred_xml, (not html) if mixed is None else mixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return shredded_batches(batches, shred, mixed)

    return rows.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).mapInPandas(run, SHRED)


# What editors and version control leave behind.
DEFAULT_EXCLUDES = ("**/*~", "**/#*#", "**/.#*", "**/%*%", "**/._*", "**/CVS", "**/CVS/**", "**/.cvsignore", "**/SCCS", "**/SCCS/**", "**/vssver.scc", "**/.svn", "**/.svn/**", "**/.DS_Store")


def load_files(spark: SparkSession, path: str, include: Sequence[str] = ("*",), exclude: Sequence[str] = (), default_excludes: bool = True) -> DataFrame:
    """(doc, modified, text) of the files below ``path``; names relative to it, matched by shell patterns."""
    exclude = (*exclude, *(DEFAULT_EXCLUDES if default_excludes else ()))
    found = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path)
    root = path.rstrip("/").split("://")[-1].split(":")[-1]
    rel = F.regexp_replace("path", "^.*?" + re.escape(root) + "/", "")

    def like(patterns: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | rel.rlike("^" + re.escape(p).replace(r"\*\*/", "(.*/)?").replace(r"/\*\*", "/.+").replace(r"\*", "[^/]*" if "/" in p else ".*").replace(r"\?", ".") + "$")
        return out

    return found.where(like(include) & ~like(exclude)).select(rel.alias("doc"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("text"))


def inherit_unchanged(files: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to load, names to inherit): by name and time of modification."""
    same = files.join(before.select("doc", "modified"), ["doc", "modified"], "left_semi").select("doc")
    return files.join(same, "doc", "left_anti"), same


def history_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """(code, date, author, rev, file, change, interest) of ``code date time author rev file`` lines; others are skipped."""
    parts = F.split(F.col(value), r"\s+")
    rows = lines.where(F.size(parts) >= 6).select(parts[0].alias("code"), F.try_to_timestamp(F.concat_ws(" ", parts[1], parts[2]), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("date"), parts[3].alias("author"), parts[4].alias("rev"), parts[5].alias("file"))
    known = rows.where(F.col("date").isNotNull() & F.col("code").isin("M", "R", "A", "T"))
    return known.withColumn("change", F.col("code") != "T").withColumn("interest", F.col("code") == "T")


def revision_log(entries: DataFrame, value: str = "value") -> DataFrame:
    """(file, name, author, date, commit_id, message) of revision logs, one row of text for each file's entry, as the text
    reader gives with ``lineSep`` set to the entries' ruler of equal signs.

    Line ends of a message become newlines; text before the first revision names the file; what has no revision number or
    date is skipped.
    """
    parts = F.split(F.col(value), r"(?:^|\n)-{20,}\r?\n")
    file = F.regexp_extract(parts[0], r"RCS file: ([^\r\n]*)", 1)
    found = entries.select(F.regexp_replace(file, ",v$", "").alias("file"), F.explode(F.slice(parts, 2, F.size(parts))).alias("_r"))
    head = lambda name: F.nullif(F.regexp_extract("_r", name + r": ([^;\r\n]*);", 1), F.lit(""))
    message = F.regexp_replace(F.regexp_replace(F.regexp_extract("_r", r"(?s)^[^\n]*\n[^\n]*\n?(.*)$", 1), "\r\n", "\n"), "\r", "")
    date = F.coalesce(F.try_to_timestamp(head("date"), F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(head("date"), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")
    rows = found.select("file", F.regexp_extract("_r", r"^revision (\S+)", 1).alias("name"), head("author").alias("author"), date.alias("date"), head("commitid").alias("commit_id"), F.btrim(message, F.lit(" \t\r\n")).alias("message"))
    return rows.where("name <> '' and date is not null")


def objects_from_xml(rows: DataFrame, text: str, schema: str, into: str = "object") -> DataFrame:
    """Documents as structs: attributes are fields with ``_``, repeated elements arrays; broken ones give null."""
    return rows.withColumn(into, F.from_xml(F.col(text), schema, {"mode": "PERMISSIVE"}))


def simple_path(text: Column, names: str) -> Column:
    """The texts of the elements that ``names``, separated by spaces, lead to from the root's children, as an array."""
    return F.xpath(text, F.lit("/*/" + "/".join(names.split()) + "/text()"))


def read_gxl(spark: SparkSession, path: str, by_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs) of a GXL graph, through the XML reader.

    ``by_line``: each element stands on a line of its own, so that files are split between tasks; else elements may
    span lines and a file is one task. By line the reader takes every line for a row, so those of other tags are left out.
    """
    kind = "`type` struct<`_xlink:href`: string>"
    reader = lambda tag: spark.read.option("rowTag", tag).option("multiLine", str(not by_line).lower()).option("ignoreNamespace", "false")
    nodes = reader("node").schema(f"_id string, {kind}").xml(path).where("_id is not null")
    arcs = reader("edge").schema(f"_from string, _to string, {kind}").xml(path).where("_from is not null and _to is not null")
    href = F.col("type")["_xlink:href"].alias("kind")
    return nodes.select(F.col("_id").alias("id"), href), arcs.select(F.col("_from").alias("src"), F.col("_to").alias("dst"), href)


def gxl_lines(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """The elements of a GXL graph as text rows, for ``write.text`` between a head and a foot."""
    typed = lambda k: F.concat(F.lit('<type xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="'), escape_html(F.col(k)), F.lit('"/>'))
    n = nodes.select(F.concat(F.lit('<node id="'), escape_html(F.col("id")), F.lit('">'), typed("kind"), F.lit("</node>")).alias("value"))
    return n.unionByName(arcs.select(F.concat(F.lit('<edge from="'), escape_html(F.col("src")), F.lit('" to="'), escape_html(F.col("dst")), F.lit('">'), typed("kind"), F.lit("</edge>")).alias("value")))


def _quoted(s: object) -> str:
    return str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _rendered(rows: Sequence[tuple]) -> str:
    """The text of one document's nodes (id, parent_id, kind, name, attrs, value), in document order."""
    kids: dict[str | None, list[tuple]] = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)

    def write(r: tuple) -> str:
        id_, _, kind, name, attrs, value = r
        if kind == "text":
            return _quoted(value or "")
        marked = "".join(f' {k}="{_quoted(v)}"' for k, v in sorted(dict(attrs).items()))
        inner = (_quoted(value) if value else "") + "".join(map(write, kids.get(id_, [])))
        return f"<{name}{marked}>{inner}</{name}>" if inner else f"<{name}{marked}/>"

    return "".join(map(write, kids.get(None, [])))


def rendered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, xml) of nodes sorted by document and position: what a document costs follows its nodes, however many documents
    there are. Nodes of a document that goes on in the next batch are held."""
    held: list[tuple] = []
    now: str | None = None
    docs: list[str | None] = []
    texts: list[str] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(texts, pa.string())], names=["doc", "xml"])

    for b in batches:
        for doc, *node in zip(*(b.column(k).to_pylist() for k in ("doc", *_WRITTEN)), strict=True):
            if held and doc != now:
                docs.append(now)
                texts.append(_rendered(held))
                size, held = size + len(texts[-1]), []
                if len(docs) >= SHREDDED or size >= RENDERED:
                    yield batch()
                    docs, texts, size = [], [], 0
            now = doc
            held.append(tuple(node))
    if held:
        docs.append(now)
        texts.append(_rendered(held))
    if docs:
        yield batch()


def serialised(nodes: DataFrame) -> DataFrame:
    """(doc, xml): each document's nodes as escaped text. A document is one row, so its nodes meet in one task, where they
    come in order; documents follow each other there without a group of their own."""
    rows = nodes.select("doc", "pos", *_WRITTEN).repartition("doc").sortWithinPartitions("doc", "pos").drop("pos")
    return rows.mapInArrow(rendered_batches, "doc string, xml string")


def collapsed_names(nodes: DataFrame) -> DataFrame:
    """Names without namespace punctuation: ``:``, ``-`` and ``.`` become ``_``."""
    return nodes.withColumn("name", F.translate("name", ":-.", "___"))


def export_by(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One folder of text files for each value of ``key``."""
    rows.select(key, F.col(text).alias("value")).repartition(key).write.partitionBy(key).text(path)


def exported(entities: DataFrame, key: str, template: str, sides: Mapping[str, DataFrame], path: str) -> None:
    """One file of text for each entity: ``template`` with ``#{column}`` by the entity's columns and ``#{side}`` by the
    lines (column ``line``, in the order of ``ord``) that a side table has for its key, one to a line."""
    found = entities
    for name, side in sides.items():
        lines = joined_text(side, [key], "line", "ord", "\n", name)
        found = found.join(lines, key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    text = expand(template, {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in found.columns})
    export_by(found.select(F.col(key), text.alias("_text")), key, "_text", path)


def affecting(mods: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Provenance of some nodes: mods that inserted them or anything above or below them."""
    related = nodes.select("id", F.explode("path").alias("up"))
    below = related.join(ids.select(F.col("id").alias("up")), "up", "left_semi").select("id")
    above = related.join(ids.select("id"), "id", "left_semi").select(F.col("up").alias("id"))
    return mods.join(below.union(above).distinct().withColumnRenamed("id", "affected"), "affected", "left_semi")


TYPE = re.compile(r"\b(class|interface|enum)\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w.,<>\s]+?))?(?:\s+implements\s+([\w.,<>\s]+?))?\s*\{")
MEMBER = re.compile(r"^((?:(?:public|protected|private|static|final|abstract|synchronized|native|transient|volatile)\s+)*)(?:<[^>]*>\s*)?(?:([\w.]+(?:<[^()]*>)?(?:\s*\[\s*\])*)\s+)?(\w+)\s*(\([^)]*\))?((?:\s*\[\s*\])*)\s*(?:throws\s+([\w.,\s]+?))?\s*(?:=.*)?$", re.DOTALL)
NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|@\w+(?:\([^)]*\))?", re.DOTALL)
MEMBERS = "doc string, package string, type string, kind string, name string, returns string, params array<string>, throws array<string>, extends array<string>, modifiers array<string>, line int"


def _names(text: str | None) -> list[str]:
    """Types of a list, without what they are applied to; arrays keep their brackets."""
    plain = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", text or ""))
    return [re.sub(r"\s*\[\s*\]", "[]", t.strip()) for t in plain.split(",") if t.strip()]


def _variables(head: str) -> list[str]:
    """A declaration's variables, the first with what stands before it: cut at commas outside of any brackets."""
    out, depth = [""], 0
    for c in head:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def _members(doc: str, text: str) -> Iterator[tuple]:
    """The declarations of one source, read by its braces and semicolons: bodies of methods are skipped."""
    text = NOISE.sub(lambda m: " " + "\n" * m.group().count("\n"), text)
    package, types, depth, start = "", [], 0, 0
    for m in re.finditer(r"[{};]", text):
        mark, head = m.group(), text[start : m.start()].strip()
        line = 1 + text.count("\n", 0, m.start() - len(text[start : m.start()].lstrip()))
        start, inside = m.end(), bool(types) and depth == types[-1][0] + 1
        if mark == "}":
            depth -= 1
            if types and depth == types[-1][0]:
                types.pop()
            continue
        within = "$".join(t for _, t in types)
        if (t := TYPE.search(head + "{")) and mark == "{" and depth == (types[-1][0] + 1 if types else 0):
            types.append((depth, t.group(2)))
            above = _names(t.group(3)) + _names(t.group(4))
            yield doc, package, "$".join(x for _, x in types), t.group(1), t.group(2), None, [], [], above, head[: t.start()].split(), line
        elif mark == ";" and depth == 0 and (p := re.match(r"(package|import)\s+(?:static\s+)?([\w.]+(?:\.\*)?)$", head)):
            if p.group(1) == "package":
                package = p.group(2)
            else:
                yield doc, package, "", "import", p.group(2), None, [], [], [], [], line
        elif inside and mark == ";" and len(variables := _variables(head)) > 1 and (d := MEMBER.match(variables[0])) and d.group(2) and d.group(4) is None:
            for v in variables:
                name, arrays = re.match(r"(?:.*\s)?(\w+)((?:\s*\[\s*\])*)\s*(?:=.*)?$", v if v is variables[0] else v.strip(), re.DOTALL).groups()
                yield doc, package, within, "field", name, _names(d.group(2) + arrays)[0], [], [], [], d.group(1).split(), line
        elif inside and (d := MEMBER.match(head)) and d.group(3) not in ("static", "return"):
            called, result = d.group(4) is not None, d.group(2)
            if called and result is None and d.group(3) != types[-1][1] or not called and (result is None or mark == "{" and not head.endswith("=")):
                depth += mark == "{"
                continue
            params = [re.sub(r"^(?:final\s+)?(.*?)\s*\w+((?:\s*\[\s*\])*)$", r"\1\2", p) for p in _names((d.group(4) or "()")[1:-1])]
            kind = "field" if not called else "constructor" if result is None else "method"
            returns = _names(result + d.group(5))[0] if result else None
            yield doc, package, within, kind, d.group(3), returns, params, _names(d.group(6)), [], d.group(1).split(), line
        depth += mark == "{"


def code_members(units: DataFrame) -> DataFrame:
    """(MEMBERS) of Java-like sources (doc, text): types with what they extend, fields, methods and constructors with the
    types of their parameters and of what they throw, and imports.

    Comments, texts and annotations are dropped, bodies skipped; each variable of a declaration is a field.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([row for doc, text in zip(pdf["doc"], pdf["text"], strict=True) for row in _members(doc, text or "")], columns=names)

    return units.select("doc", "text").mapInPandas(run, MEMBERS)


def matches(name: str, include: Sequence[str], exclude: Sequence[str]) -> bool:
    """The driver-side form of the patterns of ``load_files``."""
    return any(fnmatchcase(name, p) for p in include) and not any(fnmatchcase(name, p) for p in exclude)
