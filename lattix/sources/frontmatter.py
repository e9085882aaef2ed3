"""Nested frontmatter as VARIANT: block mappings and lists, lists of scalars in brackets, quoted, plain and block scalars. Every scalar is text unless a type is declared for its place."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.operators.links import RELATIONS

#: Deepest nesting of mappings and lists; what is deeper is refused.
DEEPEST = 64
#: Files of more bytes are reported, not read.
MOST_BYTES = 1 << 20
#: How a scalar of a declared type has to be written; others stay text.
WRITTEN = {"integer": re.compile(r"-?(?:0|[1-9][0-9]*)"), "number": re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"), "boolean": re.compile("true|false")}
#: Characters that double quotes escape by a letter, fixed by the format.
LETTERS = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
QUOTED = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""", re.S)
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`-](?:[^:#]|:(?=\S)|(?<=\S)\#)*?|-(?=\S)(?:[^:#]|:(?=\S)|(?<=\S)\#)*?)\s*:(?=\s|$)""")
HEADER = re.compile(r"([|>])(?:([+-])?([1-9])?|([1-9])([+-]))\s*(?:(?<=\s)#.*)?")
#: What a value can't start with, and the finding it gives.
STARTS = {"&": "anchor", "*": "anchor", "!": "tag", "{": "construct", "}": "construct", "]": "construct", ",": "construct", "%": "construct", "@": "construct", "`": "construct"}


class Refused(ValueError):
    """(finding, line, column), both from 1."""


def _unescaped(text: str, at: tuple) -> str:
    def one(m):
        if m[4] and m[4] not in LETTERS:
            raise Refused("construct", *at)
        return LETTERS[m[4]] if m[4] else chr(int(m[1] or m[2] or m[3], 16))

    return ESCAPE.sub(one, text)


def _folded(lines: list[str]) -> str:
    """Lines of a plain or quoted scalar: a break is a space, n empty lines are n breaks."""
    out, empty = lines[0], 0
    for line in lines[1:]:
        if line:
            out, empty = out + ("\n" * empty if empty else " ") + line, 0
        else:
            empty += 1
    return out


class _Front:
    def __init__(self, text: str, types: dict[str, str], first: int):
        self.lines, self.types, self.first, self.i = [x.removesuffix("\r") for x in text.split("\n")], types, first, 0

    def at(self, column: int = 0) -> tuple[int, int]:
        return self.i + self.first, column + 1

    def refuse(self, finding: str, column: int = 0):
        raise Refused(finding, *self.at(column))

    def peek(self) -> tuple[int, str] | None:
        """Indent and rest of the next line that isn't empty and no comment."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            rest = line.lstrip(" ")
            if rest.strip() and not rest.lstrip().startswith("#"):
                indent = len(line) - len(rest)
                if rest[0] == "\t":
                    self.refuse("construct", indent)
                if indent == 0 and re.match(r"(---|\.\.\.)(\s|$)", rest):
                    self.refuse("second-document")
                return indent, rest
            self.i += 1
        return None

    def typed(self, text: str, place: str):
        kind = self.types.get(place)
        if kind is None or not WRITTEN[kind].fullmatch(text):
            return text
        return int(text) if kind == "integer" else text == "true" if kind == "boolean" else float(text)

    def node(self, indent: int, rest: str, place: str, depth: int):
        if depth > DEEPEST:
            self.refuse("too-deep", indent)
        if rest == "-" or rest.startswith(("- ", "-\t")):
            return self.sequence(indent, place, depth)
        if rest == "?" or rest.startswith("? "):
            self.refuse("construct", indent)
        if KEY.match(rest):
            return self.mapping(indent, place, depth)
        return self.inline(rest, indent, indent - 1, place)

    def below(self, indent: int, place: str, depth: int, lists: bool):
        """The node on the lines after one that ends with a key or a dash; empty text if there is none."""
        self.i += 1
        ahead = self.peek()
        if ahead and (ahead[0] > indent or lists and ahead[0] == indent and (ahead[1] == "-" or ahead[1].startswith("- "))):
            return self.node(*ahead, place, depth + 1)
        return self.typed("", place)

    def mapping(self, indent: int, place: str, depth: int) -> dict:
        out: dict = {}
        while (ahead := self.peek()) and ahead[0] == indent:
            rest = ahead[1]
            key = KEY.match(rest)
            if not key:
                self.refuse(STARTS.get(rest[0], "construct"), indent)
            name = key[1]
            if name == "<<":
                self.refuse("tag", indent)
            if name[0] == "?" and name[1:2] in ("", " "):
                self.refuse("construct", indent)
            name = _unescaped(name[1:-1], self.at(indent)) if name[0] == '"' else name[1:-1].replace("''", "'") if name[0] == "'" else name
            if name in out:
                self.refuse("duplicate-key", indent)
            inner = f"{place}.{name}" if place else name
            value = rest[key.end() :]
            if not value.strip() or value.lstrip().startswith("#"):
                out[name] = self.below(indent, inner, depth, True)
            else:
                out[name] = self.inline(value.lstrip(), len(self.lines[self.i]) - len(value.lstrip()), indent, inner)
        if ahead and ahead[0] > indent:
            self.refuse("construct", ahead[0])
        return out

    def sequence(self, indent: int, place: str, depth: int) -> list:
        out, inner = [], f"{place}[]"
        while (ahead := self.peek()) and ahead[0] == indent and (ahead[1] == "-" or ahead[1].startswith(("- ", "-\t"))):
            value = ahead[1][1:].lstrip()
            if not value or value.startswith("#"):
                out.append(self.below(indent, inner, depth, False))
                continue
            column = len(self.lines[self.i]) - len(value)
            if value == "-" or value.startswith(("- ", "? ")) or KEY.match(value):
                self.lines[self.i] = " " * column + value
                out.append(self.node(column, value, inner, depth + 1))
            else:
                out.append(self.inline(value, column, indent, inner))
        if ahead and ahead[0] > indent:
            self.refuse("construct", ahead[0])
        return out

    def inline(self, rest: str, column: int, indent: int, place: str):
        """A value that starts on a key's or dash's own line, and goes on over lines further in than indent."""
        if rest[0] in STARTS:
            self.refuse(STARTS[rest[0]], column)
        if rest[0] in "|>":
            return self.typed(self.block(rest, column, indent), place)
        if rest[0] == "[":
            return self.flow(rest, column, indent, place)
        if rest[0] in "\"'":
            found, _ = self.spanned(rest, column, indent, QUOTED)
            return self.typed(self.quoted(found[1], column), place)
        kept, value = [], rest
        while True:
            bare = re.split(r"\s#", value, maxsplit=1)[0]
            if re.search(r":(\s|$)", bare):
                self.refuse("construct", column)
            kept.append(bare.strip())
            self.i += 1
            if bare != value or self.i >= len(self.lines):
                break
            n = 0
            while self.i + n < len(self.lines) and not self.lines[self.i + n].strip():
                n += 1
            value = self.lines[self.i + n] if self.i + n < len(self.lines) else ""
            if len(value) - len(value.lstrip(" ")) <= indent or value.lstrip().startswith("#"):
                break
            kept += [""] * n
            self.i += n
        return self.typed(_folded(kept), place)

    def spanned(self, rest: str, column: int, indent: int, whole: re.Pattern) -> tuple[re.Match, str]:
        """The match of what may take several lines; only a comment may follow it on its last line."""
        text, began = rest, self.at(column)
        parts = [rest]
        closing = {'"': '"', "'": "'", "[": "]"}[rest[0]]
        while True:
            # only a line with the closing character can be the last
            found = whole.match(text) if closing in parts[-1][1 if len(parts) == 1 else 0 :] else None
            if found:
                break
            self.i += 1
            line = self.lines[self.i].lstrip(" ") if self.i < len(self.lines) else ""
            # a closing bracket may stand as far out as the key
            if self.i >= len(self.lines) or line.strip() and len(self.lines[self.i]) - len(line) <= indent - (line[0] == closing == "]"):
                raise Refused("construct", *began)
            parts.append(self.lines[self.i])
            text = "\n".join(parts)
        tail = text[found.end() :]
        if tail.strip() and not re.match(r"\s+#", tail):
            raise Refused("construct", *began)
        self.i += 1
        return found, tail

    def quoted(self, text: str, column: int) -> str:
        body = text[1:-1]
        if text[0] == "'":
            lines = body.replace("''", "'").split("\n")
        else:
            lines = re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", r"\1", body).split("\n")
        lines = [x.rstrip(" \t") if i < len(lines) - 1 else x for i, x in enumerate(lines)]
        lines = [x.lstrip(" \t") if i else x for i, x in enumerate(lines)]
        whole = _folded(lines) if lines[-1] or len(lines) == 1 else _folded(lines[:-1]) + " "
        return whole if text[0] == "'" else _unescaped(whole, self.at(column))

    def flow(self, rest: str, column: int, indent: int, place: str) -> list:
        """A list in brackets; only scalars may be in it."""
        began = self.at(column)
        found, _ = self.spanned(rest, column, indent, re.compile(r"""\[(?:\s+\#[^\n]*\n|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\]"'])*\]""", re.S))
        text, out, at = re.sub(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|\s\#[^\n]*""", lambda m: m[1] or "", found[0][1:-1]), [], 0
        while text[at:].strip():
            item = QUOTED.match(text, at)
            if item:
                value, at = self.quoted(item[1], column), item.end()
            else:
                bare = re.compile(r"[^,]*").match(text, at)
                value, at = _folded([x.strip() for x in bare[0].strip().split("\n")]), bare.end()
                if not value or value[0] in STARTS or value[0] in "[|>?" or re.search(r":(\s|$)", value):
                    raise Refused(STARTS.get(value[:1], "construct"), *began)
            gap = re.compile(r"\s*(,|$)").match(text, at)
            if not gap:
                raise Refused("construct", *began)
            out.append(self.typed(value, f"{place}[]"))
            at = gap.end()
        return out

    def block(self, rest: str, column: int, indent: int) -> str:
        head = HEADER.fullmatch(rest)
        if not head:
            self.refuse("construct", column)
        chomp, own = head[2] or head[5], head[3] or head[4]
        self.i += 1
        kept, least = [], max(indent, 0) + int(own) if own else None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            n = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if least is None and n > indent:
                    least = n
                if least is None or n < least:
                    break
            kept.append(line[least:] if least is not None else "")
            self.i += 1
        n = len(kept)
        while n and not kept[n - 1]:
            n -= 1
        body, empty = kept[:n], len(kept) - n
        if head[1] == "|":
            text = "\n".join(body)
        else:
            text, blank, last = "", 0, None
            for line in body:
                if not line:
                    blank += 1
                    continue
                further = line[0] in " \t"
                text += "\n" * blank if last is None else "\n" * (blank + 1) if further or last else "\n" * blank if blank else " "
                text, blank, last = text + line, 0, further
        return text + ("" if chomp == "-" else "\n" * (empty + bool(body)) if chomp == "+" else "\n" * bool(body))


def parsed(text: str, types: dict[str, str] | None = None, first: int = 1):
    """The value of frontmatter without its fences; its first line has this number."""
    front = _Front(text, types or {}, first)
    ahead = front.peek()
    if ahead is None:
        return {}
    value = front.node(*ahead, "", 1)
    if front.peek() is not None:
        front.refuse("construct")
    return value


RESULT = "json string, finding string, line int, col int"


def parse(df: DataFrame, text: str, types: dict[str, str] | None = None, first: int = 2) -> DataFrame:
    """df with front (VARIANT), finding, line and col of the frontmatter, without fences, in a column.

    types names the type (integer, number or boolean) of places such as usage.tokens or blocks[].order; a scalar that isn't written as its type stays text, and so does all else.
    finding is anchor, tag (merge keys too), construct, duplicate-key, second-document, too-deep or too-large, with its line and column; front is then null. Null text: all null. Empty text: an empty mapping.
    """
    declared = dict(types or {})

    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            try:
                if x is not None and len(x.encode("utf-8", "surrogatepass")) > MOST_BYTES:
                    raise Refused("too-large", first, 1)
                out.append((None if x is None else json.dumps(parsed(x, declared, first), ensure_ascii=False), None, None, None))
            except Refused as e:
                out.append((None, *e.args))
        return pd.DataFrame(out, columns=["json", "finding", "line", "col"]).astype({"line": "Int32", "col": "Int32"})

    got = df.withColumn("__r", F.pandas_udf(read, RESULT)(text))
    return got.select(*df.columns, F.parse_json("__r.json").alias("front"), "__r.finding", "__r.line", "__r.col")


def field(front: Column, path: str, kind: str = "string") -> Column:
    """What is at a JSON path such as $.usage.tokens; null if it isn't there or is of another type."""
    return F.try_variant_get(front, path, kind)


#: The fences, the frontmatter and the body.
FENCED = r"(?s)^\x{FEFF}?---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*(?:\r?\n(.*))?$"


def read_files(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """(path, slug, front, body, finding, line, col) of the .md files below a folder; finding may also be no-frontmatter or open-frontmatter, with a first fence that isn't closed. Files without a byte give no row, since Spark doesn't open them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    fenced = F.col("text").rlike(FENCED)
    opened = F.col("text").rlike(r"^\x{FEFF}?---[ \t]*(\r?\n|$)")
    own = raw.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"), F.when(fenced, F.regexp_extract("text", FENCED, 2)).alias("body"), F.when(fenced, F.regexp_extract("text", FENCED, 1)).alias("__front"), F.when(~fenced, F.when(opened, "open-frontmatter").otherwise("no-frontmatter")).alias("__none"))
    got = parse(own, "__front", types)
    return got.select("path", "slug", "front", "body", F.coalesce("__none", "finding").alias("finding"), "line", "col")


def links(items: DataFrame) -> DataFrame:
    """(source, key, target) of the link keys of items with slug and front; a target is a name, or the target of a mapping."""
    keys = F.array(*(F.lit(r[0]) for r in RELATIONS))
    of = items.where("finding is null").select("slug", F.explode(keys).alias("key"), "front")
    got = of.select(F.col("slug").alias("source"), "key", F.explode(F.try_variant_get("front", F.concat(F.lit('$["'), "key", F.lit('"]')), "array<string>")).alias("t"))
    target = F.coalesce(F.get_json_object("t", "$.target"), F.col("t"))
    return got.select("source", "key", target.alias("target")).where("target is not null and target != ''").distinct()
