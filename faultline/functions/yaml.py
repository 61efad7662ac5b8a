"""Flatten a YAML document into nodes, in one pass over its lines.

A document is one row.  A scanner reads it line by line; what it keeps is the chain of open nodes and
at most one open block scalar, quoted text or flow collection.  Nodes are emitted as they are met, so
the time is linear in the document.  Documents come in Arrow batches; there is no shuffle.

Node kinds: ``key`` (a mapping entry), ``item`` (a list entry) and ``scalar`` (a document that is one
value).  ``ord`` numbers the nodes of a document from 0 in reading order; a parent comes before its
children.  A node's ``val`` is the text of its scalar value ('' for null, or where it has children).

Read as a YAML loader reads it: block mappings and lists, block scalars (``|``, ``>`` with indicators;
lines in them are text), quoted and plain text over several lines, flow lists and mappings over several
lines, comments, tags and anchors (skipped), aliases (kept as text).  Not parsable, as for a loader: tabs
in the indentation, an indentation that fits no open node, unclosed quotes or brackets, text where
a key is due, a second document.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the scanner by value: executors need pyarrow only, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PLAIN = r"(?:[^\s#&*!|>'\"%@`{}\[\],?:-]|[?:-](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*?"
_KEY = re.compile(rf"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|{_PLAIN})\s*:(?:[ \t]+(.*))?$", re.S)
_SIMPLE_KEY = re.compile(r"([A-Za-z_][\w.\-/]*):(?: +(.*))?$", re.S)
_PROPERTY = re.compile(r"(?:&\S+|!\S*)(?:\s+|$)")
_BLOCK = re.compile(r"([|>])(?:[+-]?([1-9])?|([1-9])[+-])$")
_COMMENT = re.compile(r"(?:^|\s)#.*$", re.S)
_QUOTED = {'"': re.compile(r'"(?:[^"\\]|\\.)*"', re.S), "'": re.compile(r"'(?:[^']|'')*'(?!')", re.S)}
_FLOW = re.compile(r"[\[\]{}]|(?:(?<=[\s\[{,:])|^)[\"']|\s#")
_FLOW_PLAIN = re.compile(r"(?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<=\S)#)+")
_MAPPING_IN_TEXT = re.compile(r":(?:\s|$)")
_NUMBER = re.compile(r"[-+]?(?:\d[\d_]*)(?:\.[\d_]*)?(?:[eE][-+]?\d+)?$")
_WORDS = {"~": "n", "null": "n", "Null": "n", "NULL": "n", "": "n"} | {
    w: f"b{int(truth)}" for truth, names in ((True, "yes true on"), (False, "no false off"))
    for name in names.split() for w in (name, name.capitalize(), name.upper())}


class Unparsable(Exception):
    """The document is not YAML that a loader accepts."""


def _unquote(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S)


class Scanner:
    """One document: nodes as parallel lists, ``tags`` holding the typed form of scalar values."""

    def __init__(self) -> None:
        self.kinds, self.keys, self.vals, self.parents, self.depths = [], [], [], [], []
        self.tags: list[str | None] = []       # None: no value of its own (yet)
        self.filled: list[bool] = []           # has children
        self.stack: list[tuple[int, int]] = []  # (indentation, node); items sit half a step in
        self.plain: tuple[int, int] | None = None            # (node, column) whose plain text may go on
        self.block: tuple | None = None        # (node, column, style, indent or None, lines)
        self.quote: tuple | None = None        # (node, quote sign, parts)
        self.flow: list | None = None          # [node, parts, depth, open quote]

    # -- nodes
    def add(self, kind: str, key: str | None, parent: int) -> int:
        if parent >= 0:
            if self.tags[parent] is not None:
                raise Unparsable
            self.filled[parent] = True
        self.kinds.append(kind)
        self.keys.append(key)
        self.vals.append("")
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.tags.append(None)
        self.filled.append(False)
        return len(self.kinds) - 1

    def push(self, indent: int, kind: str, key: str | None) -> int:
        popped = indent
        while self.stack and self.stack[-1][0] >= indent:
            popped = self.stack.pop()[0]
        if popped != indent or (not self.stack and popped == indent and self.kinds and indent != self.root):
            raise Unparsable
        if not self.kinds:
            self.root = indent
        node = self.add(kind, key, self.stack[-1][1] if self.stack else -1)
        self.stack.append((indent, node))
        return node

    def put(self, node: int, val: str, tag: str) -> None:
        self.vals[node], self.tags[node] = val, tag

    def text(self, node: int, val: str) -> None:
        self.put(node, val, "s" + val)

    # -- values
    def value(self, node: int, text: str, column: int) -> None:
        """The value that starts on a node's line; ``column`` is what its further lines must exceed."""
        if not text:
            return
        first = text[0]
        if first in "&!":
            while m := _PROPERTY.match(text):
                text = text[m.end():]
            first = text[:1]
        if not first or first == "#":
            return
        if first in "|>":
            head = _BLOCK.match(_COMMENT.sub("", text).rstrip())
            if not head:
                raise Unparsable
            given = head[2] or head[3]
            self.block = (node, column, head[1], max(column, 0) + int(given) if given else None, [])
        elif first in _QUOTED:
            self.quote = (node, first, [])
            self.quoted(text)
        elif first in "[{":
            self.flow = [node, [], 0, None]
            self.flowing(text)
        elif first in "%@`":
            raise Unparsable
        else:
            if "#" in text:
                text = _COMMENT.sub("", text).rstrip()
            if ":" in text and _MAPPING_IN_TEXT.search(text):
                raise Unparsable
            self.simple(node, text)
            self.plain = (node, column)

    def simple(self, node: int, text: str) -> None:
        tag = _WORDS.get(text) or (("d" if text[0] in "+-0123456789" and _NUMBER.match(text) else "s") + text)
        self.put(node, "" if tag == "n" else text, tag)

    def quoted(self, text: str) -> None:
        node, sign, parts = self.quote
        if not parts:                       # the opening line
            m = _QUOTED[sign].match(text)
        else:                               # a later line closes it at the first sign that is not escaped
            m = _QUOTED[sign].match(sign + text)
        if not m:
            parts.append(text)
            return
        end = m.end() - bool(parts)
        if _COMMENT.sub("", text[end:]).strip():
            raise Unparsable
        parts.append(text[:end])
        self.text(node, _unquote(" ".join(p.strip() for p in parts)))
        self.quote = None

    def flowing(self, text: str) -> None:
        """Read on in a flow collection until its brackets close; only the new line is looked at."""
        flow, at = self.flow, 0
        while True:
            if flow[3]:
                m = _QUOTED[flow[3]].match(flow[3] + text[at:])
                if not m:
                    break
                at, flow[3] = at + m.end() - 1, None
            m = _FLOW.search(text, at)
            if not m:
                break
            at = m.end()
            sign = m[0]
            if sign in "[{":
                flow[2] += 1
            elif sign in "]}":
                flow[2] -= 1
                if not flow[2]:
                    if _COMMENT.sub("", text[at:]).strip():
                        raise Unparsable
                    flow[1].append(text[:at])
                    self.flow = None
                    whole = " ".join(flow[1])
                    if self.collection(flow[0], whole, 0) != len(whole):
                        raise Unparsable
                    return
            elif sign in "\"'":
                flow[3] = sign
            else:                           # a comment
                text = text[:m.start()]
        flow[1].append(text)

    def collection(self, node: int, s: str, at: int) -> int:
        """Emit the entries of the flow collection at ``s[at]`` below ``node``; returns where it ends."""
        close = {"[": "]", "{": "}"}[s[at]]
        kind = "item" if close == "]" else "key"
        self.tags[node] = None
        self.filled[node] = True
        at = self.blank(s, at + 1)
        while at < len(s) and s[at] != close:
            if kind == "item":
                entry = self.add("item", None, node)
                at = self.entry(entry, s, at)
                if at < len(s) and s[at] == ":":         # a single pair in a list
                    if self.filled[entry]:
                        raise Unparsable
                    key, self.vals[entry], self.tags[entry] = self.vals[entry], "", None
                    at = self.entry(self.add("key", key, entry), s, self.blank(s, at + 1))
            else:
                entry = self.add("key", "", node)
                at = self.entry(entry, s, at)
                if self.filled[entry]:
                    raise Unparsable
                self.keys[entry], self.vals[entry], self.tags[entry] = self.vals[entry], "", None
                if at < len(s) and s[at] == ":":
                    at = self.entry(entry, s, self.blank(s, at + 1))
            if at < len(s) and s[at] == ",":
                at = self.blank(s, at + 1)
            elif at >= len(s) or s[at] != close:
                raise Unparsable
        if not self.filled_by(node):
            self.filled[node] = False
            self.put(node, "", "e" + close)
        return self.blank(s, at + 1)

    def filled_by(self, node: int) -> bool:
        return len(self.parents) > node + 1 and self.parents[node + 1] == node

    def blank(self, s: str, at: int) -> int:
        while at < len(s) and s[at] in " \t":
            at += 1
        return at

    def entry(self, node: int, s: str, at: int) -> int:
        while m := _PROPERTY.match(s, at):
            at = m.end()
        if at >= len(s) or s[at] in ",]}:":
            self.put(node, "", "n")
            return at
        if s[at] in "[{":
            return self.collection(node, s, at)
        if s[at] in _QUOTED:
            m = _QUOTED[s[at]].match(s, at)
            if not m:
                raise Unparsable
            self.text(node, _unquote(m[0]))
        else:
            m = _FLOW_PLAIN.match(s, at)
            if not m:
                raise Unparsable
            self.simple(node, m[0].strip())
        return self.blank(s, m.end())

    # -- lines
    def in_block(self, line: str) -> bool:
        """Whether the line belongs to the open block scalar."""
        node, column, style, indent, lines = self.block
        bare = line.lstrip(" ")
        if not bare.strip():
            lines.append("")
            return True
        here = len(line) - len(bare)
        if here <= column:
            self.end_block()
            return False
        if indent is None:
            indent = here
        elif here < indent:
            raise Unparsable
        lines.append(line[indent:])
        self.block = (node, column, style, indent, lines)
        return True

    def end_block(self) -> None:
        node, _, style, _, lines = self.block
        text = "\n".join(lines).strip("\n")
        if style == ">":
            text = re.sub(r"(?<=[^\n])\n(?=[^\n])", " ", text)
        self.text(node, text)
        self.block = None

    def line(self, line: str) -> None:
        if self.block and self.in_block(line):
            return
        text = line.strip()
        if self.quote:
            self.quoted(text)
            return
        if self.flow:
            self.flowing(text)
            return
        if not text or text[0] == "#":
            return
        column = len(line) - len(line.lstrip(" "))
        if line[column] == "\t":
            raise Unparsable
        if not column and text in ("---", "..."):
            if self.kinds and text == "---":
                raise Unparsable
            return
        if text[0] == "%" and not self.kinds:
            return
        if self.plain and column > self.plain[1]:      # plain text goes on
            text = _COMMENT.sub("", text).rstrip()
            if _MAPPING_IN_TEXT.search(text):
                raise Unparsable
            node = self.plain[0]
            self.text(node, f"{self.vals[node]} {text}".strip())
            return
        self.plain = None
        node = None
        while text == "-" or text[:2] in ("- ", "-\t"):
            node = self.push(2 * column + 1, "item", None)
            rest = text[1:].lstrip()
            at, column, text = column, column + len(text) - len(rest), rest
        if not text:
            return
        m = _SIMPLE_KEY.match(text) or _KEY.match(text)
        if m:
            key = _unquote(m[1]) if m[1][0] in _QUOTED else m[1]
            self.value(self.push(2 * column, "key", key), (m[2] or "").strip(), column)
        elif node is not None:
            self.value(node, text, at)
        else:
            self.scalar(text, column)

    def scalar(self, text: str, column: int) -> None:
        """A line that is neither key nor item: the value of the key or item above, or the whole document."""
        while self.stack and self.stack[-1][0] >= 2 * column:
            self.stack.pop()
        if self.stack:
            node = self.stack[-1][1]
            if self.filled[node] or self.tags[node] is not None:
                raise Unparsable
            self.value(node, text, column - 1)
        elif self.kinds:
            raise Unparsable
        else:
            self.value(self.push(2 * column, "scalar", None), text, column - 1)

    def read(self, document: str) -> None:
        for line in document.split("\n"):
            self.line(line.rstrip("\r"))
        if self.block:
            self.end_block()
        if self.quote or self.flow:
            raise Unparsable

    def hashes(self) -> list[str]:
        """Of every node, its value in a form that is equal for equal values: the typed scalar, or a hash of the
        children's forms -- in order for a list, by key for a mapping (the last of equal keys counts).  Children
        come after their parent, so one pass from the end builds them bottom-up."""
        below: list[list[int]] = [[] for _ in self.kinds]
        out = [""] * len(self.kinds)
        for node in range(len(self.kinds) - 1, -1, -1):
            if below[node]:
                if self.kinds[below[node][0]] == "key":
                    entries: dict[str, str] = {}
                    for child in below[node]:             # last first
                        entries.setdefault(self.keys[child], out[child])
                    form = "m" + "\x00".join(f"{k}\x01{v}" for k, v in sorted(entries.items()))
                else:
                    form = "l" + "\x00".join(out[child] for child in reversed(below[node]))
                out[node] = "h" + hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            else:
                out[node] = self.tags[node] or "n"
            if self.parents[node] >= 0:
                below[self.parents[node]].append(node)
        return out


def scan(document: str | None) -> Scanner | None:
    """The nodes of a document; None for a missing, empty or unparsable one."""
    if not document:
        return None
    scanner = Scanner()
    try:
        scanner.read(document)
    except (Unparsable, RecursionError):
        return None
    return scanner


_FIELDS = [("ord", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("val", pa.string()), ("parent", pa.int32()),
           ("depth", pa.int32()), ("has_children", pa.bool_()), ("pkind", pa.string()), ("pkey", pa.string()),
           ("gpkind", pa.string()), ("sub", pa.string())]
NODE_TYPE = ("array<struct<ord:int,kind:string,key:string,val:string,parent:int,depth:int,has_children:boolean,pkind:string,"
             "pkey:string,gpkind:string,sub:string>>")


def _flatten(documents: pa.Array, hashes: bool) -> pa.Array:
    columns: list[list] = [[] for _ in _FIELDS]
    offsets: list[int | None] = []
    total = 0
    for document in documents:
        s = scan(document.as_py())
        if s is None:
            offsets.append(None)
            continue
        offsets.append(total)
        n = len(s.kinds)
        total += n
        kind = [*s.kinds, "root"]            # index -1: the top level
        above = [*s.parents, -1]
        keys = [*s.keys, None]
        for column, values in zip(columns, (
                range(n), s.kinds, s.keys, s.vals, s.parents, s.depths, s.filled, [kind[p] for p in s.parents],
                [keys[p] for p in s.parents], [kind[above[p]] for p in s.parents], s.hashes() if hashes else [None] * n)):
            column.extend(values)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), flat)


def yaml_nodes(content_col: str, hashes: bool = False) -> Column:
    """``ARRAY<STRUCT<ord, kind, key, val, parent, depth, has_children, pkind, pkey, gpkind, sub>>``.

    ``parent`` is the ordinal of the enclosing node (-1 at top level), ``pkind``/``pkey`` describe the parent
    (``root`` at top level) and ``gpkind`` the grandparent's kind.  With ``hashes``, ``sub`` is a form of the
    node's value that is equal exactly for equal values (see ``Scanner.hashes``).  NULL when the document is
    missing, empty or not parsable; a document of comments alone has no nodes.
    """
    def flatten(documents: pa.Array) -> pa.Array:
        return _flatten(documents, hashes)

    # "Not deterministic" only keeps the optimizer from scanning again for every use of the nodes.
    return F.arrow_udf(flatten, NODE_TYPE).asNondeterministic()(F.col(content_col))
