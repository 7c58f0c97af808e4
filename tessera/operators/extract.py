"""Entities and relations from source text: Python by its own grammar, brace languages by a scanner, the rest by the patterns of `blocks`.

A file gives tagged rows of the schema `Extracted`: nodes (kind set) and edges (edge_type set). Rows are per file and in
order, so the work is a narrow map over files.
"""

from __future__ import annotations

import ast
import bisect
import contextlib
import contextvars
import functools
import itertools
import re
from collections.abc import Callable, Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera import schemas
from tessera.functions import text as X
from tessera.operators import blocks
from tessera.operators.corpus import first_per_id
from tessera.operators.stats import CALL_KEYWORDS, OTHER_BRANCHES, RUST_BRANCHES
from tessera.session import stored

COLUMNS = schemas.Extracted.fieldNames()
_NONE = dict.fromkeys(COLUMNS)
_IDENT = r"[^\W\d]\w*"


#: The columns that rows are made for; None: all.
_ASKED: contextvars.ContextVar[frozenset[str] | None] = contextvars.ContextVar("asked", default=None)
#: The kinds of nodes and types of edges that rows are made of; None: all.
_WANTED: contextvars.ContextVar[frozenset[str] | None] = contextvars.ContextVar("wanted", default=None)


@contextlib.contextmanager
def asking(columns: Collection[str], wanted: Collection[str] | None = None) -> Iterator[None]:
    """Parsers called within make rows of these columns only, file_path and kind among them, and if wanted is given, only of
    these kinds and types; ordinals then only rise in the order of a file. A parser may give more, which the caller leaves out."""
    tokens = _ASKED.set(frozenset(columns)), _WANTED.set(None if wanted is None else frozenset(wanted))
    try:
        yield
    finally:
        _ASKED.reset(tokens[0])
        _WANTED.reset(tokens[1])


class Rows:
    """Collects one file's rows.

    A value may be given as a function without arguments, which is called only if its column is asked for. It must be one
    that can't fail, so that whether a file can be read doesn't depend on the columns.
    """

    def __init__(self, path: str):
        self.path, self.rows, self.asked, self.wanted = path, [], _ASKED.get(), _WANTED.get()

    def asks(self, *columns: str) -> bool:
        return self.asked is None or not self.asked.isdisjoint(columns)

    def wants(self, *kinds: str) -> bool:
        return self.wanted is None or not self.wanted.isdisjoint(kinds)

    def node(self, kind: str, name: str, qualified: str | None = None, **more) -> str:
        qualified = qualified or name
        own = f"{kind}:{self.path}:{qualified if kind == 'function' else name}"
        if self.wanted is not None and kind not in self.wanted:
            return own
        if self.asked is None:
            more = {c: v() if callable(v) else v for c, v in more.items()}
        else:
            more = {c: v() if callable(v) else v for c, v in more.items() if c in self.asked}
        self.rows.append({"kind": kind, "id": own, "name": name, "qualified_name": qualified, **more})
        return own

    def edge(self, kind: str, src: str, dst: str, **more) -> None:
        if self.wanted is not None and kind not in self.wanted:
            return
        self.rows.append({"edge_type": kind, "src": src, "dst": dst, **more})

    def done(self) -> list[dict]:
        if self.asked is not None:  # what a row lacks is null
            for n, r in enumerate(self.rows):
                r["file_path"], r["ordinal"] = self.path, n
                r.setdefault("kind", "edge")
            return self.rows
        return [_NONE | r | {"file_path": self.path, "kind": r.get("kind") or "edge", "ordinal": n} for n, r in enumerate(self.rows)]


def count_branches(text: str, words: tuple[str, ...]) -> int:
    return 1 + sum(map(text.count, words))


@functools.lru_cache(64)
def _hidden(line: tuple[str, ...], quotes: str, nested: bool, chars: bool) -> re.Pattern:
    """Comments and strings; the last group is what is blanked, what follows it ends the string. A nested comment only begins here."""
    parts = [rf"({re.escape(m)}[^\n]*)" for m in line]
    if "//" in line:
        parts.append(r"(/\*)" if nested else r"(/\*(?:[\s\S]*?\*/|[\s\S]*))")
    for q in quotes:
        if q == "'" and chars:
            parts.append(r"'(\\.[^']*|[^'\\])'")
        else:
            parts.append(rf"{q}((?:\\[\s\S]?|[^{q}\\{'' if q == '`' or chars else chr(92) + 'n'}])*+){q}?")
    return re.compile("|".join(parts))


#: Without any of these a text has neither comments nor strings.
_HIDES = re.compile(r"[\"'`/]")
_BLOCK_COMMENT = re.compile(r"\*/|/\*")
_INK = re.compile(r"[^\n]")


def masked(text: str, line: tuple[str, ...] = ("//",), quotes: str = "\"'`", nested: bool = False, chars: bool = False) -> str:
    """The text with comments and the contents of strings blanked, lines kept. chars: ' quotes single characters only."""
    out, at = [], 0
    search = _hidden(line, quotes, nested, chars).search
    while m := search(text, at):
        a, b = m.span(m.lastindex)
        end = m.end()
        if nested and m[0] == "/*":
            depth, k = 1, b
            while depth and (mark := _BLOCK_COMMENT.search(text, k)):
                depth, k = depth + (1 if mark[0] == "/*" else -1), mark.end()
            b = end = len(text) if depth else k
        hidden = text[a:b]
        out += (text[at:a], _INK.sub(" ", hidden) if "\n" in hidden else " " * len(hidden), text[b:end])
        at = end
    return "".join((*out, text[at:]))


_PAIRS = {"}": "{", ")": "(", "]": "["}
_BRACKET = re.compile(r"[{}()\[\]]")


def braces(text: str) -> dict[int, int]:
    """Place of each opening bracket → place of the one that closes it."""
    out, waiting = {}, []
    for m in _BRACKET.finditer(text):
        k = m.start()
        c = text[k]
        if c in "{([":
            waiting.append((c, k))
        else:
            while waiting:
                o, p = waiting.pop()
                out[p] = k
                if o == _PAIRS[c]:
                    break
    for _, p in waiting:
        out[p] = len(text)
    return out


_NESTING = re.compile(r"[(\[{<)\]}>]")


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts of a list, not split inside brackets."""
    if not _NESTING.search(text):
        return [p for x in text.split(mark) if (p := x.strip())]
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and k and text[k - 1] not in "-=":
            depth = max(0, depth - 1)
        if c == mark and not depth:
            out.append(text[last:k])
            last = k + 1
    return [p for x in (*out, text[last:]) if (p := x.strip())]


_BODY = re.compile(r"[{;(\[]")
_DOC_MARKS, _TAG, _HEAD_END = re.compile(r"^/\*+!?|\*+/$|^\*+"), re.compile(r"<[^>]*>"), re.compile(r"\s*(\{|:|=>)\s*$")
_CONTROL = re.compile(r"\b(if|else|match|switch|case|for|foreach|while|loop|do)\b")
#: A word at whose second letter no match can begin that does not begin at its first.
_WORD_BEGINS = r"(?<![^\W\d])(?=[^\W\d])"
_CALL = re.compile(rf"(?:{_WORD_BEGINS}|(?=\.))(?:\b(new)\s+)?((?:{_IDENT}+\s*(?:::(?:<[^<>()]*>)?|\??\.)\s*)*)(\.\s*)?({_IDENT}+)(!?)\s*(?:::\s*<[^<>()]*>\s*|<[\w\s,.\[\]?]*>\s*)?\(")
_NO_CALL = frozenset(CALL_KEYWORDS) | {"catch", "foreach", "using", "lock", "typeof", "nameof", "sizeof", "super", "constructor", "do", "case", "in", "where", "synchronized", "defer", "go", "func"}
_DEFINES = re.compile(r"\b(fn|func|function|def)\s+$")


class Source:
    """A brace language's file: masked text, brackets, lines."""

    def __init__(self, path: str, text: str, language: str):
        self.text, self.language = text, language
        self.code = masked(text, quotes="\"'`" if language in ("ts", "go") else "\"'", nested=language == "rust", chars=language in ("rust", "go", "java", "csharp"))
        self.close = braces(self.code)
        self.lines = text.split("\n")
        self.starts = [0, *itertools.accumulate(len(x) + 1 for x in self.lines[:-1])]
        self.rows = Rows(path)
        self.file = f"file:{path}"

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def body(self, at: int) -> tuple[int, int] | None:
        """The block that opens at or after a place, unless the statement ends before."""
        while m := _BODY.search(self.code, at):
            k = m.start()
            if m[0] == "{":
                return k, self.close[k]
            if m[0] == ";":
                return None
            at = self.close.get(k, k) + 1
        return None

    def doc(self, at: int) -> str | None:
        """Comment lines right above a place, without their marks; attributes in between are passed over."""
        lines, k, out = self.lines, self.line(at) - 2, []
        block = False
        while k >= 0:
            s = lines[k].strip()
            if block or s.endswith("*/"):
                block = not s.startswith("/*")
                out.append(_DOC_MARKS.sub("", s).strip())
            elif s.startswith("//"):
                out.append(_TAG.sub("", s.lstrip("/!")).strip() if self.language == "csharp" else s.lstrip("/!").strip())
            elif not (s.startswith(("#[", "@")) or s.startswith("[") and s.endswith("]")):
                break
            k -= 1
        text = "\n".join(x for x in reversed(out) if x)
        return text or None

    def span(self, begin: int, end: int, words: tuple[str, ...] = OTHER_BRANCHES) -> dict:
        if not self.rows.asks("start_line", "end_line", "cyclomatic", "loc"):
            return {}
        first, last = self.line(begin), self.line(min(end, len(self.text) - 1))
        return {"start_line": first, "end_line": last, "cyclomatic": lambda: count_branches(self.text[begin : end + 1], words), "loc": last - first + 1}

    def signature(self, begin: int, body: tuple[int, int] | None) -> str:
        head = self.text[begin : body[0] if body else self.text.find(";", begin)]
        return _HEAD_END.sub("", head.strip().split("\n", 1)[0]).strip()

    def calls(self, owner: str, begin: int, end: int, method_all: bool = False) -> None:
        """Call edges of a block, with the control blocks around each."""
        if not self.rows.wants("calls"):
            return
        found = list(_CALL.finditer(self.code, begin, end)) if self.code.find("(", begin, end) >= 0 else []
        if not found:
            return
        branches, loops = [], []
        for m in _CONTROL.finditer(self.code[begin:end]) if self.rows.asks("is_conditional", "is_in_loop") else ():
            block = self.body(begin + m.end())
            if block:
                (loops if m[1] in ("for", "foreach", "while", "loop", "do") else branches).append((begin + m.start(), block[1]))
        for m in found:
            new, lead, dot, name, bang = m.groups()
            if bang or name in _NO_CALL:
                continue
            before = self.code[max(0, m.start() - 12) : m.start()]
            if before[-1:].isspace() and _DEFINES.search(before):
                continue
            if new:
                kind = "constructor"
            elif lead.rstrip().endswith(".") or dot or before.rstrip().endswith(".") or method_all:
                kind = "method"
            else:
                kind = "constructor" if name[0].isupper() else "direct"
            at = m.start(4)
            inside = lambda spans: any(a <= at < b for a, b in spans)
            self.rows.edge("calls", owner, f"function:?:{name}", call_type=kind, is_conditional=inside(branches), is_in_loop=inside(loops))


#: What functions give rows of.
_OF_FUNCTIONS = ("function", "contains", "calls", "returns_type")


def parameter(name: str, kind: str, default: str, mutable: bool = False, reference: bool = False) -> dict:
    return {"name": name, "type_name": kind.strip() or default, "is_mutable": mutable, "is_reference": reference}


_VIS = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?"
#: What can't begin one of these is passed over by its first letter.
_RUST_FN = re.compile(rf"(?=[acefpu]){_VIS}(?P<mods>(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)fn\s+(?P<name>\w+)")
_RUST_ITEM = re.compile(rf"(?m)^[ \t]*+(?=[acdefipstu]){_VIS}(?:(?P<mods>(?:(?:const|async|unsafe|default|extern(?:\s*\"[^\"]*\")?)\s+)*)(?P<what>struct|enum|trait|impl|fn)\b\s*(?P<name>\w+)?|(?P<cs>const|static)\s+(?P<mut>mut\s+)?(?P<cname>\w+)\s*:\s*(?P<ctype>[^=;]+))")
_GENERICS, _RETURNS, _SELF = re.compile(r"\s*<([^{(;]*?)>\s*(?=[({;:=w]|where|for)"), re.compile(r"->\s*(.*?)\s*(?:\bwhere\b.*)?$", re.S), re.compile(r"(&\s*('\w+\s+)?)?(mut\s+)?self(\s*:.*)?")
_ATTRIBUTE, _WORDS, _FN_NAME, _TYPE_NAME = re.compile(r"#\[([^\]]*)\]"), re.compile(r"\w+"), re.compile(r"\bfn\s+(\w+)"), re.compile(r"\btype\s+(\w+)")
_RUST_FIELD, _MEMBER, _SUPERS = re.compile(r"(?:(pub(?:\s*\([^)]*\))?)\s+)?(\w+)\s*:\s*(.+)$", re.S), re.compile(r"(?:#\[[^\]]*\]\s*)*(\w+)"), re.compile(r":\s*([^{]*?)\s*(?:where\b|$)", re.S)


def _at_lines(pattern: re.Pattern, text: str, starts: Sequence[int]) -> Iterator[re.Match]:
    """The matches of a pattern that begins with ^, as finditer gives them, looked for at the beginnings of lines alone."""
    match, at = pattern.match, 0
    for k in starts:
        if k >= at and (m := match(text, k)):
            at = m.end()
            yield m


def rust(path: str, text: str) -> list[dict]:
    if text.count("{") != text.count("}") and not _HIDES.search(text):
        raise SyntaxError("unbalanced braces")
    s = Source(path, text, "rust")
    code = s.code
    if code.count("{") != code.count("}"):
        raise SyntaxError("unbalanced braces")
    seen: list[tuple[int, int, str]] = []  # blocks whose inside is not searched for items

    def visibility(m) -> str:
        v = (m["vis"] or "").replace(" ", "").strip()
        return {"": "private", "pub": "public", "pub(crate)": "public_crate", "pub(super)": "public_super"}.get(v, "public_in")

    def generics(at: int) -> list[str]:
        m = _GENERICS.match(code, at)
        return split_top(m[1]) if m else []

    def function(m, owner: str | None = None, holder: str | None = None) -> None:
        begin, name = m.start(), m["name"]
        if not s.rows.wants(*_OF_FUNCTIONS):
            return
        open_ = code.find("(", m.end())
        close = s.close.get(open_, open_)
        body = s.body(close + 1)
        end = body[1] if body else code.find(";", close)
        head = code[close + 1 : body[0] if body else end]
        back = _RETURNS.search(head) if "->" in head else None
        parameters = []
        for p in split_top(s.text[open_ + 1 : close]) if s.rows.asks("parameters") else ():
            if _SELF.fullmatch(p):
                continue
            left, _, kind = p.partition(":")
            parameters.append(parameter(re.sub(r"^mut\s+", "", left.strip()), kind, "_", left.strip().startswith("mut "), kind.strip().startswith("&")))
        qualified = f"{owner}::{name}" if owner else name
        words = m["mods"] or ""
        own = s.rows.node(
            "function", name, qualified, visibility=lambda: visibility(m), is_async="async" in words, is_unsafe="unsafe" in words, signature=lambda: s.signature(begin, body), parent=owner, return_type=back[1].strip() if back else None,
            doc_comment=lambda: s.doc(begin), parameters=parameters, attributes=lambda: generics(m.end()), **s.span(begin, end, RUST_BRANCHES),
        )
        if owner is None:
            s.rows.edge("contains", s.file, own)
            if back:
                s.rows.edge("returns_type", own, f"type:?:{back[1].strip()}")
        else:
            s.rows.edge("contains", holder or s.file, own)
        if body:
            s.calls(own, body[0] + 1, body[1])

    for m in _at_lines(_RUST_ITEM, code, s.starts):
        if any(a < m.start() < b for a, b, _ in seen):
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        attributes = _ATTRIBUTE.findall("\n".join(s.lines[max(0, s.line(begin) - 8) : s.line(begin) - 1]).rpartition("}")[2]) if s.rows.asks("attributes", "bases") and s.rows.wants("struct", "enum") else []
        derives = [d for a in attributes if a.startswith("derive") for d in _WORDS.findall(a[6:])]
        if m["cs"]:
            own = s.rows.node(m["cs"], m["cname"], start_line=s.line(begin), end_line=s.line(begin), visibility=lambda: visibility(m), return_type=m["ctype"].strip(), doc_comment=lambda: s.doc(begin), is_unsafe=bool(m["mut"]))
            s.rows.edge("contains", s.file, own)
            continue
        what = m["what"]
        if what == "fn":
            inner = _RUST_FN.search(code, begin)
            body = s.body(s.close.get(code.find("(", m.end()), m.end()) + 1)
            function(inner)
            if body:
                seen.append((*body, "fn"))
            continue
        body = s.body(m.end("what"))
        end = body[1] if body else code.find(";", m.end())
        if body:
            seen.append((*body, what))
        plain = code[body[0] + 1 : body[1]] if body else ""
        common = {"visibility": lambda: visibility(m), "doc_comment": lambda: s.doc(begin), **(s.span(begin, end, RUST_BRANCHES) if s.rows.wants(what) else {})}
        if what == "struct":
            fields = []
            for part in split_top(_ATTRIBUTE.sub("", plain)) if s.rows.asks("fields") and s.rows.wants("struct") else ():
                f = _RUST_FIELD.match(part)
                if f:
                    fields.append({"name": f[2], "type_name": f[3].strip(), "visibility": "public" if f[1] == "pub" else "public_crate" if f[1] else "private", "attributes": [], "doc_comment": None})
            own = s.rows.node("struct", m["name"], fields=fields, bases=derives, attributes=attributes, **common)
            s.rows.edge("contains", s.file, own)
        elif what == "enum":
            members = lambda: [v[1] for v in map(_MEMBER.match, split_top(plain)) if v]
            own = s.rows.node("enum", m["name"], members=members, bases=derives, attributes=attributes, **common)
            s.rows.edge("contains", s.file, own)
        elif what == "trait":
            supers = _SUPERS.search(code[m.end() : body[0]])
            if not s.rows.wants("trait", "contains", "extends"):
                continue
            methods = list(_FN_NAME.finditer(plain))
            provided = [f[1] for f in methods if (b := s.body(s.close.get(code.find("(", body[0] + 1 + f.end()), 0) + 1)) and b[1] < body[1]]
            own = s.rows.node("trait", m["name"], bases=[x.strip() for x in supers[1].split("+")] if supers and supers[1] else [], members=[f[1] for f in methods if f[1] not in provided], attributes=provided + [f"type {x}" for x in _TYPE_NAME.findall(plain)], **common)
            s.rows.edge("contains", s.file, own)
            for base in [x.strip() for x in supers[1].split("+")] if supers and supers[1] else []:
                s.rows.edge("extends", own, f"trait:?:{base}")
        elif what == "impl":
            head = code[m.end("what") : body[0]].strip()
            if head.startswith("<"):
                depth = 0
                for k, c in enumerate(head):
                    depth += (c == "<") - (c == ">")
                    if not depth:
                        head = head[k + 1 :].strip()
                        break
            head = re.split(r"\bwhere\b", head)[0].strip()
            trait, target = (x.strip() for x in head.split(" for ", 1)) if " for " in head else (None, head)
            name = f"{trait}_for_{target}" if trait else target
            own = s.rows.node("impl", name, target, members=lambda: _FN_NAME.findall(plain), parent=trait, return_type=target, **common)
            s.rows.edge("contains", s.file, own)
            if trait:
                s.rows.edge("implements", own, f"trait:?:{trait}")
            done = body[0]
            for f in _RUST_FN.finditer(code, body[0] + 1, body[1]) if s.rows.wants(*_OF_FUNCTIONS) else ():
                if f.start() < done:
                    continue
                function(f, target, own)
                own_body = s.body(s.close.get(code.find("(", f.end()), f.end()) + 1)
                done = own_body[1] if own_body else f.end()
    return s.rows.done()


_TS_ITEM = re.compile(rf"\b(?=[a-f]|i)(?P<lead>(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+|const\s+)*)(?P<what>function\b\s*\*?|class\b|interface\b|enum\b)\s*(?P<name>{_IDENT})")
_TS_METHOD = re.compile(rf"(?m)^[ \t]*(?P<lead>(?:(?:public|private|protected|static|async|readonly|abstract|get|set|override)\s+)*)(?P<name>#?{_IDENT})\s*(?:<[^>(]*>)?\(")
_TS_FIELD = re.compile(rf"(?m)^[ \t]*((?:(?:public|private|protected|static|readonly)\s+)*)({_IDENT})\s*[?!]?:\s*([^=;(]+)(?:=[^;]*)?;")
_TS_RETURNS, _TS_PUBLIC, _TS_BASES = re.compile(r"\s*:\s*([^{;=]+)"), re.compile(r"\bexport\b|\bpublic\b"), re.compile(r"(?:extends|implements)\s+([^{]*?)(?=\bimplements\b|$)", re.S)
_DEFAULT, _PARAMETER_MARKS = re.compile(r"=.*$", re.S), re.compile(r"^(public|private|protected|readonly)\s+|\?$")


def typescript(path: str, text: str) -> list[dict]:
    s = Source(path, text, "ts")

    def add(kind: str, name: str, begin: int, open_: int, lead: str, parent: str | None = None) -> None:
        close = s.close.get(open_, open_)
        body = s.body(close + 1)
        end = body[1] if body else max(close, s.code.find(";", close))
        back = _TS_RETURNS.match(s.code[close + 1 : body[0] if body else end + 1])
        parameters = []
        for p in split_top(s.text[open_ + 1 : close]) if s.rows.asks("parameters") else ():
            left, _, kind_ = _DEFAULT.sub("", p).partition(":")
            parameters.append(parameter(_PARAMETER_MARKS.sub("", left.strip()), kind_, "any"))
        head = s.text[begin : body[0] if body else end]
        seen = s.text[begin : end + 1] if kind == "function" else head
        visibility = "public" if _TS_PUBLIC.search(lead + seen[: len(head)]) else "private" if "private" in lead else "public_super" if "protected" in lead else "private"
        own = s.rows.node("function", name, visibility=visibility, is_async="async" in lead.split(), is_unsafe=False, signature=lambda: s.signature(begin, body), parent=parent, return_type=back[1].strip() if back else None, doc_comment=lambda: s.doc(begin), parameters=parameters, **s.span(begin, end))
        s.rows.edge("contains", s.file, own)
        if body:
            s.calls(own, body[0] + 1, body[1])

    for m in _TS_ITEM.finditer(s.code):
        begin, what = m.start(), m["what"].rstrip("* \t")
        if what == "function":
            if s.rows.wants(*_OF_FUNCTIONS):
                add("function", m["name"], begin, s.code.find("(", m.end()), m["lead"])
            continue
        body = s.body(m.end())
        if not body:
            continue
        head = s.code[m.end() : body[0]]
        bases = [b.strip() for part in _TS_BASES.findall(head) for b in split_top(part)]
        common = {"visibility": "public" if "export" in m["lead"] else "private", "doc_comment": lambda: s.doc(begin), "bases": bases, **s.span(begin, body[1])}
        plain = s.code[body[0] + 1 : body[1]]
        if what == "enum":
            own = s.rows.node("enum", m["name"], members=lambda: [v[0] for v in map(_WORDS.match, split_top(plain)) if v], **common)
        elif what == "interface":
            own = s.rows.node("trait", m["name"], members=lambda: [x["name"] for x in _TS_METHOD.finditer(plain)], **common)
        else:
            fields = [{"name": f[2], "type_name": f[3].strip(), "visibility": "private" if "private" in f[1] else "public_super" if "protected" in f[1] else "public", "attributes": f[1].split(), "doc_comment": None} for f in _TS_FIELD.finditer(plain)] if s.rows.asks("fields") and s.rows.wants("struct") else []
            own = s.rows.node("struct", m["name"], fields=fields, attributes=[], **common)
        s.rows.edge("contains", s.file, own)
        if what == "class" and s.rows.wants(*_OF_FUNCTIONS):
            deeper = [(a, b) for a, b in s.close.items() if body[0] < a and b < body[1] and s.code[a] == "{"]
            for f in _TS_METHOD.finditer(s.code, body[0] + 1, body[1]):
                open_ = s.code.find("(", f.end("name"))
                if f["name"] not in CALL_KEYWORDS and f["name"] not in ("catch", "super") and s.body(s.close.get(open_, open_) + 1) and not any(a < f.start() < b for a, b in deeper):
                    add("function", f["name"], f.start("lead") if f["lead"] else f.start("name"), open_, f["lead"], m["name"])
    return s.rows.done()


def go(path: str, text: str) -> list[dict]:
    s = Source(path, text, "go")
    public = lambda n: "public" if n[0].isupper() else "private"
    for m in re.finditer(rf"(?m)^func\s+(?:\(\s*(?:\w+\s+)?(?P<ptr>\*?)\s*(?P<recv>\w+)[^)]*\)\s*)?(?P<name>{_IDENT})\s*(?:\[[^\]]*\])?\(|^type\s+(?P<type>{_IDENT})(?:\[[^\]]*\])?\s+(?P<what>struct|interface)\b", s.code):
        begin = m.start()
        if m["type"]:
            body = s.body(m.end())
            if not body:
                continue
            plain = s.code[body[0] + 1 : body[1]]
            common = {"visibility": public(m["type"]), "doc_comment": lambda: s.doc(begin), **s.span(begin, body[1])}
            if m["what"] == "struct":
                fields = [{"name": n.strip(), "type_name": f[2].strip(), "visibility": public(n.strip()), "attributes": [], "doc_comment": None} for f in re.finditer(rf"(?m)^\s*({_IDENT}(?:\s*,\s*{_IDENT})*)\s+([^\n`]+)", plain) for n in f[1].split(",")] if s.rows.wants("struct") else []
                own = s.rows.node("struct", m["type"], fields=fields, bases=[], attributes=[], **common)
            else:
                own = s.rows.node("trait", m["type"], members=lambda: re.findall(rf"(?m)^\s*({_IDENT})\s*\(", plain), bases=[], **common)
            s.rows.edge("contains", s.file, own)
            continue
        if not s.rows.wants(*_OF_FUNCTIONS):
            continue
        open_ = m.end() - 1
        close = s.close.get(open_, open_)
        body = s.body(close + 1)
        end = body[1] if body else close
        parameters, waiting = [], []
        for p in split_top(s.text[open_ + 1 : close]) if s.rows.asks("parameters") else ():
            name, _, kind = p.partition(" ")
            waiting.append(name)
            if kind:
                parameters += [parameter(n, kind, "interface{}", False, kind.strip().startswith("*")) for n in waiting]
                waiting = []
        parameters += [parameter("", n, "interface{}") for n in waiting]
        qualified = f"{m['recv']}.{m['name']}" if m["recv"] else m["name"]
        back = s.code[close + 1 : body[0] if body else end].strip()
        own = s.rows.node("function", m["name"], qualified, visibility=public(m["name"]), is_async=False, is_unsafe=False, signature=lambda: s.signature(begin, body), parent=m["recv"], return_type=back or None, doc_comment=lambda: s.doc(begin), parameters=parameters, **s.span(begin, end))
        s.rows.edge("contains", s.file, own)
        if body:
            s.calls(own, body[0] + 1, body[1])
    return s.rows.done()


_MODIFIERS = "public|private|protected|internal|static|final|abstract|sealed|partial|readonly|const|virtual|override|async|unsafe|extern|synchronized|native|default|strictfp|transient|volatile|new|required"


_DECLARED = re.compile(rf"\b(?P<mods>(?:(?:{_MODIFIERS})\s+)*)(?P<what>class|interface|enum|struct|record)\s+(?P<name>{_IDENT})")
_MODS = rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)"
_TYPE = rf"(?P<type>{_IDENT}+(?:\.{_IDENT}+)*(?:<[^()=;{{}}]*>)?(?:\[\])*\??)"
_METHOD = re.compile(rf"(?:{_WORD_BEGINS}|(?=<)){_MODS}(?:<[^>(]*>\s*)?{_TYPE}\s+(?P<name>{_IDENT}+)\s*(?:<[^>(]*>)?\(")
_FIELD = re.compile(rf"{_WORD_BEGINS}{_MODS}{_TYPE}\s+(?P<names>{_IDENT}+(?:\s*=[^;{{]*)?(?:\s*,\s*{_IDENT}+(?:\s*=[^;{{,]*)?)*)\s*(?P<end>;|\{{\s*(?:get|set|init)\b)")
_CONSTRUCTOR = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)+)(?P<type>)(?P<name>{_IDENT})\s*\(")
_OPENS = re.compile(r"\s*\(")
_ASSIGNED, _MARKED, _ROLE = re.compile(r"\s*=.*$", re.S), re.compile(r"@\w+\s+|\[[^\]]*\]\s*"), re.compile(r"^(final|ref|out|in|params|this)\s+")


def _classes(path: str, text: str, language: str) -> list[dict]:
    s = Source(path, text, language)
    java = language == "java"
    none = "public_crate" if java else "private"

    def visibility(mods: str) -> str:
        words = mods.split()
        return "public" if "public" in words else "private" if "private" in words else "public_super" if "protected" in words else "public_crate" if "internal" in words else none

    def top_of(a: int, b: int) -> Callable[[int], bool]:
        """Whether a place is in a block and not inside a deeper one."""
        opened, closed, k = [], [], a
        while 0 <= (k := s.code.find("{", k, b)):
            opened.append(k)
            closed.append(s.close[k])
            k = s.close[k] + 1
        return lambda at: a <= at < b and (not (n := bisect.bisect_left(opened, at)) or at > closed[n - 1])

    def called_there(name: str, a: int, b: int) -> bool:
        """Whether a name stands before an opening bracket anywhere, as a constructor's must."""
        while 0 <= (a := s.code.find(name, a, b)):
            a += len(name)
            if _OPENS.match(s.code, a, b):
                return True
        return False

    def add(m, owner: str | None) -> None:
        open_ = m.end() - 1
        close = s.close.get(open_, open_)
        body = s.body(close + 1)
        end = body[1] if body else s.code.find(";", close)
        words = m["mods"].split()
        parameters = []
        for p in split_top(s.text[open_ + 1 : close]) if s.rows.asks("parameters") else ():
            p = _ASSIGNED.sub("", _MARKED.sub("", p) if not p.endswith("]") else p)
            kinds, _, name = p.rpartition(" ")
            marks = [w for w in ("final", "ref", "out", "in", "params", "this") if re.match(rf"{w}\b", kinds)]
            kind = _ROLE.sub("", kinds)
            parameters.append(parameter(name, kind, "Object" if java else "object", java and "final" not in marks, not java and bool({"ref", "out", "in"} & set(marks))))
        fast, unsafe = ("synchronized", "native") if java else ("async", "unsafe")
        own = s.rows.node(
            "function", m["name"], f"{owner}.{m['name']}" if owner else m["name"], visibility=lambda: visibility(m["mods"]), is_async=fast in words, is_unsafe=unsafe in words, signature=lambda: s.signature(m.start(), body), parent=owner,
            return_type=m["type"] if m["type"] not in ("public", "private", "protected") else None, doc_comment=lambda: s.doc(m.start()), parameters=parameters, attributes=words, **s.span(m.start(), end),
        )
        s.rows.edge("contains", s.file, own)
        if body:
            s.calls(own, body[0] + 1, body[1], method_all=True)

    for m in _DECLARED.finditer(s.code):
        body = s.body(m.end())
        if not body:
            continue
        head = s.code[m.end() : body[0]]
        if java:
            bases = [b.strip() for part in re.findall(r"(?:extends|implements)\s+([^{]*?)(?=\bimplements\b|\bpermits\b|$)", head, re.S) for b in split_top(part)]
        else:
            listed = re.search(r":\s*([^{]*?)\s*(?:\bwhere\b|$)", head, re.S)
            bases = split_top(listed[1]) if listed else []
        what, top = m["what"], top_of(body[0] + 1, body[1])
        methods = s.rows.wants(*_OF_FUNCTIONS)
        searched = methods or what == "interface" and s.rows.wants("trait")
        found = [] if not searched or s.code.find("(", body[0] + 1, body[1]) < 0 else [f for f in _METHOD.finditer(s.code, body[0] + 1, body[1]) if top(f.start()) and top(f.start("name")) and f["type"] not in ("return", "new", "throw", "else", "await", "case", "yield")]
        if searched and called_there(m["name"], body[0] + 1, body[1]):
            found += [c for c in _CONSTRUCTOR.finditer(s.code, body[0] + 1, body[1]) if c["name"] == m["name"] and top(c.start()) and not any(f.start("name") == c.start("name") for f in found)]
        common = {"visibility": lambda: visibility(m["mods"]), "doc_comment": lambda: s.doc(m.start()), "bases": bases, "attributes": m["mods"].split(), **s.span(m.start(), body[1])}
        plain = s.code[body[0] + 1 : body[1]]
        if what == "interface":
            own = s.rows.node("trait", m["name"], members=[f["name"] for f in found], **common)
        elif what == "enum":
            own = s.rows.node("enum", m["name"], members=lambda: [re.match(r"\w+", v)[0] for v in split_top(plain.split(";")[0]) if re.match(r"\w+", v)], **common)
        else:
            fields = []
            for f in _FIELD.finditer(s.code, body[0] + 1, body[1]) if s.rows.asks("fields") and s.rows.wants("struct") else ():
                if top(f.start()) and top(f.start("names")) and f["type"] not in ("return", "throw", "package", "import", "using", "new", "else"):
                    fields += [{"name": re.match(r"\w+", n)[0], "type_name": f["type"], "visibility": visibility(f["mods"]), "attributes": f["mods"].split(), "doc_comment": None} for n in split_top(f["names"])]
            own = s.rows.node("struct", m["name"], fields=fields, **common)
        s.rows.edge("contains", s.file, own)
        for f in sorted(found, key=lambda f: f.start()) if methods else ():
            add(f, None if what == "interface" else m["name"])
    return s.rows.done()


def java(path: str, text: str) -> list[dict]:
    return _classes(path, text, "java")


def csharp(path: str, text: str) -> list[dict]:
    return _classes(path, text, "csharp")


def _children(n: ast.AST) -> Iterator[ast.AST]:
    for name in n._fields:
        value = getattr(n, name, None)
        if isinstance(value, list):
            yield from (x for x in value if isinstance(x, ast.AST))
        elif isinstance(value, ast.AST):
            yield value


def _source(n: ast.AST) -> str:
    return n.id if isinstance(n, ast.Name) else ast.unparse(n)


#: Parts of a tree in which nothing is defined or called.
_LEAVES = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop, ast.Constant, ast.Name)


def python(path: str, text: str) -> list[dict]:
    tree, rows, file = ast.parse(text), Rows(path), f"file:{path}"
    lines = text.split("\n")

    def visibility(name: str) -> str:
        return "private" if name.startswith("__") and not name.endswith("__") else "public_crate" if name.startswith("_") else "public"

    def span(n: ast.AST) -> dict:
        part = lambda: "\n".join(lines[n.lineno - 1 : n.end_lineno])
        return {"start_line": n.lineno, "end_line": n.end_lineno, "cyclomatic": lambda: count_branches(part(), OTHER_BRANCHES), "loc": n.end_lineno - n.lineno + 1}

    def calls(owner: str, n: ast.AST, conditional: bool, loop: bool) -> None:
        for child in _children(n):
            if isinstance(child, _LEAVES):
                continue
            c, l = conditional or isinstance(child, ast.If | ast.IfExp | ast.Match), loop or isinstance(child, ast.For | ast.AsyncFor | ast.While)
            if isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    rows.edge("calls", owner, f"function:?:{f.id}", call_type="constructor" if f.id[0].isupper() else "direct", is_conditional=c, is_in_loop=l)
                elif isinstance(f, ast.Attribute):
                    rows.edge("calls", owner, f"function:?:{f.attr}", call_type="method", is_conditional=c, is_in_loop=l)
                else:
                    continue
            calls(owner, child, c, l)

    def visit(n: ast.AST, parent: str | None) -> None:
        for child in _children(n):
            if isinstance(child, ast.expr | ast.expr_context):
                continue  # they define nothing
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                a = child.args
                listed = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
                parameters = [parameter(p.arg, _source(p.annotation) if p.annotation else "", "Any") for p in listed if p.arg not in ("self", "cls")]
                own = rows.node(
                    "function", child.name, visibility=visibility(child.name), is_async=isinstance(child, ast.AsyncFunctionDef), is_unsafe=False, signature=re.sub(r"\s*:\s*$", "", lines[child.lineno - 1].strip()), parent=parent,
                    return_type=_source(child.returns) if child.returns else None, doc_comment=lambda: ast.get_docstring(child), parameters=parameters, attributes=[_source(d) for d in child.decorator_list], **span(child),
                )
                rows.edge("contains", file, own)
                for statement in child.body:
                    calls(own, ast.Module([statement], []), False, False)
            elif isinstance(child, ast.ClassDef):
                made = next((f for f in child.body if isinstance(f, ast.FunctionDef) and f.name == "__init__"), None)
                names = dict.fromkeys(x.attr for x in ast.walk(made) if isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name) and x.value.id == "self") if made else {}
                fields = [{"name": x, "type_name": "Any", "visibility": "public", "attributes": [], "doc_comment": None} for x in names]
                own = rows.node("struct", child.name, visibility=visibility(child.name), doc_comment=lambda: ast.get_docstring(child), fields=fields, bases=[_source(b) for b in child.bases], attributes=[], **span(child))
                rows.edge("contains", file, own)
            visit(child, child.name if isinstance(child, ast.ClassDef) else parent)

    visit(tree, None)
    return rows.done()


PARSERS: dict[str, Callable[[str, str], list[dict]]] = {"rs": rust, "ts": typescript, "tsx": typescript, "js": typescript, "jsx": typescript, "mjs": typescript, "cjs": typescript, "py": python, "pyi": python, "go": go, "java": java, "cs": csharp}


def register(extension: str, parser: Callable[[str, str], list[dict]]) -> None:
    """Adds a parser; the last one registered for an extension counts."""
    PARSERS[extension.lower()] = parser


def extract_file(path: str, text: str, parsers: dict[str, Callable[[str, str], list[dict]]] = PARSERS) -> list[dict] | None:
    """Rows of one file by its language's parser; None if there is none or it fails."""
    parser = parsers.get(path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else "")
    try:
        return parser(path, text) if parser else None
    except (SyntaxError, ValueError, RecursionError, IndexError, KeyError):
        return None


#: The kind of a row that stands for a file whose parser failed.
FAILED = "failed"


#: Rows that are handed on at once.
HANDED = 8192


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    """Rows as columns; what a row lacks is null. Only what rows have is looked at, so that edges cost nothing for the columns of nodes."""
    place, value = {c: [] for c in kinds.names}, {c: [] for c in kinds.names}
    for n, r in enumerate(rows):
        for c, v in r.items():
            if v is not None and c in place:
                place[c].append(n)
                value[c].append(v)

    def column(c: str, kind: pa.DataType) -> pa.Array:
        if not value[c]:
            return pa.nulls(len(rows), kind)
        own = pa.array(value[c], kind)
        if len(own) == len(rows):
            return own
        at = np.full(len(rows), -1, np.int32)
        at[place[c]] = np.arange(len(own), dtype=np.int32)
        return own.take(pa.array(at, mask=at < 0))

    return pa.RecordBatch.from_arrays([column(k.name, k.type) for k in kinds], schema=kinds)


def parsed(files: DataFrame, columns: Sequence[str] = COLUMNS, wanted: Collection[str] | None = None, firsts: bool = False) -> DataFrame:
    """files: path, content → rows of the schema Extracted, and of each file that its parser can't read one row of kind FAILED with its content.

    Of the schema only columns, file_path and kind; of the rows only nodes of a kind and edges of a type that is wanted. firsts
    (of kinds of nodes): of nodes of one id in a file only the first; ordinals then only rise in the order of a file, so that
    nothing is made for rows that aren't wanted.
    """
    parsers = dict(PARSERS)  # as they are registered here, not in the workers
    own = [f for f in schemas.Extracted if f.name in (*columns, "file_path", "kind")]
    kinds = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in own), ("content", pa.string())])
    wanted = None if wanted is None else frozenset(wanted)
    asked = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with asking(asked, wanted if firsts or "ordinal" not in asked else None):  # workers are used again
            yield from made_of(batches)

    def made_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, content = path.as_py(), content.as_py()
                made = extract_file(path, content, parsers) if content else []
                if made is None:
                    rows.append({"file_path": path, "kind": FAILED, "ordinal": 0, "content": content})
                else:
                    own = made if wanted is None else [r for r in made if (r.get("edge_type") or r["kind"]) in wanted]
                    rows += reversed({r.get("id"): r for r in reversed(own)}.values()) if firsts else own
                if len(rows) >= HANDED:
                    yield _batch(rows, kinds)
                    rows = []
        yield _batch(rows, kinds)

    return files.select("path", "content").mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in own), T.StructField("content", T.StringType())]))


def extracted(files: DataFrame, columns: Sequence[str] = COLUMNS, wanted: Collection[str] | None = None, firsts: bool = False) -> DataFrame:
    """files: path, content → rows of the schema Extracted: by parsers where there is one that can read the file, by patterns elsewhere.

    Only columns, and if wanted is given, only nodes of these kinds and edges of these types (firsts: see parsed). What parsers give is written
    once, files that they can't read with their content, so that no file is looked up again; what patterns never give isn't
    asked of them.
    """
    files = files.select("path", "content")
    name = X.file_name(F.col("path"))
    has_parser = F.coalesce(name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*PARSERS), F.lit(False))
    made = parsed(files.where(has_parser), columns, wanted, firsts)
    if wanted is not None and not blocks.GIVEN & set(wanted):
        return made.where(F.col("kind") != FAILED).select(*columns)
    made = stored(made)
    failed = made.where(F.col("kind") == FAILED).select(F.col("file_path").alias("path"), "content")
    only = wanted if firsts or "ordinal" not in columns else None
    rest = blocks.fallback_rows(files.where(~has_parser).unionByName(failed), wanted=only)
    if wanted is not None:
        rest = rest.where(F.coalesce("edge_type", "kind").isin(*wanted))
    if firsts:
        rest = first_per_id(rest.select(*dict.fromkeys((*columns, "id", "ordinal"))))
    return made.where(F.col("kind") != FAILED).select(*columns).unionByName(rest.select(*columns))
