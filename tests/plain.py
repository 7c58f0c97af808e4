"""Plain versions of table operators, file by file, to hold them against."""

import itertools
import operator
import re

from tessera.operators.blocks import FUNCTION_PATTERNS, FUNCTION_STOP, NO_FUNCTION, STRUCT_PATTERNS, STRUCT_STOP
from tessera.operators.extract import Rows
from tessera.operators.stats import CALL_KEYWORDS


def _named(m: re.Match, stop) -> str:
    """The last group, trimmed, that is a word and none of the stop words."""
    words = [g.strip() for g in (m[0], *m.groups()) if g]
    return next((w for w in reversed(words) if re.fullmatch(r"\w+", w) and w not in stop), "")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def block_end(lines: list[str], begin: int) -> int:
    """1-based last line of the block that begins at a 0-based line: the first line behind at which the running balance of
    brackets is none after a block has opened, or the line before if that one belongs to what follows; 50 lines otherwise."""
    rest = itertools.islice(lines, begin, None)
    balances = itertools.accumulate(line.count("{") - line.count("}") for line in rest)
    opens = itertools.accumulate(("{" in line or line.strip().endswith(":") for line in itertools.islice(lines, begin, None)), operator.or_)
    closed = next((k for k, (balance, opened) in enumerate(zip(balances, opens), begin) if k > begin and opened and balance <= 0), None)
    if closed is None:
        return min(begin + 50, len(lines))
    follows = lines[closed].strip() and _indent(lines[closed]) <= _indent(lines[begin]) and "}" not in lines[closed]
    return closed if follows else closed + 1


def fallback(path: str, text: str) -> list[dict]:
    """Structs and functions by pattern, in the order of patterns and places, with the calls of each function's block."""
    text = "\n".join(x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")) if text else ""
    rows, lines = Rows(path), text.split("\n")
    kinds = [(p, "struct", STRUCT_STOP, True) for p in STRUCT_PATTERNS] + [(p, "function", FUNCTION_STOP, simple) for p, simple in FUNCTION_PATTERNS]
    for pattern, kind, stop, simple in kinds:
        for m in re.finditer(pattern, text):
            name = _named(m, stop if simple else ())
            if not name or kind == "function" and name in NO_FUNCTION:
                continue
            begin = text.count("\n", 0, m.start()) + 1
            end = block_end(lines, min(begin - 1, len(lines) - 1))
            visible = "public" if "pub" in m[0] or "export" in m[0] else "private"
            own = rows.node(kind, name, start_line=begin, end_line=end, visibility=visible, is_async="async" in m[0] if kind == "function" else None)
            rows.edge("contains", f"file:{path}", own)
            if kind == "function":
                for call in re.findall(r"\b(\w+)\s*\(", "\n".join(lines[begin - 1 : end])):
                    if call not in CALL_KEYWORDS:
                        rows.edge("calls", own, f"function:?:{call}", call_type="direct", is_conditional=False, is_in_loop=False)
    return rows.done()
