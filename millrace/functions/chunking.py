"""Chunkers of one text, in plain Python; operators.chunks applies them in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

Chunker = Callable[[str], list[str]]

SEPARATORS = ("\n\n", "\n", " ", "")
# What a definition, a fenced block, a table row and a rule row look like, and where a body may be cut.
_DEFINITION = re.compile(r"(?:async )?(?:def|class|function|public|private|protected) ")
_FENCE = re.compile(r"```(\w*)\n(.*?)\n```", re.S)
_TABLE_ROW = re.compile(r"\|.*\|")
_RULE_ROW = re.compile(r"\|[-:\s|]+\|$")
_BODY_BREAK = ("if ", "for ", "while ", "try:", "with ", "elif ", "else:", "return")


def _pack(parts: Iterable[str], size: int, overlap: int, glue: str) -> list[str]:
    """Greedy runs of parts of at most ``size`` characters; each starts with up to ``overlap`` of the one before."""
    out: list[str] = []
    run: list[str] = []
    length = 0
    for part in parts:
        grown = length + len(part) + (len(glue) if run else 0)
        if run and grown > size:
            out.append(glue.join(run))
            while run and (length > overlap or length + len(part) + len(glue) > size):
                length -= len(run.pop(0)) + (len(glue) if run else 0)
            grown = length + len(part) + (len(glue) if run else 0)
        run.append(part)
        length = grown
    if run:
        out.append(glue.join(run))
    return [c for c in (c.strip() for c in out) if c]


def recursive(text: str, size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that makes them fit.

    Every character that isn't white space is in a chunk; neighbours share at
    most ``overlap`` characters.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator == "":
        step = max(1, size - overlap)
        return [c for c in (text[i : i + size].strip() for i in range(0, max(1, len(text) - overlap), step)) if c]
    out: list[str] = []
    fitting: list[str] = []
    for part in text.split(separator):
        if len(part) <= size:
            if part:
                fitting.append(part)
            continue
        out += _pack(fitting, size, overlap, separator)
        fitting = []
        out += recursive(part, size, overlap, finer or ("",))
    return out + _pack(fitting, size, overlap, separator)


def sentences(text: str) -> list[str]:
    return [s for s in (s.strip() for s in re.split(r"(?<=[.!?])\s+", text)) if s]


def by_sentences(text: str, target: int = 500, overlap: int = 1) -> list[str]:
    """Sentences packed up to ``target`` characters; a chunk starts with the last ``overlap`` sentences of the one before.

    The first sentence of a chunk is taken whatever its length.
    """
    out: list[str] = []
    run: list[str] = []
    length = 0
    for s in sentences(text):
        if run and length + 1 + len(s) > target:
            out.append(" ".join(run))
            run = run[-overlap:] if overlap else []
            length = len(" ".join(run))
        length += len(s) + bool(run)
        run.append(s)
    return [*out, " ".join(run)] if run else out


def _definitions(lines: Sequence[str]) -> list[int]:
    return [i for i, line in enumerate(lines) if _DEFINITION.match(line.strip())]


def _cut_lines(lines: Sequence[str], may_cut: Callable[[int, int], bool], keep: Callable[[list[str]], list[str]] = lambda run: []) -> list[str]:
    """Runs of lines; ``may_cut(i, characters so far)`` ends one after line i, ``keep`` says which lines the next repeats."""
    out, run, size = [], [], -1
    for i, line in enumerate(lines):
        run.append(line)
        size += len(line) + 1
        if may_cut(i, size):
            text = "\n".join(run)
            if text.strip():
                out.append(text)
            run = keep(run)
            size = sum(map(len, run)) + len(run) - 1
    tail = "\n".join(run)
    return out + ([tail] if tail.strip() and tail not in out else [])


def logical_parts(code: str, size: int) -> list[str]:
    """Code cut after imports, comments and, from 60 % of ``size``, blank lines, once 80 % full."""
    lines = code.split("\n")

    def block_ends(i: int, starts: tuple[str, ...]) -> bool:
        return lines[i].strip().startswith(starts) and not lines[i + 1].strip().startswith(starts)

    def may_cut(i: int, so_far: int) -> bool:
        if i + 1 >= len(lines) or so_far < 0.8 * size:
            return False
        blank = not lines[i].strip() and bool(lines[i + 1].strip())
        return block_ends(i, ("import ", "from ")) or block_ends(i, ("#",)) or blank

    return _cut_lines(lines, may_cut) or [code]


def function_parts(lines: Sequence[str], size: int) -> list[str]:
    """A long function cut inside its body once 80 % full; the next part repeats its last two lines."""

    def may_cut(i: int, so_far: int) -> bool:
        line = lines[i].strip()
        blank = not line and i + 1 < len(lines) and bool(lines[i + 1].strip())
        return i > 0 and so_far >= 0.8 * size and (line.startswith(_BODY_BREAK) or line.startswith("#") and len(line) > 10 or blank)

    return _cut_lines(lines, may_cut, lambda run: run[-min(2, len(run) - 1) :] if len(run) > 1 else [])


def _code_block(code: str, size: int) -> list[str]:
    """A long fenced block cut before definitions once 80 % full, what stays too long at logical places."""
    lines = code.split("\n")
    starts = set(_definitions(lines))
    if not starts:
        return logical_parts(code, size)
    parts = _cut_lines(lines, lambda i, so_far: i + 1 in starts and so_far >= 0.8 * size)
    return parts[:-1] + (logical_parts(parts[-1], size) if len(parts[-1]) > size else parts[-1:])


def by_code(text: str, size: int = 800, overlap: int = 50) -> list[str]:
    """Fenced blocks stay whole or are cut at definitions; unfenced code is cut into its definitions.

    Without fences what stands before the first definition is left out.
    """
    fences = list(_FENCE.finditer(text))
    if fences:
        out, last = [], 0
        for m in fences:
            out += recursive(text[last : m.start()].strip(), size, overlap)
            out += [m[0]] if len(m[0]) <= size else [f"```{m[1]}\n{part}\n```" for part in _code_block(m[2], size)]
            last = m.end()
        return out + recursive(text[last:].strip(), size, overlap)
    lines = text.split("\n")
    starts = _definitions(lines)
    if not starts:
        return recursive(text, size, overlap)
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        whole = "\n".join(lines[a:b])
        out += [whole] if len(whole) <= size else function_parts(lines[a:b], size)
    return out


def _table_parts(rows: list[str], size: int) -> list[str]:
    """Rows under a repeated header; the row that overflows ends one part and begins the next."""
    head = rows[: 2 if len(rows) > 1 and _RULE_ROW.match(rows[1]) else 1]
    out, run = [], []
    for row in rows[len(head) :]:
        run.append(row)
        text = "\n".join(head + run)
        if len(text) > size:
            out.append(text)
            run = [row]
    return out + (["\n".join(head + run)] if run else [])


def by_tables(text: str, size: int = 1000, max_table: int = 2000, overlap: int = 50) -> list[str]:
    """Markdown tables (two rows or more) stay whole up to ``max_table``, else are cut by rows; the rest recursively."""
    out: list[str] = []
    run: list[str] = []
    plain: list[str] = []

    def flush_table() -> None:
        if len(run) < 2:
            plain.extend(run)
        else:
            out.extend(recursive("\n".join(plain).strip(), size, overlap))
            plain.clear()
            whole = "\n".join(run)
            out.extend([whole] if len(whole) <= max_table else _table_parts(run, size))
        run.clear()

    for line in text.split("\n"):
        if _TABLE_ROW.match(line):
            run.append(line)
        else:
            flush_table()
            plain.append(line)
    flush_table()
    return out + recursive("\n".join(plain).strip(), size, overlap)


STRATEGIES: dict[str, Callable[..., list[str]]] = {"recursive": recursive, "semantic": by_sentences, "code_aware": by_code, "table_aware": by_tables}
