"""Declarations with their place: imports with specifiers, exports, functions with lines, class, visibility, annotations.

Scripts have a reader of their own (``scripts``), Python its syntax tree (``python_tree``). For the
others ``code.RULES`` finds names; this adds what needs more than a pattern. A file is read twice in one
pass: with comments blanked out, and with texts blanked out as well, so that offsets stay true and
neither hides a brace. Blocks end at the matching brace, or by indentation. Every file gives rows or
one row of relation ``error``, never an exception. Files are rows, so a file is one task's work and
nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.shared import spread
from quarry.shipping import ship
from quarry.sources import python_tree, scripts
from quarry.sources.code import RULES

SPECIFIER = "struct<name:string,local_name:string,type:string>"
SCHEMA = (
    "project string, file string, lang string, relation string, type string, name string, line int, end_line int, class_name string, "
    f"visibility string, kind string, exported boolean, is_default boolean, source_module string, specifiers array<{SPECIFIER}>, annotations array<string>"
)
FIELDS = [f.split()[0] for f in re.split(r", (?![^<]*>)", SCHEMA)]
#: Files whose rows a task holds at a time, however many come in one batch.
FILES = 128

#: Languages by the form of their comments and blocks.
_HASH = frozenset("python ruby perl r elixir crystal julia nim shell powershell".split())
_DASH = frozenset("haskell lua".split())
_INDENTED = frozenset(("python", "nim"))
_ENDED = frozenset("ruby elixir lua julia crystal".split())
_SLASH_TEXT = r"""//[^\n]*|/\*.*?(?:\*/|\Z)"""
_TEXTS = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_BLANK: dict[str, re.Pattern] = {
    "slash": re.compile(rf"(?P<c>{_SLASH_TEXT})|(?P<t>{_TEXTS}|`(?:\\.|[^`\\])*`)", re.S),
    "hash": re.compile(rf"""(?P<t>\"{{3}}.*?(?:\"{{3}}|\Z)|'{{3}}.*?(?:'{{3}}|\Z)|{_TEXTS})|(?P<c>\#[^\n]*)""", re.S),
    "dash": re.compile(rf"(?P<c>--\[\[.*?(?:\]\]|\Z)|--[^\n]*|\{{-.*?(?:-\}}|\Z))|(?P<t>{_TEXTS})", re.S),
}
_COMPILED = {lang: [(rel, kind, re.compile(p)) for own, rel, kind, p in RULES if own == lang] for lang in dict.fromkeys(r[0] for r in RULES)}

_FROM = re.compile(r"(?m)^[ \t]*from\s+([\w.]+)\s+import\s+(\([^)]*\)|[^\n#;]+)")
_PLAIN = re.compile(r"(?m)^[ \t]*import\s+([\w., \t]+)")
_LOADED = re.compile(r"""\b(?:import_module|__import__)\(\s*['"]([\w.]+)['"]""")
_MODIFIERS = re.compile(r"\b(private protected|private|protected|public|internal|fileprivate|pub)\b")
_NOTE = re.compile(r"^\s*(?:@([\w.]+)|\[\s*([\w.]+)|#\[\s*([\w:]+))")
_SPACE = re.compile(r"\s*")
_METHOD_OF = re.compile(r"^func\s+\(")


class _Source:
    """One file: its text with comments, and with comments and texts, blanked out."""

    def __init__(self, lang: str, content: str):
        self.lang, self.content = lang, content
        style = _BLANK["hash" if lang in _HASH else "dash" if lang in _DASH else "slash"]
        blank = lambda s: re.sub(r"[^\n]", " ", s)
        self.code = style.sub(lambda m: blank(m[0]) if m["c"] is not None else m[0], content)
        self.bare = style.sub(lambda m: blank(m[0]), content)
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        self.lines = self.bare.split("\n")

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def block(self, at: int) -> tuple[int, int]:
        """First and last line of the declaration at an offset."""
        first = self.line(at)
        if self.lang in _INDENTED:
            return first, self._indented(first)
        if self.lang in _ENDED:
            return first, self._ended(first)
        return first, self.line(self.close(at))

    def close(self, at: int) -> int:
        """Offset of the brace that ends the block opened next, or of the end of a statement without one."""
        depth, inside = 0, 0
        for m in re.compile(r"[{}();\n]").finditer(self.bare, at):
            c = m[0]
            if c == "(":
                inside += 1
            elif c == ")":
                inside -= 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth <= 0 and inside <= 0:
                    return m.start()
            elif c == ";" and not depth and inside <= 0:
                return m.start()
            elif c == "\n" and not depth and inside <= 0 and self._ends(m.start()):
                return m.start() - 1
        return max(at, len(self.bare) - 1)

    def _ends(self, at: int) -> bool:
        """Whether a statement may end at this line break: the next line opens no block, and this one leaves nothing open."""
        first, last = at, _SPACE.match(self.bare, at).end()
        while first > 0 and self.bare[first - 1].isspace():
            first -= 1
        return not self.bare.endswith(("=>", "=", ",", "(", "|", "&", "+", ":", "extends"), 0, first) and not self.bare.startswith(("{", ".", "=>", "where", "throws", ":", "extends", "implements"), last)

    def _indented(self, first: int) -> int:
        own = len(self.lines[first - 1]) - len(self.lines[first - 1].lstrip())
        last = first
        for k in range(first, len(self.lines)):
            text = self.lines[k]
            if text.strip():
                if len(text) - len(text.lstrip()) <= own and not text.lstrip().startswith((")", "]", "}")):
                    break
                last = k + 1
        return last

    def _ended(self, first: int) -> int:
        own = re.match(r"\s*", self.lines[first - 1])[0]
        for k in range(first, len(self.lines)):
            if re.match(rf"{re.escape(own)}end\b", self.lines[k]):
                return k + 1
        return first

    def notes(self, line: int) -> list[str]:
        """Annotations, decorators or attributes on the lines right above, and before the name on its own."""
        out = []
        k = line - 2
        while k >= 0 and (m := _NOTE.match(self.lines[k])):
            out.append(next(g for g in m.groups() if g))
            k -= 1
        own = _NOTE.match(self.lines[line - 1]) if line <= len(self.lines) else None
        if own:
            out.append(next(g for g in own.groups() if g))
        return out[::-1]


def _python_imports(src: _Source) -> Iterator[dict]:
    for m in _FROM.finditer(src.bare):
        named = []
        for part in m[2].strip("() \n").split(","):
            name, _, local = (x.strip() for x in part.strip().partition(" as "))
            if name:
                named.append((name, local or name, "namespace" if name == "*" else "named"))
        yield {"relation": "import", "type": "from", "name": m[1], "line": src.line(m.start() + len(m[0]) - len(m[0].lstrip())), "specifiers": named}
    for m in _LOADED.finditer(src.code):
        yield {"relation": "import", "type": "dynamic", "name": m[1], "line": src.line(m.start()), "specifiers": []}
    for m in _PLAIN.finditer(src.bare):
        for part in m[1].split(","):
            name = part.strip().partition(" as ")[0].strip()
            if name:
                yield {"relation": "import", "type": "import", "name": name, "line": src.line(m.start() + len(m[0]) - len(m[0].lstrip())), "specifiers": []}


def _general(src: _Source) -> Iterator[dict]:
    """Every other language: the names that ``RULES`` finds, with place, class, visibility and annotations."""
    lang = src.lang
    rules = _COMPILED.get(lang, ())
    if lang == "python":
        yield from _python_imports(src)
    classes: list[tuple[int, int, str]] = []
    for relation, kind, pattern in rules:
        if relation == "class":
            for m in pattern.finditer(src.bare):
                first, last = src.block(m.start(1))
                classes.append((first, last, m[1]))
                yield {
                    "relation": "class", "type": kind, "name": m[1], "line": first, "end_line": last, "exported": _exported(src, m[1], first),
                    "visibility": _visibility(src, m[1], first), "annotations": src.notes(first),
                }
    section = _ruby_sections(src) if lang == "ruby" else None
    for relation, kind, pattern in rules:
        if relation == "import" and lang != "python":
            for m in pattern.finditer(src.code):
                yield {"relation": "import", "type": kind, "name": m[1], "line": src.line(m.start(1)), "specifiers": []}
        elif relation == "function":
            for m in pattern.finditer(src.bare):
                first, last = src.block(m.start(1))
                own = max((c for c in classes if c[0] <= first <= c[1] and c[2] != m[1]), default=None)
                method = own is not None or (lang == "go" and bool(_METHOD_OF.match(src.lines[first - 1])))
                level = section[first - 1] if section else _visibility(src, m[1], first)
                yield {
                    "relation": "function", "type": "method" if method else kind, "name": m[1], "line": first, "end_line": last, "class_name": own[2] if own else None,
                    "visibility": level, "kind": "method" if method else "function", "exported": _exported(src, m[1], first), "annotations": src.notes(first),
                }
    if lang == "csharp":
        for m in re.finditer(r"(?m)^\s*namespace\s+([\w.]+)", src.bare):
            yield {"relation": "namespace", "type": "namespace", "name": m[1], "line": src.line(m.start(1))}


def _visibility(src: _Source, name: str, line: int) -> str:
    if src.lang == "python":
        return "private" if name.startswith("_") else "public"
    if src.lang == "go":
        return "public" if name[:1].isupper() else "private"
    found = _MODIFIERS.search(src.lines[line - 1])
    if found:
        return "public" if found[1] == "pub" else found[1]
    return {"rust": "private", "elixir": "private" if "defp" in src.lines[line - 1] else "public"}.get(src.lang, "public")


def _exported(src: _Source, name: str, line: int) -> bool:
    if src.lang == "python":
        return not src.lines[line - 1][:1].isspace() and not name.startswith("_")
    return _visibility(src, name, line) in ("public", "pub")


def _ruby_sections(src: _Source) -> list[str]:
    """Visibility in force on each line: a bare ``private`` holds until another, or a class begins."""
    out, now = [], "public"
    for text in src.lines:
        word = text.strip()
        if re.match(r"(class|module)\s", word):
            now = "public"
        elif word in ("private", "protected", "public"):
            now = word
        out.append("private" if re.match(r"private\s+def\s", word) else now)
    return out


def parse(lang: str, content: str) -> list[dict]:
    """Rows of one file. Vue and Svelte files are read from their script, at the file's lines."""
    if lang == "javascript":
        return scripts.read(content)
    failed = []
    if lang == "python":
        try:
            return python_tree.read(content)
        except (SyntaxError, RecursionError, MemoryError, ValueError) as why:
            # Another version's syntax: an error row, and what patterns find.
            failed = [{"relation": "error", "type": type(why).__name__, "name": str(why)[:200], "line": getattr(why, "lineno", None) or 0}]
    src = _Source(lang, content)
    rows = failed + list(_general(src))
    if lang == "python":
        rows += [
            {"relation": "export", "type": r["relation"], "name": r["name"], "line": r["line"], "is_default": False}
            for r in rows
            if r["relation"] in ("function", "class") and not r.get("class_name") and r["exported"]
        ]
    return rows


def script_only(content: str) -> str:
    """What is outside the script elements of a component file, blanked out."""
    out, at = [], 0
    for m in re.finditer(r"(?is)<script[^>]*>(.*?)</script>", content):
        out += [re.sub(r"[^\n]", " ", content[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join([*out, re.sub(r"[^\n]", " ", content[at:])])


def rows_of(project: str, file: str, lang: str, content: str | None, parsers: dict[str, Callable[[str, str], list[dict]]] | None = None) -> list[dict]:
    """Whole rows of one file, ``FIELDS`` each; an error row where its reader fails."""
    text = content or ""
    if (file or "").endswith((".vue", ".svelte")):
        text = script_only(text)
    try:
        rows = (parsers or {}).get(lang, parse)(lang, text)
    except (SyntaxError, RecursionError, MemoryError, ValueError, IndexError, KeyError, TypeError) as why:
        rows = [{"relation": "error", "type": type(why).__name__, "name": str(why)[:200], "line": 0}]
    out = []
    for r in rows:
        named = [{"name": n, "local_name": local, "type": t} for n, local, t in r.get("specifiers") or ()]
        full = {"exported": False, "is_default": False} | r | {"project": project, "file": file, "lang": lang, "specifiers": named, "annotations": r.get("annotations") or []}
        full.setdefault("end_line", r.get("line"))
        out.append({f: full.get(f) for f in FIELDS})
    return out


def _parse(parsers: dict[str, Callable[[str, str], list[dict]]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"line": pa.int32(), "end_line": pa.int32(), "exported": pa.bool_(), "is_default": pa.bool_(), "annotations": pa.list_(pa.string())}
        types["specifiers"] = pa.list_(pa.struct([("name", pa.string()), ("local_name", pa.string()), ("type", pa.string())]))
        for whole in batches:
            for at in range(0, whole.num_rows, FILES):
                batch = whole.slice(at, FILES)
                rows = [r for own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) for r in rows_of(*own, parsers)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], types.get(f, pa.string())) for f in FIELDS], FIELDS)

    return run


def parsed(files: DataFrame, parsers: dict[str, Callable[[str, str], list[dict]]] | None = None) -> DataFrame:
    """All rows of ``files`` (project, file, lang, content). ``parsers`` replaces the reader of a language."""
    ship(files.sparkSession)
    return spread(files.select("project", "file", "lang", "content")).mapInArrow(_parse(parsers), SCHEMA)


def imports(rows: DataFrame) -> DataFrame:
    return rows.filter("relation = 'import'").select("project", "file", "lang", "type", F.col("name").alias("module"), "line", "specifiers")


def exports(rows: DataFrame) -> DataFrame:
    return rows.filter("relation = 'export'").select("project", "file", "name", "type", "line", "is_default", "source_module")


def functions(rows: DataFrame) -> DataFrame:
    own = ("project", "file", "lang", "name", "type", "kind", "class_name", "visibility", "exported", "line", "end_line", "annotations")
    return rows.filter("relation = 'function'").select(*own, (F.col("end_line") - F.col("line") + 1).alias("line_count"))


def status(rows: DataFrame, files: DataFrame) -> DataFrame:
    """project, file, status of every file: parsed, empty (no declaration) or error."""
    per = rows.groupBy("project", "file").agg(F.bool_or(F.col("relation") == "error").alias("_error"))
    told = F.when(F.col("_error").isNull(), "empty").when(F.col("_error"), "error").otherwise("parsed")
    return files.select("project", "file").join(per, ["project", "file"], "left").select("project", "file", told.alias("status"))
