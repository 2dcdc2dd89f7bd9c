"""Declarations of JavaScript and TypeScript: a tokenizer with states, and a reader over matched brackets.

``tokens`` knows what a pattern can't: whether a slash begins a regular expression or divides, where
a template ends that holds other templates, which braces are blocks, objects, classes or clauses,
and what is markup. ``Reader`` walks the tokens once. Where a declaration begins it reads its clause,
parameters, types and end, and goes on inside, so that nested declarations are found in their
scopes. Nothing recurses with the depth of the source, and every jump goes over a bracket that was
matched before, so work is linear in the tokens.

Unbalanced sources are read as far as they make sense: an open bracket ends with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

NAME, NUMBER, STRING, TEMPLATE, REGEX, MARK = range(6)

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v ﻿]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>#?[A-Za-z_$\u0080-\U0010ffff][\w$]*)"
    r"|(?P<number>\.?\d[\w.]*)|(?P<string>\"(?:\\.|[^\"\\\n])*(?:\"|$|(?=\n))|'(?:\\.|[^'\\\n])*(?:'|$|(?=\n)))"
    r"|(?P<mark>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|<=|\+\+|--|\*\*=?|[-+*/%&|^]=|<<=?|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE_PART = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_TAG_NAME = re.compile(r"[\w$.:-]*")
_TAG_PART = re.compile(r"\s+|/>|>|\"[^\"]*\"|'[^']*'|\{|//[^\n]*|/\*.*?\*/|[^\s/>\"'{]+|.", re.S)
_MARKUP_TEXT = re.compile(r"[^<{]*")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[\w$]+(?:\s+extends\s[^>()]*|\s*,[^>()]*|\s*=[^>()]*)*>\s*\(")

#: Words after which an expression begins, heads of statements with a condition, and modifiers.
_BEFORE_EXPRESSION = frozenset("return typeof case in of delete void throw new instanceof do else yield await default extends as satisfies".split())
_CONDITIONS = frozenset("if while for with".split())
_MODIFIERS = frozenset("public private protected static async readonly override abstract declare accessor get set".split())
_NO_OPERAND = frozenset("return typeof case in of delete void throw new instanceof yield await extends as satisfies".split())
_TYPE_WORDS = frozenset("keyof typeof is infer readonly unique asserts extends in new abstract".split())
_DECLARED = frozenset("function class const let var enum interface type namespace module using abstract async declare".split())
_NOT_A_NAME = frozenset("if for while switch catch function return with do else new await typeof case throw in of delete void yield super this null true false import export class var let const".split())
_OPENS, _CLOSES = "({[", ")}]"


@dataclass(slots=True)
class Token:
    kind: int
    text: str
    at: int
    end: int
    #: Whether a line break stands before it.
    fresh: bool
    #: Of a bracket: its partner's index, and for ``{`` what it opens. Of anything: the index of the bracket around it, or -1.
    match: int = -1
    role: str = ""
    around: int = -1


def _operand_ends(t: Token, before: Token | None) -> bool:
    """Whether ``t`` ends an operand, so that a slash after it divides and ``<`` compares."""
    if t.kind == MARK:
        return t.text in (")", "]", "++", "--") and t.role != "condition" or t.text == "}" and t.role in ("object", "value", "hole")
    if t.kind == NAME and (before is None or before.text not in (".", "?.")):
        return t.text not in _BEFORE_EXPRESSION
    return True


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    stack: list[int] = []
    #: Markup that is open: depth of the bracket stack, and whether its tag or its content is being read.
    markup: list[list] = []
    at, fresh, n = 0, False, len(text)

    def add(kind: int, piece: str) -> Token:
        nonlocal fresh
        t = Token(kind, piece, at, at + len(piece), fresh, around=stack[-1] if stack else -1)
        out.append(t)
        fresh = False
        return t

    def template(start: int) -> int:
        """Read on in a template; a hole's brace goes on the stack."""
        nonlocal at
        end = _TEMPLATE_PART.match(text, start).end()
        if text.startswith("${", end):
            at = end
            t = add(MARK, "{")
            t.role = "hole"
            stack.append(len(out) - 1)
            return end + 2
        out[-1].end = end + 1
        return end + 1

    while at < n:
        if markup and len(stack) == markup[-1][0]:
            state = markup[-1]
            if state[1] == "content":
                end = _MARKUP_TEXT.match(text, at).end()
                fresh = fresh or "\n" in text[at:end]
                at = end
                if at >= n:
                    break
                if text.startswith("</", at):
                    at = (text.find(">", at) + 1) or n
                    markup.pop()
                    if not markup or len(stack) != markup[-1][0]:
                        out.append(Token(STRING, "", at - 1, at, False, around=stack[-1] if stack else -1))
                elif text[at] == "<":
                    at = _TAG_NAME.match(text, at + 1).end()
                    markup.append([len(stack), "tag"])
                else:
                    add(MARK, "{").role = "markup"
                    stack.append(len(out) - 1)
                    at += 1
                continue
            m = _TAG_PART.match(text, at)
            piece = m[0]
            if piece == "/>":
                markup.pop()
                at = m.end()
                if not markup or len(stack) != markup[-1][0]:
                    out.append(Token(STRING, "", at - 1, at, False, around=stack[-1] if stack else -1))
            elif piece == ">":
                state[1] = "content"
                at = m.end()
            elif piece == "{":
                add(MARK, "{").role = "markup"
                stack.append(len(out) - 1)
                at = m.end()
            else:
                fresh = fresh or "\n" in piece
                at = m.end()
            continue
        m = _TOKEN.match(text, at)
        kind, piece = m.lastgroup, m[0]
        last = out[-1] if out else None
        before = out[-2] if len(out) > 1 else None
        if kind == "space":
            at = m.end()
            continue
        if kind in ("line", "comment"):
            fresh = fresh or "\n" in piece
            at = m.end()
            continue
        if kind == "name":
            add(NAME, piece)
        elif kind == "number":
            add(NUMBER, piece)
        elif kind == "string":
            add(STRING, piece[1:-1]).end = m.end()
        elif piece == "`":
            t = add(TEMPLATE, "")
            end = _TEMPLATE_PART.match(text, at + 1).end()
            t.text = text[at + 1 : end] if not text.startswith("${", end) else "\0"
            at = template(at + 1)
            continue
        elif piece in ("/", "/=") and (last is None or not _operand_ends(last, before)) and (found := _REGEX.match(text, at)):
            add(REGEX, found[0])
            at = found.end()
            continue
        elif piece == "<" and (last is None or not _operand_ends(last, before)) and _is_markup(text, at):
            at = _TAG_NAME.match(text, at + 1).end()
            markup.append([len(stack), "tag"])
            continue
        else:
            t = add(MARK, piece)
            index = len(out) - 1
            if piece in _OPENS:
                t.role = _role(out, index)
                stack.append(index)
            elif piece in _CLOSES:
                # A bracket of another kind ends what was left open inside it.
                while stack and _OPENS.index(out[stack[-1]].text) != _CLOSES.index(piece) and any(out[k].text == _OPENS[_CLOSES.index(piece)] for k in stack[-50:]):
                    lost = stack.pop()
                    out[lost].match = index
                if stack and out[stack[-1]].text == _OPENS[_CLOSES.index(piece)]:
                    k = stack.pop()
                    opener = out[k]
                    opener.match, t.match, t.role, t.around = index, k, opener.role, opener.around
                    if opener.role == "hole":
                        at = template(at + 1)
                        continue
        at = m.end()
    for k in stack:
        out[k].match = len(out)
    return out


def _is_markup(text: str, at: int) -> bool:
    """``<`` where an expression begins: markup, unless it is a generic arrow or an old type assertion."""
    if _GENERIC_ARROW.match(text, at):
        name = _TAG_NAME.match(text, at + 1)[0]
        return f"</{name}" in text[at:] if name and "extends" not in text[at : at + 80] and "," not in text[at : at + 80].split(">")[0] else False
    nxt = text[at + 1 : at + 2]
    if nxt == ">":
        return "</>" in text[at:]
    if not (nxt.isalpha() or nxt in ("_", "$")):
        return False
    name = _TAG_NAME.match(text, at + 1)[0]
    if text.find(f"</{name}", at) >= 0:
        return True
    end = text.find("/>", at)
    return end >= 0


def _role(out: list[Token], k: int) -> str:
    """What a bracket opens, from what stands before it."""
    t, last = out[k], out[k - 1] if k else None
    before = out[k - 2] if k > 1 else None
    if t.text == "(":
        plain = before is None or before.text not in (".", "?.")
        return "condition" if last is not None and last.kind == NAME and (last.text in _CONDITIONS and plain or last.text == "await" and before is not None and before.text == "for") else "group"
    if t.text == "[":
        return "list"
    if last is None or last.text in (";", "=>") and last.kind == MARK:
        return "value" if last is not None and last.text == "=>" else "block"
    if last.kind == MARK:
        if last.text == "{":
            return "object" if last.role in ("object", "hole", "markup") else "block"
        if last.text == "}":
            return "block"
        if last.text in (")", "]", ">"):
            return "block"
        if last.text == ":":
            return _after_colon(out, k)
        if last.text == "*" and before is not None and before.text in ("import", "export"):
            return "clause"
        return "object"
    if last.kind == NAME:
        if last.text in ("import", "export"):
            return "clause"
        if last.text == "type" and before is not None and before.text in ("import", "export"):
            return "clause"
        if last.text in _NO_OPERAND or last.text == "default" and before is not None and before.text == "export":
            return "object" if not (before is not None and before.text in (".", "?.")) else "block"
        return "block"
    return "block"


def _after_colon(out: list[Token], k: int) -> str:
    """A brace after a colon: a block after a case or a label, else an object or a type."""
    around = out[k].around
    if around >= 0 and (out[around].text in "([" or out[around].role in ("object", "hole", "markup")):
        return "object"
    j = k - 2
    while j > around and not (out[j].kind == MARK and out[j].text in (";", "{", "}", "?")):
        if out[j].kind == NAME and out[j].text in ("case", "default") and (j == 0 or out[j - 1].text != "."):
            return "block"
        if out[j].kind == MARK and out[j].text in _CLOSES and out[j].match >= 0:
            j = out[j].match
        j -= 1
    label = k >= 2 and out[k - 2].kind == NAME and (k == 2 or out[k - 3].kind == MARK and out[k - 3].text in (";", "{", "}"))
    return "block" if label and (around < 0 or out[around].role != "class") else "object"


class Reader:
    def __init__(self, text: str):
        self.t = tokens(text)
        self.n = len(self.t)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.rows: list[dict] = []
        self.exported: set[str] = set()
        self.notes: dict[int, list[str]] = {}
        #: Names of classes by the brace of their body.
        self.owners: dict[int, str] = {}

    # --- places

    def line(self, k: int) -> int:
        return bisect_right(self.starts, self.t[min(k, self.n - 1)].at) if self.n else 1

    def last_line(self, k: int) -> int:
        return bisect_right(self.starts, max(self.t[min(k, self.n - 1)].end - 1, 0)) if self.n else 1

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < self.n and self.t[k].kind in (NAME, MARK) and self.t[k].text in texts

    def name(self, k: int) -> bool:
        return 0 <= k < self.n and self.t[k].kind == NAME

    def after(self, k: int) -> int:
        """Past the bracket that opens at ``k``."""
        m = self.t[k].match
        return m + 1 if m >= 0 else k + 1

    def begins(self, k: int) -> bool:
        """Whether a statement may begin at ``k``."""
        if k == 0:
            return True
        p = self.t[k - 1]
        if p.kind == MARK:
            if p.text in (";", "}", "{") or p.text == ")" and p.role == "condition":
                return not (p.text == "{" and p.role == "object")
            if p.text == ":":
                return _after_colon(self.t, k) == "block"
            return p.text in (")", "]") and self.t[k].fresh
        if p.kind == NAME:
            if p.text in ("else", "do", "export", "default", "declare", "abstract"):
                return True
            return p.text not in _NO_OPERAND and self.t[k].fresh
        return self.t[k].fresh

    def angle(self, k: int) -> int:
        """Past the type arguments that open at ``k``, or ``k`` if they are none."""
        if not self.is_(k, "<"):
            return k
        depth, j = 0, k
        while j < self.n:
            t = self.t[j]
            if t.kind == MARK:
                if t.text in ("<", "<<"):
                    depth += len(t.text)
                elif t.text == ">":
                    depth -= 1
                    if not depth:
                        return j + 1
                elif t.text in _OPENS:
                    j = self.after(j)
                    continue
                elif t.text in (";", ")", "}", "]", "&&", "||", "==", "===", "!=", "!==", "+", "/", "++"):
                    return k
            j += 1
        return k

    def type(self, k: int) -> int:
        """Past the type that begins at ``k``: before what can't go on with it."""
        wants = True
        while k < self.n:
            t = self.t[k]
            if t.kind == MARK:
                if t.text in _OPENS:
                    if not wants and (t.text != "[" or t.fresh):
                        return k
                    k = self.after(k)
                    wants = False
                    continue
                if t.text == "<":
                    past = self.angle(k)
                    if past == k:
                        return k
                    k = past
                    wants = wants and self.is_(k, "(")
                    continue
                if t.text in ("|", "&", "=>", ".", "?", ":", "..."):
                    if t.text in ("?", ":") and wants:
                        return k
                    if t.text == ":" and not self._conditional(k):
                        return k
                    wants = True
                elif t.text == "-" and wants:
                    pass
                else:
                    return k
            elif t.kind == NAME and t.text in _TYPE_WORDS and (not wants or t.text not in ("is", "extends", "in")):
                if not wants and t.text not in ("is", "extends", "in"):
                    return k
                wants = True
            else:
                if not wants:
                    return k
                wants = False
            k += 1
        return k

    def _conditional(self, k: int) -> bool:
        """Whether the colon at ``k`` belongs to a conditional type: a question mark on the same level comes before it."""
        j = k - 1
        around = self.t[k].around
        while j > around:
            t = self.t[j]
            if t.kind == MARK and t.text in _CLOSES and t.match >= 0:
                j = t.match
            elif t.kind == MARK and t.text == "?":
                return True
            elif t.kind == MARK and t.text in (";", "{", "="):
                return False
            j -= 1
        return False

    def expression(self, k: int) -> int:
        """Past the expression that begins at ``k``: at a comma, a bracket that closes, a semicolon or the line's end where a statement ends."""
        first = k
        while k < self.n:
            t = self.t[k]
            if t.kind == MARK and t.text in (",", ";", ")", "}", "]"):
                return k
            if k > first and t.fresh and self._ends(k):
                return k
            if t.kind == MARK and t.text in _OPENS:
                k = self.after(k)
                continue
            if t.kind == MARK and t.text == "<":
                past = self.angle(k)
                k = past if past > k and self.is_(past, "(", ")", ",", ";", ".", "?.", "]", "}") else k + 1
                continue
            if t.kind == NAME and t.text in ("function", "class") and not self.is_(k - 1, ".", "?."):
                body = self.body(k + 1, t.text == "class")
                k = self.after(body) if body < self.n else body
                continue
            if t.kind == NAME and t.text in ("as", "satisfies") and k > first:
                k = self.type(k + 1)
                continue
            if t.kind == MARK and t.text == "=>" and self.is_(k + 1, "{"):
                # A body ends the arrow; what follows on a new line is another statement.
                k = self.after(k + 1)
                if k < self.n and self.t[k].fresh and not self.is_(k, ",", ")", "]", "}", ";"):
                    return k
                continue
            k += 1
        return k

    def _ends(self, k: int) -> bool:
        """Whether a statement ends before ``k``, which begins a line: what stands there can't go on, and before it an operand is complete."""
        t, p = self.t[k], self.t[k - 1]
        if not (_operand_ends(p, self.t[k - 2] if k > 1 else None) or p.kind == MARK and p.text in ("}", ">")):
            return False
        if t.kind == MARK:
            return t.text in ("{", "@", "++", "--", "!", "~")
        if t.kind == NAME:
            return t.text not in ("instanceof", "in", "as", "satisfies", "of")
        return t.kind in (NUMBER, STRING, REGEX)

    def body(self, k: int, heritage: bool = False) -> int:
        """The brace of a function's or (with its heritage) a class's body, searched from ``k`` on: past its name, types and parameters. ``n`` if there is none."""
        called = False
        while k < self.n:
            t = self.t[k]
            if t.kind == MARK:
                if t.text == "{":
                    return k
                if t.text == "(":
                    called = True
                    k = self.after(k)
                    continue
                if t.text == "<":
                    k = max(self.angle(k), k + 1)
                    continue
                if t.text == ":" and called:
                    k = self.type(k + 1)
                    if not self.is_(k, "{"):
                        return self.n
                    continue
                if t.text in (";", ")", "}", "]", "=", "=>") or t.text == "," and not heritage:
                    return self.n
                if t.text == "[":
                    k = self.after(k)
                    continue
            elif called and t.fresh and t.kind == NAME and t.text not in ("extends", "implements"):
                return self.n
            k += 1
        return self.n

    # --- functions as values

    def function_value(self, k: int) -> tuple[str, int] | None:
        """If a function begins at ``k``: its type and the index past it."""
        if self.is_(k, "async") and not self.t[min(k + 1, self.n - 1)].fresh and not self.is_(k + 1, "=>"):
            k += 1
        if self.is_(k, "function"):
            body = self.body(k + 1)
            return ("expression", self.after(body)) if body < self.n else None
        j = self.angle(k)
        if self.is_(j, "("):
            j = self.after(j)
            if self.is_(j, ":"):
                j = self._arrow_type(j + 1)
        elif j == k and self.name(j) and self.t[j].text not in _NOT_A_NAME:
            j += 1
        else:
            return None
        if not self.is_(j, "=>"):
            return None
        return "arrow", (self.after(j + 1) if self.is_(j + 1, "{") else self.expression(j + 1))

    def _arrow_type(self, k: int) -> int:
        """Past an arrow's return type, which an arrow of its own would follow: ``: (x) => y =>`` has two."""
        end = self.type(k)
        if self.is_(end, "=>"):
            return end
        # The type took the arrow and what it gives along: the last arrow on this level is the function's.
        last, j = k, k
        while j < end:
            if self.is_(j, "=>"):
                last = j
            j = self.after(j) if self.t[j].kind == MARK and self.t[j].text in _OPENS else j + 1
        return last

    # --- rows

    def row(self, relation: str, form: str, name: str, k: int, /, **more) -> None:
        self.rows.append({"relation": relation, "type": form, "name": name, "line": self.line(k)} | more)

    def export(self, kind: str, name: str, k: int, default: bool = False, local: str | None = None) -> None:
        self.exported.add(local or name)
        self.row("export", kind, name, k, is_default=default)

    def clause(self, k: int) -> list[tuple[str, str, str]]:
        """Names of the braces at ``k``: of an import or export clause, or a pattern."""
        out, end = [], min(self.t[k].match, self.n)
        k += 1
        while k < end:
            if self.is_(k, "type") and (self.name(k + 1) and not self.is_(k + 1, "as") or k + 1 < end and self.t[k + 1].kind == STRING):
                k += 1
            if self.t[k].kind in (NAME, STRING):
                first = local = self.t[k].text
                if self.is_(k + 1, "as", ":") and k + 2 < end and self.t[k + 2].kind in (NAME, STRING):
                    local = self.t[k + 2].text
                    k += 2
                if first:
                    out.append((first, local, "default" if first == "default" else "named"))
            while k < end and not self.is_(k, ","):
                k = self.after(k) if self.t[k].kind == MARK and self.t[k].text in _OPENS else k + 1
            k += 1
        return out

    def bound(self, k: int) -> list[str]:
        """Names that the pattern at ``k`` binds."""
        out, todo = [], [k]
        while todo:
            k = todo.pop(0)
            if k >= self.n:
                continue
            if self.name(k):
                out.append(self.t[k].text)
                continue
            if not self.is_(k, "{", "["):
                continue
            end, is_object = min(self.t[k].match, self.n), self.t[k].text == "{"
            j = k + 1
            while j < end:
                if self.is_(j, ","):
                    j += 1
                    continue
                if self.is_(j, "..."):
                    j += 1
                elif is_object:
                    past = self.after(j) if self.is_(j, "[") else j + 1
                    if self.is_(past, ":"):
                        j = past + 1
                todo.append(j)
                j = self.after(j) if self.is_(j, "{", "[") else j + 1
                if self.is_(j, "="):
                    j = self.expression(j + 1)
                while j < end and not self.is_(j, ","):
                    j += 1
        return out

    def read(self) -> list[dict]:
        k = 0
        while k < self.n:
            k = self.step(k)
        for r in self.rows:
            if r["relation"] in ("function", "class") and not r.get("class_name") and r["type"] != "method":
                r["exported"] = r["name"] in self.exported
        return self.rows

    def step(self, k: int) -> int:
        t = self.t[k]
        if t.kind == MARK:
            if t.text == "{" and t.role in ("object", "class"):
                self.members(k)
            elif t.text == "@":
                return self.decorators(k)
            return k + 1
        if t.kind != NAME or self.is_(k - 1, ".", "?.") and t.text != "exports":
            return k + 1
        if self.is_(k + 1, ":") and self.t[k - 1 if k else 0].text in ("{", ",") and self._in_object(k):
            return k + 1
        word = t.text
        if word == "import":
            return self.imports(k)
        if word == "export" and self.begins(k):
            return self.exports(k)
        if word in ("const", "let", "var", "using") and self._declares(k):
            return self.variables(k)
        if word == "class" and not self.is_(k + 1, ":", "=", ",", ")", "(", "."):
            return self.class_(k)
        if word == "function" and not self.is_(k + 1, ":", "=", ",", ")", "."):
            return self.function(k)
        if word == "require" and self.is_(k + 1, "(") and k + 2 < self.n and self.t[k + 2].kind in (STRING, TEMPLATE) and "\0" not in self.t[k + 2].text:
            self.row("import", "commonjs", self.t[k + 2].text, k, specifiers=self._required(k))
        if word == "exports" and self.is_(k + 1, ".") and self.name(k + 2) and self.is_(k + 3, "=") and (not self.is_(k - 1, ".") or self.is_(k - 2, "module")):
            self.export("commonjs", self.t[k + 2].text, k)
        return k + 1

    def _in_object(self, k: int) -> bool:
        around = self.t[k].around
        return around >= 0 and self.t[around].text == "{" and self.t[around].role == "object"

    def _declares(self, k: int) -> bool:
        nxt = k + 1
        return self.is_(nxt, "{", "[") and not self.is_(k, "using") or self.name(nxt) and not self.is_(nxt, "in", "of", "instanceof") and not self.is_(k + 1, "enum")

    def _required(self, k: int) -> list[tuple[str, str, str]]:
        """The names that the pattern before ``= require(...)`` takes."""
        if self.is_(k - 1, "=") and self.is_(k - 2, "}") and self.t[k - 2].match >= 0:
            return self.clause(self.t[k - 2].match)
        return []

    def imports(self, k: int) -> int:
        first = k
        if self.is_(k + 1, "("):
            arg = k + 2
            if arg < self.n and self.t[arg].kind in (STRING, TEMPLATE) and "\0" not in self.t[arg].text:
                self.row("import", "dynamic-import", self.t[arg].text, k, specifiers=[])
            return k + 1
        if self.is_(k + 1, "."):
            if self.is_(k + 2, "meta") and self.is_(k + 3, ".") and self.is_(k + 4, "glob", "globEager"):
                arg = self.angle(k + 5)
                if self.is_(arg, "(") and arg + 1 < self.n and self.t[arg + 1].kind in (STRING, TEMPLATE) and "\0" not in self.t[arg + 1].text:
                    self.row("import", "import-meta-glob", self.t[arg + 1].text, k, specifiers=[])
            return k + 2
        if not self.begins(k):
            return k + 1
        k += 1
        if self.is_(k, "type", "defer", "source", "typeof") and (self.is_(k + 1, "{", "*") or self.name(k + 1) and not self.is_(k + 1, "from") or self.is_(k + 1, "from") and self.is_(k + 2, "from")):
            k += 1
        named, rest = [], []
        while k < self.n:
            t = self.t[k]
            if t.kind == STRING:
                self.row("import", "esm", t.text, first, specifiers=[*named, *rest])
                return self._attributes(k + 1)
            if t.kind == NAME and t.text == "from" and k + 1 < self.n and self.t[k + 1].kind == STRING:
                k += 1
            elif t.kind == NAME:
                rest.append(("default", t.text, "default"))
                k += 1
                if self.is_(k, "="):
                    return k + 1  # import x = require("y"): what follows says what is imported
            elif self.is_(k, "*"):
                local = self.t[k + 2].text if self.is_(k + 1, "as") and self.name(k + 2) else "*"
                rest.append(("*", local, "namespace"))
                k += 3 if local != "*" else 1
            elif self.is_(k, "{"):
                named += self.clause(k)
                k = self.after(k)
            elif self.is_(k, ","):
                k += 1
            else:
                break
        return max(k, first + 1)

    def _attributes(self, k: int) -> int:
        return self.after(k + 1) if self.is_(k, "with", "assert") and self.is_(k + 1, "{") else k

    def exports(self, k: int) -> int:
        first, k = k, k + 1
        if self.is_(k, "type") and self.is_(k + 1, "{", "*"):
            k += 1
        if self.is_(k, "*"):
            local = "*"
            if self.is_(k + 1, "as") and k + 2 < self.n:
                local = self.t[k + 2].text
                k += 2
            k += 1
            if self.is_(k, "from") and k + 1 < self.n and self.t[k + 1].kind == STRING:
                self.reexport(first, self.t[k + 1].text, [("*", local, "namespace")])
                return self._attributes(k + 2)
            return k
        if self.is_(k, "{"):
            named, past = self.clause(k), self.after(k)
            if self.is_(past, "from") and past + 1 < self.n and self.t[past + 1].kind == STRING:
                self.reexport(first, self.t[past + 1].text, named)
                return self._attributes(past + 2)
            for name, local, _ in named:
                self.export("named", local, first, local == "default", name)
            return past
        if self.is_(k, "default"):
            k += 1
            j = k
            while self.is_(j, "async", "abstract") and self.name(j + 1) and not self.t[j + 1].fresh:
                j += 1
            name = None
            if self.is_(j, "function", "class"):
                at = j + 1 + self.is_(j + 1, "*")
                name = self.t[at].text if self.name(at) and not self.is_(at, "extends", "implements") else None
            self.export("default", name or "default", first, True)
            return k
        while self.is_(k, "declare", "async", "abstract") and self.name(k + 1):
            k += 1
        if self.is_(k, "const") and self.is_(k + 1, "enum"):
            k += 1
        if self.is_(k, "const", "let", "var", "using"):
            for names, _, _ in self.declarators(k + 1):
                for name in names:
                    self.export(self.t[k].text, name, first)
            return k
        if self.is_(k, "function", "class", "enum", "interface", "type", "namespace", "module"):
            at = k + 1 + self.is_(k + 1, "*")
            if at < self.n and self.t[at].kind in (NAME, STRING):
                self.export(self.t[k].text, self.t[at].text, first)
        return k

    def reexport(self, first: int, module: str, named: list[tuple[str, str, str]]) -> None:
        self.row("import", "reexport", module, first, specifiers=[("*", "*", "namespace")] if named and named[0][2] == "namespace" else named)
        for name, local, _ in named:
            self.row("export", "reexport", local, first, is_default=local == "default", source_module=module)
            self.row("reexport", "reexport", name, first, source_module=module)

    def declarators(self, k: int) -> Iterator[tuple[list[str], int, int]]:
        """Names, first token, and index of the value (-1 if there is none) of each declarator from ``k`` on."""
        while k < self.n:
            first = k
            names = self.bound(k)
            if not names and not self.is_(k, "{", "["):
                return
            k = self.after(k) if self.is_(k, "{", "[") else k + 1
            if self.is_(k, "!"):
                k += 1
            if self.is_(k, ":"):
                k = self.type(k + 1)
            value = -1
            if self.is_(k, "="):
                value = k + 1
                k = self.expression(value)
            yield names, first, value
            if not self.is_(k, ","):
                return
            k += 1

    def variables(self, k: int) -> int:
        for names, first, value in self.declarators(k + 1):
            if value < 0 or not self.name(first):
                continue
            found = self.function_value(value)
            if found:
                self.function_row(found[0], names[0], k, found[1] - 1, kind="function")
        return k + 1

    def function_row(self, form: str, name: str, first: int, last: int, /, **more) -> None:
        self.row("function", form, name, first, end_line=self.last_line(max(last, first)), exported=False, **more)

    def function(self, k: int) -> int:
        start = k - 1 if self.is_(k - 1, "async") and not self.t[k].fresh else k
        at = k + 1 + self.is_(k + 1, "*")
        if self.name(at) and self.begins(start):
            body = self.body(at + 1)
            if body < self.n:
                self.function_row("function", self.t[at].text, start, self.after(body) - 1, kind="function")
        return k + 1

    def class_(self, k: int) -> int:
        named = self.name(k + 1) and not self.is_(k + 1, "extends", "implements")
        name = self.t[k + 1].text if named else "default"
        body = self.body(k + 1 + named, heritage=True)
        if body >= self.n:
            return k + 1
        self.t[body].role = "class"
        self.row("class", "class", name, k, end_line=self.last_line(self.after(body) - 1), exported=False, annotations=self.notes.get(k, []))
        self.owners[body] = name
        return k + 1

    def decorators(self, k: int) -> int:
        """The decorators from ``k`` on, kept for the class that they stand before."""
        start = k
        found, j = self._decorators(k)
        while self.is_(j, "export", "default", "abstract", "declare"):
            j += 1
        if self.is_(j, "class"):
            self.notes.setdefault(j, found)
        return start + 1

    def _decorators(self, k: int) -> tuple[list[str], int]:
        found = []
        while self.is_(k, "@"):
            k += 1
            if self.is_(k, "("):
                k = self.after(k)
                continue
            path = []
            while self.name(k):
                path.append(self.t[k].text)
                k += 1
                if not self.is_(k, "."):
                    break
                k += 1
            found.append(".".join(path))
            k = self.angle(k)
            if self.is_(k, "(") and not self.t[k].fresh:
                k = self.after(k)
        return found, k

    def members(self, opener: int) -> None:
        """Methods of a class or an object, and its properties that hold functions."""
        is_class = self.t[opener].role == "class"
        owner = self.owners.get(opener) if is_class else None
        end = min(self.t[opener].match, self.n)
        k = opener + 1
        while k < end:
            if self.is_(k, ",", ";"):
                k += 1
                continue
            notes, k = self._decorators(k)
            first = k
            words = set()
            while self.name(k) and self.t[k].text in _MODIFIERS and not self.is_(k + 1, "(", "=", ":", ";", ",", "?", "!", "<", "}"):
                words.add(self.t[k].text)
                k += 1
            if self.is_(k, "*"):
                k += 1
            if self.is_(k, "{"):  # a static block
                k = self.after(k)
                continue
            if k >= end:
                return
            key = self.t[k]
            if key.kind in (NAME, STRING, NUMBER):
                name, past = key.text, k + 1
            elif self.is_(k, "["):
                inner = [x.text for x in self.t[k + 1 : min(key.match, end)]]
                name, past = f"[{''.join(inner)}]", self.after(k)
            else:
                k = max(self.expression(k), k + 1)
                continue
            level = next((w for w in ("private", "protected", "public") if w in words), "public")
            place = {"class_name": owner, "visibility": "private" if name.startswith("#") else level, "annotations": notes}
            call = self.angle(past)
            if self.is_(past, "?", "!"):
                call = past = past + 1
            if self.is_(call, "("):
                body = self.after(call)
                if self.is_(body, ":"):
                    body = self.type(body + 1)
                if self.is_(body, "{"):
                    kind = "constructor" if is_class and name == "constructor" else "get" if "get" in words else "set" if "set" in words else "method"
                    self.function_row("method", name, first, self.after(body) - 1, kind=kind, **place)
                    k = self.after(body)
                else:
                    k = max(body, k + 1)
                continue
            if is_class and self.is_(past, ":"):
                past = self.type(past + 1)
            if self.is_(past, "=" if is_class else ":"):
                value = past + 1
                stop = self.expression(value)
                found = self.function_value(value)
                if found:
                    self.function_row("property", name, first, found[1] - 1, kind="property", **place)
                k = max(stop, past + 1)
            else:
                k = max(past, k + 1) if is_class else max(self.expression(k), k + 1)


def read(text: str) -> list[dict]:
    """Rows of one script: imports, exports, classes and functions with their place."""
    return Reader(text).read()
