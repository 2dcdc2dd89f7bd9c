"""Declarations of Python files, from the syntax tree: imports, classes and functions with their scope, and ``__all__``.

A definition under ``if``, ``try``, ``with`` or a loop belongs to the scope around it; one inside a
function is that function's own and neither a method nor exported. Where the module has an
``__all__`` that can be read, it names the exports; else names without an underscore are exported.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def tree(content: str) -> ast.Module:
    """The syntax tree; lines are counted by line feeds alone, as everywhere else here."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(re.sub(r"\r(?!\n)|\f", " ", content.removeprefix("\ufeff")))


def _scoped(module: ast.Module) -> Iterator[tuple[ast.AST, list[ast.AST]]]:
    """Every node with the functions and classes around it, the outermost first; in the order of the source."""
    stack: list[tuple[ast.AST, list[ast.AST]]] = [(module, [])]
    while stack:
        node, around = stack.pop()
        yield node, around
        inside = [*around, node] if isinstance(node, (*_DEFINITIONS, ast.ClassDef)) else around
        # Decorators, defaults and bases are evaluated in the scope around, which matters to nothing here.
        stack += [(child, inside) for child in reversed(list(ast.iter_child_nodes(node)))]


def _path(node: ast.expr) -> str:
    """``a.b`` of a decorator that is a name, an attribute or a call of one."""
    if isinstance(node, ast.Call):
        node = node.func
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        return ".".join([_path(node), *parts[::-1]])
    return ".".join([*([node.id] if isinstance(node, ast.Name) else []), *parts[::-1]])


def _texts(node: ast.AST | None) -> list[tuple[str, int]] | None:
    """The constant texts of a list or tuple, with their lines; None if it is something else."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        left, right = _texts(node.left), _texts(node.right)
        return left + right if left is not None and right is not None else left if right is None else right
    if not isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return None
    return [(e.value, e.lineno) for e in node.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]


def listed(module: ast.Module) -> list[tuple[str, int]] | None:
    """Names in ``__all__`` with their lines, additions included; None if there is no such list of texts."""
    names: list[tuple[str, int]] | None = None
    own = lambda n: isinstance(n, ast.Name) and n.id == "__all__"
    for node, around in _scoped(module):
        if around:
            continue
        if isinstance(node, ast.Assign) and any(own(t) for t in node.targets) or isinstance(node, ast.AnnAssign) and own(node.target):
            found = _texts(node.value)
            names = found if found is not None else names
        elif isinstance(node, ast.AugAssign) and own(node.target):
            names = (names or []) + (_texts(node.value) or [])
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and own(node.func.value) and node.args:
            if node.func.attr == "extend":
                names = (names or []) + (_texts(node.args[0]) or [])
            elif node.func.attr == "append" and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                names = (names or []) + [(node.args[0].value, node.args[0].lineno)]
    return names


def read(content: str) -> list[dict]:
    """Rows of one file; raises ``SyntaxError`` where there is no tree."""
    module = tree(content)
    names = listed(module)
    public = {n for n, _ in names} if names is not None else None
    froms, loads, plain, declared = [], [], [], []
    for node, around in _scoped(module):
        if isinstance(node, ast.ImportFrom):
            specifiers = [(a.name, a.asname or a.name, "namespace" if a.name == "*" else "named") for a in node.names]
            froms.append({"relation": "import", "type": "from", "name": "." * node.level + (node.module or ""), "line": node.lineno, "specifiers": specifiers})
        elif isinstance(node, ast.Import):
            plain += [{"relation": "import", "type": "import", "name": a.name, "line": node.lineno, "specifiers": []} for a in node.names]
        elif isinstance(node, ast.Call) and _path(node.func).split(".")[-1] in ("import_module", "__import__") and node.args:
            if isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                loads.append({"relation": "import", "type": "dynamic", "name": node.args[0].value, "line": node.lineno, "specifiers": []})
        elif isinstance(node, (*_DEFINITIONS, ast.ClassDef)):
            outer = around[-1] if around else None
            is_class, method = isinstance(node, ast.ClassDef), isinstance(outer, ast.ClassDef)
            declared.append(
                {
                    "relation": "class" if is_class else "function", "type": "class" if is_class else "method" if method else "function", "name": node.name,
                    "line": node.lineno, "end_line": node.end_lineno, "class_name": outer.name if method and not is_class else None,
                    "visibility": "private" if node.name.startswith("_") else "public", "kind": None if is_class else "method" if method else "function",
                    "exported": outer is None and (node.name in public if public is not None else not node.name.startswith("_")),
                    "annotations": [p for d in node.decorator_list if (p := _path(d))],
                }
            )
    if names is None:
        exports = [{"relation": "export", "type": r["relation"], "name": r["name"], "line": r["line"], "is_default": False} for r in declared if r["exported"]]
    else:
        at = {r["name"]: r["line"] for r in declared if r["exported"]}
        exports = [{"relation": "export", "type": "explicit", "name": n, "line": at.get(n, line), "is_default": False} for n, line in dict(names).items()]
    return [*froms, *loads, *plain, *(r for r in declared if r["relation"] == "class"), *(r for r in declared if r["relation"] == "function"), *exports]
