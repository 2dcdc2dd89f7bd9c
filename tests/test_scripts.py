"""Hard scripts: each snippet with the functions, (name, type, line, end line, class), that it declares, and no others."""

import random

import pytest

from quarry.sources import parse, scripts

HARD = {
    "a comment of any length after the equals sign": ("const a = /* " + "x" * 500 + " */\n  () => {\n    return 1;\n  };\nconst b = 2;\n", [("a", "arrow", 1, 4, None)]),
    "a short comment there": ("const a = /* x */\n  () => {\n    return 1;\n  };\n", [("a", "arrow", 1, 4, None)]),
    "braces in texts and comments": ("function f() {\n  return '}' + \"}\" + `}`; // }\n  /* } */\n}\nfunction g() {}\n", [("f", "function", 1, 4, None), ("g", "function", 5, 5, None)]),
    "regular expressions": ("function f(s) {\n  if (/[/}]{2}/.test(s)) return s.replace(/\\/}/g, '');\n  return s / 2 / 1;\n}\nconst g = (x) => x / 2; // }/\nfunction h() {}\n", [("f", "function", 1, 4, None), ("g", "arrow", 5, 5, None), ("h", "function", 6, 6, None)]),
    "a regular expression after a condition": ("function f(x) {\n  if (x) /}/.exec(x);\n  while (x) /{/.exec(x);\n  return (x) / 2 + [1] / x;\n}\n", [("f", "function", 1, 5, None)]),
    "templates in templates": ("const t = (x) => `a ${x ? `b } ${`{`}` : '}'} {`;\nconst u = () => `one\n${x}\nthree`;\nfunction v() {}\n", [("t", "arrow", 1, 1, None), ("u", "arrow", 2, 4, None), ("v", "function", 5, 5, None)]),
    "functions in template holes": ("const s = `${list.map(function (x) { return `}`; })}`;\nfunction f() {}\n", [("f", "function", 2, 2, None)]),
    "markup": (
        "const A = () => (\n  <div className=\"}\" title='{'>\n    it's {list.map((x) => <B key={x} {...x} />)} a function f() {'}'}\n    <></>\n  </div>\n);\nfunction g() { return <p>don't</p>; }\nconst h = a < b;\n",
        [("A", "arrow", 1, 6, None), ("g", "function", 7, 7, None)],
    ),
    "generics": (
        "const id = <T,>(x: T): T => x;\nconst pick = async <K extends keyof T>(k: K): Promise<Map<string, T[K]>> => {\n  return new Map<string, T[K]>();\n};\nfunction f<T extends { a: number }>(x: T): { b: T } {\n  return { b: x };\n}\n",
        [("id", "arrow", 1, 1, None), ("pick", "arrow", 2, 4, None), ("f", "function", 5, 7, None)],
    ),
    "types with arrows": ("const f: (x: number) => void = (x) => {\n  x;\n};\nconst g = (x): ((y: string) => number) => (y) => 1;\ntype H = () => void;\nlet k: { m(): void } = { m() {\n} };\n", [("f", "arrow", 1, 3, None), ("g", "arrow", 4, 4, None), ("m", "method", 6, 7, None)]),
    "no semicolons": ("const a = () => 1\nconst b = async x => {\n  await x\n}\nlet c = function () {\n}\n[1].map(a)\nfunction d() {}\n", [("a", "arrow", 1, 1, None), ("b", "arrow", 2, 4, None), ("c", "expression", 5, 6, None), ("d", "function", 8, 8, None)]),
    "a value over many lines": ("const a = (x) =>\n  x\n    .map((y) => y)\n    .filter(Boolean)\nconst b = (x) => [\n  x,\n]\n", [("a", "arrow", 1, 4, None), ("b", "arrow", 5, 7, None)]),
    "several in one declaration": ("let a = 1,\n  b = () => {\n  },\n  c = function* named() {};\n", [("b", "arrow", 1, 3, None), ("c", "expression", 1, 4, None)]),
    "classes": (
        "class A extends mixin({ a: 1 }) {\n  static #n = 1;\n  static { init(); }\n  constructor(private x = {}) { super(); }\n  async *walk() {\n    class B { m() {} }\n  }\n  get size() { return 1; }\n  static async ['x' + 1]() {}\n"
        "  handler = async (e) => {\n    e;\n  };\n  if(x) { return x; }\n  abstract none(): void;\n  'quoted name'() {}\n  done?: boolean\n  last(): { a: number } {\n    return { a: 1 };\n  }\n}\n",
        [
            ("constructor", "method", 4, 4, "A"), ("walk", "method", 5, 7, "A"), ("m", "method", 6, 6, "B"), ("size", "method", 8, 8, "A"), ("[x+1]", "method", 9, 9, "A"),
            ("handler", "property", 10, 12, "A"), ("if", "method", 13, 13, "A"), ("quoted name", "method", 15, 15, "A"), ("last", "method", 17, 19, "A"),
        ],
    ),
    "objects": ("module.exports = {\n  a() { return 1; },\n  async b(x) {\n    return x;\n  },\n  c: function () {},\n  d: (x) => ({ e: x }),\n  get f() { return 1; },\n  class: 1, function: 2, import: 3,\n  ...rest,\n  [g]: 4,\n};\n", [("a", "method", 2, 2, None), ("b", "method", 3, 5, None), ("c", "property", 6, 6, None), ("d", "property", 7, 7, None), ("f", "method", 8, 8, None)]),
    "nested scopes": ("function outer() {\n  function inner() {\n    const deep = () => {\n    };\n  }\n  return { method() { function last() {} } };\n}\n", [("outer", "function", 1, 7, None), ("inner", "function", 2, 5, None), ("deep", "arrow", 3, 4, None), ("method", "method", 6, 6, None), ("last", "function", 6, 6, None)]),
    "overloads and declarations": ("function f(a: string): void;\nfunction f(a: number): void;\nfunction f(a: any) {\n}\ndeclare function g(): void\nabstract class C { abstract m(): void }\ninterface I { h(): void }\n", [("f", "function", 3, 4, None)]),
    "blocks and labels": ("switch (x) {\n  case 1: {\n    break;\n  }\n  default: {\n    function f() {}\n  }\n}\nout: for (;;) { break out; }\nif (x) {} else /}/.test(y);\nfunction g() {}\n", [("f", "function", 6, 6, None), ("g", "function", 11, 11, None)]),
    "calls that look like methods": ("if (a) { b(); }\nfoo(function () { bar(); });\nnew Foo(() => {\n});\nwhile (x) {\n}\n", []),
    "expressions with names": ("foo(function named() {});\nconst x = (function inner() { return 1; })();\n(() => {})();\n", []),
    "unbalanced": ("function f() {\n  if (x) {\n", [("f", "function", 1, 2, None)]),
}


@pytest.mark.parametrize("name", HARD)
def test_hard_scripts(name):
    text, want = HARD[name]
    got = [(r["name"], r["type"], r["line"], r["end_line"], r.get("class_name")) for r in scripts.read(text) if r["relation"] == "function"]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_imports_and_exports():
    text = (
        "import def, * as all from './a' with { type: 'json' };\nimport type { T, type U as V } from \"./types\";\nimport {\n  one,\n  default as two,\n} from './many';\nimport './effect';\nimport eq = require('./eq');\n"
        "const lazy = () => import('./lazy');\nconst tpl = import(`./tpl`), not = import(`./${x}`);\nconst { p, q: { r } } = require('./nested');\nimport.meta.glob<Mod>('./*.ts');\n"
        "// import no from './comment'\nconst s = \"import x from './text'\";\nexport * as ns from './ns';\nexport { default } from './d';\nexport type { W } from './w';\n"
        "export const { a, b: [c, d = 1], ...rest } = x, e = 2;\nexport default async function main() {}\nexport abstract class K {}\nexport const enum E { A }\nexport declare function f(): void;\nexports.cjs = 1;\nmodule.exports.two = 2;\n"
        "foo.import('./no'); foo.require('./no'); foo.exports.bar = 1;\n"
    )
    rows = scripts.read(text)
    imports = {(r["type"], r["name"]): r["specifiers"] for r in rows if r["relation"] == "import"}
    assert imports == {
        ("esm", "./a"): [("default", "def", "default"), ("*", "all", "namespace")],
        ("esm", "./types"): [("T", "T", "named"), ("U", "V", "named")],
        ("esm", "./many"): [("one", "one", "named"), ("default", "two", "default")],
        ("esm", "./effect"): [],
        ("commonjs", "./eq"): [],
        ("dynamic-import", "./lazy"): [],
        ("dynamic-import", "./tpl"): [],
        ("commonjs", "./nested"): [("p", "p", "named"), ("q", "q", "named")],
        ("import-meta-glob", "./*.ts"): [],
        ("reexport", "./ns"): [("*", "*", "namespace")],
        ("reexport", "./d"): [("default", "default", "default")],
        ("reexport", "./w"): [("W", "W", "named")],
    }
    exports = {r["name"]: (r["type"], r["is_default"]) for r in rows if r["relation"] == "export"}
    assert exports == {
        "ns": ("reexport", False), "default": ("reexport", True), "W": ("reexport", False), "a": ("const", False), "c": ("const", False), "d": ("const", False), "rest": ("const", False),
        "e": ("const", False), "main": ("default", True), "K": ("class", False), "E": ("enum", False), "f": ("function", False), "cjs": ("commonjs", False), "two": ("commonjs", False),
    }


def test_decorators_belong_to_what_they_stand_before():
    text = "@Injectable({ providedIn: 'root' })\n@ns.Other\nexport class A {\n  @Input() x = 1;\n  @Hook('}')\n  go() {}\n}\nclass B {}\n"
    rows = scripts.read(text)
    assert {r["name"]: r["annotations"] for r in rows if r["relation"] == "class"} == {"A": ["Injectable", "ns.Other"], "B": []}
    assert [(r["name"], r["line"], r["annotations"]) for r in rows if r["relation"] == "function"] == [("go", 6, ["Hook"])]


def test_deep_and_random_sources_end():
    assert parse.parse("javascript", "(" * 50_000) == [] and parse.parse("javascript", "`${" * 20_000) == [] and parse.parse("javascript", "<a>" * 5000) == []
    rng = random.Random(5)
    pieces = ["{", "}", "(", ")", "[", "]", "`", "${", "'", '"', "/", "<", ">", "</a>", "<a", "/>", "=>", "function f", "class A", "const x =", "import ", "export ", "async ", ":", "?", ",", ";", "\n", "a", "1", "@", "*", "="]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        for r in parse.parse("javascript", text):
            assert r["relation"] != "function" or 1 <= r["line"] <= r["end_line"] <= text.count("\n") + 1, text
