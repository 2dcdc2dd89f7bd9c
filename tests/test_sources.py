import pytest
from pyspark.sql import functions as F

from quarry.sources import code, configs, files, parse

OTHERS = [
    ("go", "go.mod", "module example.com/app\n"), ("go", "cmd/main.go", 'package main\nimport (\n\t"example.com/app/internal/store"\n)\n'), ("go", "internal/store/db.go", "package store\n"),
    ("go", "internal/store/more.go", "package store\n"), ("go", "internal/store/db_test.go", "package store\n"),
    ("rs", "src/main.rs", "mod parser;\nuse crate::net::client::Client;\n"), ("rs", "src/parser.rs", "mod words;\n"), ("rs", "src/parser/words.rs", ""), ("rs", "src/net/client.rs", ""),
    ("rb", "app.rb", "require 'jobs/mail'\nrequire_relative './lib/util'\n"), ("rb", "lib/jobs/mail.rb", ""), ("rb", "lib/util.rb", ""),
    ("php", "index.php", "<?php\nuse App\\Models\\User;\n"), ("php", "src/Models/User.php", "<?php"),
    ("cs", "Program.cs", "using Shop.Cart;\n"), ("cs", "Shop/Cart.cs", ""), ("ex", "lib/web.ex", "alias Shop.OrderLine\n"), ("ex", "lib/shop/order_line.ex", ""),
    ("hs", "Main.hs", "import Data.Tree.Walk\n"), ("hs", "src/Data/Tree/Walk.hs", ""), ("dart", "lib/main.dart", "import 'package:shop/src/cart.dart';\n"), ("dart", "lib/src/cart.dart", ""),
    ("pl", "run.pl", "use Shop::Cart;\n"), ("pl", "lib/Shop/Cart.pm", ""), ("clj", "core.clj", "(ns core (:require [shop.my-cart :as c]))"), ("clj", "src/shop/my_cart.clj", ""),
    ("java", "src/main/java/a/Main.java", "import a.b.Tool;\nimport a.c.*;\n"), ("java", "src/main/java/a/b/Tool.java", ""), ("java", "src/main/java/a/c/One.java", ""),
    ("py", "pkg/one.py", "from . import two\nfrom ..top import thing\nfrom lib.deep import member\n"), ("py", "pkg/two.py", ""), ("py", "top.py", ""), ("py", "lib/deep/member.py", ""),
    ("scala", "A.scala", "import shop.Cart\n"), ("scala", "src/shop/Cart.scala", ""), ("lua", "a.lua", "require('shop.cart')"), ("lua", "shop/cart.lua", ""),
    ("cpp", "a.cpp", '#include "shop/cart.h"\n'), ("cpp", "include/shop/cart.h", ""),
    ("zig", "a.zig", 'const x = @import("b.zig");'), ("zig", "b.zig", ""), ("ml", "a.ml", "open Cart\n"), ("ml", "cart.ml", ""), ("jl", "a.jl", "using Shop.Cart\n"), ("jl", "src/Shop/Cart.jl", ""),
]
EDGES = {
    ("go", "cmd/main.go", "internal/store/db.go"), ("go", "cmd/main.go", "internal/store/more.go"), ("rs", "src/main.rs", "src/parser.rs"),
    ("rs", "src/parser.rs", "src/parser/words.rs"), ("rs", "src/main.rs", "src/net/client.rs"), ("rb", "app.rb", "lib/jobs/mail.rb"), ("rb", "app.rb", "lib/util.rb"),
    ("php", "index.php", "src/Models/User.php"), ("cs", "Program.cs", "Shop/Cart.cs"), ("ex", "lib/web.ex", "lib/shop/order_line.ex"),
    ("hs", "Main.hs", "src/Data/Tree/Walk.hs"), ("dart", "lib/main.dart", "lib/src/cart.dart"), ("pl", "run.pl", "lib/Shop/Cart.pm"), ("clj", "core.clj", "src/shop/my_cart.clj"),
    ("java", "src/main/java/a/Main.java", "src/main/java/a/b/Tool.java"), ("java", "src/main/java/a/Main.java", "src/main/java/a/c/One.java"),
    ("py", "pkg/one.py", "pkg/two.py"), ("py", "pkg/one.py", "top.py"), ("py", "pkg/one.py", "lib/deep/member.py"), ("scala", "A.scala", "src/shop/Cart.scala"),
    ("lua", "a.lua", "shop/cart.lua"), ("cpp", "a.cpp", "include/shop/cart.h"), ("zig", "a.zig", "b.zig"), ("ml", "a.ml", "cart.ml"), ("jl", "a.jl", "src/Shop/Cart.jl"),
}


def test_imports_of_other_languages(spark):
    rows = spark.createDataFrame(OTHERS, "project string, file string, content string").withColumn("lang", files.language(F.col("file"))).filter("lang IS NOT NULL")
    got = {(r.project, r.src, r.dst) for r in code.resolved(parse.imports(parse.parsed(rows)), rows).collect()}
    assert got == EDGES


ALIASED = [
    ("tsconfig.json", '{\n  // paths\n  "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/app/*"], "shared": ["libs/shared/index.ts"],}}\n}'),
    ("vite.config.ts", "export default { resolve: { alias: { '@': path.resolve(__dirname, './src'), '~ui': './packages/ui/src' } } }"),
    ("package.json", '{"name": "root", "private": true, "workspaces": ["packages/*"]}'), ("packages/ui/package.json", '{"name": "@shop/ui", "main": "src/index.ts"}'),
    ("src/index.ts", "import a from '@app/one';\nimport b from 'shared';\nimport { c } from '@/two';\nimport '~ui/three';\nimport d from '@shop/ui';\nimport e from '@shop/ui/src/four';\nimport x from 'react';\n"),
    ("src/app/one.ts", ""), ("libs/shared/index.ts", ""), ("src/two.ts", ""), ("packages/ui/src/three.ts", ""), ("packages/ui/src/index.ts", ""), ("packages/ui/src/four.ts", ""),
]


def test_aliases_and_workspaces(spark):
    rows = spark.createDataFrame([("p", *r) for r in ALIASED], "project string, file string, content string").withColumn("lang", files.language(F.col("file")))
    own = rows.filter("lang IS NOT NULL")
    got = {r.dst for r in code.resolved(parse.imports(parse.parsed(own)), own, configs.aliases(rows)).collect()}
    assert got == {"src/app/one.ts", "libs/shared/index.ts", "src/two.ts", "packages/ui/src/three.ts", "packages/ui/src/index.ts", "packages/ui/src/four.ts"}
    assert [(r.directory, r.name) for r in configs.workspace_packages(rows).collect()] == [("packages/ui", "@shop/ui")]


def test_script_declarations():
    text = (
        "import React, { useState as state, type Props } from 'react'; // import no from 'x'\nimport * as all from \"./all\";\nconst { a, b: c } = require('./cjs');\n"
        "export * from './barrel';\nexport { one as two } from './named';\nexport default class Shop {\n  @Input() name = 1;\n  #secret() { return '}'; }\n  private hidden(): void {\n  }\n"
        "  static async load(x) {\n    if (x) { return 1; }\n  }\n  get size() { return 1; }\n}\n"
        "export const go = async (x: number) => {\n  return `}${x}`;\n};\nfunction plain() {}\nconst v = 1;\nexport { v as w };\n"
    )
    rows = parse.parse("javascript", text)
    imports = {(r["type"], r["name"]): r["specifiers"] for r in rows if r["relation"] == "import"}
    assert imports["esm", "react"] == [("useState", "state", "named"), ("Props", "Props", "named"), ("default", "React", "default")]
    assert imports["esm", "./all"] == [("*", "all", "namespace")] and imports["commonjs", "./cjs"] == [("a", "a", "named"), ("b", "c", "named")]
    assert ("esm", "x") not in imports and imports["reexport", "./barrel"] == [("*", "*", "namespace")]
    exports = {(r["name"], r["is_default"]) for r in rows if r["relation"] == "export" and not r.get("source_module")}
    assert exports == {("Shop", True), ("go", False), ("w", False)}
    functions = {r["name"]: (r["type"], r["line"], r["end_line"], r.get("class_name"), r.get("visibility"), r.get("kind")) for r in rows if r["relation"] == "function"}
    assert functions["#secret"] == ("method", 8, 8, "Shop", "private", "method")
    assert functions["hidden"] == ("method", 9, 10, "Shop", "private", "method")
    assert functions["load"][:4] == ("method", 11, 13, "Shop") and functions["size"][5] == "get"
    assert functions["go"][:3] == ("arrow", 16, 18) and functions["plain"][:3] == ("function", 19, 19) and "if" not in functions


PYTHON = '''import os, sys as s
from a.b import (c,
  d as e)
@wraps(f)
def top(x):
    """}"""
    return 1

class K:
    @staticmethod
    def _in(self):
        pass
'''
DECLARED = [
    ("python", PYTHON, {"top": (5, 7, None, ["wraps"]), "_in": (11, 12, "K", ["staticmethod"])}),
    ("go", 'package a\n\nfunc (s *T) Do() {\n}\n\nfunc help(x string) int {\n\tif x == "}" {\n\t}\n\treturn 1\n}\n', {"Do": (3, 4, None, []), "help": (6, 10, None, [])}),
    ("java", 'class A {\n    @Override\n    private void run(int a) {\n        x("}");\n    }\n}\n', {"run": (3, 5, "A", ["Override"])}),
    ("ruby", "class A\n  def a\n    1\n  end\n\n  private\n\n  def b?\n    if x\n    end\n  end\nend\n", {"a": (2, 4, "A", []), "b?": (8, 11, "A", [])}),
    ("rust", "#[test]\nfn one() {\n  let x = '}';\n}\npub fn two() -> i32 { 1 }\n", {"one": (2, 4, None, ["test"]), "two": (5, 5, None, [])}),
    ("csharp", "class A {\n  [Obsolete]\n  private int Go() {\n    return 1;\n  }\n}\n", {"Go": (3, 5, "A", ["Obsolete"])}),
]


@pytest.mark.parametrize(("lang", "text", "want"), DECLARED)
def test_declarations_of_other_languages(lang, text, want):
    rows = parse.parse(lang, text)
    got = {r["name"]: (r["line"], r["end_line"], r["class_name"], r["annotations"]) for r in rows if r["relation"] == "function"}
    assert {k: got.get(k) for k in want} == want
    if lang == "ruby":
        assert {r["name"]: r["visibility"] for r in rows if r["relation"] == "function"} == {"a": "public", "b?": "private"}
    if lang == "python":
        assert [(r["name"], r["specifiers"]) for r in rows if r["relation"] == "import"][0] == ("a.b", [("c", "c", "named"), ("d", "e", "named")])


def test_unreadable_files_are_rows(spark):
    rows = [("p", "a.js", "javascript", None), ("p", "b.js", "javascript", "import './c'"), ("p", "c.js", "javascript", "(" * 5000)]
    frame = spark.createDataFrame(rows, "project string, file string, lang string, content string")

    def broken(lang, text):
        raise ValueError("no")

    got = parse.parsed(frame, {"javascript": broken})
    assert {r.status for r in parse.status(got, frame).collect()} == {"error"}
    assert {r.file: r.status for r in parse.status(parse.parsed(frame), frame).collect()} == {"a.js": "empty", "b.js": "parsed", "c.js": "empty"}


def test_python_by_its_tree():
    text = (
        "\ufeffimport a.b as c, d\nfrom .. import e as f\nfrom .g import *\n__all__: list[str] = ['one', \"_two\"]\n__all__ += ('three',)\n__all__.extend(['K'])\n"
        "try:\n    import fast\nexcept ImportError:\n    fast = importlib.import_module('slow')\n"
        "def one(x=lambda: 1):\n    def _inner():\n        from late import z\n    return f'{x!r:>{10}} def no():'\nasync def _two(): ...\ndef hidden(): pass\n"
        "@app.route('/x', methods=['GET'])\n@deco(1)(2)\nclass K(Base, metaclass=M):\n    class Deep:\n        def m(self): pass\n    if X:\n        @overload\n        def m(self): pass\n    else:\n        def m(self): pass\n"
    )
    rows = parse.parse("python", text)
    assert [(r["type"], r["name"], r["line"]) for r in rows if r["relation"] == "import"] == [
        ("from", "..", 2), ("from", ".g", 3), ("from", "late", 13), ("dynamic", "slow", 10), ("import", "a.b", 1), ("import", "d", 1), ("import", "fast", 8),
    ]
    assert [(r["name"], r["type"], r["line"]) for r in rows if r["relation"] == "export"] == [("one", "explicit", 11), ("_two", "explicit", 15), ("three", "explicit", 5), ("K", "explicit", 19)]
    got = [(r["name"], r["type"], r["line"], r["end_line"], r["class_name"], r["exported"]) for r in rows if r["relation"] == "function"]
    assert got == [
        ("one", "function", 11, 14, None, True), ("_inner", "function", 12, 13, None, False), ("_two", "function", 15, 15, None, True), ("hidden", "function", 16, 16, None, False),
        ("m", "method", 21, 21, "Deep", False), ("m", "method", 24, 24, "K", False), ("m", "method", 26, 26, "K", False),
    ]
    assert {r["name"]: (r["end_line"], r["annotations"]) for r in rows if r["relation"] == "class"} == {"K": (26, ["app.route", "deco"]), "Deep": (21, [])}


@pytest.mark.parametrize("text", ["print 'x'\ndef f():\n    pass\n", "def f():\n\tif x:\n        pass\n", "(" * 5000, "x = '\0'\ndef f(): pass\n", "x" + "[0" * 3000])
def test_python_without_a_tree_is_an_error_row_and_patterns(text):
    rows = parse.parse("python", text)
    assert [r["relation"] for r in rows][0] == "error"
    assert [r["name"] for r in rows if r["relation"] == "function"] == (["f"] if "def" in text else [])


def test_statements_end_over_any_blank_space():
    gap = " " * 500
    rows = parse.parse("kotlin", f"fun a() ={gap}\n{gap}b()\nfun c() {{\n}}\n")
    assert [(r["name"], r["line"], r["end_line"]) for r in rows if r["relation"] == "function"] == [("a", 1, 2), ("c", 3, 4)]
