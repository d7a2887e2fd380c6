"""Chunks of JavaScript and TypeScript by their declarations, and what indexing keeps of symbols."""

from __future__ import annotations

import pytest

from tessera.operators import chunking, scripts


def found(text):
    return [(k, n) for k, n, _ in scripts.declarations(text)[0]]


def test_functions_classes_and_imports():
    text = """
import { foo } from './foo';
import './side.css';
export * from "other";

export function greet(name: string): string {
  return 'hi ' + name;
}

export default class Service<T extends { a: 1 }> extends Base<{ b: 2 }> implements X {
  run() { return 1; }
}
async function* steps() { yield 1 }
"""
    made, imports = scripts.declarations(text)
    assert [(k, n) for k, n, _ in made] == [("function", "greet"), ("class", "Service"), ("function", "steps")]
    assert made[0][2].startswith("function greet(") and made[0][2].endswith("name;\n}")
    assert made[1][2].startswith("class Service<") and made[2][2] == "async function* steps() { yield 1 }"
    assert imports == ["./foo", "import './side.css';", "other"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("function a() { return '}' + \"}\" + `}${ {x: `}`}.x }}` } function b() {}", "ab"),
        ("function a() { /* } */ // }\n } function b() {}", "ab"),
        ("function a() { return /[}/]\\/}/g.test(x) } function b() {}", "ab"),
        ("function a() { const x = 4 / 2 / 1; if (x) /}/.test(y); return `}` } function b() {}", "ab"),
        ("const f = function c() {}\nconst g =\n  function d() {}\nfunction b() {}", "b"),
        ("foo(function c() {}); (function d() {})(); function b() {}", "b"),
        ("function a(x: string): string;\nfunction a(x: any): { y: number } | [1, { z: 2 }] { return x }", "a"),
        ("@Dec({ a: 1 }) export class A { @In() x = 1 } abstract class B {} declare class C {} class D {}", "AD"),
        ("if (x) { function inner() {} } else { class Inner {} }\nfunction b() {}", "b"),
        ("export default function () { return 1 }\nexport default class { }\nfunction b() {}", "b"),
        ("const t = <p>don't</p>\nfunction b() {}", "b"),
        ("function $a_é() {}", ["$a_é"]),
        ("x = a\nclass B {}", "B"),
        ("let s = `a${`b${1}`}`; class B { m() { return `${{}}` } }", "B"),
        ("function a() {", ""),
        ("", ""),
    ],
)
def test_what_counts_as_a_declaration(text, names):
    assert [n for _, n in found(text)] == list(names)


def test_offsets_after_other_letters_than_ascii():
    text = "// čaš \U0001f600 ünï\nconst s = 'ž';\nexport function běh(a) { return 'ž' + a }\n"
    assert scripts.declarations(text)[0] == [("function", "běh", "function běh(a) { return 'ž' + a }")]


def test_long_symbols_are_cut_and_keys_stay(spark):
    long = "function big() {\n" + "  step();\n" * 60 + "}"
    docs = spark.createDataFrame([("a", f"import x from 'm'\n{long}\nclass C {{}}"), ("b", "\n\n" + long), ("c", "no declaration\n\n" + "word " * 60), ("d", None)], "document_id string, content string")
    rows = chunking.script_chunks(docs, size=200, overlap=20).collect()
    keys = lambda d: [r.chunk_key for r in rows if r.document_id == d]
    assert keys("a")[-1] == "class:C" and keys("a")[:-1] == keys("b") == [f"function:big#{i}" for i in range(len(keys("b")))] and len(keys("b")) > 2
    assert all(len(r.content) <= 200 for r in rows) and {tuple(r.imports) for r in rows if r.document_id == "a"} == {("m",)}
    assert keys("c") == ["size:0", "size:1", "size:2"] and keys("d") == []


def test_indexing_keeps_symbols(spark):
    rows = [("code", "a.py", "import x\n\ndef f():\n    return 1\n"), ("code", "b.TSX", "import y from 'z'\n\nexport class V { }\n"), ("code", "c.go", "package c"), ("documentation", "d.js", "# H\ntext")]
    docs = spark.createDataFrame(rows, "type string, file string, content string")
    got = {r.file: (r.section, r.symbol, r.symbol_kind, r.chunk_key, r.imports, r.start_line) for r in chunking.explode_chunks(docs).collect()}
    assert got == {"a.py": ("f", "f", "function", "function:f", ["x"], 3), "b.TSX": ("V", "V", "class", "class:V", ["z"], 3), "c.go": (None, None, None, "size:0", [], 1), "d.js": ("H", None, None, None, None, 1)}
