import ast
import glob
import random
import sysconfig
import warnings

import pytest
from pyspark.sql import functions as F

from textloom.llm import handwritten, python_syntax, script_syntax, syntax
from textloom.llm.derive import Grammar


def test_derivatives_of_a_small_grammar():
    g = Grammar("e = t (('+' | '-') t)* ; t = f ('*' f)* ; f = N | '(' e ')' ;")

    def run(tokens):
        state = g.start("e")
        for i, t in enumerate(tokens):
            state = g.step(state, t)
            if not state:
                return i
        return "ok" if g.ends(state) else "more"

    assert run("N+N*N") == "ok" and run("(N+N") == "more" and run("N+*") == 2 and run("N)") == 1
    assert g.takes(g.start("e")) == {"N", "("}


GOOD = {
    "js": ["const a = {b, c: 1, ...d, e() {}, get f() { return 1 }, [g]: 2};", "a\nb", "for (const [k, v] of m) x(k)\n", "let r = a / b / c, q = /[/\\]]+/g.test(s);", "`a ${b + `c ${d}`} e`", "x = async ({a = 1}, ...r) => { await a }", "label: while (1) { break label }", "if (a) b; else c", "class A extends B { #p = 1; static x; async *g() {} constructor() { super() } }", "do x++; while (x < 5)\ny", "var s = '<<<<<<< HEAD';", "export default function () {}\nexport { a as b } from 'c';", "return_ = 1", "a?.b?.[c]?.(d) ?? e", "x = y ? (z) : w => w", "", "// only a comment", "#!/usr/bin/env node\nx()"],
    "jsx": ["const a = <b c=\"d\" {...e} f={g}>don't {h} <i/> <></></b>;", "x = cond && <A.B>{list.map((i) => <li key={i}>{i}</li>)}</A.B>"],
    "ts": ["let a: Map<string, Array<number>> = new Map();", "interface A<T extends B = C> { readonly a?: T[]; (x: number): string; [k: string]: any }", "type F = (a: number, b?: string) => Promise<void>;", "@Injectable()\nexport class A { constructor(private readonly b: B, @Inject(C) c?: D) {} }", "enum E { A = 1, B }", "const x = y as unknown as Z; z!.w;", "function f(this: X, a?: number): a is string { return true }", "abstract class Q { abstract m(): void; protected x!: number }", "declare module 'a' { export const b: number }", "type M = { [K in keyof T]?: T[K] extends infer U ? U : never };", "let t: [a: string, b?: number, ...c: boolean[]] = x;", "export type { A } from './a';", "a < b && c > (d)"],
    "tsx": ["const f = <T,>(x: T) => <div>{x as any}</div>;", "export function A({ a }: { a: string }) { return <B<number> c={1}>text</B>; }"],
}
BAD = {
    "js": ["const a = ;", "function f( {", "if (a {", "x = {a: 1,, b: 2}", "a b", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "let s = 'abc\n';", "import json", "def f():\n  pass", "let x: number = 1;", "const x = <div/>;", "foo(]", "}", "`abc ${", "a = ‘b’", "class A { foo( }"],
    "jsx": ["x = <a><b></a>;", "x = <a>{</a>;", "x = <a>;", "x = <a b=></a>"],
    "ts": ["let a: = 1;", "interface A { b: }", "const x = <div></div>;", "type = ;", "@ class A {}"],
    "tsx": ["const a = <div>{x</div>;", "x = <a>b"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_scripts(lang):
    for code in GOOD[lang]:
        assert script_syntax.check(code, lang)[0] == "ok", code
    for code in BAD[lang]:
        assert script_syntax.check(code, lang)[0] != "ok", code


def test_the_failing_token_and_truncation():
    assert script_syntax.check("let a = 1;\nlet b = ;", "js") == ("failed", 19)
    assert script_syntax.check("function f() { if (a) {", "js")[0] == "truncated"
    assert python_syntax.check("x = (1,\n")[0] == "truncated"
    assert python_syntax.check("x = 1\ny = = 2\n") == ("failed", 10)


PYTHON = ["print 'x'", "x = 0777", "def f(a=1, b): pass", "f(a=1, b)", "if x:\npass", "if x:\n\ty\n        z", "x = [1, 2", "'''abc", "a + 1 = b", "except A, e:", "f'{a b}'", "f'{a'", "x = 12abc", "lambda: (yield", "return = 1", "for x in: pass", "class A(:\n  pass", "x = 'a\n'", "del f()", "with a as 1: pass", "import a.b as", "f\"{x!z}\"", "b'é'", "match x:\n  case 1: pass", "type X[T] = int", "async def f():\n  async with a as b, c: await d", "x: int = 3", "f'{x:>{w}} {y!r:^10} {{z}} {d[\"k\"]}'", "print(*a, **b, sep='')", "def f(a, /, b, *, c=1, **d) -> int: ...", "x = not in y", "@a.b(c)\nclass D: pass", "try:\n  a\nexcept* E as e:\n  b", "a = b if c else lambda *d, e=1: e", "x[1:2, ::3, ...]", "{**a, 'b': 1, **c}", "if(a):=b", "(a := b)", "\tx = 1", "if a:\n  b\n c", "x = 1 if 2", "[a for b in c if d async for e in f]", "raise A from b", "global a, b; nonlocal c", "'a' f'b{c}' r'\\d'", "return'x'", "0_0 + 1_000j + 0xFFn", "x = 1if y else 2", "a\\\n  + b", "", "#"]


def test_python_against_the_language():
    warnings.simplefilter("ignore")
    for code in PYTHON:
        try:
            ast.parse(code)
            want = True
        except SyntaxError:
            want = False
        assert (python_syntax.check(code)[0] == "ok") == want, code


def test_python_on_the_standard_library():
    for file in sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))[:90]:
        with open(file, encoding="utf8") as f:
            assert python_syntax.check(f.read())[0] == "ok", file


def test_parsed_rows_and_rates(spark):
    rows = [(1, "x = 1", "py", "a.py", "o/r"), (2, "x = (", None, "b.PY", "O/r.git"), (3, "let a = ;", "js", "c.js", None), (4, None, "js", "d.js", "o/r"), (5, "", "js", "e.js", "o/r"), (6, "a b c", "cobol", "f.cob", "o/r"), (2, "x = (", None, "b.PY", "O/r.git")]
    df = spark.createDataFrame(rows, "file_id long, code string, lang string, path string, repo string").withColumn("status", F.lit(0))
    got = {r["id"]: r["status"] for r in syntax.parsed(df).collect()}
    assert got == {1: "ok", 2: "truncated", 3: "failed"}
    out = {(r["project"], r["lang"]): (r["files"], r["failed"], r["truncated"], r["rate"]) for r in syntax.rates(df, syntax.parsed(df)).collect()}
    assert out == {("o/r", "py"): (2, 0, 1, 0.5), (None, "js"): (1, 1, 0, 1.0)}
    assert syntax.parsed(df.limit(0)).count() == 0


def test_very_deep_and_very_long_texts():
    assert script_syntax.check("(" * 20_000 + "1" + ")" * 20_000, "js")[0] == "ok"
    assert python_syntax.check("x = [\n" + "  1,\n" * 50_000 + "]\n")[0] == "ok"


HAND = "import x from 'y';\n\nexport function add(a, b) {\n  // sums generated by this page are kept\n  const banner = 'Code generated by z. DO NOT EDIT.';\n  return a + b;\n}\n"


def test_kinds_of_content():
    kind = lambda code, path="src/a.js": handwritten.kinds(code, path)[0]
    assert kind(HAND) == set()
    assert kind("// Copyright (c) 2020 a\n// Licensed under the terms of b\n" + HAND) == set()
    assert kind("// Code generated by tool v1. DO NOT EDIT.\n" + HAND) == {"generated"}
    assert kind("/* license */\n\n/**\n * Fichier produit par x, ne pas modifier.\n */\n" + HAND) == {"generated"}
    assert kind(HAND + "\n// AUTO-GENERATED FILE. Any change will be overwritten.\n") == {"generated"}
    assert kind("class A {\n" + "".join(f"  get_f_{i}(buf) {{ return this.read(buf, {i + 1}, 2); }}\n" for i in range(9)) + "}\n") == {"generated"}
    assert kind("class A(Model):\n" + "".join(f"    {w} = models.CharField(max_length=20, default='{w}')\n" for w in "alpha beta gamma delta eps zeta eta theta".split()), "a.py") == set()
    assert kind("const d = [\n" + "  12.5, -3.25, 8,\n" * 60 + "];\n") == {"data"}
    assert kind("const table = [\n" + "  0x46, 0x0a, 0xff, 1e5, 0b11,\n" * 40 + "];\n") == {"data"}
    assert kind("const codes = {\n" + "".join(f"  e{i}: {{ code: {400 + i}, message: '{' '.join('bad request now'.split()[: i % 3 + 1])}!' }},\n" for i in range(9)) + "};\nexport default codes;\n") == {"generated"}
    assert kind("function a(b){return b?b.c(1):void 0}" * 20) == {"minified"}
    assert kind("\n".join(f"// note {chr(97 + i)} of many" for i in range(20)) + "\n// Bundled copy of lib (1.2.3), see the x distribution\n" + HAND) == {"vendored"}
    assert kind("# Bundled copy of lib (1.2.3), see the x distribution\nimport os\n\n\ndef f():\n    return os.name\n", "a.py") == {"vendored"}


def test_attribute_files():
    text = "# marks\n*.pb.go linguist-generated\n/gen/** linguist-generated=true\nlib/*.js linguist-vendored\nlib/own.js -linguist-vendored\n*.md text\n"
    say = lambda path, files=None: handwritten.declared(path, files or [("", text)])
    assert say("a/b/x.pb.go") == {"generated": True} and say("gen/a/b.c") == {"generated": True} and say("x/gen/a.c") == {}
    assert say("lib/x.js") == {"vendored": True} and say("lib/own.js") == {"vendored": False} and say("lib/a/x.js") == {}
    deeper = [("", "*.js linguist-vendored\n"), ("src/", "*.js -linguist-vendored\nkeep.js !linguist-vendored\n")]
    assert say("src/a.js", deeper) == {"vendored": False} and say("b.js", deeper) == {"vendored": True} and say("src/keep.js", deeper) == {}


def test_attribute_files_in_directories_with_a_dot():
    assert handwritten.declared(".yarn/x.js", [("", ".yarn/** linguist-vendored\n")]) == {"vendored": True}
    assert handwritten.declared("./.yarn/a/x.js", [(".yarn/", "*.js linguist-generated\n")]) == {"generated": True} and handwritten.declared("yarn/x.js", [(".yarn/", "*.js linguist-generated\n")]) == {}


def test_patterns_mined_from_declaring_repositories(spark):
    """Two repositories declare what lies in directories and endings that others have without saying so."""
    body = lambda i: f"export function work{i}(a) {{\n  return a.part{i} + other{i}(a);\n}}\n"
    rows = [(i, body(i), f"src/stubs{i % 3}/emitted/f{i}.js" if i % 2 else f"api/f{i}.proto-out.js", f"o/d{i % 2 if i < 12 else i % 4}") for i in range(40)]
    rows += [(100, body(100), "lib/emitted/x.js", "u/a"), (101, body(101), "lib/y.proto-out.js", "u/b"), (102, body(102), "lib/z.js", "u/a"), (103, body(103), "api/own.js", "o/d0"), (104, body(104), "src/emitted/w.js", "o/clear")]
    df = spark.createDataFrame(rows, "file_id long, code string, path string, repo string")
    said = "**/emitted/** linguist-generated\n*.proto-out.js linguist-vendored\n"
    marks = spark.createDataFrame([*((f"o/d{i}", ".gitattributes", said) for i in range(4)), ("o/clear", ".gitattributes", "**/emitted/** -linguist-generated\n")], "repo string, path string, text string")
    got = {r["id"]: (r["kinds"], r["reasons"]) for r in handwritten.not_handwritten(df, marks).collect()}
    assert got[100] == (["generated"], ["place"]) and got[101][0] == ["vendored"] and "place" in got[101][1] and got[1] == (["generated"], ["declared"]) and not {102, 103, 104} & set(got)


def test_not_handwritten(spark):
    body = "".join(f"def work_{w}(a):\n    return a.{w} + {i}\n\n\n" for i, w in enumerate("alpha beta gamma delta eps zeta eta theta iota kappa".split()))
    rows = [
        (1, HAND, "src/a.js", "o/a"), (2, HAND.replace("add", "sub"), "node_modules/q/b.js", "o/b"), (3, body, "vendor/lib1/tool.py", "o/c"), (4, "# local\n" + body, "src/tool.py", "o/d"),
        (5, body.replace("alpha", "omega"), "src/other.py", "o/e"), (6, None, "src/x.py", "o/a"), (7, "", "node_modules/x.js", "o/a"), (8, HAND, None, None), (9, HAND, "lib/mine.js", "o/g"), (10, HAND, "node_modules/z/own.js", "o/g"),
    ]
    df = spark.createDataFrame(rows, "file_id long, code string, path string, repo string").withColumn("kinds", F.lit(0))
    marks = spark.createDataFrame([("O/g.git", ".gitattributes", "lib/** linguist-generated\nnode_modules/** -linguist-vendored\n")], "repo string, path string, text string")
    got = {r["id"]: r["kinds"] for r in handwritten.not_handwritten(df, marks).collect()}
    assert got == {2: ["vendored"], 3: ["vendored"], 4: ["vendored"], 9: ["generated"]}
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_mined_directories(spark):
    rows = [(i, f"p{i}", ["web", "bundle", f"pkg{i}"]) for i in range(30)] + [(100 + i, f"p{i}", ["src", "app"]) for i in range(30)] + [(200 + i, f"p{i}", ["src", "bundle", f"pkg{i}"]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, project string, dirs array<string>")
    assert [r[0] for r in handwritten.packages(df).collect()] == ["bundle"]


def test_every_copy_that_reaches_the_threshold(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(60):
        own = [f"word{i}x{j}" for j in range(200)]
        rows.append((2 * i, " ".join(own), f"node_modules/lib{i}/part{i}.js", f"a/r{i}"))
        changed = list(own)
        for j in rng.sample(range(0, 200, 5), 8 + i % 4):  # each change costs five runs on either side
            changed[j] = f"new{i}x{j}"
        rows.append((2 * i + 1, " ".join(changed), f"src/part{i}.js", f"b/r{i}"))
        sets = [{tuple(t[k : k + 5]) for k in range(196)} for t in (own, changed)]
        if len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= handwritten.COPIED:
            want.add(2 * i + 1)
    rows.append((200, rows[0][1], "lib/part0.js", "c/r"))
    rows.append((201, rows[0][1] + " " + rows[0][1].upper(), "lib/part0.js", "c/r"))  # 0.49 of it
    rows += [(202, "other text of the same key", "lib/part1.js", "c/r"), (202, rows[2][1] + " end", "lib/part1.js", "c/r")]
    assert 10 < len(want) < 60
    df = spark.createDataFrame(rows, "file_id long, code string, path string, repo string")
    got = {r["id"] for r in handwritten.not_handwritten(df).collect() if "copy of a third-party file" in r["reasons"]}
    assert {i for i in got if i % 2 or i >= 200} == want | {200, 202}


def test_copies_in_blocks(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i // 10}x{j}" for j in range(100)) + f" own{i}") for i in range(100)], "id long, code string")
    sets = rows.select("code").mapInArrow(handwritten._class_sets, "c0 long, c1 long, runs array<long>").toPandas()
    ids = rows.toPandas()["id"].tolist()
    keyed = spark.createDataFrame([("n", int(c0), int(c1), i) for i, c0, c1 in zip(ids, sets["c0"], sets["c1"])], "name string, c0 long, c1 long, id long")
    known = keyed.where("id % 10 = 0 and id < 50")
    for block in (1024, 3):
        got = handwritten.copies_of(known, keyed, rows, block).join(keyed, ["name", "c0", "c1"])
        assert sorted(r["id"] for r in got.collect()) == list(range(50))
