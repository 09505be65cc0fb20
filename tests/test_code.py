import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import code as C
from textloom.functions import python_code as P
from textloom.functions import tokens as T

REACT = "import React, { useState } from 'react';\nexport const A = () => {\n  const [x] = useState(1);\n  return x;\n};\n" * 6
FAST = "from fastapi import FastAPI\napp = FastAPI()\n\n\n@app.get('/x')\nasync def x():\n    return {'a': 1}\n" * 6


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("path,lang", [("a/b.TSX", "tsx"), ("x.d.ts", "ts"), ("a.b/c", None), ("noext", None), ("m.py", "py"), ("a.", None), ("s.css", None), (None, None), ("", None)])
def test_language(spark, path, lang):
    assert one(spark, C.language(F.col("p")), p=path) == lang


@pytest.mark.parametrize("code,lang,want", [("from next/x import React from 'next/link'; import React", "tsx", "nextjs"), (REACT, "jsx", "react"), (FAST, "py", "fastapi"), ("import flask\nimport requests", "py", "flask"), ("import requests", "py", "python-http"), ("x = process.env.A", "ts", "node"), ("x = process.env.A", "py", None), ("export interface A {}", "ts", "ts-app"), ("export interface A {}", "js", None), (None, "js", None)])
def test_framework(spark, code, lang, want):
    assert one(spark, C.framework(F.col("c"), F.col("l")), c=code, l=lang) == want


@pytest.mark.parametrize("code,want", [("a" * 199, "too_small"), ("ab cd\n" * 40, None), ("ab\n" * 40_000, "too_large"), ("// @generated\n" + "ab cd\n" * 60, "autogenerated"), ("ab cd\n" * 200 + "// @generated\n", None), ("-- .\n" * 60, "low_alnum"), ("abcd " * 200, "long_lines"), (None, "too_small"), ("", "too_small"), ("é" * 100 + "\n", None)])
def test_quality(spark, code, want):
    assert one(spark, C.quality_reason(F.col("c")), c=code) == want


@pytest.mark.parametrize("path,code,want", [("src/App.tsx", REACT, None), ("node_modules/x/index.js", REACT, "bad_path"), ("a\\vendor\\x.js", REACT, "bad_path"), ("app/x.min.js", REACT, "bad_path"), ("a.css", REACT, "language"), ("u.py", "x = 1\n" * 60, "off_domain"), ("m.py", FAST, None), (None, REACT, "language"), ("a.jsx", None, "off_domain")])
def test_cascade(spark, path, code, want):
    assert one(spark, C.cascade_reason(F.col("c"), F.col("p")), c=code, p=path) == want


BASE64 = "QUJD" * 12
NOISE = [
    ("a.D.TS", "x", "ts", "dts"), ("a.ts", "a <gh_stars>1", "ts", "tags"), ("a.js", "//# sourceMappingURL=data:app", "js", "sourcemap"), ("a.js", "�" * 3, "js", "mojibake"), ("a.js", "��", "js", None),
    ("a.py", "\n".join([BASE64] * 8), "py", "blob"), ("a.py", "\n".join([BASE64] * 7), "py", None), ("a.py", "x = '" + "QUJD" * 60 + "'", "py", "blob"), ("a.js", "/" * 300, "js", None), ("a.js", "var s = <%= user %>;", "js", "template"),
    ("a.jsx", "{{#each x}}", "jsx", "template"), ("a.jsx", "style={{ a: 1 }}", "jsx", None), ("a.py", "print 'x'", "py", "python2"), ("a.py", "print('x')", "py", None), ("a.py", "except A, e:", "py", "python2"), ("a.py", "raise E, 'x'", "py", "python2"), ("a.js", "print 'x'", "js", None), ("a.js", None, "js", None),
]


@pytest.mark.parametrize("path,code,lang,want", NOISE)
def test_noise(spark, path, code, lang, want):
    assert one(spark, C.noise_reason(F.col("c"), F.col("p"), F.col("l")), c=code, p=path, l=lang) == want


def test_metadata_tags(spark):
    strip = lambda c: one(spark, C.strip_metadata(F.col("c")), c=c)
    assert strip("<reponame>o/r<filename>a.py<gh_stars>10\nx = 1") == "x = 1" and strip("<gh_stars>3\n\nx") == "\nx" and strip("x <gh_stars>3") == "x <gh_stars>3" and strip("<div>") == "<div>" and strip(None) is None


LICENSE = "/*\n * Copyright x\n * All rights reserved\n */\n"


@pytest.mark.parametrize("code,want", [
    (LICENSE + "\n\ncode", "code"), ("#!/bin/x\n# Copyright\n# b\n# c\n# d\n\ncode", "#!/bin/x\ncode"), ("'use client'\n// license\n// b\n// c\n// d\ncode", "'use client'\ncode"), ("// license\n// b\n// c\ncode", "// license\n// b\n// c\ncode"),
    ("// a\n// b\n// c\n// d\ncode", "// a\n// b\n// c\n// d\ncode"), ("code", "code"), ("", ""), (None, None), (LICENSE.rstrip(), ""), ("/* copyright\na\nb\nc", ""), ("#!/a\n#!/b", "#!/a\n#!/b"),
])
def test_license(spark, code, want):
    assert one(spark, C.strip_license(F.col("c")), c=code) == want


def test_small_columns(spark):
    assert one(spark, C.repeated_lines(F.col("c")), c="same\nsame\nother\n}\n}") == pytest.approx(1 / 3)
    assert one(spark, C.repeated_lines(F.col("c")), c="a\nb") == 0.0
    assert one(spark, C.around_cursor(F.col("c")), c="ab<CURSOR>cd<CURSOR>") == ("ab", "cd<CURSOR>") and one(spark, C.around_cursor(F.col("c")), c="ab") is None
    assert one(spark, C.first_unit(F.col("c"), F.lit("py")), c="def f():\n    return 1\n\nx = 2") == "def f():\n    return 1\n" and one(spark, C.first_unit(F.col("c"), F.lit("js")), c="{\n  a\n}\nb") == "{\n  a\n}"
    assert one(spark, C.class_key(F.col("f"), F.col("l")), f="react", l="tsx") == "react|tsx" and one(spark, C.class_key(F.col("f"), F.col("l")), f="vue", l="js") == "vue|other" and one(spark, C.class_key(F.col("f"), F.col("l")), f=None, l="js") is None


def test_python_code(spark):
    assert P.parses("x = 1") and not P.parses("x = (") and not P.parses("\0")
    assert P.unsafe_reason("import os") == "import os" and P.unsafe_reason("import math\nopen('x')") == "name open" and P.unsafe_reason("x.__class__") == "attribute __class__" and P.unsafe_reason("import math") is None and P.unsafe_reason("(") == "syntax"
    assert P.longest_valid("x = 1\ny = 2\nz = (") == pytest.approx(2 / 3) and P.longest_valid("(") == 0.0 and P.longest_valid("") == 0.0
    df = spark.createDataFrame([("x = 1", "x = 1 "), ("(", "y"), (None, "a")], "a string, b string")
    got = df.select(P.python_parses(F.col("a")), P.python_unsafe(F.col("a")), P.python_retention(F.col("a")), P.likeness(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, None, 1.0, 1.0), (False, "syntax", 0.0, 0.0), (None, None, None, None)]


@pytest.mark.parametrize("code,lang,want", [
    ("    return x\n\ndef other():\n    pass\n", "py", "    return x\n"), ("    a = 1\n    return a\n", "py", "    a = 1\n    return a\n"), ("    a = 1\n\n    return a\nprint(1)", "py", "    a = 1\n\n    return a\n"),
    ("  return a + b;\n}\n\nconsole.log(1)", "js", "  return a + b;\n}"), ("  return 1;\n", "js", "  return 1;\n"), ("}\nfoo()", "js", "}"), (None, "py", None), ("", "js", ""),
])
def test_first_unit(spark, code, lang, want):
    assert one(spark, C.first_unit(F.col("c"), F.col("l")), c=code, l=lang) == want


@pytest.mark.parametrize("code", ["import os\nos.remove('x')", "import subprocess", "from shutil import rmtree", "x = open('f', 'w')", "eval('1+1')", "exec('a=1')", "__import__('os')", "x = ().__class__.__bases__", "getattr(obj, 'a')", "import socket", "from . import a", "import random", "help()", "x = __builtins__"])
def test_unsafe_python(code):
    assert P.unsafe_reason(code) is not None


@pytest.mark.parametrize("code", ["import math\nx = math.floor(1.5)", "import textwrap, urllib.parse", "from collections import Counter\nc = Counter(s)", "def f(x):\n    return sorted(set(x))\n"])
def test_safe_python(code):
    assert P.unsafe_reason(code) is None


PARTS = ["x = 1", "def f(a):", "    return a", "", "if x:", "    y = (", "        2)", "class A:", "    '''doc", "    more'''", "  bad", "z = [", "1,", "]", "try:", "    pass", "except E:", "    pass", "@d", "s = '''", "'''", "print(f'{x}')", "else:"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9))
def test_longest_valid_against_all_beginnings(lines):
    code = "\n".join(lines)
    parts = code.splitlines(keepends=True)
    total = sum(bool(x.strip()) for x in parts)
    want = next((sum(bool(x.strip()) for x in parts[:n]) / total if total else 0.0 for n in range(len(parts), 0, -1) if P.parses("".join(parts[:n]))), 0.0)
    assert P.longest_valid(code) == want


def test_undefined_names():
    assert P.undefined_names("def f(a):\n    return a + b") and not P.undefined_names("import os\nclass A:\n    x = os.sep\n    def g(self):\n        return [self for i in range(3)] + [__class__]")
    assert not P.undefined_names("from m import *\nq()") and not P.undefined_names("(") and not P.undefined_names("def f():\n    global g\n    g = 1\nprint(g, __name__)") and P.undefined_names("print(later)\ndef f():\n    later = 1")


def test_pieces_and_codecs(spark):
    text = "if x  ===\ty:\r\n    return $a_1 + 22 ;  \n\n"
    assert one(spark, T.pieces(F.col("c")), c=text) == ["if", " x", " ", " ===", "\t", "y", ":", "\r\n    ", "return", " $a_1", " +", " 22", " ;", " ", " ", "\n", "\n"]
    assert one(spark, T.count_pieces(F.col("c")), c=text) == 17 and one(spark, T.pieces(F.col("c")), c=None) is None and one(spark, T.pieces(F.col("c")), c="") == []
    assert one(spark, T.byte_alphabet(F.col("c")), c="a é\n") == "a\u0120Ã©\u010a"
    ids = one(spark, T.encoded(F.col("c")), c="hello  wörld")
    assert ids and one(spark, T.decoded(T.encoded(F.col("c"))), c="hello  wörld") == "hello  wörld" and one(spark, T.encoded(F.col("c")), c="") == [] and one(spark, T.encoded(F.col("c")), c=None) is None
    assert one(spark, T.without_special(F.array(F.lit(6), F.lit(9))), c="x") and not one(spark, T.without_special(F.array(F.lit(5))), c="x") and one(spark, T.without_special(F.array().cast("array<int>")), c="x")
