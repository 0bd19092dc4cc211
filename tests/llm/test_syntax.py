"""Parsers against the languages' own readers where there are some, and on hand-written cases."""

import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm.syntax import check, lr
from stratagraph.llm.syntax import operator as op

GOOD = {
    "c": [
        "", "int a;", "typedef struct { int x; } t;\nt *f(t *p, const foo_t **q);", "#define X \"{\"\nint g(void) { if (a) { return; } else b(); for (int i = 0; i < n; i++) x[i] ^= 0x1u; }",
        "#ifdef A\nint f(int a) {\n#else\nint f(void) {\n#endif\n return 1;\n}\n", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint a(void);\n#ifdef __cplusplus\n}\n#endif\n", "int f(void)\n{\n\tswitch (a & 3) {\n\tcase 0:\n\t\tb = '}';\n\t\tbreak;\n\tdefault:\n\t\tbreak;\n\t}\n\treturn (int)((d->s + a) / 6);\n}",
        "static const struct api x = { .open = f, [3] = { 1, 2 }, };", "MODULE(x);\nint a = sizeof(struct s) + sizeof a + (u8)b;", "#if 0\nthis is ' no C at all {\n#endif\nint x;", "foo_t x, *y;\nbar *z(void) { foo_t *p = q; a * b; (void)p; return (bar){ 0 }; }",
        "int x __attribute__((unused));\n__weak int h(void) { goto out;\nout:\n\treturn 0; }", "/* open <<<<<<< { */ // }\nint y;", "int a = 1 ? 2 : 3, b[2] = {1, 2,};\nvoid (*cb)(int, void *);\nint (*tab[3])(void);", "#if defined(A) && B > 3\nint q;\n#elif C\nint r;\n#endif\n",
        "int f(void) { do { x++; } while (0); do x--; while (y); L: ; asm volatile(\"nop\" : : \"r\"(x)); return a ? b : c, d; }", "enum e { A, B = 8, };\nunion u { int a : 3; struct { int b; }; };", "int f(int a, ...);\nint g() { return f(1, \"a\" \"b\", 'c'); }",
    ],
    "devicetree": ["/dts-v1/;\n#include <a.dtsi>\n/ {\n\tmodel = \"x; {\";\n\tn1: spi@a1c {\n\t\treg = <0x1 (2 + 3)>, <&clk 3>;\n\t\tbytes = [00 ff];\n\t\tflag;\n\t\t#size-cells = <1>;\n\t\tchild { }; /* } */\n\t};\n};\n&n1 { status = \"okay\"; };\n/delete-node/ &n1;"],
    "kconfig": ["", "menu \"M\"\nconfig A\n\tbool \"x\" if B\n\tdepends on (A && !B) || C = y\n\tdefault y if D\n\thelp\n\t  free <<<<<<< text }\n\n\t  more\n\nif E\nconfig F\n\tint\n\trange 1 5\nendif\nendmenu\nchoice\n\tprompt \"p\"\nconfig G\n\tbool\nendchoice\nsource \"x/Kconfig\"\n# c\n"],
    "kconfig-fragment": ["", "CONFIG_A=y\n# CONFIG_B is not set\n\n# ====\nCONFIG_S=\"a # b\"\nCONFIG_N=-5\n"],
}
BAD = {
    "c": ["int f(void) {", "int a = ;", "<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n", "/* open", "def f(x):\n    return x\n", "#if A\nint a;\n", "#endif\n", "some words of prose.", "int f(void) { return 1; } }", "\"open\nint a;", "#ifdef A\nint f(void) {\n#endif\n return 1;\n}\n", "struct s { int a }", "int a[;", "@", "int 3x;"],
    "devicetree": ["/ {\n\ta = <1>;\n", "/ { a = <1> };", "<<<<<<< x\n/ { };", "prose here.", "/ { n { }; } }", "/ { a = \"x; };"],
    "kconfig": ["menu \"M\"\nconfig A\n\tbool\n", "config A\n\tbool \"x\n", "if A\nconfig B\n\tbool\n", "=======\n", "int f(void)\n", "config\n", "config A\n\tdepends on\n", "endmenu\n"],
    "kconfig-fragment": ["CONFIG_A=y\n=======\n", "config A\n", "CONFIG_S=\"open\n", "A=y\n", "CONFIG_A=\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_hand_written(language):
    for t in GOOD[language]:
        assert check.first_error(language, t) == -1, t
    for t in BAD[language]:
        assert check.first_error(language, t) >= 0, t


PY = [
    "", "x = 1\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    '''d'''\n    return a\n", "match x:\n    case [1, 2]:\n        pass\n    case {'a': b} if b:\n        pass\n    case _:\n        pass\n", "match = 1\nmatch(x)\nprint(match)\n", "type X[T] = list[T]\n",
    "rf'\\d{x}\\{y}'\n", "f'\\N{BULLET}{a}'\n", "f\'\'\'{a # c }\n}\'\'\'\n", "f'{3!s  }'\n", "f'{3!s x}'\n", "f'{a!r'\n", "with (a, b as c, d):\n    pass\n", "with (a as b), c: pass\n", "with (a) as b: pass\n", "f'{a!r:>{w}} {{ {b[\"k\"]}'\n", "with (open(a) as b, open(c) as d):\n    pass\n", "with open(a) as b, c: pass\n", "try:\n    a\nexcept* E as e:\n    b\nelse:\n    c\nfinally:\n    d\n", "async def g():\n    async for x in y:\n        await z\n    return [i async for i in a if i]\n",
    "lambda *a, k=1: (yield)\n", "a: int\nb: str = 'x'\na, *b = c = d\na += 1; del x[1:2, ::3], y\n", "@d.e(1)\nclass A[T](B, m=C):\n    x: int = 0\n", "if a := 1: pass\nelif b: pass\nelse: pass\nwhile x: break\nelse: pass\n", "x = a if b else c\nnot a in b is not c\n-x ** -y\n", "from . import a\nfrom ..b.c import (d as e, f,)\nimport g.h as i, j\n",
    "raise A from b\nassert x, 'm'\nglobal q\n", "x = [*a, *b]\ny = {**a, 'b': 1}\nz = {1, 2}\nf(*a, **b, c=1)\nprint(x for x in y)\n", "\\\n\nx = (1,\n  2)\n", "r'\\' b'x' rb'\\x'\n".replace("r'\\' ", ""), "0777\n", "x = 'a\n", "def f(:\n", "  x\n", "if a:\nb\n", "try:\n  x\n", "print 'x'\n", "x = $\n", "(]\n", "f'{a'\n", "f'{}'\n", "f'}'\n", "class\n", "x ==\n", "if a:\n\tx\n        y\n", "a = 0x\n", "1_000_\n", "x = 1 if 2\n", "<<<<<<< a\n", "1st\n", "é = 1\n", "def f():\n    x = '''a\n", "return\n", "x = {a: 1, **b, 'c': f'{d:{e}}'}\n", "print(f\"{x['a']}\")\n", "async with a as b: pass\n",
]


def py_ok(t):
    try:
        ast.parse(t)
        return True
    except (SyntaxError, ValueError):
        return False


def test_python_like_the_interpreter():
    for t in PY:
        assert (check.first_error("python", t) == -1) == py_ok(t), t


def test_the_tables_alone_take_valid_python():
    from stratagraph.llm.syntax import scan

    t = lr.load("python")
    for text in PY:
        if py_ok(text):
            kinds, _, _ = scan.python(text)
            assert lr.parse_all(t, check._ids(t, kinds), {}) == -1, (text, kinds)


def test_the_tables_take_the_standard_library():
    import glob
    import os

    texts = []
    for f in sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[::8]:
        with open(f, encoding="utf-8") as h:
            texts.append((f, h.read()))
    assert texts
    for f, t in texts:
        assert check.first_error("python", t) == -1, f


BROKEN = "int f(void) { return 1;\n"
READ = ["#if X == 3\n?#endif\n", "#if VERSION > 4\n?#endif\n", "#if A\nint a;\n#elif X == 2\n?#endif\n", "#if defined(A) && defined(B) && !defined(C) && !defined(D)\n?#endif\n", "#if (X + 1) > 3 && !(defined(A) || B)\n?#endif\n", "#ifdef A\n#if Y >= 2\n#ifndef Z\n?#endif\n#endif\n#endif\n", "#ifndef X\n#define X 3\n#endif\n#if X > 4\n?#endif\n", "#if IS_ENABLED(CA) && IS_ENABLED(CB)\nint a;\n#else\n?#endif\n"]
UNREAD = ["#if 0\n?#endif\n", "#define X 2\n#if X == 1\n?#endif\n", "#if 1 > 2\n?#endif\n", "#ifdef __cplusplus\n?#endif\n", "#if 1\n#else\n?#endif\n"]


def test_every_branch_is_read_that_can_be():
    for t in READ:
        assert check.first_error("c", t.replace("?", "int g;\n")) == -1, t
        assert check.first_error("c", t.replace("?", BROKEN)) >= 0, t
    for t in UNREAD:
        assert check.first_error("c", t.replace("?", BROKEN)) == -1, t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]",:0123456789.-eEtrufalsn \n\\', max_size=24))
def test_json_like_the_library(text):
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
        want = True
    except (ValueError, ZeroDivisionError):
        want = False
    assert (check.first_error("json", text) == -1) == want


YAML = [
    "", "a: 1\nb:\n  - x\n  - y: 2\n    z: 3\nc: {d: [1, 2], \"e\": 'f'}\n", "a:\n- b\n- c\n", "- - 1\n  - 2\n- k: v\n", "text over\n  two lines\n", "a: |\n  x\n   y\n\nb: >-\n  folded\n", "---\na: 1\n---\nb\n...\n", "? x\n: y\n", "&a b: *a\n", "!t x: !!str y\n", "a: b: c\n", "a: [1, 2\n", "a: 'x\n", "\ta: 1\n", "a: @x\n", "- a\nb: 1\n", "a: 1\n b: 2\n",
    "<<<<<<< x\na: 1\n", "a: \"\\q\"\n", "%YAML 1.1\n---\na\n", "'a' 'b'\n", "{a: 1}: b\n", "a: {b: 1,}\n", "#c\n", "key: - x\n", "a:\n  b\n c: 1\n", "a: &x\n  b: 1\n", "x: [a, [b, {c: d}]]\n", "a: b #c\n", "a #b: c\n", "- \n- a\n", "a: |x\n  b\n", "a\n=======\nb: 1\n", "<html><p>isn't</p></html>\n", "one: two: three\n", "'it''s': ok\n",
]


def test_yaml_like_the_library():
    yaml = pytest.importorskip("yaml")
    for t in YAML:
        try:
            list(yaml.compose_all(t))
            want = True
        except yaml.YAMLError:
            want = False
        assert (check.first_error("yaml", t) == -1) == want, t


def test_generator_resolves_by_precedence_and_reports_the_token():
    t = lr.build("%left +\n%left *\ne : e + e\n  | e * e\n  | N\n")
    ids = lambda s: [t.terminals.get(c, -1) for c in s] + [t.terminals[lr.END]]
    assert lr.parse(t, ids("N+N*N")) == -1 and lr.parse(t, ids("N+*N")) == 2 and lr.parse(t, ids("N+")) == 2
    amb = lr.build("s : A x\n  | B\nx : A\n  |\n")
    get = lambda s: [amb.terminals.get(c, -1) for c in s] + [amb.terminals[lr.END]]
    both = {amb.terminals["B"]: (amb.terminals["A"], amb.terminals["B"])}
    assert lr.parse_all(amb, get("BB"), both) == -1 and lr.parse(amb, get("BB")) == 1


def test_paths():
    assert [check.language_of(p) for p in ("a/x.py", "x.h", "b/Kconfig", "Kconfig.net", "a_defconfig", "x.conf", "y.yaml", "z.json", "q.overlay", "README.md", "x.C", None, "", "Kconfigs")] == ["python", "c", "kconfig", "kconfig", "kconfig-fragment", "kconfig-fragment", "yaml", "json", "devicetree", None, None, None, None, None]


FILES = "file_id long, source_file string, repo string, content string, language string, error_line string"


def test_operator(spark):
    long = "int x;\n" * 30000
    rows = [(1, "r/a.c", "r", "int a;", "c", "?"), (2, "r/b.c", "r", "int a", None, "?"), (2, "r/b.c", "r", "int a", None, "?"), (3, "r/c.py", None, "x = (\n1", "c", "?"), (4, "r/d.bin", "r", None, None, "?"), (5, "r/e.json", "r", "", "other", "?"), (6, "r/f.py", "r", "", "c", "?"), (7, None, "r", "x", "c", "?"), (8, "r/g.c", "r", long, "c", "?"), (9, "r/h.c", "r", long + "}", "c", "?"), (None, "r/i.c", "r", "int", "c", "?")]
    got = op.check_files(spark.createDataFrame(rows, FILES))
    assert {(r.file_id, r.error_line) for r in got.collect()} == {(1, None), (2, 1), (3, 2), (5, 1), (6, None), (8, None), (9, 30001), (None, 1)}
    rates = {(r.repo, r.language): (r.files, r.invalid_files) for r in op.invalid_rates(got).collect()}
    assert rates[("r", "c")] == (5, 3) and rates[(None, "python")] == (1, 1)
    assert op.check_files(spark.createDataFrame([], FILES)).count() == 0
