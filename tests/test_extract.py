"""Extractors on small files of every language."""

from stratagraph.extract import dispatch
from stratagraph.extract.records import COLUMNS, SHAPE

PY = '''import os
X = 1
class A(Base):
    def m(self, a, *args, k=1, **kw):
        """Doc."""
        return helper(a)
def outer():
    def inner():
        call()
    return inner
Y = 2
'''
C = '''#include "m.h"
#include <zlib.h>
#define N 3
#ifdef A
#define F(x) (x)
#endif
struct s { int a; };
union u { int b; };
enum e { P, Q };
typedef unsigned int word;
struct fwd;
static int count = 2;
int proto(int a, char *b);
/* } not code { */
int main(void)
{
#ifdef DEBUG
	if (a > 1) {
#else
	if (a) {
#endif
		helper("}");
	}
	return p->method(2);
}
#ifdef __cplusplus
extern "C" {
#endif
void late(void);
#ifdef __cplusplus
}
#endif
'''
KCONFIG = '''config ALPHA
	bool "Alpha"
	depends on BETA_X && AB
	select DEF_Y
	help
	  Some help
	  on two lines.

menuconfig GAMMA
	int
endmenu
'''
DTS = '''/dts-v1/;
#include "base.dtsi"
/ {
	model = "x; {y}";
	uart0: serial@4000 {
		compatible = "acme,uart", "acme,generic";
		clocks = <&clk 3>;
		child { status = "okay"; /* } */ };
	};
};
&uart0 { status = "disabled"; };
'''
RST = '''Title
=====

Intro with :c:func:`do_it` and text.

.. _my-anchor:

Part
----

The unit must stay idle. It should wait.
See :ref:`my-anchor` and :kconfig:option:`CONFIG_A=y`.
'''
MD = '''# One

### Three
Use `known_symbol` here. You must not stop it.
must it?
'''


def rows(path, lang, text):
    return [dict(zip(COLUMNS, r)) for r in dispatch.extract_file(path, lang, text)]


def ents(rs):
    return {(r["entity_type"], r["name"], r["kind"]) for r in rs if r["rec"] == "entity"}


def test_python():
    r = rows("p/a.py", "python", PY)
    assert ents(r) == {("Variable", "X", "definition"), ("Class", "A", "definition"), ("Function", "m", "definition"), ("Function", "outer", "definition"), ("Function", "inner", "definition")}
    m = next(x for x in r if x["name"] == "m")
    assert m["parameters"] == ["self", "a", "k"] and m["description"] == "Doc." and m["signature"].startswith("def m(self, a")
    assert {(x["subject"].split("|")[-1], x["target"]) for x in r if x["pend_kind"] == "call"} == {("m", "helper"), ("outer", "call"), ("inner", "call")}
    assert [x["target"] for x in r if x["pend_kind"] == "extends"] == ["Base"]
    assert {(x["subject"].split("|")[-1], x["object"].split("|")[-1]) for x in r if x["predicate"] == "DECLARES"} >= {("A", "m"), ("outer", "inner")}


def test_python_syntax_error_is_one_ambiguity():
    assert [x["rec"] for x in rows("p/b.py", "python", "def f(:\n")] == ["ambiguity"]


def test_c():
    r = rows("s/m.c", "c", C)
    assert ents(r) == {
        ("Macro", "N", "object"), ("Macro", "F", "function"), ("Class", "s", "struct"), ("Class", "u", "union"), ("Type", "e", "enum"), ("Type", "word", "typedef"), ("Variable", "count", "definition"),
        ("Function", "proto", "declaration"), ("Function", "main", "definition"), ("Function", "late", "declaration"),
    }
    assert [x["target"] for x in r if x["pend_kind"] == "include"] == ["m.h", "zlib.h"]
    assert [x["target"] for x in r if x["pend_kind"] == "call"] == ["helper"]
    proto = next(x for x in r if x["name"] == "proto")
    assert proto["parameters"] == ["int a", "char *b"] and proto["return_type"] == "int" and proto["line_start"] == 13


def test_kconfig():
    r = rows("x/Kconfig", "kconfig-decl", KCONFIG)
    assert ents(r) == {("KconfigOption", "ALPHA", "declared"), ("KconfigOption", "GAMMA", "declared"), ("KconfigOption", "BETA_X", "stub"), ("KconfigOption", "DEF_Y", "stub")}
    assert {(x["predicate"], x["object"]) for x in r if x["predicate"] in ("DEPENDS_ON", "SELECTS")} == {("DEPENDS_ON", "KconfigOption|BETA_X"), ("SELECTS", "KconfigOption|DEF_Y")}
    assert next(x for x in r if x["name"] == "ALPHA")["description"] == "Some help\non two lines."


def test_fragment():
    r = rows("x/prj.conf", "kconfig-fragment", "CONFIG_A=y\n# CONFIG_B is not set\n# note\nCONFIG_S=\"a b\"\n")
    assert [(x["object"], x["metadata"]) for x in r if x["predicate"] == "SETS"] == [("KconfigOption|A", '{"value": "y"}'), ("KconfigOption|B", '{"value": "n"}'), ("KconfigOption|S", '{"value": "\\"a b\\""}')]


def test_devicetree():
    r = rows("b/x.dts", "devicetree", DTS)
    assert {(x["name"], x["kind"]) for x in r if x["rec"] == "entity"} == {("/", "node"), ("uart0", "node"), ("child", "node"), ("uart0", "node-override")}
    assert [x["target"] for x in r if x["pend_kind"] == "compatible"] == ["acme,uart", "acme,generic"]
    assert {(x["target"], x["role"]) for x in r if x["pend_kind"] == "phandle"} == {("clk", "clocks"), ("uart0", "&override")}
    assert len([x for x in r if x["predicate"] == "CHILD_OF"]) == 2


def test_binding():
    assert ents(rows("dts/bindings/u.yaml", "dt-binding-yaml", 'compatible: "a,b"\n')) == {("DTBinding", "a,b", "binding")}
    assert rows("dts/bindings/u.yaml", "dt-binding-yaml", "compatible: [a, b]\n") == []
    assert [x["rec"] for x in rows("dts/bindings/u.yaml", "dt-binding-yaml", "a: [\n")] == ["ambiguity"]


def test_rst():
    r = rows("d/a.rst", "rst", RST)
    assert {("Document", "a.rst", ""), ("Concept", "Title", "heading-0"), ("Concept", "Part", "heading-1")} <= ents(r)
    assert [(x["role"], x["target"]) for x in r if x["pend_kind"] == "docref"] == [("c:func", "do_it"), ("ref", "my-anchor"), ("kconfig:option", "CONFIG_A=y")]
    assert [x["name"] for x in r if x["entity_type"] == "Requirement"] == ["The unit must stay idle.", "It should wait."]
    w = [(x["win_start"], x["win_end"]) for x in r if x["pend_kind"] == "window"]
    assert w == [(11, 12), (11, 12)]


def test_markdown():
    r = rows("d/b.md", "markdown", MD)
    assert {("Concept", "One", "heading-1"), ("Concept", "Three", "heading-3")} <= ents(r)
    assert [x["target"] for x in r if x["pend_kind"] == "docref"] == ["known_symbol"]
    assert [x["name"] for x in r if x["entity_type"] == "Requirement"] == ["You must not stop it."]


def test_operator_skips_what_it_cannot_read(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 1\n", "!"), ("a.bin", "other", None, "!"), ("b.py", "python", None, "!"), ("c.txt", "other", "text", "!"), (None, None, None, "!")], "source_file string, language string, content string, rec string")
    got = dispatch.extract(files)
    assert [c.split()[0] for c in SHAPE.split(", ")] == got.columns
    assert {r.source_file for r in got.collect()} == {"a.py"}
    assert dispatch.extract(files.limit(0)).count() == 0


def test_failing_extractor_becomes_an_ambiguity():
    def bad(path, text):
        raise RuntimeError

    dispatch.register_extractor("odd", bad)
    try:
        assert rows("z.odd", "odd", "")[0]["rec"] == "ambiguity"
    finally:
        dispatch.EXTRACTORS.pop("odd")
