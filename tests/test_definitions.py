"""Definitions by lexer: pieces of code whose spans are known, put together in any order."""

import random
import time

import pytest

from tessera.operators.definitions import top_level_spans

# (code, whether it is a definition); brackets and quotes stand where a count of braces would go wrong.
JS = [
    ('function greet(name) {\n    return "Hello, }" + name;\n}', True), ("export default class A\n  extends B {\n  f() { return `a ${ {x: `}`}.x } {`; }\n}", True), ("const re = /[/{]\\/{/g;", True),
    ("const f = (a, b = {}) => {\n  // it's {\n  return a\n}", True), ("let x =\n  call(1,\n    2)\n  .then(y => {\n  })", True), ("async function g({a, b})\n{\n}", True), ("import { a } from './a'", False),
    ("/* function no() {\n} */", False), ("x.y = function () {\n  class Inner {}\n}", False), ("if (a / 2 > b / 3) {\n  const inner = '{'\n}", False),
]
TS = [("interface P {\n  a: string;\n}", True), ("type U =\n  | { a: 1 }\n  | { b: 2 }", True), ("@Dec({ a: '}' })\nexport class Q {\n  x?: number\n}", True), ("const enum_ = <T,>(x: T): T => x", True), ("declare module 'x' {\n  class Y {}\n}", False)]
GO = [
    ("func Add(a, b int) int {\n\treturn a + b // }\n}", True), ("type (\n\tA int\n\tB struct {\n\t\tx int\n\t}\n)", True), ("func (p *P) M() string {\n\treturn `}\n{` + \"{\" + string('{')\n}", True),
    ('import (\n\t"fmt"\n)', False), ("var x = map[string]int{\n\t\"a\": 1,\n}", False), ("type T struct{}", True),
]
RS = [
    ("struct P {\n    x: f64,\n}", True), ("impl<'a> P<'a> {\n    fn f(&'a self) -> char { '{' }\n    const S: &str = r#\"}\"{\"#;\n}", True), ("pub(crate) async fn g<T>(x: T) -> u8\nwhere\n    T: Copy,\n{\n    b'}'\n}", True),
    ("struct U(i32);", True), ("pub trait T { fn f(&self); }", True), ("mod m;", True), ("use a::{b, c};", False), ("const N: [u8; 2] = [0; 2];", False), ("macro_rules! m {\n    () => { fn no() {} }\n}", False), ("/// has } in it", False), ('unsafe extern "C" fn h() {\n}', True),
]
JAVA = [("@A(\"}\")\npublic final class B<T> extends C {\n  String s = \"\"\"\n  }}}\n  \"\"\";\n}", True), ("enum E { A, B; int f() { return 1; } }", True), ("import a.b.C;", False), ("interface I\n{\n}", True), ("package a;", False)]
C = [
    ("static int f(struct a *x, int (*g)(int))\n{\n    char c = '}';\n    return 1;\n}", True), ("struct s {\n    int x;\n};", True), ("int g(void);", False), ("#define M(x) \\\n    { x }", False), ("int a[] = { 1, 2 };", False),
    ("typedef struct {\n    int y;\n} t;", False), ("enum e { A };", True), ("/* } */ int h(void) { return 0; }", True),
]
CPP = [("namespace n {\nclass X {};\n}", True), ("template <class T>\nT max_(T a, T b) {\n    return a;\n}", True), ("bool A::operator==(const A& b) const {\n    return R\"x(}\")x\"[0] == 1'000;\n}", True), ("class D : public B {\n};", True), ("using namespace std;", False)]
KT = [("data class P(val x: Int)", True), ("fun f(x: Int) =\n    x + 1", True), ("object O {\n    val s = \"{\"\n}", True), ("val y: Int? = null", False), ("private suspend fun <T> g(): T? {\n    return null\n}", True)]
PHP = [("function f($x) {\n    # {\n    return '}';\n}", True), ("abstract class A extends B {\n}", True), ("#[Attr({})]\nfinal class C {\n}", True), ("$x = function () {\n    return 1;\n};", False), ("namespace A\\B;", False)]


@pytest.mark.parametrize("lang,pieces", [("js", JS), ("mjs", JS), ("ts", JS + TS), ("tsx", TS), ("go", GO), ("rs", RS), ("java", JAVA), ("c", C), ("cpp", CPP), ("kt", KT), ("php", PHP)])
def test_pieces_in_any_order(lang, pieces):
    r = random.Random(4)
    for _ in range(200):
        lines, want = ["<?php"] if lang == "php" else [], []
        for code, is_definition in r.sample(pieces, r.randint(1, len(pieces))):
            if is_definition:
                want.append((len(lines) + 1, len(lines) + 1 + code.count("\n")))
            lines += code.split("\n") + [""] * r.randint(0, 2)
        end = r.choice(["\n", "\r\n"])
        assert (top_level_spans(end.join(lines) + r.choice(["", end]), lang) or []) == want, "\n".join(lines)


def test_rust_attributes_stand_before_the_definition():
    assert top_level_spans("#![allow(x)]\n#[derive(Debug)]\nstruct A {\n}\n", "rs") == [(3, 4)]


@pytest.mark.parametrize("lang", ["js", "ts", "go", "rs", "java", "c", "cpp", "cs", "kt", "php", "rb", "sh", "lua", "py", "swift", "scala"])
def test_anything_ends(lang):
    r = random.Random(5)
    for _ in range(150):
        text = "".join(r.choice(["{", "}", "(", ")", "[", "]", '"', "'", "`", "${", "/", "*", "\\", "\n", "#", "fn ", "class A ", "function f", "\x00", "é", "=", ";"]) for _ in range(r.randint(0, 80)))
        n = len(text.splitlines())
        assert all(1 <= a <= b <= n for a, b in top_level_spans(text, lang) or [])
    assert top_level_spans("", lang) is None and top_level_spans("x\n", "txt") is None


def test_end_words_and_shell():
    assert top_level_spans("class A\n  def f\n  end\nend\n\ndef g; end\nx = 1\n", "rb") == [(1, 4), (6, 6)]
    assert top_level_spans("set -e\nf() {\n  case x in a) ;; esac\n}\n", "sh") == [(2, 4)]
    assert top_level_spans("local function f(x)\n  return x\nend\n", "lua") == [(1, 3)]


@pytest.mark.parametrize("text", ["x" * 400_000, "{" * 200_000, "(" * 200_000 + "]" * 200_000, "`${" * 100_000 + ")" * 100_000, "/*" * 200_000, "'" * 200_000, "`" * 200_001, "a = 1;\n" * 60_000, "@a " * 100_000, "@a\n" * 50_000, '"\\' * 150_000])
def test_long_sources_take_linear_time(text):
    for lang in ("js", "rs", "cpp"):
        began = time.perf_counter()
        top_level_spans(text, lang)
        assert time.perf_counter() - began < 6
