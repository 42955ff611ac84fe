"""Technical facts of sources, against a list made by hand."""

import json
import random

from cairn.sources.typescript import SCHEMA, parsed, read_source

TEXT = r"""
@Module({ imports: [A, core.B, C.forRoot(), ...D], 'providers': [S, { provide: X, useValue: f(1) }], exports: OTHER, controllers: [], other: [Q] })
@core.Injectable
export class W<T> extends mixin(Base) {
  @Prop('a\n', 2, true, null, -1, x, `t`) name: string = init(1);
  @Input() set value(v: number) { this.v = v; }
  constructor(@Inject('TOKEN') @Optional() private readonly a: any, @Inject(cfg.KEY) b: ns.Cfg, c: string, d?: Repo<Map<K, V>>, e: typeof conf.x = make(1, 2), f: A[], @Inject(forwardRef(() => Z)) g: Z, @Inject() h?: H | null) { super(a); }
  @web.Get('/x') async run(@Param('id') id: string, { z }: P): Promise<void> {
    this.d?.load(id, 1); list[0](id); make<A, B>(id,); super.run?.(id); a().b().c(1);
    new Foo(x).bar(); new Foo<A>(y); if (q) (z)(1); (() => 1)(); f!(2);
    const o = { m(x) { return g(x); }, n(x): T { return h(x); }, k: p ? r(x) : s(y) };
    await import('./x'); of(1); for (const u of (v)) w(u); x as (A | B);
    list.map((i: number): number => t(`${u1(i)} and ${`${u2('}')}`}`));
    this.#p(1); /x/.test(y); tag`a`(1); arr.filter(<T>(a) => b(a)); delete(x); m.delete(x);
    f1(new Map<string, number>(), 2); a < b, c > (d);
  }
  [Symbol.iterator]() { return 1; }
}
function plain(x: number, @Dec() y): void {}
interface I { go(x: number): void; stop(x) }
const K = @Dec class { constructor(z: Zed) {} };
!function () { q1(); }();
"""
#: Callee, the text of the call and how many arguments it has.
CALLS = [
    ("mixin", "mixin(Base)", 1), ("init", "init(1)", 1), ("make", "make(1, 2)", 2), ("super", "super(a)", 1), ("this.d.load", "this.d?.load(id, 1)", 2), (None, "list[0](id)", 1), ("make", "make<A, B>(id,)", 1), ("super.run", "super.run?.(id)", 1),
    (None, "a().b().c(1)", 1), (None, "a().b()", 0), ("a", "a()", 0), (None, "new Foo(x).bar()", 0), (None, "(z)(1)", 1), (None, "(() => 1)()", 0), (None, "f!(2)", 1), ("g", "g(x)", 1), ("h", "h(x)", 1), ("r", "r(x)", 1), ("s", "s(y)", 1),
    (None, "import('./x')", 1), ("of", "of(1)", 1), ("w", "w(u)", 1), ("list.map", "list.map((i: number): number => t(`${u1(i)} and ${`${u2('}')}`}`))", 1), ("t", "t(`${u1(i)} and ${`${u2('}')}`}`)", 1), ("u1", "u1(i)", 1), ("u2", "u2('}')", 1),
    ("this.#p", "this.#p(1)", 1), (None, "/x/.test(y)", 1), (None, "tag`a`(1)", 1), ("arr.filter", "arr.filter(<T>(a) => b(a))", 1), ("b", "b(a)", 1), ("m.delete", "m.delete(x)", 1), ("f1", "f1(new Map<string, number>(), 2)", 2), (None, "function () { q1(); }()", 0), ("q1", "q1()", 0),
]
#: Name, kind and name of the target, and literal arguments.
DECORATORS = [
    ("Module", "class", "W", []), ("core.Injectable", "class", "W", []), ("Prop", "property", "name", ["a\n", 2, True, None, "t"]), ("Input", "declaration", None, []), ("Inject", "parameter", "a", ["TOKEN"]), ("Optional", "parameter", "a", []), ("Inject", "parameter", "b", []),
    ("Inject", "parameter", "g", []), ("Inject", "parameter", "h", []), ("web.Get", "method", "run", ["/x"]), ("Param", "parameter", "id", ["id"]), ("Dec", "parameter", "y", []), ("Dec", "declaration", None, []),
]
#: Parameter, token, type and whether it is optional.
INJECTIONS = [("a", "TOKEN", None, True), ("b", "cfg.KEY", "ns.Cfg", False), ("d", None, "Repo", False), ("e", None, "conf.x", False), ("g", None, "Z", False), ("z", None, "Zed", False)]


def facts(kind, text=TEXT):
    return [f for f in read_source(text, True).technical if f["fact"] == kind]


def test_call_sites_are_all_calls_outside_of_decorators():
    got = facts("call")
    assert [(f["name"], TEXT[f["offset"] : f["end_offset"]], f["arguments"]) for f in got] == CALLS
    by = {TEXT[f["offset"] : f["end_offset"]]: f for f in got}
    assert {x for x, f in by.items() if f["optional"]} == {"super.run?.(id)"}
    assert [(by[x]["receiver"], by[x]["member"]) for x in ("this.d?.load(id, 1)", "a().b()", "list[0](id)", "super(a)", "g(x)", "/x/.test(y)")] == [("this.d", "load"), (None, "b"), (None, None), (None, None), (None, "g"), (None, "test")]
    assert by["list[0](id)"]["container"] == "W.run" and by["super(a)"]["container"] == "W.constructor" and by["q1()"]["container"] is None
    computed = [(f["offset"], f["end_offset"], f["name"]) for f in facts("diagnostic")]
    assert computed == [(f["offset"], f["end_offset"], "unsupported_computed_call_target") for f in got if f["name"] is None]


def test_decorators_tell_their_target_and_what_a_module_holds():
    got = facts("decorator")
    assert [(f["name"], f["target_kind"], f["target_name"], json.loads(f["literals"])) for f in got] == DECORATORS
    assert [f["module_metadata"] and json.loads(f["module_metadata"]) for f in got] == [{"imports": ["A", "core.B"], "providers": ["S"], "controllers": []}] + [None] * (len(DECORATORS) - 1)
    odd = ["@Module()", "@Module(x)", "@Module", "@Module({ a: [B] })", "@Module({ imports: x })", "@Module({ imports: [A].concat(b) })", "@NotModule({ imports: [A] })", "@Module([A])"]
    assert {f["module_metadata"] for o in odd for f in facts("decorator", o + " class A {}")} == {None}
    assert [f["module_metadata"] for f in facts("decorator", "@n.Module({ imports: [A], 'imports': [B.C, f(), 'x', this.d] }, 1) class A {}")] == ['{"imports":["B.C","this.d"]}']


def test_injections_are_by_token_or_type():
    got = facts("injection")
    assert [(f["name"], f["token"], f["type_name"], f["optional"]) for f in got] == INJECTIONS and all(f["target_name"] == (f["token"] or f["type_name"]) for f in got)
    assert TEXT[got[0]["offset"] : got[0]["end_offset"]] == "@Inject('TOKEN') @Optional() private readonly a: any"
    of = lambda own: [(f["name"], f["target_name"]) for f in facts("injection", f"class A {{ constructor({own}) {{}} }}")]
    assert of("@Inject(7) a, @Inject('') b: B, @Inject(true) c: C, @n.Inject(k) d, ...e: E, f: () => F, g: import('x').G, h: readonly H[], i: this, { j }: J") == [("a", "7"), ("c", "C"), ("d", "k"), ("e", "E"), ("{ j }", "J")]
    assert facts("injection", "interface A { constructor(a: B): C }") == [] and facts("injection", "const a = { constructor(a: B) {} }") == []


def test_offsets_are_code_units(spark):
    text = "const \U0001f600a = 'é'; f(x);".replace("\U0001f600a", "a") + "/* \U0001f600 */ g('\U0001f600');"
    got = facts("call", text)
    units = text.encode("utf-16-le")
    assert [units[2 * f["offset"] : 2 * f["end_offset"]].decode("utf-16-le") for f in got] == ["f(x)", "g('\U0001f600')"]
    files = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    rows = {r["id"]: [f["name"] for f in r["technical"]] for r in parsed(files, only=["technical"]).collect()}
    assert rows == {1: ["f", "g"], 2: [], 3: []} and "technical array" in SCHEMA


def test_broken_sources_give_facts_with_ranges():
    rng = random.Random(4)
    soup = ["(", ")", "{", "}", "[", "]", "<", ">", "@", "!", "?.", ".", ",", ";", ":", "=", "=>", "class", "constructor", "function", "async", "new", "if", "super", "`${", "`", "'", "\n", " ", "a", "1", "get", "\U0001f600"]
    for k in range(400):
        text = list(TEXT[rng.randrange(len(TEXT)) :] if k % 2 else TEXT[: rng.randrange(len(TEXT))])
        for _ in range(8):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(3)] = rng.choice(soup)
        assert all(0 <= f["offset"] <= f["end_offset"] for f in read_source("".join(text), True).technical)
