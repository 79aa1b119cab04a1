import pytest

from lodeworks.sources import braces, syntax


def shape(lang, text):
    p = braces.parse(lang, text)
    names = [d.qualified for d in p.definitions]
    spans = {d.qualified: (d.start, d.end) for d in p.definitions}
    return spans, {(c, names[by] if by >= 0 else None) for c, _, by in p.calls}


def test_script_traps():
    spans, calls = shape(
        "javascript",
        "export default class Foo extends Bar {\n"
        "  static async *gen(a, b = call(2)) {\n"
        "    const t = `a } ${inner({x: 1})} {`;\n"
        "    return /[{]/.test(t) ? '}' : \"{\";\n"
        "  }\n"
        "  constructor() { super(); if (a) { b() } }\n"
        "  handler = () => {\n    deep()\n  }\n"
        "}\n"
        "async function top(a, { b, c }) {\n"
        "  items.forEach(function (it) { use(it) })\n"
        "  return { method(x) { return mm(x) } }\n"
        "}\n",
    )
    assert spans == {"Foo": (1, 10), "Foo.gen": (2, 5), "Foo.constructor": (6, 6), "top": (11, 14), "top.method": (13, 13)}
    assert calls == {("call", "Foo.gen"), ("inner", "Foo.gen"), ("test", "Foo.gen"), ("b", "Foo.constructor"), ("deep", "Foo"), ("forEach", "top"), ("use", "top"), ("mm", "top.method")}


def test_types_in_braces():
    spans, calls = shape(
        "typescript",
        "export abstract class A<T extends {a: number}> implements I {\n"
        "  abstract run(a: string): void;\n"
        "  public async load(id: string): Promise<{ok: boolean}> {\n"
        "    return await this.http.get<User>(`/u/${id}`);\n"
        "  }\n"
        "}\n"
        "interface I { run(a: string): void }\n"
        "namespace N.M { export function inner(): void { f?.() } }\n",
    )
    assert spans == {"A": (1, 6), "A.run": (2, 2), "A.load": (3, 5), "I": (7, 7), "N.M": (8, 8), "N.M.inner": (8, 8)}
    assert calls == {("get", "A.load"), ("f", "N.M.inner")}


def test_lifetimes_macros_and_raw_strings():
    spans, calls = shape(
        "rust",
        "#[derive(Debug)]\npub struct P<'a> { name: &'a str }\nstruct U(u8);\n"
        "impl<'a> fmt::Display for P<'a> {\n"
        "    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result {\n"
        "        let c = '{'; let s = r#\"raw \" } \"#; /* } /* } */ */\n"
        "        write!(f, \"{}\", helper::<u8>(c))\n    }\n}\n"
        "trait T { fn sig(&self); fn dflt(&self) { Foo::new(1) } }\n",
    )
    assert spans == {"P": (2, 2), "U": (3, 3), "Display": (4, 9), "Display.fmt": (5, 8), "T": (10, 10), "T.dflt": (10, 10)}
    assert calls == {("write", "Display.fmt"), ("helper", "Display.fmt"), ("new", "T.dflt")}


def test_classes_of_java_and_csharp():
    spans, calls = shape(
        "java",
        "@Service(\"x\")\npublic class Foo<T> extends Bar {\n  @Override\n  public List<String> get(int a) throws IOException {\n"
        "    Runnable r = new Runnable() { public void run() { inner(); } };\n    return compute(a).map(x -> { return f(x); });\n  }\n"
        "  Foo(int a) { super(a); }\n  abstract void none();\n  enum K { A(1), B(2); K(int x) { } }\n}\n",
    )
    assert spans == {"Foo": (2, 11), "Foo.get": (4, 7), "Foo.get.run": (5, 5), "Foo.Foo": (8, 8), "Foo.none": (9, 9), "Foo.K": (10, 10), "Foo.K.K": (10, 10)}
    assert calls == {("Runnable", "Foo.get"), ("inner", "Foo.get.run"), ("compute", "Foo.get"), ("map", "Foo.get"), ("f", "Foo.get")}
    spans, calls = shape(
        "csharp",
        "namespace My.App {\n  public class Foo : Bar {\n    public int X { get; set; }\n    public string Name => Make(\"}\");\n"
        "    [HttpGet(\"a\")]\n    public async Task<int> Run(int a) {\n      var s = $@\"verb \"\"{a}\"\" {{\";\n      var o = new Thing { A = 1 };\n"
        "      void Local(int q) { w(q); }\n      return await Go(o);\n    }\n    public int Sum(int a) => Add(a, 1);\n    public Foo(int x) : base(x) { }\n  }\n}\n",
    )
    assert spans == {"My.App": (1, 15), "My.App.Foo": (2, 14), "My.App.Foo.Run": (6, 11), "My.App.Foo.Sum": (12, 12), "My.App.Foo.Foo": (13, 13)}
    assert calls == {("Make", "My.App.Foo"), ("Thing", "My.App.Foo.Run"), ("w", "My.App.Foo.Run"), ("Go", "My.App.Foo.Run"), ("Add", "My.App.Foo.Sum")}


def test_cpp_and_go():
    spans, calls = shape(
        "cpp",
        "#define MACRO(x) { x\nnamespace n {\ntemplate <typename T>\nclass Foo : public Bar {\n public:\n  Foo(int a) : a_(a), b_(make(a)) { init(); }\n  ~Foo() = default;\n"
        "  void decl(int x);\n  int inl() const noexcept { return 1'000 + call('{'); }\n  std::vector<int> v_{1, 2};\n};\n"
        "std::string Foo::name(const std::string& s) {\n  Foo bar(1);\n  const char* r = R\"(raw { )\";\n  return std::move(s);\n}\nstatic struct P* mk(void) { return new P(); }\n}\n",
    )
    assert spans == {"n": (2, 18), "n.Foo": (4, 11), "n.Foo.Foo": (6, 6), "n.Foo.~Foo": (7, 7), "n.Foo.inl": (9, 9), "n.name": (12, 16), "n.mk": (17, 17)}
    assert calls == {("make", "n.Foo.Foo"), ("init", "n.Foo.Foo"), ("call", "n.Foo.inl"), ("move", "n.name")}
    found = braces.parse("go", "type Foo struct {\n\ta int\n}\ntype I interface { M(a int) error }\nfunc (f *Foo) Run(fn func(int) error) (map[string]struct{}, error) {\n\tgo func() { work(x) }()\n\tfor _, v := range list() {\n\t\tif err := fn(v); err != nil { return nil, fmt.Errorf(\"{ %v\", err) }\n\t}\n\ts := `raw { `\n\treturn nil, nil\n}\nfunc Next() {}\n")
    assert [(d.qualified, d.kind, d.start, d.end, d.graph) for d in found.definitions] == [
        ("Foo", "container", 1, 3, False), ("I", "container", 4, 4, False), ("Run", "callable", 5, 12, True), ("Next", "callable", 13, 13, True),
    ]
    assert {c for c, *_ in found.calls} == {"work", "list", "fn", "Errorf"}


@pytest.mark.parametrize("lang", sorted(braces.BRACED))
def test_anything_is_read_to_its_end(lang):
    for text in ("", "}}})))", "{{{(((", "'\"`", "class", "class {", "x = `${`${", "/*", "#[", "R\"(", "fn f(", "@\"", "\"\"\"", "a<b>(c)", "}\n" * 2000, "(" * 3000):
        braces.parse(lang, text)
        syntax.extract(lang, text)


def test_innermost_definition():
    make = lambda a, z: braces.Definition(f"{a}-{z}", "callable", a, z, a, None, False)
    found = [make(2, 20), make(4, 10), make(5, 6), make(8, 9), make(8, 9), make(30, 30)]
    want = []
    for n in range(1, 33):
        around = [(d.end - d.start, i) for i, d in enumerate(found) if d.start <= n <= d.end]
        want.append(min(around)[1] if around else -1)
    assert syntax.innermost(found, list(range(1, 33))) == want
