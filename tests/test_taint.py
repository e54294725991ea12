"""Source-to-sink detectors against cases and, for Python files, against the syntax tree."""

import ast
import random

import pytest

from quillspark.operators import taint

CASES = {
    "python": [
        ("q = request.args.get('q')\ndb.execute('select ' + q)\n", [("sqli", 2, "q")]),
        ("q = request.args.get('q')\ndb.execute('select ?', (q,))\n", []),
        ("# db.execute(request.args)\nx = 'db.execute(request.args)'\n\"\"\"\ndb.execute(input())\n\"\"\"\n", []),
        ("def f():\n    a = input()\n    b = a.strip()\n    c = f'x {b}'\n    db.execute(c)\ndef g():\n    db.execute(c)\n", [("sqli", 5, "c")]),
        ("def f():\n    c = b\n    b = a\n    a = sys.argv\n    requests.get(url=c)\n", [("ssrf", 5, "c")]),
        ("n = int(request.args['n'])\ndb.execute('x' + n)\nurlopen(quote(input()))\n", []),
        ("password = 'hunter2'\nTOKEN = \"\"\nself.api_key = os.environ['K']\ndb.secret = 'abcd'\n", [("auth", 1, "literal"), ("auth", 4, "literal")]),
        ("db.execute(\n    'a'\n    + input()\n)\n", [("sqli", 1, "input")]),
    ],
    "javascript": [
        ("function f(){ const x = req.query.q; el.innerHTML = x; }\nfunction g(){ el.innerHTML = x; }", [("xss", 1, "x")]),
        ("// el.innerHTML = location\n/* fetch(location) */ const s = `fetch(${1})`; fetch('/a')", []),
        ("const g = (a) => { let u = `http://${location.host}`; fetch(u) }; fetch(u)", [("ssrf", 1, "u")]),
        ("let t = parseInt(req.query.n); db.query('a' + t); document.write(encodeURIComponent(location.hash))", []),
        ("const apiKey = 'abcdef123'; let y = \"unclosed\nfetch(location)", [("auth", 1, "literal"), ("ssrf", 2, "location")]),
    ],
    "php": [("<?php $q = $_GET['q']; # mysqli_query($c)\n mysqli_query($q, 1); echo $q; echo htmlspecialchars($q);", [("sqli", 2, "$q"), ("xss", 2, "$q")])],
    "go": [("func f() { u := r.URL.Query()\n http.Get(u) }\nfunc g() { http.Get(u) }", [("ssrf", 2, "u")])],
    "text": [("db.execute(input())", [])],
}


@pytest.mark.parametrize(("language", "code", "want"), [(k, c, w) for k, cases in CASES.items() for c, w in cases])
def test_cases(language, code, want):
    assert [(kind, line, source) for kind, _, line, _, _, source in taint.findings(code, language)] == want


# --- the syntax tree ----------------------------------------------------------------------------


def dotted(node):
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := dotted(node.value)):
        return f"{left}.{node.attr}"
    return None


def reads(node, known):
    if isinstance(node, ast.Call) and (n := dotted(node.func)) and taint.SAFE.match(n):
        return False
    n = dotted(node)
    if n is not None:
        return bool(taint.SOURCE.match(n)) or n.split(".")[0] in known
    return any(reads(c, known) for c in ast.iter_child_nodes(node))


def plain(code):
    tree = ast.parse(code)
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
    inner = {x for f in functions for s in f.body for x in ast.walk(s)}
    out = set()
    for nodes in [[x for x in ast.walk(tree) if x not in inner], *[[x for s in f.body for x in ast.walk(s)] for f in functions]]:
        sets = [(n.targets[0] if isinstance(n, ast.Assign) else n.target, n.value, n) for n in nodes if isinstance(n, ast.Assign | ast.AugAssign)]
        known = set()
        for _ in sets:
            known |= {t.id for t, v, _ in sets if isinstance(t, ast.Name) and reads(v, known)}
        for n in nodes:
            if isinstance(n, ast.Call) and (name := dotted(n.func)):
                args = [*n.args, *[k.value for k in n.keywords]]
                for kind, _, rx, first in taint.CALLS:
                    if rx.match(name) and any(reads(a, known) for a in (args[:1] if first else args)):
                        out.add((kind, n.lineno, n.col_offset + 1))
        for t, v, n in sets:
            if taint.CREDENTIAL[2].match(dotted(t) or "") and isinstance(v, ast.Constant) and isinstance(v.value, str) and len(v.value) >= 4:
                out.add(("auth", n.lineno, t.col_offset + 1))
    return out


def program(rng):
    names = ["a", "b", "c", "url", "password"]

    def value():
        pick = rng.choice(["'lit # text'", "input()", "request.args.get('k')", "NAME", "NAME + 'x'", "f'u {NAME}'", "int(NAME)", "NAME.strip()", "g(NAME, 1)", "escape(input())", "[NAME, 2]", "12", "'db.execute(input())'"])
        return pick.replace("NAME", rng.choice(names))

    def line():
        form = rng.choice(["{n} = {v}", "{n} = {v}", "{n} += {v}", "db.execute({v})", "db.execute('q', {v})", "requests.get({v})", "mark_safe({v}, 1)", "# db.execute(input())", "db.execute(\n{i}    {v},\n{i}    1)", "pass  # {n} = input()", "if {n}: cur.query({v})"])
        return form

    out = []
    for k in range(rng.randrange(1, 4)):
        indent = "" if k == 0 else "    "
        if k:
            out.append(f"def f{k}(x):")
        out += [indent + line().format(n=rng.choice(names), v=value(), i=indent) for _ in range(rng.randrange(1, 8))]
        if k:
            out.append("    return 0")
    return "\n".join(out) + "\n"


def test_python_files_equal_the_syntax_tree():
    rng, some = random.Random(7), 0
    for _ in range(1500):
        code = program(rng)
        got = {(kind, line, column) for kind, _, line, column, _, _ in taint.findings(code, "python")}
        assert got == plain(code), code
        some += len(got)
    assert some > 1000


def test_long_files_and_odd_ones():
    code = "x = input()\n" + "y = 1\n" * 100_000 + "db.execute(x)\n"
    assert [(f[0], f[2]) for f in taint.findings(code, "python")] == [("sqli", 100_002)]
    for odd in ("((((", "))))", "}}}}{{", "'", '"""', "/*", "= = =", "def", "f'{", "a = ", "\\"):
        for language in taint.COMMENTS:
            taint.findings(odd, language)


def test_taint_query_equals_file_by_file(spark, sf):
    from quillspark.plans import catalog, inputs

    got = sorted(tuple(r) for r in catalog.taint_scan(spark, sf).collect())
    files = catalog._code(spark, sf).collect()
    want = sorted((r["path"], *f) for r in files for f in taint.findings(r["content"], r["language"]))
    assert got == want and {r[1] for r in got} == {"sqli", "xss", "ssrf", "auth"} and inputs.CODE
    python = {(r["path"], kind, line, col) for r in files if r["language"] == "python" for kind, line, col in plain(r["content"])}
    assert python == {(f, k, line, col) for f, k, _, line, col, _, _ in got if f.endswith(".py")} and python
    assert taint.scan(spark.createDataFrame([("a.py", None, "python")], "path string, content string, language string")).count() == 0


def test_files_are_dealt_over_the_tasks(spark, sf):
    """The table is one file of one row group: neither contents nor findings may be one task's work."""
    from quillspark.plans import catalog

    found = catalog.taint_scan(spark, sf)
    assert found.rdd.getNumPartitions() > 1
    assert catalog._code(spark, sf).rdd.getNumPartitions() > 1
