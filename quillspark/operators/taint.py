"""Detectors that follow data from sources to sinks.

A file is lexed by its language, so that comments and strings are no code; names inside interpolated strings count.
Its statements belong to functions (by indentation, or by braces).  Inside a function, a variable is tainted if
some assignment to it reads a source or a tainted variable, outside of calls that make values safe; assignments are
gone over until nothing changes.  A finding is a sink that is given something tainted: for queries their first
argument, so that bound parameters are no finding; or a literal stored under a name of a credential.

Files are independent rows, dealt evenly over the tasks first, as many small files lie in one row group of a table; work is
linear in a file's length for each round of its assignments.

Defined cases: null and empty contents have no findings; unclosed strings end with their line, unclosed comments and
brackets with the file; files of other languages have no findings; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH, SLASHES = r"\#[^\n]*", r"//[^\n]*|/\*.*?(?:\*/|\Z)"
COMMENTS = {"python": HASH, "ruby": HASH, "php": f"{HASH}|{SLASHES}", "javascript": SLASHES, "typescript": SLASHES, "go": SLASHES, "java": SLASHES}
BY_INDENT = ("python", "ruby")
NAME = r"[A-Za-z_$][\w$]*(?:[ \t]*(?:\.|->|::)[ \t]*[A-Za-z_$][\w$]*)*"
STRING = r"""[fFrRbBuU]{0,2}(?:\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|`(?:\\.|[^`\\])*`?"""
LEXERS = {
    k: re.compile(rf"(?P<comment>{c})|(?P<string>{STRING})|(?P<name>{NAME})|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<space>[ \t\r\f\v]+|\\\n)|(?P<op>:=|[-+*/%.|&]=|===?|!==?|<=|>=|=>|.)", re.DOTALL)
    for k, c in COMMENTS.items()
}
INSIDE = re.compile(r"\$\{([^{}]*)\}|#\{([^{}]*)\}|\{([^{}]*)\}|(\$[A-Za-z_]\w*)")
SOURCE = re.compile(r"(?:flask\.)?(?:request|req|params|sys\.argv|argv|os\.environ|input|\$_(?:GET|POST|REQUEST|COOKIE)|location|window\.location|document\.(?:cookie|URL|location)|r\.(?:URL|Form|FormValue|Header)|process\.(?:argv|env))(?:\.|$)")
SAFE = re.compile(r"(?:.*\.)?(?:int|float|bool|len|escape|quote|quote_plus|parseInt|parseFloat|Number|encodeURIComponent|htmlspecialchars|Atoi|sanitize|is_allowed)$")
# kind, severity, name of the call, whether only its first argument counts
CALLS = (
    ("sqli", "critical", re.compile(r".*(?:\.|->)(?:execute|executemany|query|raw|rawQuery|exec|QueryRow|Query)$|mysqli_query$"), True),
    ("xss", "high", re.compile(r"document\.write(?:ln)?$|(?:.*\.)?(?:render_template_string|mark_safe|Markup|insertAdjacentHTML|dangerouslySetInnerHTML)$|echo$"), False),
    ("ssrf", "medium", re.compile(r"(?:requests|httpx|axios|http|urllib\.request|session)\.(?:get|post|put|delete|request|urlopen|Get|Post)$|(?:fetch|urlopen|file_get_contents|axios)$"), False),
)
STORED = ("xss", "high", re.compile(r".*\.(?:innerHTML|outerHTML|srcdoc)$"))
CREDENTIAL = ("auth", "high", re.compile(r"(?:.*[._])?(?:password|passwd|secret|token|api_?key)$", re.IGNORECASE))
LEAST_SECRET = 4
ORDER = {"sqli": 0, "xss": 1, "ssrf": 2, "auth": 3}


@dataclass(slots=True)
class Token:
    kind: str  # name, string, number, op
    text: str
    at: int


@dataclass
class Scope:
    statements: list = field(default_factory=list)


def tokens(code: str, language: str) -> list[Token]:
    """Code without comments and white space; line ends are tokens of kind 'line'."""
    out = []
    for m in LEXERS[language].finditer(code):
        kind = m.lastgroup
        if kind not in ("comment", "space"):
            out.append(Token(kind, m[0].replace(" ", "").replace("\t", "") if kind == "name" else m[0], m.start()))
    return out


def scopes(code: str, language: str) -> list[Scope]:
    """The functions of a file, and first what stands outside of them; a statement is a list of tokens."""
    indented = language in BY_INDENT
    out = [Scope()]
    stack = [(out[0], -1)]  # scope, and the indent or depth where it began
    now: list[Token] = []
    depth = braces = 0
    opens = False  # a function's head was seen, its brace not yet

    def end() -> None:
        nonlocal now
        if now:
            if indented:
                column = now[0].at - (code.rfind("\n", 0, now[0].at) + 1)
                while len(stack) > 1 and column <= stack[-1][1]:
                    stack.pop()
                if now[0].text in ("def", "async"):
                    out.append(Scope())
                    stack.append((out[-1], column))
            stack[-1][0].statements.append(now)
        now = []

    for t in tokens(code, language):
        if t.kind == "line" or t.text == ";":
            if depth == 0:
                end()
            continue
        if t.text in "([" or (indented and t.text == "{"):
            depth += 1
        elif t.text in ")]" or (indented and t.text == "}"):
            depth = max(0, depth - 1)
        elif t.text in ("function", "func", "=>"):
            opens = True
        elif t.text == "{":
            end()
            braces += 1
            if opens:
                out.append(Scope())
                stack.append((out[-1], braces))
                opens, depth = False, 0
            continue
        elif t.text == "}":
            end()
            if len(stack) > 1 and stack[-1][1] == braces:
                stack.pop()
            braces = max(0, braces - 1)
            continue
        now.append(t)
    end()
    return out


def _closing(statement: list[Token], at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(statement)):
        depth += (statement[i].text in "([{") - (statement[i].text in ")]}") if statement[i].kind == "op" else 0
        if depth == 0:
            return i + 1
    return len(statement)


def tainted_part(expression: list[Token], known: set[str]) -> str | None:
    """The first source or tainted variable that an expression reads, outside of calls that make it safe."""
    i = 0
    while i < len(expression):
        t = expression[i]
        names = [t.text] if t.kind == "name" else []
        if t.kind == "string" and (t.text[0] in "fF`" or "$" in t.text or "#{" in t.text):
            names = [n for m in INSIDE.finditer(t.text) for n in re.findall(NAME, next(g for g in m.groups() if g is not None)) if t.text[0] in "fF" or m[3] is None]
        if t.kind == "name" and i + 1 < len(expression) and expression[i + 1].text == "(" and SAFE.match(t.text):
            i = _closing(expression, i + 1)
            continue
        for n in names:
            if SOURCE.match(n) or re.split(r"\.|->|::", n)[0] in known:
                return n
        i += 1
    return None


def assignments(statement: list[Token]) -> tuple[list[str], list[Token]] | None:
    """(assigned names, right side) of a statement that assigns."""
    depth = 0
    for i, t in enumerate(statement):
        if t.kind == "op":
            depth += (t.text in "([{") - (t.text in ")]}")
            if depth == 0 and (t.text in ("=", ":=") or (len(t.text) == 2 and t.text[1] == "=" and t.text[0] in "+-*/%.|&")):
                return [x.text for x in statement[:i] if x.kind == "name" and x.text not in ("var", "let", "const", "auto")], statement[i + 1 :]
    return None


def variables(scope: Scope) -> set[str]:
    """Tainted variables: the least set that is closed under the scope's assignments."""
    known: set[str] = set()
    pending = [a for s in scope.statements if (a := assignments(s))]
    while True:
        left = []
        for names, right in pending:
            if tainted_part(right, known) is None:
                left.append((names, right))
            else:
                known |= {re.split(r"\.|->|::", n)[0] for n in names[-1:] if "." not in n} | {n for n in names[:-1] if "." not in n}
        if len(left) == len(pending):
            return known
        pending = left


def _calls(statement: list[Token]):
    """(name token, arguments) of every call in a statement."""
    for i, t in enumerate(statement):
        if t.kind != "name" or i + 1 >= len(statement) or not (statement[i + 1].text == "(" or t.text == "echo"):
            continue
        inner = statement[i + 2 : _closing(statement, i + 1) - 1] if statement[i + 1].text == "(" else statement[i + 1 :]
        args, depth = [[]], 0
        for x in inner:
            depth += (x.text in "([{") - (x.text in ")]}") if x.kind == "op" else 0
            if depth == 0 and x.text == ",":
                args.append([])
            else:
                args[-1].append(x)
        yield t, args


def findings(code: str, language: str) -> list[tuple[str, str, int, int, str, str]]:
    """(kind, severity, line, column, sink, source) in the order of places, then kinds; lines and columns from 1."""
    if not code or language not in COMMENTS:
        return []
    out = set()

    def found(kind, level, token, sink, source):
        begin = code.rfind("\n", 0, token.at) + 1
        out.add((code.count("\n", 0, token.at) + 1, token.at - begin + 1, ORDER[kind], kind, level, sink, source))

    for scope in scopes(code, language):
        known = variables(scope)
        for s in scope.statements:
            for t, args in _calls(s):
                for kind, level, name, first in CALLS:
                    if name.match(t.text):
                        for a in args[:1] if first else args:
                            if (source := tainted_part(a, known)) is not None:
                                found(kind, level, t, t.text, source)
                                break
            if (a := assignments(s)) and a[0]:
                token = next(x for x in reversed(s) if x.kind == "name" and x.text == a[0][-1])
                if STORED[2].match(a[0][-1]) and (source := tainted_part(a[1], known)) is not None:
                    found(*STORED[:2], token, a[0][-1], source)
                value = a[1]
                literal = len(value) == 1 and value[0].kind == "string" and value[0].text[0] not in "fF" and "${" not in value[0].text
                if literal and CREDENTIAL[2].match(a[0][-1]) and len(value[0].text.strip("fFrRbBuU").strip("\"'`")) >= LEAST_SECRET:
                    found(*CREDENTIAL[:2], token, a[0][-1], "literal")
    return [(kind, level, line, column, sink, source) for line, column, _, kind, level, sink, source in sorted(out)]


def scan(files: DataFrame, path_col: str = "path", content_col: str = "content", language_col: str = "language") -> DataFrame:
    """(file, vuln_type, severity, line, column, sink, source) of source files with their language."""

    def run(batches):
        for b in batches:
            rows = [(p, *f) for p, c, k in zip(*(x.to_pylist() for x in b.columns), strict=True) for f in findings(c, k)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "vuln_type", "severity", "line", "column", "sink", "source"])

    picked = files.select(*[F.col(c).cast("string") for c in (path_col, content_col, language_col)])
    picked = picked.where(F.col(language_col).isin(*COMMENTS) & (F.length(content_col) > 0))  # others have no findings
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return picked.repartition(spread).mapInArrow(run, "file string, vuln_type string, severity string, line long, column long, sink string, source string")
