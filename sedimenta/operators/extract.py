"""From source files to symbols, references, imports, type fields, chunks and skeletons.

Python is parsed by the standard library's ast. The other languages are read by a lexer that blanks strings and comments and
matches braces, with one declaration pattern per kind; that is lexical, not a full parse. A language is a LanguagePack, and more can
be added to PACKS.
"""

from __future__ import annotations

import ast
import bisect
import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_CHUNK, MIN_CHUNK = 8192, 256
EXTENSIONS = {"py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "vue": "vue"}


@dataclass
class Parsed:
    symbols: list[tuple] = field(default_factory=list)  # name, kind, first line, last line, signature
    refs: list[tuple] = field(default_factory=list)  # name, kind, line
    imports: list[tuple] = field(default_factory=list)  # module, item, relative, line
    fields: list[tuple] = field(default_factory=list)  # type, field
    exports: list[tuple] = field(default_factory=list)  # name, kind, line
    decorators: list[tuple] = field(default_factory=list)  # symbol, decorator, line
    impls: list[tuple] = field(default_factory=list)  # type, trait (null for its own methods), line


class LanguagePack:
    """What a language gives; lines count from 1."""

    #: The lists of Parsed that texts of this language may fill.
    gives = frozenset(("symbols", "refs", "imports", "fields", "exports", "decorators", "impls"))

    def parse(self, text: str, what: str | None = None, kind: str | None = None) -> Parsed:
        """With what, a list of Parsed, the others may stay empty; with kind, so may references of other kinds."""
        raise NotImplementedError

    def skeleton(self, text: str) -> str:
        raise NotImplementedError


#: Fields of Python's nodes that hold statements, or clauses with statements, in their order.
BODIES = ("body", "handlers", "cases", "orelse", "finalbody")
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class PythonPack(LanguagePack):
    gives = LanguagePack.gives - {"impls"}

    def parse(self, text: str, what: str | None = None, kind: str | None = None) -> Parsed:
        out = Parsed()
        if what == "decorators" and "@" not in text:
            return out
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return out
        if what in (None, "symbols", "exports", "decorators", "fields"):
            self._definitions(tree, text.split("\n"), out, what == "exports")
        if what in (None, "refs", "imports"):
            self._uses(tree, out, what != "imports", kind in (None, "call"))
            out.refs += [(item if item != "*" else module.split(".")[-1], "import", line) for module, item, _, line in out.imports]
        return out

    @staticmethod
    def _definitions(tree: ast.Module, rows: list[str], out: Parsed, top: bool) -> None:
        """Symbols, exports, decorators and fields; expressions hold none. top: definitions in others are left out."""
        left = [(tree, None)]
        while left:
            node, inside = left.pop()
            below = []
            for name in BODIES:
                below += [(child, inside) for child in getattr(node, name, ())]
            if isinstance(node, DEFINITIONS):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if inside == "class" else "function"
                decorators = node.decorator_list
                first = min([node.lineno, *(d.lineno for d in decorators)])
                out.symbols.append((node.name, kind, first, node.end_lineno, rows[node.lineno - 1].strip()))
                out.decorators += [(node.name, d.id if isinstance(d, ast.Name) else ast.unparse(d), d.lineno) for d in decorators]
                if inside is None and not node.name.startswith("_"):
                    out.exports.append((node.name, kind, node.lineno))
                if is_class:
                    out.fields += [(node.name, item.target.id) for item in node.body if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name)]
                below = [] if top else [(child, "class" if is_class else "function") for child, _ in below]
            left += reversed(below)

    @staticmethod
    def _uses(tree: ast.Module, out: Parsed, refs: bool, calls: bool) -> None:
        """Imports, with refs types in annotations and bases, and with calls these too, for which alone expressions are walked."""
        refs_, left = out.refs, [tree]

        def typed(annotation: ast.AST | None) -> None:
            for x in ast.walk(annotation) if annotation is not None else ():
                if isinstance(x, ast.Name) and x.id not in PRIMITIVES and x.id not in ("float", "bytes", "list", "dict", "tuple", "set"):
                    refs_.append((x.id, "type_usage", x.lineno))

        while left:
            node = left.pop()
            kind = type(node)
            if kind is ast.Import:
                out.imports += [(a.name, "*", False, node.lineno) for a in node.names]
                continue
            if kind is ast.ImportFrom:
                out.imports += [("." * node.level + (node.module or ""), a.name, node.level > 0, node.lineno) for a in node.names]
                continue
            if refs:
                if kind is ast.Call:
                    f = node.func
                    if name := f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None:
                        refs_.append((name, "call", node.lineno))
                elif kind is ast.ClassDef:
                    refs_ += [(b.id, "type_usage", b.lineno) for b in node.bases if isinstance(b, ast.Name) and b.id not in PRIMITIVES]
                    for item in node.body:
                        if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                            typed(item.annotation)
                elif kind in (ast.FunctionDef, ast.AsyncFunctionDef):
                    a = node.args
                    typed(node.returns)
                    for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))):
                        typed(arg.annotation)
            if not refs or not calls:
                below = [x for name in BODIES for x in getattr(node, name, ())]
            else:
                below = []
                for name in node._fields:
                    value = getattr(node, name, None)
                    if type(value) is list:
                        below += [x for x in value if isinstance(x, ast.AST)]
                    elif isinstance(value, ast.AST) and kind is not ast.Name:
                        below.append(value)
            left += reversed(below)

    def skeleton(self, text: str) -> str:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return text
        rows, cut = text.split("\n"), []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = node.body[1:] if ast.get_docstring(node) is not None else node.body
                if body and body[0].lineno > node.lineno:
                    cut.append((body[0].lineno, node.end_lineno, body[0].col_offset))
        out, at = [], 1
        for first, last, indent in sorted(cut):
            if first < at:
                continue
            out += rows[at - 1 : first - 1] + [" " * indent + "..."]
            at = last + 1
        return "\n".join(out + rows[at - 1 :])


BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|\'(?:\\.|[^\'\\\n])\'', re.S)
#: Names that no reference is kept for.
PRIMITIVES = frozenset(
    """bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 Self String Vec Option Result Box Rc Arc Ok Err Some None true
    false string number boolean void null undefined any never unknown object Array Promise console JSON Math Date Error int int8 int16 int32
    int64 uint uint8 uint16 uint32 uint64 float32 float64 complex64 complex128 byte rune error nil""".split()
)
#: A capitalised name where a type may stand: behind a colon, an arrow, an angle bracket, a reference or pointer mark, or the words of a base type.
TYPED = re.compile(r"(?:(?<!:):(?!:)|->|=>|[<&*|,\]]|\bextends\b|\bimplements\b|\bdyn\b|\bimpl\b)\s*(?:mut\s+|dyn\s+|impl\s+|\[\])*([A-Z]\w*)\b(?!\s*[({:.])")
CALL = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(")
# Names before a parenthesis that are no calls.
KEYWORDS = frozenset("if for while switch match return fn func function catch await typeof sizeof new in loop impl struct enum pub let const var type interface class super self".split())
#: Before and behind the name and bracket that begin a method of a class.
DECLARING = re.compile(r"\b(?:function\s*\*?|fn|func)\s+$|#!?\[\s*$")
BRACE = re.compile("[{};]")
NEWLINE, NOT_NEWLINE = re.compile("\n"), re.compile(r"[^\n]")
TYPED_BEHIND = re.compile(r"\w\s+(?:\*|\[\])*([A-Z]\w*)\b(?!\s*[(.])|\)\s*(?:\*|\[\])*([A-Z]\w*)\b(?!\s*[(.])")
MODIFIERS = re.compile(r"\s*(?:(?:public|private|protected|static|abstract|override|async|get|set)\s+)*\*?\s*")
METHOD_HEAD = re.compile(r"[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{};=]+)?\{")


class BracePack(LanguagePack):
    """Declarations by pattern; a declaration's end is the brace that closes the first one it opens."""

    gives = LanguagePack.gives - {"decorators"}

    def __init__(self, declarations: list[tuple[str, str]], imports, members: str | None = None, *, exported: str | None = None, receivers: bool = False, more=None, methods: bool = False, words: dict[str, str] | None = None):
        # with a word that each has: a text without it is not searched
        self.declarations = [(kind, (words or {}).get(kind, kind), re.compile(p, re.M)) for kind, p in declarations]
        self.find_imports, self.member = imports, re.compile(members, re.M) if members else None
        self.exported = re.compile(exported) if exported else None  # on a declaration's first line, or its name where types follow names
        self.receivers, self.more = receivers, more
        self.methods = methods  # classes have methods that no word announces

    @staticmethod
    def blanked(text: str) -> str:
        return BLANK.sub(lambda m: NOT_NEWLINE.sub(" ", m.group()) if "\n" in m.group() else " " * (m.end() - m.start()), text)

    def declares(self, clear: str, m: re.Match, inside: list[tuple[int, int]]) -> bool:
        """Whether a name before a bracket is declared there: a function behind its word, a method of a class in a script or of an
        interface in Go, or the name of an attribute in Rust."""
        before_ = clear[clear.rfind("\n", 0, m.start()) + 1 : m.start()]
        if DECLARING.search(before_) or any(first < m.start() < last for first, last in inside):
            return True
        return bool(self.methods and MODIFIERS.fullmatch(before_) and METHOD_HEAD.match(clear, m.end()))

    @staticmethod
    def closing(text: str, at: int) -> int:
        """The place of the brace that closes the first one from `at`, or the end of the statement without one."""
        depth = 0
        for m in BRACE.finditer(text, at):
            c = m.group()
            depth += (c == "{") - (c == "}")
            if depth <= 0 and c != "{":
                return m.start()
        return len(text) - 1

    def declared(self, clear: str) -> list[tuple[str, str, int, int]]:
        found = []
        for kind, word, pattern in self.declarations:
            for m in pattern.finditer(clear) if word in clear else ():
                found.append((m.group("name"), kind, m.start("head"), self.closing(clear, m.end())))
        if self.more:
            found += [(name, kind, first, self.closing(clear, end)) for name, kind, first, end in self.more(clear)]
        return sorted(found, key=lambda x: x[2])

    def used(self, clear: str, declared: list[tuple]) -> Iterator[tuple[str, int]]:
        """Types in heads of functions and in bodies of types: name and place."""
        for _, kind, first, last in declared:
            if kind in ("function", "method"):
                start = clear.find("{", first, last)
                end = start if start >= 0 else last
            elif kind in ("struct", "interface", "class", "type"):
                end = last
            else:
                continue
            if self.receivers:  # the type follows its name
                for m in TYPED_BEHIND.finditer(clear[first:end]):
                    yield m.group(1) or m.group(2), first + m.start(1 if m.group(1) else 2)
            else:
                for m in TYPED.finditer(clear, first, end):
                    yield m.group(1), m.start(1)

    def parse(self, text: str, what: str | None = None, kind: str | None = None) -> Parsed:
        out, refs_of = Parsed(), kind
        if what in (None, "refs", "imports"):
            out.imports = self.find_imports(text)
        if what == "imports":
            return out
        clear = self.blanked(text)
        starts = [0, *(m.end() for m in NEWLINE.finditer(text))]
        line = lambda at: bisect.bisect_right(starts, at)
        heads = set()
        declared = self.declared(clear)
        for name, kind, first, last in declared:
            at, end = line(first), text.find("\n", first)
            head = text[first : end if end >= 0 else None].strip()
            out.symbols.append((name, kind, at, line(last), head))
            heads.add((name, at))
            if kind == "impl":
                if what in (None, "impls"):
                    out.impls.append((name, trait_of(clear[first:last]), at))
            elif self.exported and self.exported.search(name if self.receivers else head):
                out.exports.append((name, kind, at))
            if what in (None, "fields") and self.member and kind in ("struct", "interface", "class") and "{" in clear[first:last]:
                body = clear[clear.index("{", first) + 1 : last]
                out.fields += [(name, m.group(1)) for m in self.member.finditer(body)]
        if what not in (None, "refs"):
            return out
        inside = [(first, last) for _, kind, first, last in declared if kind == "interface" and self.receivers]
        for m in CALL.finditer(clear) if refs_of in (None, "call") else ():
            name = m.group(1)
            if name not in KEYWORDS and (name, line(m.start())) not in heads and not self.declares(clear, m, inside):
                out.refs.append((name, "call", line(m.start())))
        out.refs += [(item if item != "*" else re.split(r"[/:.]", module)[-1], "import", at) for module, item, _, at in out.imports]
        out.refs += [(name, "type_usage", line(at)) for name, at in self.used(clear, declared) if name not in PRIMITIVES and (name, line(at)) not in heads]
        return out

    def skeleton(self, text: str) -> str:
        clear, out, at = self.blanked(text), [], 0
        for _, kind, first, last in self.declared(clear):
            start = clear.find("{", first, last)
            if kind in ("function", "method") and start >= at and start >= 0:
                out += [text[at : start + 1], " ... "]
                at = last
        return "".join(out) + text[at:]


#: An angle bracket that is no part of an arrow.
ANGLE = re.compile("<|(?<![-=])>")
HEAD_STOP = re.compile("[<{]")
ARROW_HEAD = re.compile(r"^[ \t]*(?P<head>(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?)(?=[(<])", re.M)
ARROW = re.compile(r"\s*(?::[^;={]*(?:\{[^}]*\}[^;={]*)?)?=>")
ROUND = re.compile("[()]")


def angled(text: str, at: int) -> int:
    """The place behind the angle brackets that open at `at`; arrows close none."""
    depth = 0
    for m in ANGLE.finditer(text, at):
        depth += 1 if m.group() == "<" else -1
        if not depth and m.group() == ">":
            return m.end()
    return len(text)


def impl_head(text: str) -> list[str]:
    """The names of the trait, if any, and the type of an impl block's head, without generics and paths."""
    head, at = "", 4
    while m := HEAD_STOP.search(text, at):
        head += text[at : m.start()]
        at = m.start() if m.group() == "{" else angled(text, m.start())
        if m.group() == "{":
            break
    else:
        head += text[at:]
    head = re.split(r"\bwhere\b", head)[0]
    return [re.split(r"\W+", x.strip(" &\n\t"))[-1] or x.strip() for x in re.split(r"\bfor\b", head)]


def trait_of(text: str) -> str | None:
    names = impl_head(text)
    return names[0] if len(names) > 1 else None


def rust_impls(clear: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"^[ \t]*(?P<head>(?:unsafe\s+)?impl\b)", clear, re.M) if "impl" in clear else ():
        body = clear[m.end("head") - 4 :]
        out.append((impl_head(body)[-1], "impl", m.start("head"), m.end("head")))
    return out


def arrows(clear: str) -> list[tuple]:
    """Functions that are values: const name = (arguments over any lines): type => ..."""
    out = []
    for m in ARROW_HEAD.finditer(clear):
        at = angled(clear, m.end()) if clear[m.end()] == "<" else m.end()
        depth, k = 0, at
        while k < len(clear):
            depth += (clear[k] == "(") - (clear[k] == ")")
            k += 1
            if not depth:
                break
        if arrow := ARROW.match(clear, k):
            out.append((m.group("name"), "function", m.start("head"), arrow.end()))
    return out


def rust_imports(text: str) -> list[tuple]:
    out = []

    def tree(prefix: str, rest: str, at: int) -> None:
        rest = rest.strip()
        if "{" in rest:
            head, body = rest.split("{", 1)
            depth, part = 0, ""
            for c in body.rsplit("}", 1)[0] + ",":
                depth += (c == "{") - (c == "}")
                if c == "," and not depth:
                    if part.strip():
                        tree(prefix + head, part, at)
                    part = ""
                else:
                    part += c
            return
        path = (prefix + rest).split(" as ")[0]
        module, _, item = path.rpartition("::")
        if path.split("::")[0] not in ("std", "core"):
            out.append((module or item, item, path.split("::")[0] in ("crate", "self", "super"), at))

    for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;]+);", text, re.M):
        tree("", m.group(1), text.count("\n", 0, m.start(1)) + 1)
    return out


def typescript_imports(text: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?(?:(.+?)\s+from\s+)?['\"]([^'\"]+)['\"]", text, re.M):
        at, module = text.count("\n", 0, m.start(2)) + 1, m.group(2)
        items = re.findall(r"[A-Za-z_$][\w$]*(?=\s*[,}]|\s*$)", re.sub(r"([\w$]+)\s+as\s+[\w$]+", r"\1", re.sub(r"\*\s+as\s+", "", m.group(1) or ""))) or ["*"]
        out += [(module, x, module.startswith(".") or module.startswith("@/"), at) for x in items]
    return out


def go_imports(text: str) -> list[tuple]:
    out = []
    for m in re.finditer(r'^import\s+(?:\w+\s+)?"([^"]+)"|^import\s*\(([^)]*)\)', text, re.M):
        if m.group(1):
            out.append((m.group(1), "*", False, text.count("\n", 0, m.start(1)) + 1))
        else:
            out += [(x.group(1), "*", False, text.count("\n", 0, m.start(2) + x.start(1)) + 1) for x in re.finditer(r'"([^"]+)"', m.group(2))]
    return out


RUST = BracePack(
    [
        ("struct", r"^[ \t]*(?P<head>(?:pub(?:\([a-z]+\))?\s+)?struct\s+(?P<name>\w+))"),
        ("enum", r"^[ \t]*(?P<head>(?:pub(?:\([a-z]+\))?\s+)?enum\s+(?P<name>\w+))"),
        ("trait", r"^[ \t]*(?P<head>(?:pub(?:\([a-z]+\))?\s+)?trait\s+(?P<name>\w+))"),
        ("function", r"^[ \t]*(?P<head>(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+))"),
        ("module", r"^[ \t]*(?P<head>(?:pub\s+)?mod\s+(?P<name>\w+))"),
    ],
    rust_imports,
    r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(\w+)\s*:(?!:)",
    exported=r"^pub\b",
    more=rust_impls,
    words={"function": "fn", "module": "mod"},
)
TYPESCRIPT = BracePack(
    [
        ("interface", r"^[ \t]*(?P<head>(?:export\s+)?interface\s+(?P<name>\w+))"),
        ("class", r"^[ \t]*(?P<head>(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+))"),
        ("enum", r"^[ \t]*(?P<head>(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+))"),
        ("function", r"^[ \t]*(?P<head>(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+))"),
        ("type", r"^[ \t]*(?P<head>(?:export\s+)?type\s+(?P<name>\w+)\s*=)"),
    ],
    typescript_imports,
    r"^\s*(?:readonly\s+|public\s+|private\s+)?(\w+)\??\s*:",
    exported=r"^export\b",
    more=arrows,
    methods=True,
)
GO = BracePack(
    [
        ("struct", r"^(?P<head>type\s+(?P<name>\w+)\s+struct)"),
        ("interface", r"^(?P<head>type\s+(?P<name>\w+)\s+interface)"),
        ("method", r"^(?P<head>func\s+\([^)]*\)\s+(?P<name>\w+))"),
        ("function", r"^(?P<head>func\s+(?P<name>\w+))"),
    ],
    go_imports,
    r"^\s*([A-Za-z]\w*)\s+[\w\[\]*.]+",
    exported=r"^[A-Z]",
    receivers=True,
    words={"method": "func", "function": "func"},
)


class VuePack(LanguagePack):
    """The script is read as TypeScript at its own lines; tags in Pascal case or with a hyphen are component references."""

    gives = BracePack.gives

    def parse(self, text: str, what: str | None = None, kind: str | None = None) -> Parsed:
        m = re.search(r"<script[^>]*>(.*?)</script>", text, re.S)
        out = TYPESCRIPT.parse("\n" * text.count("\n", 0, m.start(1)) + m.group(1), what, kind) if m else Parsed()
        if t := re.search(r"<template[^>]*>(.*)</template>", text, re.S):
            for tag in re.finditer(r"<([A-Z]\w*|[a-z]+(?:-\w+)+)", t.group(1)):
                out.refs.append((tag.group(1), "component_usage", text.count("\n", 0, t.start(1) + tag.start()) + 1))
        return out

    def skeleton(self, text: str) -> str:
        return TYPESCRIPT.skeleton(text)


PACKS: dict[str, LanguagePack] = {"python": PythonPack(), "rust": RUST, "typescript": TYPESCRIPT, "go": GO, "vue": VuePack()}


def chunks(text: str, tops: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None]]:
    """(first line, last line, name) of chunks that cover every line once: neighbouring units are packed up to MAX_CHUNK bytes, and a
    unit beyond that is split at lines. A single longer line is a chunk of its own."""
    rows = text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    sizes = [len(r.encode()) + 1 for r in rows]
    starts = {first: name for first, _, name in tops}
    out, at, size, name = [], 1, 0, None
    for k, n in enumerate(sizes, 1):
        unit = k in starts and size >= MIN_CHUNK and size + sum(sizes[k - 1 : next((last for first, last, _ in tops if first == k), k)]) > MAX_CHUNK
        if size and (size + n > MAX_CHUNK or unit):
            out.append((at, k - 1, name))
            at, size, name = k, 0, None
        size += n
        name = name or starts.get(k)
    if size:
        out.append((at, len(rows), name))
    return out


#: Files whose rows are given on at once.
STEP = 1024
SCHEMAS = {
    "symbols": "file_id long, name string, kind string, line_start int, line_end int, signature string",
    "refs": "file_id long, name string, kind string, line int",
    "imports": "file_id long, module string, item string, relative boolean, line int",
    "fields": "file_id long, type string, field string",
    "exports": "file_id long, name string, kind string, line int",
    "decorators": "file_id long, name string, decorator string, line int",
    "impls": "file_id long, name string, trait string, line int",
    "chunks": "file_id long, line_start int, line_end int, name string, content string",
    "skeleton": "file_id long, skeleton string",
}


def extract(files: DataFrame, what: str, kind: str | None = None) -> DataFrame:
    """Rows of one kind (a key of SCHEMAS) from files (file_id, language, content). Files of other languages and null contents give none,
    but chunks, which any text has. A file that cannot be parsed gives no symbols. kind: of refs, those of this kind only."""
    schema = StructType.fromDDL(SCHEMAS[what])
    arrow = to_arrow_schema(schema)
    wanted = files.select("file_id", "language", "content").where("content IS NOT NULL")
    if what != "chunks":  # contents of languages that give none do not go to the workers
        wanted = wanted.where(F.col("language").isin([k for k, pack in PACKS.items() if what == "skeleton" or what in pack.gives]))

    def rows_of(file_id, language, content) -> list[tuple]:
        pack = PACKS.get(language)
        if what == "skeleton":
            return [(file_id, pack.skeleton(content))]
        if what == "chunks":
            lines = content.split("\n")
            tops = [(s[2], s[3], s[0]) for s in pack.parse(content, "symbols").symbols] if pack else []
            return [(file_id, a, b, n, "\n".join(lines[a - 1 : b])) for a, b, n in chunks(content, tops)]
        rows = getattr(pack.parse(content, what, kind), what)
        return [(file_id, *r) for r in (dict.fromkeys(rows) if what == "refs" else rows) if kind is None or r[1] == kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()  # syntax trees set off many collections, which need not look at the modules
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out = [r for row in zip(*(part.column(k).to_pylist() for k in range(3))) for r in rows_of(*row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return wanted.mapInArrow(run, schema)


def extract_tables(files: DataFrame, kinds: tuple[str, ...], folder: str) -> dict[str, DataFrame]:
    """extract() for several lists of Parsed, each file parsed once: rows of all kinds are written to `folder` and read again by kind."""
    schemas = {k: StructType.fromDDL(SCHEMAS[k]) for k in kinds}
    fields = {f.name: f for k in kinds for f in schemas[k]}
    schema = StructType([*fields.values()]).add("what", "string")
    arrow = to_arrow_schema(schema)
    languages = [k for k, pack in PACKS.items() if pack.gives.intersection(kinds)]
    wanted = files.select("file_id", "language", "content").where(F.col("content").isNotNull() & F.col("language").isin(languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = {k: [] for k in kinds}
                for file_id, language, content in zip(*(batch.slice(at, STEP).column(k).to_pylist() for k in range(3))):
                    got = PACKS[language].parse(content)
                    for k in kinds:
                        rows = getattr(got, k)
                        out[k] += [(file_id, *r) for r in (dict.fromkeys(rows) if k == "refs" else rows)]
                for k, rows in out.items():
                    if rows:
                        held = dict(zip(schemas[k].names, zip(*rows)), what=[k] * len(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) if f.name in held else pa.nulls(len(rows), f.type) for f in arrow], schema=arrow)

    wanted.mapInArrow(run, schema).write.partitionBy("what").parquet(folder)
    kept = files.sparkSession.read.schema(schema).parquet(folder)
    return {k: kept.where(F.col("what") == k).select(*schemas[k].names) for k in kinds}
