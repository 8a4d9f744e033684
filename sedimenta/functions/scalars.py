"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_field(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", ""))


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kb, F.format_string("%d B", n))
        .when(n < mb, F.format_string("%.1f KB", n / kb))
        .when(n < gb, F.format_string("%.1f MB", n / mb))
        .otherwise(F.format_string("%.1f GB", n / gb))
    )


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm", F.floor(s / 60)))
        .when(s < 86400, F.format_string("%dh", F.floor(s / 3600)))
        .otherwise(F.format_string("%dd", F.floor(s / 86400)))
    )


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def pascal_to_kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"))


def kebab_to_pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def line_of_offset(text: Column, offset: Column) -> Column:
    head = F.left(text, offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def make_relative(path: Column, root: str) -> Column:
    return F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)


def requirement(line: Column) -> Column:
    """(name, spec) of a requirements line; null for comments and blanks."""
    bare = F.btrim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when(name != "", F.struct(F.lower(name).alias("name"), F.regexp_extract(bare, r"([<>=!~]=?[^;\s]*)", 1).alias("spec")))


def changed_lines(old: Column, new: Column) -> Column:
    """1-based numbers of lines that differ, the longer text's tail included."""
    a, b = F.split(old, "\n", -1), F.split(new, "\n", -1)
    both = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.transform(both, lambda d, i: F.when(d, i + 1)), lambda i: i.isNotNull())


#: Which paths make a change one of tests, documents, configuration or builds.
TEST_PATH, DOCS_PATH = r"test|spec", r"\.md$|^docs/"
CHORE_PATH, CI_PATH = r"\.toml$|\.json$|^\.github/", r"\.github/workflows|\.gitlab-ci|^Dockerfile$"


def change_type(paths: Column, statuses: Column, additions: Column, deletions: Column) -> Column:
    """The kind of a change from the paths and statuses (arrays) of its files: any test file, any document, any configuration or build
    file; then mostly deletions, a new file, few lines in at most three files; the first that fits."""
    holds = lambda pattern: F.exists(paths, lambda p: p.rlike(pattern))
    return (
        F.when(holds(TEST_PATH), "test").when(holds(DOCS_PATH), "docs").when(holds(CHORE_PATH), "chore").when(holds(CI_PATH), "ci")
        .when(deletions > additions * 2, "refactor").when(F.array_contains(statuses, "added"), "feat")
        .when((F.size(paths) <= 3) & (additions + deletions < 50), "fix").otherwise("refactor")
    )


def change_summary(kind: Column, statuses: Column) -> Column:
    """One sentence on a change."""
    n = lambda status: F.size(F.filter(statuses, lambda s: s == status))
    files = F.size(statuses)
    said = lambda text: F.format_string(text, files)
    cleanup = F.format_string("Code refactoring with cleanup (%d files modified, %d removed)", n("modified"), n("deleted"))
    return (
        F.when((kind == "feat") & (n("added") > 0), said("New functionality added across %d file(s)")).when(kind == "feat", said("Feature enhancement in %d file(s)"))
        .when(kind == "fix", said("Bug fix in %d file(s)")).when((kind == "refactor") & (n("deleted") > 0), cleanup).when(kind == "refactor", said("Code refactoring in %d file(s)"))
        .when(kind == "docs", said("Documentation update for %d file(s)")).when(kind == "test", said("Test updates in %d file(s)"))
        .when(kind == "chore", said("Build/config changes in %d file(s)")).when(kind == "ci", F.lit("CI/CD pipeline updates")).otherwise(said("Changes in %d file(s)"))
    )


#: Modules that a Python import may take from the standard library.
STDLIB = frozenset(
    """abc argparse ast asyncio base64 collections contextlib copy csv ctypes dataclasses datetime decimal difflib email enum functools glob
    hashlib hmac html http importlib inspect io itertools json logging math multiprocessing operator os pathlib pickle platform pprint queue
    random re secrets shutil signal socket sqlite3 ssl string struct subprocess sys tempfile textwrap threading time timeit traceback typing
    unittest urllib uuid warnings weakref xml zipfile zlib builtins codecs concurrent configparser dis fractions ftplib getpass grp gzip heapq
    ipaddress lzma mimetypes numbers posixpath pwd selectors shelve smtplib statistics sysconfig tarfile tkinter trace types unicodedata""".split()
)


def likely_stdlib(module: Column) -> Column:
    return F.split(module, r"\.")[0].isin(sorted(STDLIB))


def strip_json_comments(text: Column) -> Column:
    """JSON without line and block comments; strings stay as they are."""
    return F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")


def truncate_utf8(text: Column, n: int) -> Column:
    """The longest beginning of a text that takes at most n bytes and ends with a whole character."""
    data = text.cast("binary")
    # a byte that goes on with a character is 80 to BF: the cut moves back until the next byte begins one
    goes_on = lambda at: F.hex(F.substring(data, at, 1)).rlike("^[89AB]")
    cut = F.when(~goes_on(n + 1), n).when(~goes_on(n), n - 1).when(~goes_on(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(data, F.lit(1), cut).cast("string"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def complexity(files: Column, lines: Column) -> Column:
    return F.when((files > 10) | (lines > 500), "large").when((files > 3) | (lines > 100), "medium").otherwise("simple")


def adaptive_batch(mean_length: Column) -> Column:
    """Texts per batch for about 100 KiB, within 32 and 256."""
    return F.least(F.lit(256), F.greatest(F.lit(32), F.floor(F.lit(102_400) / mean_length))).cast("int")
