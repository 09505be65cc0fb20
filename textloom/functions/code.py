"""Columns about source files: language, framework, quality, noise, cleaning. All of it stays in the JVM.

Every column is null-safe in the way stated: a null path or code gives the first reason that a missing value fails, and
never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JS = ("js", "jsx", "ts", "tsx")
LANGUAGES = ("js", "jsx", "ts", "tsx", "py")

# What marks a framework, in order of priority, and the languages it may mark.
FRAMEWORKS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("nestjs", r"@nestjs/|@Controller\(|@Injectable\(", JS),
    ("nextjs", r"""from\s+['"]next/|['"]next/(link|image|router|navigation)['"]""", JS),
    ("react", r"""import\s+React\b|from\s+['"]react['"]|\buseState\b|\buseEffect\b""", JS),
    ("express", r"""\bexpress\(\)|require\(['"]express['"]\)|from\s+['"]express['"]""", JS),
    ("fastapi", r"from\s+fastapi\b|import\s+fastapi\b", ("py",)),
    ("flask", r"from\s+flask\b|import\s+flask\b", ("py",)),
    ("vue", r"""from\s+['"]vue['"]|defineComponent|\bcreateApp\(|@vue/""", ("js", "ts")),
    ("angular", r"@angular/|@Component\(|@NgModule\(", ("ts",)),
    ("django", r"from\s+django\b|import\s+django\b", ("py",)),
    ("pydantic", r"from\s+pydantic\b|from\s+sqlalchemy\b|import\s+sqlalchemy\b|from\s+starlette\b", ("py",)),
    ("python-http", r"(?m)^\s*(import|from)\s+(requests|aiohttp|httpx|uvicorn|gunicorn|celery)\b", ("py",)),
    ("python-async", r"(?m)\basync\s+def\b|^@app\.", ("py",)),
    ("node", r"""require\(['"](fs|http|https|path|os|crypto|dotenv|mongoose|cors|axios|pg|prisma)['"]\)|from\s+['"](node:|fs|http|path|axios|mongoose|prisma|@prisma/|typeorm|zod|dotenv|cors)|\bprocess\.env\b|\bmodule\.exports\b|\brouter\.(get|post|put|delete)\(""", JS),
    ("ts-app", r"(?m)^\s*(export\s+)?(interface|type)\s+\w+|\bawait\s+fetch\(|\bfetch\(['\"`]", ("ts", "tsx")),
)
# Paths and marks that reject a file, and the limits of size and shape.
BAD_PATH = r"(?i)(^|/)(node_modules|dist|build|out|vendor|\.next|coverage|__pycache__|site-packages|bower_components)/|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$|\.min\.(js|css)$|\.bundle\.js$|\.chunk\.js$"
AUTOGENERATED = r"(?i)(auto[- ]?generated|code generated|generated by|do not edit|@generated|this file was generated)"
MIN_BYTES, MAX_BYTES, MIN_ALNUM, MAX_MEAN_LINE, HEAD_CHARS = 200, 100_000, 0.25, 150, 1000
# Pieces of JavaScript under test that keep it from being run, in the order in which they are looked for.
BANNED_JS = (
    "require(", "import(", "import ", "process.", "process[", "fetch(", "eval(", "Function(", "globalThis",
    "child_process", "XMLHttpRequest", "WebSocket", "constructor", "__proto__",
)
# Noise.
META_HEAD = r"^(<reponame>[^\n<]*)?(<filename>[^\n<]*)?(<gh_stars>[^\n<]*)?\n?"
META_ANY = r"<(reponame|filename|gh_stars|issue_start|jupyter_start|commit_before)>"
EJS, HANDLEBARS = r"(?s)<%[=\-_#]?.*?%>", r"\{\{\s*[#/>!]"
PY2 = (r"(?m)^[ \t]*print[ \t]+[^(=\s]", r"(?m)^[ \t]*except[ \t]+[\w.]+[ \t]*,[ \t]*\w+[ \t]*:", r"(?m)^[ \t]*raise[ \t]+\w+[ \t]*,")
BASE64_RUN, BASE64_LINE = r"[A-Za-z0-9+/=]{200,}", r"^[ \t]*[A-Za-z0-9+/=]{40,}[ \t]*$"
RUN_ALNUM, LINE_ALNUM, BLOB_LINES, MOJIBAKE, LICENSE_LINES = 150, 30, 8, 3, 4
LICENSE_WORDS = r"(?i)copyright|licen[sc]e|spdx|warranty|permission|all rights reserved"
PREFIX_LINE = r"""(?i)^(#!|#\s*-\*-|#\s*(vim|coding)[:=]|\s*['"]use (client|strict|server)['"];?\s*$)"""


def language(path: Column) -> Column:
    """The language by what follows the last dot of the whole path; null for any other."""
    extension = F.regexp_extract(F.lower(path), r"\.([^.]*)$", 1)
    return F.when(extension.isin(*LANGUAGES), extension)


def framework(code: Column, lang: Column) -> Column:
    """The first framework, in order of priority, whose mark is in the code and that the language may have."""
    return F.coalesce(*(F.when(lang.isin(*langs) & code.rlike(mark), name) for name, mark, langs in FRAMEWORKS))


def bad_path(path: Column) -> Column:
    return F.translate(path, "\\", "/").rlike(BAD_PATH)


def alnum(text: Column) -> Column:
    """Letters and digits of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def occurrences(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def quality_reason(code: Column) -> Column:
    """Why a file is refused for its size or shape, the first reason that holds; null if it is accepted. Null and empty
    code is too small."""
    size = F.coalesce(F.octet_length(code), F.lit(0))
    return (
        F.when(size < MIN_BYTES, "too_small").when(size > MAX_BYTES, "too_large").when(F.left(code, F.lit(HEAD_CHARS)).rlike(AUTOGENERATED), "autogenerated")
        .when(alnum(code) <= MIN_ALNUM * F.length(code), "low_alnum").when(F.length(code) >= MAX_MEAN_LINE * (occurrences(code, "\n") + 1), "long_lines")
    )


def cascade_reason(code: Column, path: Column, languages: tuple[str, ...] = LANGUAGES, mark: Column | None = None) -> Column:
    """Why a file is refused: its language, its path, no framework, its quality; null if it is accepted. ``mark`` is the
    framework where it is already known."""
    lang = language(path)
    own = framework(code, lang) if mark is None else mark
    return (
        F.when(~F.coalesce(lang.isin(*languages), F.lit(False)), "language").when(bad_path(path), "bad_path").when(own.isNull(), "off_domain").otherwise(quality_reason(code))
    )


def strip_metadata(code: Column) -> Column:
    return F.when(code.startswith("<"), F.regexp_replace(code, META_HEAD, "")).otherwise(code)


def is_blob(code: Column) -> Column:
    """A long run of base64 characters, or many whole lines of them; rules of dashes and slashes do not count."""
    runs = F.exists(F.regexp_extract_all(code, F.lit(BASE64_RUN), F.lit(0)), lambda r: alnum(r) >= RUN_ALNUM)
    lines = F.filter(F.split(code, "\n"), lambda x: x.rlike(BASE64_LINE) & (alnum(x) >= LINE_ALNUM))
    return runs | (F.size(lines) >= BLOB_LINES)


def is_python2(code: Column) -> Column:
    return reduce(lambda a, b: a | b, (code.rlike(p) for p in PY2))


def noise_reason(code: Column, path: Column, lang: Column) -> Column:
    """Known noise, the first kind that holds, without the parse of Python files; null if there is none."""
    return (
        F.when(F.lower(F.translate(path, "\\", "/")).endswith(".d.ts"), "dts").when(code.rlike(META_ANY), "tags").when(F.contains(code, F.lit("sourceMappingURL=data:")), "sourcemap")
        .when(occurrences(code, "�") >= MOJIBAKE, "mojibake").when(is_blob(code), "blob")
        .when(lang.isin(*JS) & (code.rlike(EJS) | code.rlike(HANDLEBARS)), "template").when((lang == "py") & is_python2(code), "python2")
    )


#: Lines that must stay first, blank space within a line, and what ends one.
_GAP, _END = r"[^\S\n]*", r"(?:\n|\z)"
_PREFIX = rf"""\A(?i)(?:(?:(?:#!|#{_GAP}-\*-|#{_GAP}(?:vim|coding)[:=])[^\n]*|{_GAP}['"]use (?:client|strict|server)['"];?{_GAP}){_END})*"""
_BLOCKS = {
    "/*": rf"\A(?s){_GAP}(?=/\*).*?\*/[^\n]*{_END}",
    "//": rf"\A(?:{_GAP}//[^\n]*{_END})+",
    "#": rf"\A(?:{_GAP}#[^\n]*{_END})+",
}


def strip_license(code: Column) -> Column:
    """The code without a leading comment of four or more lines that speaks of a licence, and without the blank lines
    after it. Lines that must stay first (interpreter, encoding, directives) stay. Only the head of a text is looked at:
    each expression is anchored at its start."""
    struct = lambda **columns: F.struct(*(c.alias(n) for n, c in columns.items()))
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731 - a value that is computed once

    def whole(prefix: Column) -> Column:
        tail = F.substring(code, F.length(prefix) + 1, F.length(code))
        first = F.regexp_extract(tail, r"\A\s*?(/\*|//|#)", 1)
        first = F.when(F.regexp_extract(tail, rf"\A({_GAP})(?:/\*|//|#)", 0) != "", first).otherwise("")
        found = F.coalesce(*(F.when(first == mark, F.regexp_extract(tail, block, 0)) for mark, block in _BLOCKS.items()), F.lit(""))
        block = F.when((first == "/*") & (found == ""), tail).otherwise(found)  # a comment that never closes
        return once(struct(tail=tail, block=block, open=(first == "/*") & (found == "")), lambda x: cut(prefix, x["tail"], x["block"], x["open"]))

    def cut(prefix: Column, tail: Column, block: Column, open_: Column) -> Column:
        count = occurrences(block, "\n") + F.when(open_ | ~block.endswith("\n"), 1).otherwise(0)
        rest = F.regexp_replace(F.substring(tail, F.length(block) + 1, F.length(tail)), rf"\A(?:{_GAP}\n)*", "")
        kept = F.when(rest.rlike(r"\A\s*\z"), "").otherwise(rest)
        out = F.when(kept == "", F.regexp_replace(prefix, r"\n\z", "")).otherwise(F.concat(prefix, kept))
        return F.when((block != "") & (count >= LICENSE_LINES) & block.rlike(LICENSE_WORDS), out).otherwise(code)

    return once(F.regexp_extract(code, _PREFIX, 0), whole)


def class_key(framework_: Column, lang: Column) -> Column:
    """The mixture class: framework, and ``tsx`` or ``other``; null if either is null."""
    return F.when(framework_.isNotNull() & lang.isNotNull(), F.concat(framework_, F.lit("|"), F.when(lang == "tsx", "tsx").otherwise("other")))


def in_floor(name: str, key: Column) -> Column:
    return key.endswith("|tsx") if name == "tsx" else key.startswith(f"{name}|")


def token_language(lang: Column) -> Column:
    return F.when(lang == "jsx", "js").when(lang == "tsx", "ts").otherwise(lang)


def around_cursor(text: Column, mark: str = "<CURSOR>") -> Column:
    """``struct(before, after)`` of the first mark, or null."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.struct(F.left(text, at - 1).alias("before"), F.substring(text, at + len(mark), F.length(text)).alias("after")))


def first_banned(code: Column, banned: tuple[str, ...]) -> Column:
    """The first entry of the list that occurs in the code."""
    return F.coalesce(*(F.when(F.contains(code, F.lit(b)), b) for b in banned))


def repeated_lines(code: Column, least: int = 4) -> Column:
    """Share of trimmed lines of at least ``least`` characters that repeat another one; 0 where there are none."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= least)
    return F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0))


def first_unit(code: Column, lang: Column) -> Column:
    """A completion cut after its first unit. Python ends before the next line that starts in column 0, and blank lines at
    the cut go; others end with the first brace in column 0, which may be the first character. What never ends stays."""
    py = F.regexp_instr(code, F.lit(r"\n(?=(?U)\S)"))
    js = F.regexp_instr(code, F.lit(r"(?md)^\}"))
    cut = F.concat(F.regexp_replace(F.left(code, py), r"\n+\z", ""), F.lit("\n"))
    return F.when(lang == "py", F.when(py > 0, cut).otherwise(code)).otherwise(F.when(js > 0, F.left(code, js)).otherwise(code))


def on_topic(text: Column, expected: Column) -> Column:
    """Whether any of the expected pieces occurs in the text; null if either is null."""
    return F.when(text.isNotNull() & expected.isNotNull(), F.exists(expected, lambda e: F.contains(text, e)))


def clean(df: DataFrame, parsed: Column | None = None, code: str = "code", path: str = "path") -> DataFrame:
    """``df`` with ``lang``, ``cleaned`` and ``reason``: tags are stripped, then known noise is refused, then a licence
    heading goes. ``parsed`` says of Python files whether they parse; without it they are parsed here. ``cleaned`` is null
    where there is a reason; null code has the reason of an empty one once its quality is asked.
    """
    from textloom.functions.python_code import python_parses

    own = df.withColumn("lang", language(F.col(path))).withColumn("cleaned", strip_metadata(F.col(code)))
    own = own.withColumn("reason", noise_reason(F.col("cleaned"), F.col(path), F.col("lang")))
    asked = F.col("reason").isNull() & (F.col("lang") == "py")
    valid = python_parses(F.when(asked, F.col("cleaned"))) if parsed is None else parsed
    own = own.withColumn("reason", F.coalesce("reason", F.when(asked & ~F.coalesce(valid, F.lit(True)), "py_syntax")))
    return own.withColumn("cleaned", F.when(F.col("reason").isNull(), strip_license(F.col("cleaned"))))


# The order of the codes of cleaning reasons; any other reason is the last one.
REASON_CODES = ("ok", "dts", "template", "python2", "py_syntax", "too_small", "low_alnum", "long_lines", "other")


def reason_code(reason: Column) -> Column:
    """The code of a reason, 0 for none."""
    place = F.array_position(F.array(*(F.lit(r) for r in REASON_CODES)), F.coalesce(reason, F.lit("ok")))
    return F.when(place > 0, place - 1).otherwise(len(REASON_CODES) - 1).cast("int")


#: What the newer corpus takes; React only where it is TSX.
WANTED = ("nextjs", "fastapi", "nestjs", "react")


def selection_reason(code: Column, path: Column) -> Column:
    """The reason of the filter cascade, or ``unwanted`` for what the newer corpus does not take."""
    lang = language(path)
    mark = framework(code, lang)
    wanted = mark.isin(*WANTED) & ((mark != "react") | (lang == "tsx"))
    return F.coalesce(cascade_reason(code, path), F.when(~F.coalesce(wanted, F.lit(False)), "unwanted"))
