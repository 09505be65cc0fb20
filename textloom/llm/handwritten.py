"""Problem 5: generated, minified, vendored files and data kept as code.

1. Repositories that declare generated or vendored paths in attribute files are taken at their word: globs are read in
   order, a later line wins over an earlier one, a deeper file over a shallower one, and an unset mark clears it.
2. For all others, equivalent patterns apply. They are mined from the declaring repositories: directories and endings of
   file names whose files these nearly always declare. Beside them stand known ones, and directories mined from the whole
   corpus, namely those whose files nearly always lie in a sub-directory that hardly any other project has, as packages do.
3. Content speaks in any repository: a tool's mark in a comment before or after all code, members counted through line
   by line, lines no hand would write, literals without code, a library's own heading.
4. A file of the same name as a known third-party file and with nearly the same text is a copy of it, wherever it lies;
   exact sets of token runs decide, for every pair of one name.

A licence heading alone is no sign; neither is a mark inside a string or between pieces of code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import fingerprint as fp
from textloom.llm.splits import project
from textloom.session import join_checked, materialize

KINDS = ("generated", "minified", "data", "vendored")
#: Exact similarity from which a file of a third-party file's name is a copy of it.
COPIED = 0.6
#: Different third-party texts, and others, of one name that meet in one task; a name of more is cut into blocks.
COPY_BLOCK = 1024

# What tools write into what they put out.
MARK = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\bauto-?generated\b(?!\s+(?:by|for)\s+(?:this|the)\b)|\bautomatically generated\b|\b(?:code|file|source)\s+generated\s+by\b"
    r"|\bdo not (?:edit|modify)\b|\bany changes? (?:made )?will be (?:overwritten|lost)\b|\bcompiled from \S+ (?:by|with|using)\b|\bgenerated from \S+\.\w+"
    r"|\bne pas (?:modifier|éditer)\b|\bfichier (?:produit|généré) par\b|\bno (?:editar|modificar)\b|\barchivo generado\b|\bnicht (?:bearbeiten|ändern)\b"
)
# How the headings of third-party files begin.
ORIGIN = re.compile(
    r"(?i)\b(?:bundled|vendored|verbatim|unmodified|unchanged)\s+(?:copy|version)\s+(?:of|from)\s+\S|\b(?:taken|copied|imported|mirrored|vendored)\s+(?:unchanged|verbatim|as is|unmodified)?\s*from\s+\S+\s+(?:at|tag|version|release|commit)\b"
    r"|\bupstream release\b|^\W*[\w.@/-]+\s+version\s+v?\d+\.\d+\S*,?\s+(?:maintained|published|distributed|released)\s+by\b|@license\s+\S+\s+v?\d+\.\d+|^\W*[\w.@/-]+\.\w+\s*\|[^|\n]+\|\s*v?\d+\.\d+|^\W*[\w.@/-]+\s+v\d+\.\d+\.\d+\W*$"
)
# Names that tools give to files.
TOOL_NAME = re.compile(r"(?i)(?:_pb2?(?:_grpc)?|\.pb|[._]gen|[._-]generated|\.designer|\.g)\.[a-z]+$")
# Directories of third-party files, as path parts from the outermost in.
THIRD_PARTY = ("node_modules", "bower_components", "site-packages", "third_party", "third-party", "thirdparty", "vendor", "_vendored", "_vendor", "external", "extern", "deps", "public/plugins", "assets/libs", "static/vendor", "static/libs")
#: A versioned file name, as downloads have it.
VERSIONED = re.compile(r"^(.+?)[-._]v?\d+\.\d+(?:\.\d+)*(?:[.-]min)?\.[A-Za-z]+$")

_STRING = re.compile(r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
_COMMENT = re.compile(r"(?m)/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|^\s*#[^\n]*")
_NAME = re.compile(r"[^\W\d][\w$]*")
_NUMERAL = re.compile(r"(?<![\w$])\d[\w.]*")
_HEAD = re.compile(r"(?:﻿|\s+|#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|([\"'])use [a-z]+\1;?)*")
_WORD, _NUMBER = re.compile(r"\w+"), re.compile(r"\d{1,12}")


def _ends(code: str) -> str:
    """The comments before and after all code."""
    head = _HEAD.match(code).end()
    at = len(code)
    lines = code.splitlines(keepends=True)
    inside, take = False, []
    for line in reversed(lines):
        text = line.strip()
        if inside:
            take.append(line)
            inside = "/*" not in text
        elif not text or text.startswith(("#", "//")):
            take.append(line)
        elif text.endswith("*/") and (text.startswith(("*", "/*"))):
            take.append(line)
            inside = "/*" not in text
        else:
            break
        at -= len(line)
    return code[:head] + "\n" + code[max(at, head):]


def _counted(lines: list[str], named: bool, share: float = 0.3) -> bool:
    """Whether lines of one form follow one another while a number in them counts up by one: six such lines, four if two
    numbers count up, three in a file with a tool's name; and ``share`` of all lines stand in such rows."""
    run = best = double = both = total = held = 0
    form = before = None
    for line in lines:
        text = line.strip()
        if len(text) < 12:
            continue
        total += 1
        plain = _STRING.sub('""', text) if '"' in text or "'" in text or "`" in text else text  # whatever a text says, it is one piece
        shape = _WORD.sub("w", plain)
        ups = 0
        if shape == form:  # numbers are read only where two lines in a row have one form
            old, new = (_NUMBER.findall(x) for x in (before, text))
            ups = sum(int(y) == int(x) + 1 for x, y in zip(old, new)) if len(old) == len(new) else 0
        run, double = (run + 1 if ups else 1), (double + 1 if ups > 1 else 1)
        held += 3 if run == 3 else run > 3
        best, both = max(best, run), max(both, double)
        form, before = shape, text
    return (best >= 6 or both >= 4 or named and best >= 3) and held >= share * total


def _longest(code: str) -> int:
    return max((len(line) for line in code.splitlines()), default=0)


def kinds(code: str, path: str) -> tuple[set[str], bool]:
    """What a file's content and own name say: its kinds, and whether it has a third-party heading."""
    found: set[str] = set()
    ends = _ends(code)
    if MARK.search(ends):
        found.add("generated")
    bare = _COMMENT.sub("", _STRING.sub('""', code))
    if sum(map(bare.count, "0123456789")) > 0.1 * len(bare):
        bare = _NUMERAL.sub("0", bare)  # letters of numbers, as in 0x1f, are no names
    names = _NAME.findall(bare)
    lines = code.splitlines()
    if _counted(lines, bool(TOOL_NAME.search(path))):
        found.add("generated")
    size = len(code)
    blank = 1 - sum(map(len, code.split())) / size
    if size >= 300 and len(names) <= 8 and size > 40 * len(names):
        found.add("data")
    elif blank < 0.1 and size / max(len([x for x in lines if x.strip()]), 1) >= 110 and _longest(code) >= 200:
        found.add("minified")
    origin = any(ORIGIN.search(line) for line in ends.splitlines())
    if origin and "minified" not in found:
        found.add("vendored")
    return found, origin


def stem(path: str) -> str:
    """The name that a library's file goes by: without version and extension; an index goes by its directory."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts:
        return ""
    last = parts[-1]
    name = m.group(1) if (m := VERSIONED.match(last)) else last.rsplit(".", 1)[0]
    if name.lower() in ("index", "main", "mod", "__init__", "lib") and len(parts) > 1:
        name = parts[-2]
    return name.lower()


def third_party(path: str) -> bool:
    """Whether a known directory of third-party files is in the path, or a versioned file name under static files."""
    parts = [p.lower() for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    way = "/" + "/".join(parts[:-1]) + "/"
    return any(f"/{known}/" in way for known in THIRD_PARTY) or bool(parts and VERSIONED.match(parts[-1]) and any(p in ("static", "public", "assets", "js", "dist") for p in parts[:-1]))


@lru_cache(maxsize=50_000)
def _glob(pattern: str) -> re.Pattern:
    """A path glob of an attribute file as a pattern on the path below that file's directory."""
    anchored = "/" in pattern.rstrip("/")
    body, i = "", 0
    text = pattern.lstrip("/")
    while i < len(text):
        if text.startswith("**/", i):
            body, i = body + r"(?:[^/]+/)*", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            body, i = body + r"/.+", i + 3
        elif text[i] == "*":
            body, i = body + (r".*" if text.startswith("**", i) else r"[^/]*"), i + (2 if text.startswith("**", i) else 1)
        elif text[i] == "?":
            body, i = body + r"[^/]", i + 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            inner = text[i + 1 : end]
            body, i = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            body, i = body + re.escape(text[i]), i + 1
    return re.compile(("" if anchored else r"(?:.*/)?") + body.rstrip("/") + r"\Z")


def _plain(path: str) -> str:
    """A path with slashes and without a leading ``./`` or slash; a dot that belongs to a name stays."""
    return re.sub(r"^(?:\./+|/+)+", "", path.replace("\\", "/"))


@lru_cache(maxsize=4096)
def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """``(glob, kind, set)`` for each mark in an attribute file, in its order; None where a mark is unspecified."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        pattern, *marks = (line[1:].partition('"')[0], *line[1:].partition('"')[2].split()) if line.startswith('"') else line.split()
        for mark in marks:
            name, _, value = mark.lstrip("-!").partition("=")
            kind = {"linguist-generated": "generated", "linguist-vendored": "vendored"}.get(name)
            if kind:
                rules.append((pattern, kind, None if mark[0] == "!" else not (mark[0] == "-" or value.lower() in ("false", "0", "no"))))
    return rules


def declared(path: str, attributes: list[tuple[str, str]]) -> dict[str, bool]:
    """What the attribute files ``(directory, text)`` of a repository say of ``path``."""
    way = _plain(path)
    out: dict[str, bool] = {}
    for directory, text in sorted(attributes, key=lambda a: (_plain(a[0]).rstrip("/").count("/") + bool(_plain(a[0])), a[0])):
        base = _plain(directory).rstrip("/")
        if base and not way.startswith(base + "/"):
            continue
        below = way[len(base) + 1 :] if base else way
        for pattern, kind, value in parse_attributes(text):
            if _glob(pattern).match(below):
                if value is None:
                    out.pop(kind, None)
                else:
                    out[kind] = value
    return out


def packages(paths: DataFrame, least_files: int = 20, least_projects: int = 5, own: float = 0.8, spread: int = 2) -> DataFrame:
    """``(dir)``: directory names mined from ``paths(id, project, dirs)``: at least ``least_files`` files of
    ``least_projects`` projects lie in sub-directories of it, and ``own`` of them in ones that no more than ``spread``
    projects have anywhere."""
    steps = paths.select("project", F.posexplode("dirs").alias("i", "dir"), "dirs").withColumn("below", F.get("dirs", F.col("i") + 1))
    held = steps.groupBy("dir").agg(F.approx_count_distinct("project").alias("held"))
    pairs = steps.where("below is not null").groupBy("dir", "below").agg(F.count("*").alias("n"), F.min("project").alias("p"), F.max("project").alias("q"))
    pairs = pairs.join(held.withColumnRenamed("dir", "below"), "below")
    sums = pairs.groupBy("dir").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held") <= spread, F.col("n")).otherwise(0)).alias("own"), F.approx_count_distinct("p").alias("projects"))
    return sums.where((F.col("n") >= least_files) & (F.col("projects") >= least_projects) & (F.col("own") >= own * F.col("n"))).select("dir")


#: What a pattern must show to be mined from declaring repositories: files and projects that have it, and the share of its
#: files that are declared.
LEAST_FILES, LEAST_PROJECTS, DECLARED = 5, 2, 0.9


def marks_of(places: DataFrame) -> DataFrame:
    """``(id, mark)``: what a pattern may go by: each directory of a path, and the ending of its file name where that is
    more than an extension, which tells a language and no tool."""
    ending = F.regexp_extract(F.lower(F.translate("path", "\\", "/")), r"((?:[._-][a-z0-9]+)+\.[a-z0-9]+)$", 1)
    marks = F.concat(F.transform("dirs", lambda d: F.concat(F.lit("dir:"), d)), F.array(F.concat(F.lit("end:"), ending)))
    return places.select("id", F.explode(F.array_distinct(marks)).alias("mark")).where("mark <> 'end:'")


def mined_patterns(places: DataFrame, said: DataFrame) -> DataFrame:
    """``(mark, kind)`` mined from files of declaring repositories: ``said(id, said)`` holds what these declare of each."""
    own = marks_of(places.join(said, "id", "left_semi")).join(said, "id").join(places.select("id", "project"), "id")
    out = None
    for kind in ("generated", "vendored"):
        yes = F.coalesce(F.try_element_at("said", F.lit(kind)), F.lit(False))
        sums = own.groupBy("mark").agg(F.count("*").alias("n"), F.count_if(yes).alias("yes"), F.approx_count_distinct("project").alias("projects"))
        found = sums.where((F.col("n") >= LEAST_FILES) & (F.col("projects") >= LEAST_PROJECTS) & (F.col("yes") >= DECLARED * F.col("n"))).select("mark", F.lit(kind).alias("kind"))
        out = found if out is None else out.unionByName(found)
    return out


def _dirs(path: Column) -> Column:
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("", "."))


SCAN = "id long, found array<string>, origin boolean, party boolean, name string, c0 long, c1 long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, codes, paths = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for own in fp.chunks(codes):
            texts = [codes[i] for i in own]
            flat, counts = fp.token_hashes(texts)
            classes = fp.text_keys(flat, counts)
            said = [kinds(t, paths[i] or "") for i, t in zip(own, texts)]
            columns = [ids.take(pa.array(own)), pa.array([sorted(k) for k, _ in said], pa.list_(pa.string())), pa.array([o for _, o in said]), pa.array([third_party(paths[i] or "") for i in own]), pa.array([stem(paths[i] or "") for i in own])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(classes[:, 0]), pa.array(classes[:, 1])], names=["id", "found", "origin", "party", "name", "c0", "c1"])


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(c0, c1, runs)`` of texts: the name of their token sequence and their exact set."""
    for batch in batches:
        codes = batch.column(0).to_pylist()
        for own in fp.chunks(codes):
            flat, counts = fp.token_hashes([codes[i] for i in own])
            values, n = fp.distinct_runs(*fp.runs(flat, counts))
            classes, ends = fp.text_keys(flat, counts), np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(classes[:, 0]), pa.array(classes[:, 1]), pa.ListArray.from_arrays(ends, values.view(np.int64))], names=["c0", "c1", "runs"])


def _copies(table: pa.Table) -> pa.Table:
    """``(name, c0, c1)`` of the texts of one name that are like one of its third-party texts."""
    table = table.combine_chunks()
    sides = [table.filter(pc.equal(table["known"], pa.scalar(known))) for known in (True, False)]
    sets = []
    for side in sides:
        runs = pa.concat_arrays(side["runs"].chunks) if side.num_rows else pa.array([], pa.list_(pa.int64()))
        sets.append((runs.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)))
    like = np.zeros(len(sets[1][1]), dtype=bool)
    for at, shared in fp.shared_runs(*sets[0], *sets[1]):
        whole = sets[0][1][None, :] + sets[1][1][at : at + len(shared), None] - shared
        like[at : at + len(shared)] = (shared / whole >= COPIED).any(axis=1)
    return sides[1].select(["name", "c0", "c1"]).filter(pa.array(like))


def copies_of(known: DataFrame, asked: DataFrame, rows: DataFrame, block: int = COPY_BLOCK) -> DataFrame:
    """``(name, c0, c1)`` of the texts in ``asked`` that are like one of the same name in ``known(name, c0, c1, id)``,
    whose texts are found by id in ``rows(id, code)``. Equal texts need no sets; all others of a name are compared in
    full, in blocks where there are many."""
    key = ["name", "c0", "c1"]
    equal = asked.join(known.select(key), key, "left_semi").select(key)
    open_ = asked.join(known.select(key), key, "left_anti")
    members = known.select(*key, "id", F.lit(True).alias("known")).unionByName(open_.select(*key, "id", F.lit(False).alias("known")))
    blocks = lambda some: F.ceil(F.count_if(some) / block).cast("int")
    sizes = members.groupBy("name").agg(blocks(F.col("known")).alias("across"), blocks(~F.col("known")).alias("down")).where("across > 0 and down > 0")
    members = materialize(members.join(sizes, "name"), "copymembers")
    wanted = materialize(members.groupBy("c0", "c1").agg(F.min("id").alias("id")).select("id").distinct(), "wanted")
    sets = join_checked(rows.select("id", "code"), wanted, "id", "left_semi").select("code").mapInArrow(_class_sets, "c0 long, c1 long, runs array<long>")
    own = F.pmod(F.xxhash64("c0", "c1"), F.when(F.col("known"), F.col("across")).otherwise(F.col("down")).cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("known"), F.col("down")).otherwise(F.col("across")) - 1))
    met = sets.join(members.drop("id"), ["c0", "c1"]).select(*key, "known", "runs", own.alias("own"), other.alias("other"))
    met = met.select(*key, "known", "runs", F.when(F.col("known"), F.col("own")).otherwise(F.col("other")).alias("across"), F.when(F.col("known"), F.col("other")).otherwise(F.col("own")).alias("down"))
    return met.groupBy("name", "across", "down").applyInArrow(_copies, "name string, c0 long, c1 long").unionByName(equal).distinct()


def _declarations(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(id, said)`` of files in repositories that have attribute files."""
    rules = attributes.where("text is not null").select(project(F.col("repo")).alias("project"), F.struct(F.regexp_replace("path", r"[^/]*$", "").alias("directory"), "text").alias("file"))
    rules = rules.where("project is not null").groupBy("project").agg(F.collect_set("file").alias("files"))  # a repository's own attribute files

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [declared(p or "", [(f["directory"], f["text"]) for f in files_]) for p, files_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x.items()) for x in said], pa.map_(pa.string(), pa.bool_()))], names=["id", "said"])

    return files.join(rules, "project").select("id", "path", "files").mapInArrow(work, "id long, said map<string, boolean>")


def not_handwritten(files: DataFrame, attributes: DataFrame | None = None, key: str = "file_id", code: str = "code", path: str = "path", repo: str = "repo") -> DataFrame:
    """``(id, kinds, reasons)`` of each file that nobody wrote by hand for its project.

    ``attributes`` holds ``(repo, path, text)`` of attribute files. Null and empty code has no row; a null path or
    repository leaves content alone to speak; rows with the same key are one file if their texts are equal.
    """
    rows = files.select(F.col(key).cast("long").alias("id"), F.col(code).alias("code"), F.col(path).alias("path"), project(F.col(repo)).alias("project")).where("id is not null and code <> ''")
    scanned = materialize(rows.select("id", "code", "path").mapInArrow(_scan, SCAN).distinct(), "scanned")
    places = materialize(rows.select("id", "project", "path", _dirs(F.col("path")).alias("dirs")).dropDuplicates(["id"]), "places")

    mined = places.select("id", F.explode("dirs").alias("dir")).join(packages(places.where("project is not null").select("id", "project", "dirs")), "dir", "left_semi").select("id").distinct()
    by_place = scanned.select("id", "party").join(mined.withColumn("mined", F.lit(True)), "id", "left").select("id", (F.col("party") | F.coalesce("mined", F.lit(False))).alias("placed"))
    placed = by_place.groupBy("id").agg(F.bool_or("placed").alias("placed"))
    if attributes is not None and not attributes.isEmpty():
        said = materialize(_declarations(places, attributes).groupBy("id").agg(F.first("said").alias("said")), "said")
        patterns = mined_patterns(places, said)
        like = marks_of(places.join(said, "id", "left_anti")).join(patterns, "mark").groupBy("id").agg(F.bool_or(F.col("kind") == "generated").alias("as_generated"), F.bool_or(F.col("kind") == "vendored").alias("as_vendored"))
        placed = placed.join(said, "id", "left").join(like, "id", "left").withColumn("placed", F.col("placed") | F.coalesce("as_vendored", F.lit(False))).withColumn("as_generated", F.coalesce("as_generated", F.lit(False))).drop("as_vendored")
    else:
        placed = placed.withColumn("said", F.lit(None).cast("map<string, boolean>")).withColumn("as_generated", F.lit(False))
    placed = materialize(placed, "placed")

    full = scanned.join(placed, "id")
    third = full.where(F.col("name") != "").where(F.col("origin") | F.coalesce(F.try_element_at("said", F.lit("vendored")), F.col("placed") & F.col("said").isNull()))
    known = materialize(third.groupBy("name", "c0", "c1").agg(F.min("id").alias("id")), "known")
    named = scanned.where(F.col("name") != "").join(known.select("name").distinct(), "name", "left_semi").select("id", "name", "c0", "c1")
    asked = materialize(named.groupBy("name", "c0", "c1").agg(F.min("id").alias("id")), "asked")
    like = materialize(copies_of(known, asked, rows), "copies")
    copies = named.join(like, ["name", "c0", "c1"], "left_semi").select("id").distinct().withColumn("copied", F.lit(True))

    out = full.join(copies, "id", "left")
    no = F.lit(False)
    marks = F.col("said")
    clear = lambda kind: F.coalesce(F.try_element_at(marks, F.lit(kind)) == no, no)
    set_ = lambda kind: F.coalesce(F.try_element_at(marks, F.lit(kind)), no)
    vendored = (F.col("placed") & marks.isNull()) | F.array_contains("found", "vendored") | F.coalesce("copied", no) | set_("vendored")
    reasons = F.array(
        F.when(set_("generated") | set_("vendored"), "declared"), F.when((F.col("placed") | F.col("as_generated")) & marks.isNull(), "place"), F.when(F.size("found") > 0, "content"), F.when(F.coalesce("copied", no), "copy of a third-party file")
    )
    kept = F.array(
        F.when((F.array_contains("found", "generated") | set_("generated") | F.col("as_generated")) & ~clear("generated"), "generated"), F.when(F.array_contains("found", "minified"), "minified"),
        F.when(F.array_contains("found", "data"), "data"), F.when(vendored & ~clear("vendored"), "vendored"),
    )
    out = out.select("id", F.array_compact(kept).alias("kinds"), F.array_compact(reasons).alias("reasons")).where(F.size("kinds") > 0)
    return out.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
