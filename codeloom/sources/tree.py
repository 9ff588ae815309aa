"""Source trees: files below roots, ignore rules, vendor policy, module maps, configuration."""

from __future__ import annotations

import collections
import functools
import json
import os
import posixpath
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..extract.run import LANGUAGES
from ..functions.predicates import VENDOR_FOLDERS
from ..functions.scalars import sha256_hex
from ..plans.fixpoint import checkpointed

DEFAULT_CONFIG = {"include": ["."], "exclude": [], "vendor": "index"}
IGNORE_FILE, MODULE_FILES = ".gitignore", ("go.mod", "package.json")
#: Files and folders that a task meets below one folder before it hands the rest back, and tasks of a round at most.
ENTRIES, MOST_TASKS = 20_000, 2_000
WALK = "path string, uri string, size long, mtime_ns long, vendor boolean, module boolean"
RULES_DDL = "array<struct<folder:string,line:string>>"
RULES = pa.list_(pa.struct([("folder", pa.string()), ("line", pa.string())]))
LISTED = pa.schema([("path", pa.string()), ("uri", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("vendor", pa.bool_()), ("module", pa.bool_()), ("rules", RULES)])


def config(text=None):
    """Settings from YAML text: include, exclude, vendor (index or skip)."""
    out = dict(DEFAULT_CONFIG)
    if text:
        import yaml

        out |= {k: v for k, v in (yaml.safe_load(text) or {}).items() if k in out and v}
    if out["vendor"] not in ("index", "skip"):
        raise ValueError(f"vendor must be index or skip, not {out['vendor']!r}")
    return out


def _base(root):
    """A tree's root as a URI without a slash at its end."""
    return (root if ":/" in root else "file:" + posixpath.abspath(root)).rstrip("/")


def _opened(uri):
    """(file system, path in it) of a URI, in whichever process asks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def children(system, folder):
    """(name, is a folder, size, mtime_ns) of what a folder holds. Links to folders are not followed, so walks end."""
    if system.type_name == "local":
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0, 0
                elif e.is_file():
                    stat = e.stat()
                    yield e.name, False, stat.st_size, stat.st_mtime_ns
        return
    from pyarrow import fs

    for e in system.get_file_info(fs.FileSelector(folder)):
        if e.type != fs.FileType.NotFound:
            yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime_ns or 0


def _lines(system, path):
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace").splitlines()


@functools.lru_cache(maxsize=1 << 14)
def _compiled(line, folder):
    found = ignore_regex(line, folder)
    return found and (re.compile(found[0]), found[1])


def is_ignored(path, rules):
    """Whether the last of the rules [(folder, line)] that fits a path ignores it; a folder's path ends with a slash."""
    for folder, line in reversed(rules):
        found = _compiled(line, folder)
        if found and found[0].match(path):
            return not found[1]
    return False


def _listed(system, top, base, folder, rules, settings, source_name):
    """Files and subfolders of one folder: rows of WALK and [(subfolder, its rules)]. Ignored ones are left out, vendor ones by the policy only."""
    found = sorted(children(system, f"{top}/{folder}" if folder else top))
    vendor = bool(VENDOR_FOLDERS & set(folder.split("/")))
    if not vendor and any(name == IGNORE_FILE and not is_folder for name, is_folder, _, _ in found):
        rules = [*rules, *((folder, line) for line in _lines(system, f"{top}/{folder}/{IGNORE_FILE}" if folder else f"{top}/{IGNORE_FILE}"))]
    all_rules = [*rules, *(("", e) for e in settings["exclude"])]
    files, below = [], []
    for name, is_folder, size, mtime in found:
        path = f"{folder}/{name}" if folder else name
        if is_folder:
            own = vendor or name in VENDOR_FOLDERS
            if name != ".git" and not (settings["vendor"] == "skip" if own else is_ignored(path + "/", all_rules)):
                below.append((path, rules))
        elif not vendor and name in MODULE_FILES:
            files.append((path, f"{base}/{path}", size, mtime, False, True))
        elif source_name.search(name) and (vendor or not is_ignored(path, all_rules)):
            files.append((path, f"{base}/{path}", size, mtime, vendor, False))
    return files, below


def walk(spark, root, settings=None):
    """path (below root), uri, size, mtime_ns, vendor, module of a tree's source files and module files, once each.

    Folders are listed in tasks. A task goes down from each folder it is given until it has met ENTRIES files and folders, and hands
    back the folders it didn't come to, which are dealt out for the next round; so a small tree is one task's work and a large one as many tasks'
    as it has folders. An ignored folder is not entered, nor what lies below it; a vendor folder is entered whatever the ignore rules say, or not
    at all if the policy is skip. Nothing but the number of folders left reaches the driver.
    """
    settings = settings or DEFAULT_CONFIG
    base = _base(root)
    source_name = re.compile(f"(?i)({'|'.join(re.escape(e) for e in sorted(LANGUAGES))})$")

    def run(batches):
        system, top = _opened(base)
        for batch in batches:
            for start in batch.to_pylist():
                todo = collections.deque([(start["path"], [(r["folder"], r["line"]) for r in start["rules"]])])
                met = 0
                while todo and met < ENTRIES:
                    files, below = _listed(system, top, base, *todo.popleft(), settings, source_name)
                    met += len(files) + len(below) + 1
                    todo.extend(below)
                    if files:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)] + [pa.nulls(len(files), RULES)], schema=LISTED)
                if todo:
                    paths, rules = zip(*todo, strict=True)
                    n = len(paths)
                    rules = pa.array([[{"folder": f, "line": x} for f, x in r] for r in rules], RULES)
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), rules], schema=LISTED)

    frontier = spark.createDataFrame(_starts(base, settings), f"path string, rules {RULES_DDL}")
    found = None
    while True:
        listed = checkpointed(frontier.mapInArrow(run, f"{WALK}, rules {RULES_DDL}"))
        files = listed.where("rules IS NULL").drop("rules")
        found = files if found is None else found.unionAll(files)
        left = listed.where("rules IS NOT NULL").select("path", "rules")
        n = left.count()
        if not n:
            return found
        frontier = left.repartition(min(n, MOST_TASKS))


def _starts(base, settings):
    """The included folders, none within another, each with the ignore rules of the folders above it."""
    from pyarrow import fs

    included = sorted({posixpath.normpath(i.strip("/") or ".") for i in settings["include"]})
    included = ["" if i == "." else i for i in included]
    included = [i for i in included if not any(o != i and (not o or i.startswith(o + "/")) for o in included)]
    if included == [""]:
        return [("", [])]
    system, top = _opened(base)
    out = []
    for folder in included:
        above, rules = folder.split("/")[:-1], []
        for k in range(len(above) + 1):
            outer = "/".join(above[:k])
            path = f"{top}/{outer}/{IGNORE_FILE}" if outer else f"{top}/{IGNORE_FILE}"
            if system.get_file_info(path).type == fs.FileType.File:
                rules += [(outer, line) for line in _lines(system, path)]
        out.append((folder, rules))
    return out


def contents(files, missing="raise"):
    """files with a column content, read where the tasks run; only what is asked for is opened. missing="null" gives null for files that are gone."""
    names = files.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content binary"

    def run(batches):
        for batch in batches:
            out = []
            for uri in batch.column(names.index("uri")).to_pylist():
                system, path = _opened(uri)
                try:
                    with system.open_input_stream(path) as f:
                        out.append(f.read())
                except FileNotFoundError:
                    if missing == "raise":
                        raise
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "content"])

    return files.mapInArrow(run, schema)


def texts(root):
    """A function that gives path, content of files(path) of a tree as text; null content for those that are gone. Nothing is listed."""
    base = _base(root)

    def of(files):
        placed = files.select("path", F.concat(F.lit(base + "/"), "path").alias("uri"))
        return contents(placed, missing="null").select("path", F.col("content").cast("string").alias("content"))

    return of


def ignore_regex(pattern, folder=""):
    """(regular expression over paths, whether it takes back) of one ignore line of a folder; None for blanks and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line.removeprefix("!").removeprefix("\\")
    only_folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + line[i + 1 : end].replace("\\", "\\\\").replace("!", "^", line[i + 1] == "!") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    head = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    return f"^{head}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_folder else '(?:/.*)?'}$", back


def hashed(files):
    """Files with content and its hash."""
    return contents(files).withColumn("hash", sha256_hex(F.col("content")))


def go_module(text):
    m = re.search(r"(?m)^module\s+(\S+)", text or "")
    return m[1].strip('"') if m else None


def package_name(text):
    try:
        name = json.loads(text).get("name")
    except (ValueError, AttributeError):
        return None
    return name if isinstance(name, str) and name else None


def modules(files):
    """{'go': {root: module}, 'js': {name: root}} from a tree's module files, as walk() gives them; the two kinds never mix."""
    out: dict = {"go": {}, "js": {}}
    for path, text in contents(files.where("module")).select("path", F.col("content").cast("string")).collect():
        root = posixpath.dirname(path)
        if path.endswith("go.mod"):
            if name := go_module(text):
                out["go"][root or "."] = name
        elif name := package_name(text):
            out["js"][name] = root
    return out
