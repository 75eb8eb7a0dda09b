"""Path, scope and noise predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, file endings and extensions with a meaning of their own.
NOISE_DIRS = ["tests", "test", "testutil", "testing", "testdata", "__tests__", "docs", "docs_src", "doc", "tutorials", "tutorial", "guides", "examples", "fixtures", "benches"]
VENDOR_DIRS = ["vendor", "vendored", "_vendor", "_click", "third_party", "third-party", "external", "deps", "ext", "node_modules", "site-packages"]
INFRA_DIRS = ["node_modules", "target", ".git", ".cache", "__pycache__"]
NOISE_FILES = ["_test.go", "_test.rs", "_testing.go", ".test.ts", ".spec.ts", "target_test.go"]
SOURCE_EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "mjs", "svelte", "go", "c", "h", "cc", "cpp", "cxx", "hpp", "hh"]
CLUSTERS = {"rust": ["rs"], "python": ["py"], "typescript": ["ts", "tsx", "js", "jsx", "mjs", "svelte"], "go": ["go"], "c_cpp": ["c", "h", "cc", "cpp", "cxx", "hpp", "hh"]}


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def dirs(path: Column) -> Column:
    s = segments(path)
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def normalize_path(path: Column) -> Column:
    """Forward slashes, without drive, leading ``./`` or ``/`` and doubled slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"^[A-Za-z]:", "")
    return F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"^(\./|/)+", "")


def module_key(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def island_key(path: Column) -> Column:
    """First two components."""
    return F.array_join(F.slice(segments(path), 1, 2), "/")


def short_path(path: Column) -> Column:
    """Last three components."""
    s = segments(path)
    return F.array_join(F.slice(s, F.greatest(F.size(s) - 2, F.lit(1)), 3), "/")


def scope_facet(path: Column) -> Column:
    """First two directories, with a slash at the end."""
    d = F.slice(dirs(path), 1, 2)
    return F.when(F.size(d) > 0, F.concat(F.array_join(d, "/"), F.lit("/"))).otherwise(F.lit(""))


# ---------------------------------------------------------------- discovery


def ext_filter(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def dir_prune(path: Column, skip: list[str] = ()) -> Column:
    """A directory of the path is infrastructure, bundled or skipped; whole names only."""
    names = [*dict.fromkeys([*INFRA_DIRS, *VENDOR_DIRS, *skip])]
    return F.arrays_overlap(dirs(F.lower(path)), F.array(*map(F.lit, names)))


def priority_wave(path: Column) -> Column:
    """0 sources, 1 libraries, 2 the rest, 3 tests, docs and examples."""
    p = F.concat(F.lit("/"), F.lower(path))
    return (
        F.when(p.rlike("/(tests?|docs?|examples|benches|fixtures)/"), 3).when(p.rlike("/src/"), 0).when(p.rlike("/(lib|pkg|crates|packages)/"), 1).otherwise(2)
    )


def path_plan_priority(path: Column, first: list[str], defer: list[str]) -> Column:
    """Position among the first prefixes (0..50), 100 by default, 200 and up for deferred ones."""
    out = F.lit(100)
    for i in reversed(range(len(first))):
        out = F.when(F.startswith(path, F.lit(first[i])), min(i, 50)).otherwise(out)
    for i in reversed(range(len(defer))):
        out = F.when(F.startswith(path, F.lit(defer[i])), 200 + min(i, 50)).otherwise(out)
    return out


# ---------------------------------------------------------------- scopes


def scope_blank(scope: str | None) -> bool:
    return scope is None or scope.strip().strip("/") in ("", ".")


def scope_sanitize(scope: str) -> str | None:
    """Repository-relative form, or nothing for absolute and host paths."""
    s = scope.strip().replace("\\", "/")
    if s.startswith(("/", "~")) or "://" in s or s[1:2] == ":":
        return None
    parts: list[str] = []
    for x in s.split("/"):
        if x == "..":
            if not parts:
                return None
            parts.pop()
        elif x not in ("", "."):
            parts.append(x)
    return "/".join(parts) + ("/" if s.endswith("/") and parts else "")


def scope_file_src(scope: str) -> bool:
    name = scope.rsplit("/", 1)[-1]
    return "." in name and name.rsplit(".", 1)[1].lower() in SOURCE_EXTENSIONS


def scope_file_src_col(scope: Column) -> Column:
    """``scope_file_src`` over a column."""
    name = F.element_at(F.split(scope, "/"), -1)
    return name.contains(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SOURCE_EXTENSIONS)


def scope_sanitize_col(scope: Column) -> Column:
    """``scope_sanitize`` over a column: the parts are folded, a ``..`` taking the last one away."""
    s = F.translate(F.trim(scope), "\\", "/")
    no = F.lit(None).cast("array<string>")

    def step(parts: Column, x: Column) -> Column:
        up = F.when(F.size(parts) > 0, F.slice(parts, F.lit(1), F.size(parts) - 1))
        return F.when(parts.isNull(), no).when(x == "..", up).when((x == "") | (x == "."), parts).otherwise(F.concat(parts, F.array(x)))

    parts = F.aggregate(F.split(s, "/"), F.array().cast("array<string>"), step)
    tail = F.when(F.endswith(s, F.lit("/")) & (F.size(parts) > 0), "/").otherwise("")
    return F.when(~s.rlike("^[/~]|://|^.:"), F.concat(F.array_join(parts, "/"), tail))


def scope_dir(path: Column, scope: str) -> Column:
    """Root-anchored prefix, or the pinned file."""
    s = scope.strip("/")
    return (path == s) | F.startswith(path, F.lit(s + "/"))


def scope_file(path: Column, pattern: str) -> Column:
    """The path, a suffix of whole components, or the base name where the pattern has no slash."""
    p = pattern.strip("/")
    hit = (path == p) | F.endswith(path, F.lit("/" + p))
    return hit if "/" in p else hit | (basename(path) == p)


def scope_ignore(path: Column, pattern: str) -> Column:
    """A component anywhere, or (with a slash) any part of the path."""
    p = pattern.strip("/")
    return F.contains(path, F.lit(p)) if "/" in p else F.array_contains(segments(path), p)


def scope_include(path: Column, scopes: list[str], files: list[str] = (), ignore: list[str] = ()) -> Column:
    """Any ignored pattern wins; else any scope or file pattern, all if none is given."""
    keep = F.lit(not any(not scope_blank(s) for s in scopes) and not files)
    for s in scopes:
        if not scope_blank(s):
            keep = keep | scope_dir(path, s)
    for f in files:
        keep = keep | scope_file(path, f)
    for i in ignore:
        keep = keep & ~scope_ignore(path, i)
    return keep


def scope_in_neighbor(path: Column, scope: str) -> Column:
    s = scope.strip("/")
    return F.startswith(path, F.lit(s)) | F.contains(path, F.lit("/" + s)) | F.endswith(path, F.lit(s))


# ---------------------------------------------------------------- noise


def vendored(path: Column) -> Column:
    return F.arrays_overlap(dirs(F.lower(path)), F.array(*map(F.lit, VENDOR_DIRS)))


def noise_filename(path: Column) -> Column:
    b = basename(F.lower(path))
    hit = F.startswith(b, F.lit("test_")) | b.rlike(r"_tests?\.[^.]+$") | b.rlike(r"\.(test|spec)\.[^.]+$") | b.isin("conftest.py", "tests.rs", "test.rs")
    for x in NOISE_FILES:
        hit = hit | F.endswith(b, F.lit(x))
    return hit


def noise_block(path: Column) -> Column:
    """A noise directory by its whole name, or a test file."""
    return F.arrays_overlap(dirs(F.lower(path)), F.array(*map(F.lit, [*NOISE_DIRS, *VENDOR_DIRS]))) | noise_filename(path)


def testish_neighbor(path: Column) -> Column:
    return noise_block(path) | F.lower(path).rlike(r"(^|/)tests?(/|$)|_test\.|\.test\.|\.spec\.")


def cluster_of(lang: Column, path: Column) -> Column:
    out = F.lit("other")
    for name, exts in CLUSTERS.items():
        out = F.when(F.lower(lang).isin(name, *exts) | (F.coalesce(lang, F.lit("")).isin("", "unknown") & extension(path).isin(*exts)), name).otherwise(out)
    return F.when(F.lower(lang).isin("c", "cpp", "c++"), "c_cpp").when(F.lower(lang) == "javascript", "typescript").otherwise(out)


def app_path_priority(path: Column, first: list[str] = ("src", "lib", "app", "core"), later: list[str] = ("tools", "scripts")) -> Column:
    """200 less the index of an application prefix, 100 less that of a later one, 20 vendored, 10 noise, 50 otherwise, 150 for a crate's src."""
    out = F.lit(50)
    for i in reversed(range(len(later))):
        out = F.when(F.startswith(path, F.lit(later[i] + "/")), 100 - i).otherwise(out)
    out = F.when(path.rlike(r"^(crates|packages|pkg)/[^/]+/src/"), 150).otherwise(out)
    for i in reversed(range(len(first))):
        out = F.when(F.startswith(path, F.lit(first[i] + "/")), 200 - i).otherwise(out)
    return F.when(vendored(path), 20).when(noise_block(path), 10).otherwise(out)


def basename_match(path: Column, name: Column) -> Column:
    return F.lower(stem(path)) == F.lower(name)


def stem_match(path: Column, name: Column) -> Column:
    """120 if the stem is the name, or ends or begins with it at an underscore."""
    s, n = F.lower(stem(path)), F.lower(name)
    hit = (s == n) | F.endswith(s, F.concat(F.lit("_"), n)) | F.startswith(s, F.concat(n, F.lit("_")))
    return F.when(hit, 120).otherwise(0)


def file_tree2(files, cap: int = 40):
    """Two-level directory histogram of ``files(file)``: (dir, n_files), largest first."""
    d = F.array_join(F.slice(dirs(F.col("file")), 1, 2), "/")
    return files.select(F.when(d == "", ".").otherwise(d).alias("dir"), "file").groupBy("dir").agg(F.countDistinct("file").alias("n_files")).orderBy(F.desc("n_files"), "dir").limit(cap)
