"""A Rust workspace as a graph: files are scanned in the tasks, then linked by joins."""

from __future__ import annotations

import glob
import os
import re
import tomllib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from ..operators import link
from ..runtime import saved
from . import rust_syntax
from .evidence import mir_edges

SKIPPED = {".git", ".worktrees", "target", "node_modules"}
ROW = "what string, crate string, path string, number long, kind string, name string, qualified_name string, start_line long, end_line long, visibility string, signature string, docs string, lines long, src_number long, dst_number long, target string, strategy string, call_style string"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]
_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ROW.split(", ")])


def find_projects(root: str, max_depth: int = 4) -> list[str]:
    """Folders with a manifest, by name; build and version-control folders are not entered."""
    found = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in SKIPPED and not n.startswith(".") and os.path.relpath(folder, root).count(os.sep) + 1 < max_depth + 1)
        if "Cargo.toml" in files:
            found.append(folder)
    return sorted(found)


def find_manifest(folder: str) -> str:
    """The manifest of a folder, else of its nearest ancestor that has one."""
    here = os.path.abspath(folder)
    while not os.path.exists(f"{here}/Cargo.toml"):
        if os.path.dirname(here) == here:
            raise FileNotFoundError(f"no Cargo.toml in {folder} or above it")
        here = os.path.dirname(here)
    return f"{here}/Cargo.toml"


def _read(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def _members(root: str) -> list[str]:
    """Folders of a workspace's packages: its own, those it lists, and those that these depend on by a path inside it."""
    top = _read(f"{root}/Cargo.toml")
    space = top.get("workspace", {})
    out = [os.path.normpath(f) for p in space.get("exclude", []) for f in glob.glob(f"{root}/{p}")]
    waiting = [root] if "package" in top else []
    waiting += sorted(os.path.normpath(f) for p in space.get("members", []) for f in glob.glob(f"{root}/{p}"))
    found: list[str] = []
    while waiting:
        folder = waiting.pop(0)
        if folder in found or folder in out or not os.path.exists(f"{folder}/Cargo.toml"):
            continue
        found.append(folder)
        data = _read(f"{folder}/Cargo.toml")
        for part in ("dependencies", "dev-dependencies", "build-dependencies"):
            for d in data.get(part, {}).values():
                if isinstance(d, dict) and "path" in d and (near := os.path.normpath(f"{folder}/{d['path']}")).startswith(root + "/"):
                    waiting.append(near)
    return found


def workspace(folder: str) -> tuple[str, list[str]]:
    """(root, packages' folders) of the workspace that a folder belongs to; a package outside of any is its own."""
    own = os.path.dirname(find_manifest(folder))
    if "workspace" not in _read(f"{own}/Cargo.toml"):
        above = os.path.dirname(own)
        while above != os.path.dirname(above):
            if os.path.exists(f"{above}/Cargo.toml") and own in _members(above):
                return above, _members(above)
            above = os.path.dirname(above)
    return own, _members(own)


def _targets(folder: str, data: dict) -> list[dict]:
    """What a package builds, of the sources that exist: library, programs, examples, tests, benchmarks, build script."""
    name = data["package"]["name"]
    lib = data.get("lib", {})
    kinds = ["proc-macro"] if lib.get("proc-macro") else lib.get("crate-type", ["lib"])
    out = [(lib.get("name", name.replace("-", "_")), kinds, lib.get("path", "src/lib.rs"))]
    for kind, table, where in (("bin", "bin", "src/bin"), ("example", "example", "examples"), ("test", "test", "tests"), ("bench", "bench", "benches")):
        some = [("src/main.rs", name)] if kind == "bin" else []
        if data["package"].get(f"auto{where.rsplit('/', 1)[-1] if kind != 'bin' else 'bins'}", True):
            some += sorted((os.path.relpath(f, folder), os.path.splitext(os.path.basename(f))[0]) for f in glob.glob(f"{folder}/{where}/*.rs"))
            some += sorted((os.path.relpath(f, folder), os.path.basename(os.path.dirname(f))) for f in glob.glob(f"{folder}/{where}/*/main.rs"))
        named = {t["name"]: t.get("path") for t in data.get(table, []) if "name" in t}
        for n, path in named.items():
            usual = [p for p, other in some if other == n]
            out.append((n, [kind], path or (usual or [f"{where}/{n}.rs"])[0]))
        out += [(n, [kind], p) for p, n in some if n not in named and p not in named.values()]
    out.append(("build-script-build", ["custom-build"], data["package"].get("build") or "build.rs"))
    return [{"name": n, "kind": k, "src_path": os.path.normpath(f"{folder}/{p}")} for n, k, p in out if isinstance(p, str) and os.path.isfile(f"{folder}/{p}")]


def manifest(folder: str) -> dict | None:
    """(name, manifest_path, targets, description) of a package; None for a bare workspace."""
    data = _read(f"{folder}/Cargo.toml")
    if "package" not in data:
        return None
    about = data["package"].get("description")
    return {"name": data["package"]["name"], "manifest_path": f"{folder}/Cargo.toml", "targets": _targets(folder, data), "description": about if isinstance(about, str) else None}


def _ignored(root: str) -> list[tuple[str, bool]]:
    """(pattern on paths below the root, whether it takes paths back in) of all ignore files there, in order; none outside version control."""
    if not os.path.exists(f"{root}/.git"):
        return []
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in SKIPPED)
        if ".gitignore" not in files:
            continue
        base = os.path.relpath(folder, root).removeprefix(".")
        with open(f"{folder}/.gitignore") as f:
            for line in map(str.rstrip, f):
                if not line or line.startswith("#"):
                    continue
                back, line = line.startswith("!"), line.removeprefix("!")
                body = line.strip("/")
                glob_ = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", body))
                anywhere = "" if "/" in line.rstrip("/") else "(?:.*/)?"
                out.append((f"^{re.escape(base + '/') if base else ''}{anywhere}{glob_}{'/' if line.endswith('/') else '(?:/|$)'}", back))
    return out


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, crate, root, source in zip(*(c.to_pylist() for c in batch.columns)):
            base = {"crate": crate, "path": path}
            try:
                sink = rust_syntax.scan(path, crate, root, source)
            except (rust_syntax.ParseError, IndexError, KeyError) as e:
                rows.append(base | {"what": "warning", "name": f"{path}: {e}"})
                continue
            for what, part in (("node", sink.nodes), ("edge", sink.edges), ("pending", sink.pending)):
                rows += [base | {"what": what} | {k: x for k, x in r.items() if k in _COLUMNS} | ({"start_line": r["line"]} if "line" in r else {}) for r in part]
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def scan_files(files: DataFrame) -> DataFrame:
    """Rows of nodes, edges, pending edges and warnings of (path, crate, root, source)."""
    return files.select("path", "crate", "root", "source").mapInArrow(_scan, ROW)


def read_sources(spark: SparkSession, root: str, packages: list[dict], include_tests: bool = True) -> DataFrame:
    """(path, crate, root, source) of all Rust files beside or below a target's source, paths relative to the workspace.

    A file belongs to the first target that has it.  Ignored files and build
    output are left out.
    """
    targets = [(f"{os.path.dirname(t['src_path'])}", p["name"], n) for n, (p, t) in enumerate((p, t) for p in packages for t in p["targets"])]
    if not targets:
        return spark.createDataFrame([], "path string, crate string, root string, source string")
    tops = sorted({f for f, _, _ in targets})
    tops = [f for f in tops if not any(f.startswith(o + "/") for o in tops)]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.rs").option("recursiveFileLookup", True).load(tops)
    files = raw.select(F.regexp_replace("path", r"^file:(//)?", "").alias("full"), F.decode("content", "utf-8").alias("source"))
    files = files.withColumn("path", F.expr(f"substring(full, {len(root) + 2})")).where(~F.col("path").rlike(r"(^|/)(target|\.git)/"))
    gone = F.lit(False)
    for pattern, back in _ignored(root):
        gone = F.when(F.col("path").rlike(pattern), F.lit(not back)).otherwise(gone)
    files = files.where(~gone)
    if not include_tests:
        files = files.where(~F.col("path").rlike(r"(^|/)tests/"))
    parts = F.split("full", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    # as many rows as the manifests name targets
    owners = F.broadcast(spark.createDataFrame(targets, "folder string, crate string, number int"))
    own = files.select("path", F.explode(above).alias("folder")).join(owners, "folder").groupBy("path").agg(F.min_by(F.struct("crate", "folder"), "number").alias("o"))
    return files.join(own, "path").select("path", "o.crate", F.expr(f"substring(o.folder, {len(root) + 2})").alias("root"), "source")


def index(spark: SparkSession, folder: str, include_tests: bool = True, profile: str = "default", features: list[str] = (), all_features: bool = False, no_default_features: bool = False, target: str | None = None, mir: str | None = None) -> SymbolGraph:
    """The graph of the workspace that a folder belongs to.

    A file that cannot be parsed becomes a warning.  Names are resolved once
    all files are scanned; pending edges that stay open are dropped.  The build
    settings are kept with the graph; ``mir`` names the compiler's intermediate
    text, whose calls confirm edges or add them.
    """
    top, members = workspace(folder)
    packages = [p for p in map(manifest, members) if p]
    rows = saved(scan_files(read_sources(spark, top, packages, include_tests)))
    below = lambda path: os.path.relpath(path, top)
    roots = [("project", os.path.basename(top) or "project", top, None, None, 0), *(("crate", p["name"], p["name"], below(p["manifest_path"]), p["description"], n) for n, p in enumerate(packages, 1))]
    head = spark.createDataFrame(roots, "kind string, name string, qualified_name string, file string, docs string, number long").withColumn("path", F.lit(""))
    nodes = rows.where("what = 'node'").select("path", "number", "kind", "name", "qualified_name", F.col("path").alias("file"), "start_line", "end_line", "visibility", "signature", "docs", "lines")
    nodes = nodes.unionByName(head, allowMissingColumns=True)
    from .star import numbered

    nodes = saved(link.unique_ids(numbered(nodes, "path", "number")))
    key = nodes.select("path", "number", "id")
    src, dst = key.select("path", F.col("number").alias("src_number"), F.col("id").alias("src")), key.select("path", F.col("number").alias("dst_number"), F.col("id").alias("dst"))
    common = {"weight": F.lit(1).cast("bigint"), "label": F.lit(None).cast("string"), "profiles": F.array(F.lit(profile))}
    evidence = F.when(F.col("start_line").isNotNull(), F.struct(F.col("path").alias("file"), F.col("start_line").alias("line")))
    certain = rows.where("what = 'edge'").join(src, ["path", "src_number"]).join(dst, ["path", "dst_number"]).select("path", "src", "dst", "kind", F.lit(None).cast("string").alias("call_style"), "start_line")
    pending = rows.where("what = 'pending'").join(src, ["path", "src_number"]).withColumn("file", F.col("path"))
    linked = link.resolve(pending.withColumn("ord", F.monotonically_increasing_id()).select("ord", "path", "src", "target", "file", "strategy", F.col("kind").alias("edge_kind"), "call_style", "start_line"), nodes)
    certain = certain.unionByName(linked.select("path", "src", "dst", F.col("edge_kind").alias("kind"), "call_style", "start_line"))
    crates = nodes.where("kind = 'crate'").select(F.col("name").alias("crate"), F.col("id").alias("crate_id"))
    files = nodes.where("kind = 'file'").join(rows.where("what = 'node' and kind = 'file'").select("path", "crate"), "path").join(crates, "crate").select("path", F.col("crate_id").alias("src"), F.col("id").alias("dst"))
    project_id = f"project:{top}".replace(" ", "_")
    files = files.unionByName(crates.select(F.lit("").alias("path"), F.lit(project_id).alias("src"), F.col("crate_id").alias("dst")))
    certain = certain.unionByName(files.select("path", "src", "dst", F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("call_style"), F.lit(None).cast("bigint").alias("start_line")))
    edges = certain.withColumns(common).withColumns({"evidence": evidence, "source": F.lit("ast"), "certainty": F.lit("definite")}).drop("start_line", "path").withColumn("ord", F.monotonically_increasing_id())
    edges = saved(link.upsert(edges))
    dispatch = link.trait_dispatch(edges, nodes).withColumns(common | {"kind": F.lit("possible_dispatch"), "call_style": F.lit(None).cast("string"), "evidence": F.lit(None).cast(edges.schema["evidence"].dataType), "source": F.lit("inferred"), "certainty": F.lit("possible"), "ord": F.lit(1 << 60)})
    edges = edges.unionByName(dispatch)
    if mir:
        text = spark.read.text(mir, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
        more = mir_edges(text, nodes).withColumns(common | {"call_style": F.lit(None).cast("string"), "evidence": F.lit(None).cast(edges.schema["evidence"].dataType), "ord": F.lit((1 << 60) + 1)})
        edges = edges.unionByName(more)
    edges = link.upsert(edges)
    warnings = [r.name for r in rows.where("what = 'warning'").select("name").collect()]
    return SymbolGraph(nodes.drop("path", "number"), saved(numbered(edges.drop("ord"), "src", "dst", "kind")), [{"name": p["name"], "manifest_path": below(p["manifest_path"]), "targets": [t | {"src_path": below(t["src_path"])} for t in p["targets"]]} for p in packages], warnings, [{"name": profile, "features": list(features), "all_features": all_features, "no_default_features": no_default_features, "target": target}], top)
