"""Nodes and edges of the affinity graph from the facts of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import paths as P

from . import anchors as anchor_ops
from . import bridge, graph, imports, resolve

#: How a class signature names what it inherits from.
EXTENDS, IMPLEMENTS = r"extends\s+([A-Za-z_$][\w$.]*)", r"implements\s+([A-Za-z_$][\w$.,\s]*)"


def file_node(file: str = "file"):
    return F.concat(F.lit("file:"), F.col(file))


def nodes(files: DataFrame, symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """(node, name, kind, file, line, sig, lang) of files (file, lang), symbols and anchors (label, file, line)."""
    lang = files.select("file", "lang")
    a = files.select(file_node().alias("node"), F.col("file").alias("name"), F.lit("file").alias("kind"), "file", F.lit(0).alias("line"), F.lit("").alias("sig"), "lang")
    order = Window.partitionBy("name", "file").orderBy("line", "kind")
    first = symbols.withColumn("k", F.row_number().over(order)).where("k = 1")
    b = first.join(lang, "file", "left").select(F.concat_ws("@", "name", "file").alias("node"), "name", "kind", "file", "line", "sig", "lang")
    c = sites.select(F.concat(F.lit("anchor:"), "label").alias("node"), F.col("label").alias("name"), F.lit("anchor").alias("kind"), "file", "line", F.lit("").alias("sig"), F.lit(None).cast("string").alias("lang"))
    return a.unionByName(b).unionByName(c)


def contains(symbols: DataFrame) -> DataFrame:
    """(src, dst): each file and what it defines."""
    return symbols.select(file_node().alias("src"), F.concat_ws("@", "name", "file").alias("dst")).distinct()


def names(symbols: DataFrame) -> DataFrame:
    """(key, target, target_file): symbols by lower-case name, and by what follows the first dot of it."""
    low = F.lower("name")
    short = F.when(F.instr("name", ".") > 1, F.substring(low, F.instr("name", ".") + 1, F.length("name")))
    keys = F.array_compact(F.array_distinct(F.array(low, short)))
    return symbols.select(F.explode(keys).alias("key"), F.concat_ws("@", "name", "file").alias("target"), F.col("file").alias("target_file")).where("key <> ''").distinct()


def inherits(symbols: DataFrame, by_name: DataFrame | None = None) -> DataFrame:
    """(src, dst): classes (name, kind, file, sig) and all symbols of the names that they extend or implement."""
    by_name = names(symbols) if by_name is None else by_name
    listed = F.transform(F.split(F.regexp_extract("sig", IMPLEMENTS, 1), ","), lambda s: F.trim(s))
    said = F.array_distinct(F.concat(F.regexp_extract_all("sig", F.lit(EXTENDS), 1), listed))
    each = symbols.where("kind = 'class'").select(F.concat_ws("@", "name", "file").alias("src"), F.explode(said).alias("parent")).where("parent <> ''")
    return each.select("src", F.lower("parent").alias("key")).join(by_name, "key").select("src", F.col("target").alias("dst")).where("src <> dst").distinct()


def tests(resolved: DataFrame) -> DataFrame:
    """(src, dst): test files and the files that they import, of ``imports.resolve``."""
    return resolved.where(P.is_test_file(F.col("file"))).select(file_node().alias("src"), file_node("target").alias("dst")).distinct()


def enclosed(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites (file, line, site) with node: the symbol begun last before, else the file."""
    begun = symbols.select("file", F.col("line").cast("int").alias("line"), F.concat_ws("@", "name", "file").alias("symbol"))
    return resolve.enclosing(sites, begun).select("site", "file", F.coalesce("symbol", file_node()).alias("node"))


def calls(sites: DataFrame, symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst, w): callers and what they call, of calls (site, file, line, callee): of the same file, else of imported ones, else the only one."""
    at = enclosed(sites.select("file", "line", "site"), symbols)
    asked = anchor_ops.telling_calls(sites).join(at.select("site", "node"), "site").select(F.col("site").alias("call"), "file", F.lower("callee").alias("key"), F.col("node").alias("caller"))
    pairs = resolved.select("file", F.col("target").alias("target_file"), F.lit(True).alias("imported")).distinct()
    targets = names(symbols)
    near = resolve.tiered(asked.join(F.broadcast(pairs.groupBy("file").agg(F.collect_set("target_file").alias("known"))), "file", "left"), targets, ["file = target_file", "array_contains(known, target_file)", "candidates = 1"])
    return near.join(asked.select("call", "caller"), "call").select(F.col("caller").alias("src"), F.col("target").alias("dst"), "w").where("src <> dst")


def assemble(files: DataFrame, symbols: DataFrame, imported: DataFrame, called: DataFrame, literals: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree's facts: edges (src, dst, kind, w, ord) for ``Engine``.

    files (file, lang), symbols (name, kind, file, line, sig), imported (site, file, spec), called (site, file, line,
    callee), literals (file, line, text) and sites of anchors (label, file, line, implicit).
    """
    resolved = graph.kept(imports.resolve(imported, files))
    link = resolved.select(file_node().alias("src"), file_node("target").alias("dst")).distinct()
    held = literals.select("file", "line", F.struct("line", "text").alias("site"), "text").distinct()
    joined = bridge.bridges(enclosed(held.select("file", "line", "site"), symbols).select("file", "node", F.col("site.line").alias("line"), F.col("site.text").alias("text")))
    owners = enclosed(sites.select("file", "line", F.struct("label", "line").alias("site")), symbols).select(F.col("site.label").alias("label"), F.col("site.line").alias("line"), "file", F.col("node").alias("handler"))
    handled = sites.join(owners.distinct(), ["label", "file", "line"])
    anchored = graph.anchor_edges(handled.select(F.concat(F.lit("anchor:"), "label").alias("label"), "handler", file_node().alias("file"), "implicit"))
    edges = graph.assemble(contains(symbols), link, tests(resolved), calls(called, symbols, resolved), inherits(symbols), joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), anchored)
    kinds = F.array_position(F.array(*map(F.lit, ("contains", "imports", "tests", "invokes", "inherits", "join", "anchors"))), F.col("kind"))
    ordered = edges.withColumn("ord", F.shiftleft(kinds.cast("long"), 56) + F.shiftright(F.xxhash64("src", "dst", "kind"), 9) + F.lit(1 << 54))
    return nodes(files, symbols, anchor_ops.collapse(sites)), ordered
