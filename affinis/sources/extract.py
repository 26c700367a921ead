"""What a file says, as rows of one table: (file, fact, line, name, kind, sig)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions import paths as P
from affinis.operators import anchors, discover, structure

from . import files as F_


def rows(df: DataFrame, fact: str, name, line="line", kind=None, sig=None) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return df.select("file", F.lit(fact).alias("fact"), F.col(line).cast("int").alias("line") if isinstance(line, str) else line.cast("int").alias("line"), name.alias("name"), text(kind).alias("kind"), text(sig).alias("sig"))


def by_content(sources: DataFrame) -> DataFrame:
    """Symbols, imports, calls, literals and signatures of calls in sources (file, lang, text).

    Python has its own parser, which says ``failed`` of what it can't read; others have patterns for definitions and
    imports, and the structural scan for calls. A signature is a call's quoted argument: its key, whether it is a path,
    and which one.
    """
    calls = structure.calls(sources)
    lines = F_.lines(sources).join(sources.select("file", "lang"), "file")
    texts = F_.config_literals(lines).unionByName(F_.template_literals(lines.where("lang is not null")))
    called = calls.where((F.col("lang") != "Python") & (F.col("form") == "call") & ~F.col("callee").isin(F_.KEYWORDS))
    return (
        F_.python_facts(sources).unionByName(F_.pattern_facts(sources)).select("file", "fact", "line", "name", "kind", "sig")
        .unionByName(rows(called, "call", F.col("callee")))
        .unionByName(rows(texts, "literal", F.col("text")))
        .unionByName(anchors.quoted(calls).select("file", F.lit("signature").alias("fact"), "line", F.col("key").alias("name"), F.when(F.col("is_path"), "path").otherwise("other").alias("kind"), F.when(F.col("is_path"), F.col("content")).alias("sig")))
    )


def by_rules(sources: DataFrame, rules: list[anchors.Rule] | None = None, routes: list[P.FileRoute] | None = None) -> DataFrame:
    """Anchors of rules and routes of conventions in sources (file, lang, text): name is the label, kind the rule's id."""
    found = anchors.matches(structure.calls(sources), rules)
    by_file = F_.file_routes(sources, routes)
    return rows(found, "anchor", F.concat_ws(" ", "verb", "route"), kind=F.col("rule")).unionByName(rows(by_file, "route", F.concat_ws(" ", "verb", "route"), line=F.lit(1), kind=F.col("rule")))


def promoted(facts: DataFrame, rules: list[anchors.Rule] | None = None) -> DataFrame:
    """Signatures of all files that carry paths often enough and that no rule covers."""
    parts = F.split("name", r"\|")
    each = facts.where("fact = 'signature'").select(F.col("name").alias("key"), parts[0].alias("lang"), parts[1].alias("shape"), parts[2].alias("callee"), parts[3].cast("int").alias("arg"), "file", (F.col("kind") == "path").alias("is_path"))
    hist = discover.histogram(each)
    return discover.promoted(hist, anchors.covered(hist, rules))


def sites(facts: DataFrame, rules: list[anchors.Rule] | None = None) -> DataFrame:
    """(label, file, line, implicit) of anchors, routes, and of what promoted signatures make anchors; each place once."""
    said = facts.where("fact in ('anchor', 'route')").select(F.col("name").alias("label"), "file", "line", F.lit(False).alias("implicit"))
    keys = promoted(facts, rules).select(F.col("key").alias("name"), "callee")
    quoted = facts.where("fact = 'signature' and kind = 'path'").join(keys, "name")
    implied = anchors.labelled(anchors.signed(quoted.select("file", "line", F.col("name").alias("rule"), "callee", "sig")), True)
    return said.unionByName(implied).groupBy("label", "file", "line").agg(F.min("implicit").alias("implicit"))
