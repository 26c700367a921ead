"""Literals that can join items across languages: classification, normal form, rarity and bridge weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token shapes, base weights and document-frequency limits that results must agree on.
PATH = r"^(?:/[\w.~+\-{}*:$]+/?|/?[\w.~+\-]+(?:/[\w.~+\-{}*:$]+)+/?)$"
ENV = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"
WORD = r"^[A-Za-z][\w$.\-]{6,63}$"
ORIGIN = r"^(?:https?|wss?)://[^/]+"
PLACEHOLDER = r"^(?::[^/]+|\{[^}/]*\}|\$\{[^}/]*\}|\$[A-Za-z_]\w*|<[^/>]+>|\*+)$"
BASE_WEIGHTS = {"path": 1.0, "env": 0.8, "word": 0.55}
MOST_FILES, MOST_OCCURRENCES = 48, 192


def classify(text: Column) -> Column:
    """path, env, word or null."""
    t = F.trim(text)
    telling = F.contains(t, F.lit(".")) | F.contains(t, F.lit("::")) | F.contains(t, F.lit("-")) | F.contains(t, F.lit("_")) | F.substring(t, 2, 1 << 20).rlike("[A-Z][a-z]")
    kind = F.when(t.rlike(ENV), "env").when(F.regexp_replace(t, ORIGIN, "").rlike(PATH), "path").when(t.rlike(WORD) & telling, "word")
    return F.when((F.length(t) >= 3) & (F.length(t) <= 200), kind)


def normalize(text: Column, kind: Column) -> Column:
    """The join key: env in capitals, words unchanged, paths without origin, last slash and names of placeholders."""
    t = F.trim(text)
    segments = F.transform(F.split(F.regexp_replace(t, ORIGIN, ""), "/"), lambda s: F.when(s.rlike(PLACEHOLDER), F.lit("{*}")).otherwise(s))
    path = F.regexp_replace(F.array_join(segments, "/"), "(?<=.)/$", "")
    return F.when(kind == "env", F.upper(t)).when(kind == "word", t).when(kind == "path", path)


def specificity(total: Column, df: Column) -> Column:
    """How rare a key is: near 1 in few files, 0 where it is everywhere; never NaN."""
    return F.least(F.lit(1.0), F.ln(total / F.greatest(df, F.lit(1))) / F.ln(F.greatest(total, F.lit(2)).cast("double")))


def bridge_weight(kind: Column, spec: Column, df: Column) -> Column:
    base = F.coalesce(*(F.when(kind == k, F.lit(w)) for k, w in BASE_WEIGHTS.items()))
    return base * (0.25 + 0.75 * spec) / F.greatest(F.lit(1.0), df / 6)
