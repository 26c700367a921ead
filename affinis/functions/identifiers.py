"""Terms of identifiers and how alike two names are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that name nothing.
STOP_WORDS = ["a", "an", "and", "are", "do", "does", "find", "for", "happen", "happens", "how", "in", "is", "of", "on", "please", "the", "this", "to", "what", "where", "which", "with"]


# Fixed values below: which endings go from which lengths on, in this order, and how coverage and precision weigh.
def stem(term: Column) -> Column:
    """The term without a plural or -ing ending; the first rule that applies wins."""
    n = F.length(term)
    cut = lambda k: F.left(term, n - k)
    return (
        F.when((n > 5) & term.endswith("ing"), cut(3))
        .when((n > 4) & term.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & term.rlike("(ches|shes|sses|xes|zes)$"), cut(2))
        .when((n > 3) & term.endswith("s") & ~term.endswith("ss"), cut(1))
        .otherwise(term)
    )


def terms(value: Column) -> Column:
    """Distinct stemmed terms in order, split at case changes and at what is neither letter nor digit."""
    spaced = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    telling = lambda t: ~t.isin(STOP_WORDS)
    parts = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & telling(t))
    return F.array_distinct(F.filter(F.transform(parts, stem), telling))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def same_terms(a: Column, b: Column) -> Column:
    """Whether two names have the same terms in any order, and have any."""
    ta, tb = F.sort_array(terms(a)), F.sort_array(terms(short_name(b)))
    return (F.size(ta) > 0) & (ta == tb)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared character pairs, repeats included, over all pairs of both."""
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    count = lambda list_, x: F.size(F.filter(list_, lambda y: y == x))
    pa, pb = pairs(a), pairs(b)
    shared = F.aggregate(F.array_distinct(pa), F.lit(0), lambda n, x: n + F.least(count(pa, x), count(pb, x)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def similarity(query: Column, name: Column) -> Column:
    """The better of shared terms (0.72 coverage of the query, 0.28 precision) and shared character pairs."""
    q, c = terms(query), terms(short_name(name))
    shared = F.size(F.array_intersect(q, c))
    part = lambda n, weight: F.when(F.size(n) > 0, weight * shared / F.size(n)).otherwise(0.0)
    return F.greatest(part(q, 0.72) + part(c, 0.28), dice(F.array_join(q, ""), F.array_join(c, "")))
