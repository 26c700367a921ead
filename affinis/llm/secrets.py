"""Secrets in texts: candidates by patterns, and a random forest that removes false findings.

Everything here is DataFrame operations; the forest is Spark's own.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that issuers publish; the whole match is the candidate.
ISSUED = (
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bsk_(?:live|test)_[A-Za-z0-9]{16,}|\bAIza[0-9A-Za-z_-]{35}"
    r"|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]+-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
)
#: A value given to a name that speaks of secrets; the value is the candidate.
ASSIGNED = r"(?i)(?:passwd|password|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,2}(?:=|:|=>|:=)\s{0,2}[\"'`]?([^\s\"'`<>,;]{8,})"
#: Long runs of key characters with a digit among them.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: Words and parts of words that made-up keys hardly contain.
DICTIONARY = "(?:password|passwd|secret|token|example|sample|change|default|placeholder|your|here|user|name|admin|test|key|api|value|config|service|client|server|index|file|path|data|http|www|com|org|html|image|class|function|return|import|module|version|number|string|the|and|ing|tion|ment|able|ness)"
NAMES = r"(?i)(?:passwd|password|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,2}(?:=|:|=>|:=)\s{0,2}[\"'`]?$"
DIGESTS = r"(?i)\b(?:sha-?\d*|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|integrity|fingerprint|blob|tree|object|ref|parent)\b[^A-Za-z]*$"
#: What stands for a value to be filled in.
PLACEHOLDERS = r"^[<$%{\[]|\$\{|\{\{|(.)\1{5,}|^[A-Za-z_.]+[(\[]"
#: The letter pairs that written words are mostly made of.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ct ss us id ex nc ns ec".split()
EXAMPLES = r"(?i)\b(?:example|sample|dummy|fake|placeholder|todo|test|replace|insert|changeme)\b"
FEATURES = ("length", "transitions", "coverage", "distinct", "digits", "uppers", "hex", "issued", "named", "digest", "example", "slashes", "dots", "test_path", "pairs", "placeholder")
CONTEXT = 48


def places(pattern: str, group: int) -> Column:
    """Where the group, which ends the match, stands in each match in ``text``: start * 2**31 + length, in code points."""
    gaps, whole = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0)
    found = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), *([F.regexp_extract_all("text", F.lit(pattern), group).alias("value")] if group else []))

    def step(acc: Column, x: Column) -> Column:
        end, length = acc["at"] + F.length(x["gap"]) + F.length(x["whole"]), F.length(x["value" if group else "whole"])
        code = F.shiftleft(end - length, 31) + length
        return F.when(x["whole"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], code).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, path, secret, start, before, after): each candidate of a text at each place where a pattern finds it.

    The text's gaps between a pattern's matches give the places. The same stretch found by several patterns is one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), text.alias("text"))
    rows = rows.where(F.col("text").rlike(ISSUED) | F.col("text").rlike(ASSIGNED) | F.col("text").rlike(OPAQUE))
    found = F.array_distinct(F.concat(places(ISSUED, 0), places(ASSIGNED, 1), places(OPAQUE, 0)))

    def around(place: Column) -> Column:
        at, length = F.shiftright(place, 31).cast("int") + 1, place.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.struct(F.substring("text", at, length).alias("secret"), (at - 1).alias("start"), F.substring("text", F.greatest(at - CONTEXT, F.lit(1)), F.least(at - 1, F.lit(CONTEXT))).alias("before"), F.substring("text", at + length, F.lit(CONTEXT)).alias("after"))

    return rows.select("id", "path", F.explode(F.transform(found, around)).alias("x")).select("id", "path", "x.*")


def share(text: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def features(found: DataFrame) -> DataFrame:
    """The forest's columns: of the candidate itself, its path and the words around it."""
    s = F.col("secret")
    classes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    n = F.greatest(F.length(s), F.lit(1))
    flag = lambda c: c.cast("double")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.lower(F.substring(s, i, F.lit(2))))
    return found.withColumns(
        {
            "length": F.least(F.length(s), F.lit(256)).cast("double"),
            "transitions": (F.size(F.split(s, classes)) - 1) / n,
            "coverage": share(F.lower(s), DICTIONARY),
            "distinct": F.size(F.array_distinct(F.split(s, ""))) / n,
            "digits": share(s, "[0-9]"),
            "uppers": share(s, "[A-Z]"),
            "hex": flag(s.rlike("^[0-9a-f]+$")),
            "issued": flag(s.rlike(ISSUED)),
            "named": flag(F.col("before").rlike(NAMES)),
            "digest": flag(F.col("before").rlike(DIGESTS)),
            "example": flag(F.concat_ws(" ", F.substring("before", -24, 24), F.left("after", F.lit(24)), s).rlike(EXAMPLES)),
            "slashes": share(s, "/"),
            "dots": share(s, r"\."),
            "pairs": F.size(F.filter(pairs, lambda x: x.isin(PAIRS))) / F.greatest(F.size(pairs), F.lit(1)),
            "placeholder": flag(s.rlike(PLACEHOLDERS)),
            "test_path": flag(F.col("path").rlike("(?i)test|example|sample|mock|fixture|docs?/")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(id, path, text, label): ``n`` made-up texts with a finding each, half of them secrets."""
    i = F.col("id")

    def draw(alphabet: str, length: Column | int, salt: int) -> Column:
        pick = lambda k: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(i, k, F.lit(salt)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length) if isinstance(length, int) else length), pick), "")

    def choose(words: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))).cast("int") + 1)

    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = "0123456789abcdef", upper + lower + digits
    name = choose(["password", "token", "api_key", "secret", "API_KEY", "auth_token", "passwd"], 1)
    equals = choose(["=", " = ", ": ", "=\"", " = \""], 2)
    size = F.pmod(F.xxhash64(i, F.lit(3)), F.lit(30)).cast("int") + 14
    prose = choose(["the value of the thing", "we found it in", "connect with", "in the log there was", "then it said"], 4)
    noun = choose(["user", "config", "service", "client", "image", "module", "version", "server"], 5)
    other = choose(["index", "default", "value", "data", "class", "string", "number", "function"], 6)
    true = [
        F.concat(F.lit("AKIA"), draw(upper + digits, 16, 10)),
        F.concat(name, equals, draw(hexes, size, 11)),
        F.concat(name, equals, draw(mixed, size, 12)),
        F.concat(F.lit("ghp_"), draw(mixed, 36, 13)),
        F.concat(name, equals, draw(mixed + "+/", 40, 14)),
        F.concat(F.lit("sk_live_"), draw(mixed, 24, 15)),
    ]
    false = [
        F.concat(choose(["sha1 ", "commit ", "md5: ", "checksum ", "digest: "], 20), draw(hexes, 40, 21)),
        F.concat(F.lit("uuid "), draw(hexes, 8, 22), F.lit("-"), draw(hexes, 4, 23), F.lit("-4"), draw(hexes, 3, 24), F.lit("-a"), draw(hexes, 3, 25), F.lit("-"), draw(hexes, 12, 26)),
        F.concat(name, equals, choose(["your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxx", "example_token_value", "<your-secret>x", "test_password_1", "00000000000000"], 27)),
        F.concat(noun, F.lit("_"), other, F.lit("_"), noun, F.lit("_"), other, F.lit("_"), draw(digits, 2, 28)),
        F.concat(F.lit("/usr/share/"), noun, F.lit("/"), other, F.lit("/"), noun, F.lit("-1/"), other, F.lit(".html")),
        F.concat(name, equals, F.lit("get_"), noun, F.lit("_"), other, F.lit("()")),
        F.concat(F.lit("--------------------"), draw(digits, 4, 29)),
        F.concat(choose(["example: ", "sample ", "dummy: ", "for example "], 31), name, equals, draw(mixed, size, 32)),
        F.concat(name, equals, choose(["${", "{{ ", "<", "%("], 33), F.upper(noun), F.lit("_"), F.upper(other), F.lit("_1}")),
        F.concat(F.initcap(noun), F.initcap(other), F.initcap(choose(["proxy", "factory", "builder", "manager"], 34)), F.lit("Bean"), draw(digits, 1, 35), F.lit("Impl")),
        F.concat(choose(["blob ", "object ", "tree ", "parent ", "revision "], 36), draw(hexes, 40, 37)),
        F.concat(choose(["integrity sha384-", "integrity: sha512-", "hash sha256-"], 38), draw(mixed + "+/", 64, 39)),
        F.concat(name, equals, other, choose(["[", "(", ".get("], 42), F.lit("'"), noun, F.lit("_"), other, draw(digits, 1, 43), F.lit("')")),
        F.concat(F.lit("id "), draw(digits, 24, 30)),
    ]
    pick = lambda options, salt: F.coalesce(*(F.when(F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))) == k, o) for k, o in enumerate(options)))
    label = F.pmod(i, F.lit(2)).cast("double")
    text = F.concat(prose, F.lit(" "), F.when(label == 1, pick(true, 40)).otherwise(pick(false, 41)), F.lit(" "), choose(["and so on", "again", "in the end", "there"], 7))
    return spark.range(0, n, 1, 1).select("id", choose(["src/main.py", "src/app.js", "conf/prod.env", "tests/test_app.py", "src0"], 8).alias("path"), text.alias("text"), label.alias("label"))


_fitted: dict[str, PipelineModel] = {}


def trained(spark: SparkSession) -> PipelineModel:
    """The forest fitted on made-up findings, once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        _fitted[key] = train(spark)
    return _fitted[key]


def train(spark: SparkSession, labelled: DataFrame | None = None, trees: int = 30, depth: int = 8, seed: int = 5) -> PipelineModel:
    """A forest fitted on labelled findings (id, path, text, label), by default 4000 made-up ones, a bounded sample."""
    labelled = labelled_findings(spark) if labelled is None else labelled
    rows = features(candidates(labelled, "id", "text", "path")).join(labelled.select("id", "label"), "id").select(*FEATURES, "label").coalesce(1)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=2)
    return Pipeline(stages=[assembler, forest]).fit(rows)


def scan(docs: DataFrame, model: PipelineModel | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Findings of every whole text and the forest's verdict on each.

    Returns a row for each candidate of each input row, at each place where it is found: the id, secret, start (code
    points before it), probability and is_secret, judged by the words around that place. Candidates are published key formats, values given to names that
    speak of secrets, and runs of at least 20 key characters with a digit. The forest looks at length, character
    transitions, dictionary coverage, path and neighbouring words. Null and empty texts have no candidates; equal
    rows have equal findings each. Other columns are ignored, whatever their names.
    """
    model = trained(docs.sparkSession) if model is None else model
    found = features(candidates(docs, id_col, text_col, path_col if path_col in docs.columns else None))
    judged = model.transform(found)
    return judged.select(F.col("id").alias(id_col), "secret", "start", vector_to_array("probability")[1].alias("probability")).withColumn("is_secret", F.col("probability") >= threshold)


def unused(docs: DataFrame, name: str) -> str:
    """The name, longer if docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def redact(docs: DataFrame, model: PipelineModel | None = None, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every occurrence of each secret in its text replaced by ``mark``; all columns and rows stay.

    A value that is confirmed at one place is replaced at all.

    A text's secrets are joined to it by a 128-bit key of text and path, so ids may be null or repeat.
    """
    model = trained(docs.sparkSession) if model is None else model
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    one, two, gone_list = (unused(docs, x) for x in ("redact_key_1", "redact_key_2", "redact_list"))
    keyed = docs.withColumns({one: F.xxhash64(text, path), two: F.xxhash64(F.lit(2), text, path)})
    found = scan(keyed.select(F.struct(one, two).alias("id"), text.alias("text"), path.alias("path")), model, "id", "text", "path", threshold).where("is_secret")
    gone = found.groupBy(F.col(f"id.{one}").alias(one), F.col(f"id.{two}").alias(two)).agg(F.sort_array(F.collect_set(F.struct((-F.length("secret")).alias("n"), "secret"))).alias(gone_list))
    out = keyed.join(gone, [one, two], "left")
    cleared = F.aggregate(gone_list, F.col(text_col), lambda acc, x: F.replace(acc, x["secret"], F.lit(mark)))
    return out.withColumn(text_col, F.when(F.col(gone_list).isNull(), F.col(text_col)).otherwise(cleared)).select(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in ``documents`` with the forest's verdicts; secrets are given by their digests."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", F.length("secret").cast("long").alias("length"), F.sha2(F.col("secret"), 256).alias("secret_sha256"), "probability", "is_secret")
