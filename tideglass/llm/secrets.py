"""Secret scans with a random forest that removes false positives (operator 9), of built-in expressions only.

Candidates are runs of at least 16 characters of keys and tokens that hold a digit, and, however short and whether or not they hold a digit, what begins like
a provider's key, what is assigned to a secret word, and passwords in addresses. Each is described by its length, the
transitions between kinds of characters in it, how much of it dictionary words cover, the path that it or its source names, and
the words beside it. A random forest, trained from labelled findings, says which of them are secrets. The findings are made by rules
(``labelled_findings``), as there are none among the tables; a table of one's own with the same columns may be given instead.

The forest becomes one column expression, so that scanning and redaction stay within the row: no Python, shuffle or join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.session import fresh

CONTEXT = 40
TREES, LEVELS, SEED, FINDINGS = 15, 6, 7, 3200
# (the look-behinds go from cheap to dear, as they are tried at each place that isn't inside a run)
_RUN = r"(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
_KEY = r"(?:A[KS]IA[0-9A-Z]{8,}|(?:gh[pos]_|github_pat_|[sr]k_live_|xox[abprs]-|AIza|glpat-|eyJ)[A-Za-z0-9_+/=.-]{5,}[A-Za-z0-9_+/=-])"
_NAME = r"(?i:token|secret|pass(?:w(?:or)?d|phrase)?|pwd|pin|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)(?:[_-][A-Za-z0-9_-]{0,16})?"
_ASSIGNED = r"(?:(?<=[=:>][ \t]{0,2}[\"'`]?)(?<=" + _NAME + r"[\"'`]?\]?[ \t]{0,2}[:=]{1,2}>?[ \t]{0,2}[\"'`]?)|(?<=(?i:bearer)[ \t]))"
_VALUE = r"(?![$%{<])(?:(?<=[\"'`])[^\s\"'`\\]{4,}(?=[\"'`])|[^\s\"'`,;<>(){}\[\]\\&|]{3,}[^\s\"'`,;<>(){}\[\]\\&|.:])"
_IN_ADDRESS = r"(?<=:)(?<=://[^\s/:@]{0,40}:)[^\s/@\\\"'`]{3,}(?=@)"
#: A candidate; it doesn't begin inside a longer run, '=' stands in a run only as padding at its end. The digit of a run may stand anywhere in it.
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?:(?<=[=:>\"'`\s])(?:" + _IN_ADDRESS + "|" + _ASSIGNED + _VALUE + ")|" + _KEY + "|" + _RUN + ")"
# Words that identifiers, paths and placeholders are made of; words beside secrets; words beside harmless values; words that mark examples.
DICTIONARY = ["access", "account", "address", "admin", "api", "application", "build", "change", "client", "code", "config", "count", "data", "date", "default", "demo", "document", "example", "file", "function", "handler", "home", "image", "index", "insert", "item", "key", "library", "list", "local", "main", "message", "model", "module", "name", "number", "object", "order", "page", "password", "path", "placeholder", "report", "request", "response", "sample", "secret", "server", "service", "source", "state", "string", "table", "test", "time", "token", "update", "user", "value", "version", "view", "window", "your"]
SECRET_WORDS = "token|secret|passw|api.?key|access.?key|private.?key|credential|auth|bearer|pwd"
HARMLESS_WORDS = "commit|sha-?1|sha-?256|md5|checksum|digest|hash|revision|uuid|guid|etag|integrity|version|card|phone|order|invoice"
EXAMPLE_WORDS = "example|sample|dummy|placeholder|fake|your|xxxx|changeme|test"
PROVIDERS = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|rk_live_|xox[abprs]-|AIza|glpat-|eyJ)"

FEATURES = {
    "length": lambda v, b, a, p: F.length(v).cast("double"),
    "digits": lambda v, b, a, p: _share(v, "[^0-9]"),
    "upper": lambda v, b, a, p: _share(v, "[^A-Z]"),
    "marks": lambda v, b, a, p: _share(v, "[A-Za-z0-9]"),
    "lower_digit": lambda v, b, a, p: _pairs(v, "[a-z](?=[0-9])"),
    "digit_lower": lambda v, b, a, p: _pairs(v, "[0-9](?=[a-z])"),
    "lower_upper": lambda v, b, a, p: _pairs(v, "[a-z](?=[A-Z])"),
    "upper_lower": lambda v, b, a, p: _pairs(v, "[A-Z](?=[a-z])"),
    "digit_upper": lambda v, b, a, p: _pairs(v, "[0-9](?=[A-Z])|[A-Z](?=[0-9])"),
    "vowel_pairs": lambda v, b, a, p: _pairs(v, "(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
    "hex": lambda v, b, a, p: v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
    "distinct": lambda v, b, a, p: F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(32)),
    "dictionary": lambda v, b, a, p: 1 - F.length(F.regexp_replace(v, "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.length(v),
    "uuid": lambda v, b, a, p: v.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("double"),
    "provider": lambda v, b, a, p: v.rlike(PROVIDERS).cast("double"),
    "slashes": lambda v, b, a, p: _share(v, "[^/]"),
    "in_path": lambda v, b, a, p: (b.rlike(r"[/\\.]$") | a.rlike(r"^(\.[a-z]{1,5}\b|/)")).cast("double"),
    "test_path": lambda v, b, a, p: p.rlike("(?i)(test|example|fixture|sample|mock|docs?)").cast("double"),
    "assigned": lambda v, b, a, p: b.rlike(r"""[=:]\s*["'`]?$""").cast("double"),
    "in_address": lambda v, b, a, p: (b.rlike("://[^\\s/:@]{0,40}:$") & a.rlike("^@")).cast("double"),
    "spaced": lambda v, b, a, p: b.rlike(r"[ \t]$").cast("double"),
    "plain": lambda v, b, a, p: v.rlike("^([A-Z]?[a-z]+|[A-Z]+)$").cast("double"),
    "code": lambda v, b, a, p: v.rlike(r"^[A-Za-z_]+([._]+[A-Za-z]+)+$").cast("double"),
    "quoted": lambda v, b, a, p: (b.rlike("""["'`]$""") & a.rlike("""^["'`]""")).cast("double"),
    "secret_word": lambda v, b, a, p: b.rlike(f"(?i)({SECRET_WORDS})[^\\n]{{0,16}}$").cast("double"),
    "harmless_word": lambda v, b, a, p: b.rlike(f"(?i)({HARMLESS_WORDS})[^\\n]{{0,16}}$").cast("double"),
    # (as words of their own beside the value, not in addresses like user@example.com)
    "example_word": lambda v, b, a, p: (v.rlike(f"(?i){EXAMPLE_WORDS}") | F.concat_ws(" ", b, a).rlike(rf"(?i)(?<![\w.@-])({EXAMPLE_WORDS})(?![\w.@-])")).cast("double"),
}


def _share(v: Column, others: str) -> Column:
    return F.length(F.regexp_replace(v, others, "")) / F.length(v)


def _pairs(v: Column, first: str) -> Column:
    """How often the pattern of one character fits, for each place."""
    return (F.length(v) - F.length(F.regexp_replace(v, first, ""))) / F.length(v)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """value, before, after, path, label: findings made by rules, secrets of twelve kinds and harmless values of fourteen, in one partition."""
    h = lambda salt: f"sha2(concat('{salt}', id), 256)"
    mixed = lambda salt, size: f"substr(translate(base64(unhex({h(salt)})), '+/=', 'xYz'), 1, {size})"
    word = lambda salt: f"element_at(array({', '.join(repr(w) for w in DICTIONARY)}), 1 + cast(pmod(xxhash64('{salt}', id), {len(DICTIONARY)}) as int))"
    before = lambda salt, *options: f"element_at(array({', '.join(repr(o) for o in options)}), 1 + cast(pmod(xxhash64('{salt}', id), {len(options)}) as int))"
    keys = ("token = \"", "secret: ", "api_key=\"", "password = '", "ACCESS_KEY=", "auth_token: \"", "TOKEN = \"", "Bearer ", "credentials=", "private_key = \"")
    short = ("password=", "PASSWORD=", "pwd: ", "passwd = \"", "password: '", "DB_PASSWORD=", "secret=", "token='", "auth=\"")
    plain = ("the ", "of ", "and see ", "in ", ", ", "was ", ". ", "a ")
    kinds = [
        (1, f"substr({h('a')}, 1, 40)", before("a1", *keys)),
        (1, f"substr({h('b')}, 1, 32)", before("b1", *keys)),
        (1, mixed("c", 40), before("c1", *keys)),
        (1, mixed("d", 24), before("d1", *keys)),
        (1, f"concat('AKIA', upper(substr({h('e')}, 1, 15)), '7')", before("e1", *keys, *plain)),
        (1, f"concat('ghp_', {mixed('f', 36)})", before("f1", *keys, *plain)),
        (1, f"concat('sk_live_', {mixed('g', 24)})", before("g1", *keys, *plain)),
        (1, f"upper(substr({h('h')}, 1, 40))", before("h1", *keys)),
        (0, f"concat_ws('-', substr({h('i')}, 1, 8), substr({h('i')}, 9, 4), substr({h('i')}, 13, 4), substr({h('i')}, 17, 4), substr({h('i')}, 21, 12))", before("i1", "id: ", "uuid = \"", "request ", *plain)),
        (0, f"substr({h('j')}, 1, 40)", before("j1", "commit ", "revision: ", "sha1 = ", "hash: \"", "etag: \"")),
        (0, h("k"), before("k1", "checksum sha256:", "digest: ", "sha256 = \"", "integrity ", "hash of ")),
        (0, "lpad(cast(pmod(xxhash64('l', id), 9999999999999999) as string), 16, '4')", before("l1", *plain, "card ", "phone ", "order ")),
        (0, f"concat('your_', {word('m')}, '_key_here_', cast(id % 100 as string))", before("m1", *keys)),
        (0, f"concat({word('n')}, initcap({word('n2')}), initcap({word('n3')}), 'Handler', cast(id % 10 as string))", before("n1", "function ", "call ", "new ", "token = ", *plain)),
        (0, f"concat('/', {word('o')}, '/', {word('o2')}, '/', {word('o3')}, 'v', cast(id % 30 as string), '/file')", before("o1", "path: ", "in ", "see ", "file=")),
        (0, "concat(repeat('x', 12), lpad(cast(id % 10000 as string), 4, '0'))", before("p1", *keys)),
        (0, f"concat({word('q')}, '_', {word('q2')}, '_', {word('q3')}, '_20', lpad(cast(id % 30 as string), 2, '0'))", before("q1", "table ", "name = \"", *plain)),
        (0, "concat('20240', cast(1 + id % 9 as string), '31T2359', lpad(cast(id % 60 as string), 2, '0'), 'Z')", before("r1", "time: ", "date = \"", *plain)),
        (0, f"substr({h('s')}, 1, 40)", before("s1", "token = \"example", "the test fixture has token = \"", "sample secret: ", "dummy password = \"")),
        (0, f"concat({word('t')}, {word('t2')}, {word('t3')}, {word('t4')}, cast(id % 10 as string))", before("t1", *plain, *keys)),
        (1, mixed("u", 9), before("u1", *short)),
        (1, f"translate(substr({h('v')}, 1, 10), '0123456789', 'ghjkmnpqrs')", before("v1", *short)),
        (1, f"concat(initcap({word('w')}), cast(id % 100 as string), '!')", before("w1", *short)),
        (1, f"concat(translate(substr({h('y')}, 1, 5), '0123456789', 'ghjkmnpqrs'), cast(id % 100 as string))", before("y1", *short, "postgres://admin:", "https://deploy:", "redis://:")),
        (0, f"{before('x', 'required', 'string', 'none', 'null', 'true', 'optional', 'hidden', 'expired', 'invalid', 'missing', 'false', 'None', 'about', 'which', 'Enter', 'never')}", before("x1", "password: ", "secret: ", "token = ", "auth: ", "Bearer ", "api_key: ", "password=")),
        (0, f"concat({before('z', 'self', 'config', 'os', 'get', 'settings', 'args')}, {before('z2', '.', '_')}, {word('z3')})", before("z1", "password = ", "token=", "api_key: ", "secret = ", "auth_token=")),
    ]
    case = lambda i: "CASE CAST(id % " + str(len(kinds)) + " AS INT) " + " ".join(f"WHEN {k} THEN {kind[i]}" for k, kind in enumerate(kinds)) + " END"
    rows = spark.range(0, n, 1, 1).selectExpr(f"{case(1)} AS value", f"{case(2)} AS before", f"{case(0)} AS label", "id")
    closed = F.when(F.col("before").endswith('"'), '"').when(F.col("before").endswith("'"), "'").when(F.col("before").contains("://"), "@db1/main").otherwise("")
    path = F.when(F.col("id") % 7 == 0, "src/config").when(F.col("id") % 7 == 1, F.when(F.col("label") == 0, "tests/fixtures").otherwise("web")).otherwise("src/app")
    filler = F.element_at(F.array(*[F.lit(x) for x in ("see below: ", "lorem ipsum ", "x = 1\n", "", "in this line ", "# ")]), (1 + F.pmod(F.xxhash64("id"), F.lit(6))).cast("int"))
    return rows.select("value", F.concat(filler, "before").alias("before"), F.concat(closed, F.lit(" and more")).alias("after"), path.alias("path"), F.col("label").cast("double").alias("label"))


class Forest:
    """A trained forest as plain trees: (feature, threshold, left, right), or the probability of a secret in a leaf."""

    def __init__(self, trees: list):
        self.trees = trees

    def column(self, features: Column) -> Column:
        """The mean of the trees' leaves, as an expression over a struct of the features."""
        names = list(FEATURES)

        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(features[names[feature]] <= threshold, of(left)).otherwise(of(right))

        return reduce(lambda a, b: a + b, [of(t) for t in self.trees]) / len(self.trees)


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    return F.struct(*[f(value, before, after, path).alias(n) for n, f in FEATURES.items()])


def train(findings: DataFrame, trees: int = TREES, levels: int = LEVELS, seed: int = SEED) -> Forest:
    """From labelled findings: value, before, after, path and label (1 for a secret). Their number should be bounded; one partition makes training repeatable."""
    described = findings.select("label", features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).alias("f")).select("label", "f.*")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=levels, seed=seed).fit(rows)

    def plain(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats) if sum(stats) else 0.0
        split = node.split()
        left, right = plain(node.leftChild()), plain(node.rightChild())
        return left if left == right else (split.featureIndex(), split.threshold(), left, right)

    return Forest([plain(t._java_obj.rootNode()) for t in model.trees])


def find(text: Column, path: Column, forest: Forest, least: float = 0.5) -> Column:
    """The secrets of a text: array of value, start (from 0), score and places.

    Each place of a candidate is scored in its own context. A value is a secret if it is at any of its places; start and score are those of the first such place, places has
    start and score of all.
    """
    values = F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(text.rlike(CANDIDATE), F.split(text, CANDIDATE, -1)).otherwise(F.array().cast("array<string>"))
    steps = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value")))
    start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<value:string,at:int>>").alias("all"))
    # (substring counts characters, from 1)
    step = lambda acc, x: F.struct((acc["end"] + x["gap"] + x["size"]).alias("end"), F.array_append(acc["all"], F.struct(x["value"].alias("value"), (acc["end"] + x["gap"]).alias("at"))).alias("all"))
    placed = F.aggregate(F.filter(steps, lambda x: x["value"].isNotNull()), start, step, lambda acc: acc["all"])

    def judged(c: Column) -> Column:
        begin = F.greatest(c["at"] - CONTEXT, F.lit(1))
        before = F.substring(text, begin, c["at"] - begin)
        after = F.substring(text, c["at"] + F.length(c["value"]), F.lit(CONTEXT))
        return F.struct(c["value"].alias("value"), (c["at"] - 1).alias("start"), features(c["value"], before, after, path).alias("f"))

    scored = F.transform(F.transform(placed, judged), lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), F.round(forest.column(c["f"]), 4).alias("score")))

    def gathered(every: Column) -> Column:
        bad = F.filter(every, lambda c: c["score"] >= least)

        def of(v: Column) -> Column:
            head = F.element_at(F.filter(bad, lambda c: c["value"] == v), 1)
            places = F.transform(F.filter(every, lambda c: c["value"] == v), lambda c: F.struct(c["start"].alias("start"), c["score"].alias("score")))
            return F.struct(v.alias("value"), head["start"].alias("start"), head["score"].alias("score"), places.alias("places"))

        return F.transform(F.array_distinct(F.transform(bad, lambda c: c["value"])), of)

    # (a lambda over an array of one, so that the scores are worked out once)
    return F.element_at(F.transform(F.array(scored), gathered), 1)


def scan(df: DataFrame, forest: Forest | None = None, text: str = "text", path: str | None = "source", found: str = "secrets") -> DataFrame:
    """All columns of df with ``found``, an array of value, start, score and places (start and score of each).

    Null and empty texts have none. ``path`` names a column with the file or source of a text; null or no such column counts as an empty path. Repeated
    rows are scanned each for themselves; an empty table gives no rows. A column of df named like ``found`` is replaced.
    """
    forest = forest or default_forest(df.sparkSession)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in df.columns else F.lit("")
    return df.withColumn(found, find(F.coalesce(F.col(text), F.lit("")), where, forest))


def redact(df: DataFrame, forest: Forest | None = None, text: str = "text", path: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """All columns of df, with the secrets in the text replaced by a mark wherever they stand in it, those under 16 characters only as words of their own.

    A null text stays null, other columns stay as they are whatever their names, and repeated rows are redacted each for themselves; nothing else of the scan is in the result.
    """
    (held,) = fresh(df, "found_secrets")
    found = scan(df, forest, text, path, held)
    # longer values first, as one may begin another
    values = F.array_sort(F.transform(held, lambda s: F.struct((-F.length(s["value"])).alias("l"), s["value"].alias("v"))))
    word = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    plain = mark.replace("\\", "\\\\").replace("$", "\\$")
    clean = F.aggregate(values, F.col(text), lambda t, s: F.when(s["l"] <= -16, F.replace(t, s["v"], F.lit(mark))).otherwise(F.regexp_replace(t, word(s["v"]), F.lit(plain))))
    return found.withColumn(text, F.when(F.size(held) > 0, clean).otherwise(F.col(text))).select(*df.columns)


_forests: dict[str, Forest] = {}


def default_forest(spark: SparkSession) -> Forest:
    """Trained once for an application from ``labelled_findings``."""
    app = spark.sparkContext.applicationId
    if app not in _forests:
        _forests[app] = train(labelled_findings(spark))
    return _forests[app]


def findings(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source") -> DataFrame:
    """key, start, length, value_sha256, score: one row for each place of each secret of each row of df, without the secret itself."""
    (held,) = fresh(df, "found_secrets")
    rows = scan(df, None, text, path, held).filter(F.size(held) > 0).select(F.col(key).alias("_key"), F.explode(held).alias("_s")).select("_key", "_s", F.explode("_s.places").alias("_p"))
    return rows.select(F.col("_key").alias(key), F.col("_p.start").alias("start"), F.length("_s.value").alias("length"), F.sha2("_s.value", 256).alias("value_sha256"), F.col("_p.score").alias("score"))
