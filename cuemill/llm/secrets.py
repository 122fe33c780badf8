"""Secret scans: candidate strings judged by a random forest, in DataFrame operations only.

Candidates are token-like runs with a digit, and values of any length after a secret-like name and a separator; of
``name=value`` the value alone. For each, SQL expressions compute its length, character transitions, dictionary coverage,
path-likeness and neighbouring words; a random forest trained on labelled findings gives the probability that it is a
secret, which removes false positives such as hashes in paths, identifiers, numbers and placeholders. Labelled findings are
what the scan itself finds in labelled texts, so training and scanning see the same spans and neighbours.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: A run of token characters, at least 16 of them, with a digit among them, and base64 padding.
TOKEN = r"(?<![A-Za-z0-9_+/.~-])(?=[A-Za-z_+/.~-]*+[0-9])[A-Za-z0-9_+/.~-]{16,}={0,2}"
NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|credentials?|auth|authorization|bearer|client[_-]?secret)"
#: What follows a name, a separator ("=", ":", "=>", ":=", or a blank after "bearer") and perhaps a quote.
VALUE = r"(?<=[=:>\"'`\s])(?<=" + NAME + r"[\"'`]?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}[\"'`]?|(?i:bearer) )(?!(?i:bearer) )[^\s\"'`<>,;]{3,}[^\s\"'`<>,;.:!?)\]}]"
CANDIDATE = f"(?:{VALUE}|{TOKEN})"
#: A separator after a name: what every text with a ``VALUE`` has, looked for from the separators, of which there are few.
NAMED = r"[=:](?<=" + NAME + r"[\"'`]?[ \t]{0,3}[=:])|(?<=(?i:bearer)) "
CUE = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer|client[_-]?secret)"
BENIGN = r"(?i)(sha1|sha256|md5|commit|revision|checksum|digest|uuid|guid|build|version|static|assets|example|sample|order|invoice|isbn|phone|card|call|page|ref|file|path|image|img)"
#: Words that mark prose, paths and placeholders when they cover much of a candidate; frequent words of the corpus join them.
DICTIONARY = "example|sample|dummy|placeholder|changeme|required|optional|hidden|redacted|password|passwd|secret|token|your|insert|here|test|static|assets|images|image|files|file|path|page|index|main|build|release|version|node|modules|https|http|www|html|json|user|admin|local|host|config|default|value|name|data|info|api|key|the|and|for|with|this|that|not|null|none|true|false|must|should|never|always|next|please|enter|reset|forgot|change|empty|missing|invalid|expired|bearer|basic"
LEFT, RIGHT = 48, 24
FEATURES = ("length", "digit_share", "upper_share", "lower_share", "other_share", "transitions", "distinct_share", "hex", "dictionary", "path", "separators", "cue", "benign", "assigned", "quoted", "repeats", "word")


def learned_dictionary(docs: DataFrame, text_col: str = "text", most: int = 400, least: int = 20) -> str:
    """``DICTIONARY`` and the most frequent words of five ASCII letters and more of all texts, as a pattern: at most ``most`` words,
    each there ``least`` times at least."""
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("(?<![a-z0-9])([a-z]{5,20})(?![a-z0-9])"), F.lit(1))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").count().filter(F.col("count") >= least)
    found = {r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(most).collect()} | set(DICTIONARY.split("|"))
    return "|".join(sorted(found, key=lambda w: (-len(w), w)))


def _share(candidate: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(candidate, f"[^{kept}]", "")) / F.greatest(F.length(candidate), F.lit(1))


def with_features(found: DataFrame, dictionary: str = DICTIONARY) -> DataFrame:
    """``found`` (candidate, left, right) with the numeric columns in ``FEATURES``; ``dictionary`` is a pattern of words."""
    c, left, right = F.col("candidate"), F.coalesce(F.col("left"), F.lit("")), F.coalesce(F.col("right"), F.lit(""))
    n = F.greatest(F.length(c), F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "\u0001"), "[a-z]+", "\u0002"), "[A-Z]+", "\u0003"), "[^\u0001\u0002\u0003]+", "\u0004")
    made = {
        "length": F.length(c).cast("double"),
        "digit_share": _share(c, "0-9"),
        "upper_share": _share(c, "A-Z"),
        "lower_share": _share(c, "a-z"),
        "other_share": 1 - _share(c, "A-Za-z0-9"),
        "transitions": (F.length(classes) - 1) / n,
        "distinct_share": F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))) / n,
        "hex": c.rlike("^[0-9a-f]+$").cast("double"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), dictionary, "")) / n,
        "path": (left.rlike(r"[/\\.]$") | c.rlike(r"/.*/|\.[a-z]{2,4}$") | right.rlike(r"^[/\\]")).cast("double"),
        "separators": F.length(F.regexp_replace(c, "[^-_./]", "")) / n,
        "cue": left.rlike(CUE + r"[^\n]{0,12}$").cast("double"),
        "benign": left.rlike(BENIGN + r"[^\n]{0,12}$").cast("double"),
        "assigned": left.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).cast("double"),
        "repeats": c.rlike(r"(.)\1{3}|0123|1234|abcd").cast("double"),
        "word": c.rlike(r"^[$({%]|^[A-Z]?[a-z]+$|^[A-Z_-]+$|^[a-z_-]+$").cast("double"),
    }
    return found.select("*", *[v.cast("double").alias(k) for k, v in made.items()])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points, end exclusive), candidate, left, right: every candidate of every whole text.

    The text is cut at the candidates, so the pieces give contexts, and their running lengths the places.
    """
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")).withColumn("__named", text.rlike(NAMED))
    rows = rows.filter(F.col("__named") | text.rlike(TOKEN)).withColumn("__row", F.monotonically_increasing_id())
    either = lambda cut: F.when(F.col("__named"), cut(CANDIDATE)).otherwise(cut(TOKEN))
    hits = either(lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pieces = either(lambda pattern: F.split(text, pattern, -1))
    trimmed = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(LEFT)).alias("end"), F.left(p, F.lit(RIGHT)).alias("begin")))
    rows = rows.select("doc_id", "__row", trimmed.alias("pieces"), hits.alias("hits"))
    each = rows.select("doc_id", "__row", F.posexplode(F.arrays_zip("pieces", F.slice("pieces", 2, F.size("pieces")).alias("next"), "hits"))).filter("col.hits is not null")
    before = Window.partitionBy("__row", "doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("col.hits")
    end = F.sum(F.col("col")["pieces"]["n"] + size).over(before)
    return each.select("doc_id", (end - size).cast("long").alias("start"), end.cast("long").alias("end"), F.col("col")["hits"].alias("candidate"), F.col("col")["pieces"]["end"].alias("left"), F.col("col")["next"]["begin"].alias("right"))


def labelled_texts(spark: SparkSession, n: int = 9000) -> DataFrame:
    """text, label, kind: sentences with a finding of known kind, made from hashes of row numbers (the same on every run).

    Secrets: keys, tokens and passwords, short and long, after a name or alone. Others: content hashes, identifiers in
    paths and URLs, numbers, versions, placeholders, variables, and plain words after a secret-like name.
    """
    i, md5, sha, b64, upper, digits, short = map(F.col, ("id", "md5", "sha", "b64", "upper", "digits", "short"))
    one = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(of))) + 1).cast("int"))
    scratch = Scratch(spark)  # each step is written, or the optimizer would copy its expressions into the next ones
    step = lambda df, **made: scratch.written(df.select("*", *[v.alias(k) for k, v in made.items()]), "labelled")
    base = step(spark.range(0, n, 1, 1), md5=F.md5(i.cast("string")), sha=F.sha1(F.concat(F.lit("s"), i.cast("string"))))
    base = step(base, b64=F.regexp_replace(F.base64(F.unhex(sha)), "=", ""), digits=F.translate(md5, "abcdef", "102938"))
    words = {f"word{k}": one(k, "loading", "thereof", "chapter", "station", "mention", "weather", "another", "between") for k in range(1, 9)}
    base = step(
        base, **words, upper=F.upper(F.translate(F.left(b64, F.lit(16)), "+/abcdefghij", "23KLMNOPQRST")), sign=one(2, "=", ": ", " = ", ":", "='", '": "', ' = "'),
        name=one(1, "password", "secret", "token", "api_key", "pwd", "access-key", "client_secret", "Passphrase", "AUTH_TOKEN", "credential"),
        short=F.concat(F.left(b64, (F.pmod(i, F.lit(5)) + 3).cast("int")), one(3, "!", "-", "#", "@", "_", ""), F.left(digits, (F.pmod(F.xxhash64(i), F.lit(4)) + 1).cast("int")), F.substring(b64, 12, 3)),
    )
    word = lambda k: F.col(f"word{k}")
    after = one(9, " ", "\n", " and", "' ", '" ', ", ", ".")
    camel = F.concat(word(4), F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)))
    kinds = [
        (1, word(1), " ", F.concat(F.lit("AKIA"), upper)),
        (1, F.col("name"), F.col("sign"), sha),
        (1, F.col("name"), F.col("sign"), F.left(md5, F.lit(18))),
        (1, F.col("name"), F.col("sign"), b64),
        (1, word(2), one(2, " ", ": ", " = "), F.concat(one(4, "sk_live_", "ghp_", "xoxb-", "glpat-", "rk_test_"), F.left(b64, F.lit(24)))),
        (1, F.col("name"), F.col("sign"), F.left(b64, F.lit(20))),
        (1, F.col("name"), F.col("sign"), short),
        (1, F.col("name"), F.col("sign"), short),
        (1, F.col("name"), F.col("sign"), camel),
        (1, "Authorization: ", "Bearer ", F.concat(F.lit("eyJ"), b64, F.lit("."), F.substring(b64, 3, 20))),
        (0, "commit", " ", sha),
        (0, one(1, "sha256", "checksum", "md5", "digest", "revision"), one(2, " ", ": ", "="), F.concat(md5, F.left(sha, F.lit(32)))),
        (0, F.concat(F.lit("/static/"), word(1)), ".", F.concat(md5, F.lit("/app.js"))),
        (0, word(4), " ", F.concat(word(1), F.lit("-"), word(2), F.lit("-"), word(3), F.lit("-2024"))),
        (0, one(1, "order", "invoice", "call", "page"), " ", F.left(digits, F.lit(16))),
        (0, word(1), " ", F.left(digits, F.lit(17))),
        (0, F.col("name"), F.col("sign"), F.concat(one(4, "your_token_here_1234", "example-key-000000", "insert-password-here"), F.left(digits, F.lit(2)))),
        (0, one(1, "uuid", "guid", "id"), one(2, ": ", "=", " "), F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12))),
        (0, "see", " ", F.concat(word(1), F.lit("/"), word(2), F.lit("/"), word(3), F.left(digits, F.lit(3)), F.lit(".html"))),
        (0, word(1), "@", F.concat(F.lit("mail"), F.left(digits, F.lit(2)), F.lit(".example.com"))),
        (0, "version", " ", F.concat(F.lit("v"), F.left(digits, F.lit(2)), F.lit(".0.0-release."), F.substring(digits, 3, 5))),
        (0, F.col("name"), F.col("sign"), one(4, "required", "changeme", "never", "optional", "hidden", "password", "none", "null", "redacted", "must", "invalid", "expired", "missing")),
        (0, F.col("name"), F.col("sign"), word(4)),
        (0, F.col("name"), F.col("sign"), one(4, "${TOKEN}", "$PASSWORD", "{{secret}}", "%PASS%", "YOUR_API_KEY", "********", "xxxxxxxx", "os.environ['KEY']", "config.get(key)")),
    ]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    texts = [F.concat(word(8), F.lit(" "), column(before), column(between), value, after) for _, before, between, value in kinds]
    at = (F.pmod(i, F.lit(len(kinds))) + 1).cast("int")
    return scratch.result(base.select(F.element_at(F.array(*texts), at).alias("text"), F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), at).cast("double").alias("label"), (at - 1).alias("kind")), "labelled")


def labelled_findings(spark: SparkSession, n: int = 9000) -> DataFrame:
    """candidate, left, right, label, kind: the findings of the scan in ``labelled_texts``."""
    texts = labelled_texts(spark, n).withColumn("both", F.struct("label", "kind"))
    return find_candidates(texts, "both").select("candidate", "left", "right", "doc_id.label", "doc_id.kind")


def train_forest(findings: DataFrame, trees: int = 24, depth: int = 7, limit: int = 50_000, dictionary: str = DICTIONARY) -> RandomForestClassificationModel:
    """A forest on labelled findings (candidate, left, right, label 0 or 1), at most ``limit`` of them, chosen by hash.

    Rows without candidate or label are left out; at least one row of each label is needed.
    """
    rows = findings.filter("candidate is not null and label in (0, 1)").select("candidate", "left", "right", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("candidate", "left", "right"), "candidate", "label").limit(limit)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows, dictionary)).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(assembled)


def scan_secrets(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, candidate, score, is_secret: every candidate of every row of ``docs``.

    The dictionary is learned from the texts themselves. Texts are scanned whole and rows apart from each other, so repeated rows each give their findings. Null and empty
    texts and empty tables give none. Extra columns, whatever their names, are ignored.
    """
    dictionary = learned_dictionary(docs, text_col)
    model = train_forest(findings, dictionary=dictionary)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(find_candidates(docs, id_col, text_col), dictionary))
    scored = model.transform(ready).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "start", "end", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
