"""Secret scan with DataFrame expressions, false positives removed by a random forest.

A candidate is one of three: a run of at least 16 characters of [A-Za-z0-9+/_-] with a digit in it (and up to two
"=" after); a value of 6 characters or more, of any kind but blanks, quotes, commas and brackets, that a secret's name
(token, password, api_key ...) and "=" or ":" lead to; the password of user:password@host in an address. Every
candidate of every whole text is described by its length, its character transitions and classes, the share of it that
dictionary words cover, signs of a path, and the words beside it; a random forest trained on labelled findings
gives the probability that it is a secret.

Labelled findings are a table (candidate, before, after, label). Without one, training uses a made-up table of
`examples` rows (parameter, 6000) built from hashes: tokens, keys and passwords in assignments, headers and addresses
against commit ids, file names, addresses, card and order numbers, versions, slugs, and plain words, placeholders and
variables where a password could stand. It is built, like all features, from SQL expressions; Python code does not
touch a row.

The search is one pass over the texts; only candidates with 48 characters on either side are shuffled.

Defined results: null and empty texts have no findings; repeated rows have repeated findings; the same
candidate twice in a text is two findings; ids may be of any type and keep it, a null id keeps its findings; very long
texts are searched whole; the marks used inside (U+0001 to U+0003) may occur in texts and come out as they were; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.llm.keys import row_key
from ratelens.sources.tables import cut, drop

RUN = "[A-Za-z0-9+/_-]"
CONTEXT = 48
OPEN, CLOSE, ESCAPE = "\u0001", "\u0002", "\u0003"
MASK = "[SECRET]"
#: Keys of documents with secrets are broadcast only up to this many (with their positions, some 40 bytes each).
BROADCAST_KEYS = 500_000

#: Words of the dictionary whose share of a candidate counts.
DICTIONARY = "about account admin and asset build bundle cache client code config content cookie data date demo doc document download email event example file final font form function group guide home html http image index info item lib list local login main media menu module name news number online order page param path photo post price product profile public query release report result sale search section server session site source style table test text theme thumb title track update upload user value version video view web".split()
#: Words beside a secret, and words beside long strings that are none.
SECRET_WORDS = "token|secret|api[_-]?key|apikey|access[_-]?key|passw|pwd|auth|bearer|credential|private[_-]?key|client[_-]?secret"
PLAIN_WORDS = "commit|sha|md5|checksum|digest|uuid|guid|order|invoice|phone|tel|card|isbn|version|build|rev|image|file|src|href|url|http|see|page"

#: Groups: 1, 4 what leads to a value; 2, 3, 5 the candidate.
CANDIDATE = (
    rf"(?i:((?:{SECRET_WORDS}|passphrase)[\w-]{{0,20}}[\"'`]?\s{{0,3}}(?:=>|==?|:=?)\s{{0,3}}[\"'`]?(?:bearer\s)?))([^\s\"'`,;<>()\[\]{{}}{OPEN}-{ESCAPE}]{{6,}}+)"
    rf"|((?<!{RUN})(?=[A-Za-z+/_-]*+[0-9]){RUN}{{16,}}+={{0,2}})"
    rf"|(://[^\s/:@{OPEN}-{ESCAPE}]{{1,64}}:)([^\s/@:{OPEN}-{ESCAPE}]{{3,128}})(?=@)"
)


def features(candidate: Column, before: Column, after: Column) -> list[Column]:
    low = F.lower(candidate)
    size = F.length(candidate).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(candidate, F.lit(pattern)) / size

    uncovered = F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))
    return [
        size.alias("size"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        (F.regexp_count(candidate, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / size).alias("letter_digit"),
        (F.regexp_count(candidate, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / size).alias("case_changes"),
        (F.regexp_count(low, F.lit("(?<=[aeiou])(?=[bcdfghjklmnpqrstvwxyz])|(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])")) / size).alias("syllables"),
        (F.size(F.array_distinct(F.split(candidate, ""))) / size).alias("distinct"),
        (1 - uncovered / size).alias("covered"),
        low.rlike("^[0-9a-f]+$").cast("double").alias("hex"),
        share("[/_-]").alias("breaks"),
        share("[^A-Za-z0-9/_-]").alias("symbols"),
        sum((candidate.rlike(c).cast("double") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)).alias("classes"),
        candidate.rlike(r"[.:?!]$|^[$%{]|\(").cast("double").alias("prose"),
        before.rlike(r"://[^\s/:@]*:$").cast("double").alias("in_address"),
        share("/").alias("slashes"),
        (before.rlike(r"[/\\.?&#]$") | after.rlike(r"^[./]\w")).cast("double").alias("path"),
        before.rlike(r"[=:]\s*[\"'`]?$").cast("double").alias("assigned"),
        (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double").alias("quoted"),
        F.lower(before).rlike(rf"({SECRET_WORDS})[\w-]*\W{{0,6}}$").cast("double").alias("secret_word"),
        F.lower(before).rlike(rf"({PLAIN_WORDS})[\w-]*\W{{0,6}}$").cast("double").alias("plain_word"),
    ]


NAMES = ["size", "digits", "capitals", "letter_digit", "case_changes", "syllables", "distinct", "covered", "hex", "breaks", "symbols", "classes", "prose", "in_address", "slashes", "path", "assigned", "quoted", "secret_word", "plain_word"]


def _ingredients(spark: SparkSession, examples: int) -> DataFrame:
    """What the made-up findings are put together from, a row for each: hashes of its id, words, and choices from lists."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)

    def pick(salt: int, choices: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(choices))) + 1).cast("int"))

    return spark.range(0, examples, 1, 2).select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("roll"),
        h.alias("h"),
        F.regexp_replace(F.base64(F.unhex(h)), "[^A-Za-z0-9]", "x").alias("mixed"),
        F.regexp_replace(F.conv(F.substring(h, 1, 14), 16, 10), "$", F.conv(F.substring(h, 20, 10), 16, 10)).alias("digits"),
        *(pick(salt, DICTIONARY).alias(name) for salt, name in ((1, "word"), (2, "word2"), (3, "other"))),
        *(pick(salt, choices).alias(name) for name, (salt, choices) in _CHOICES.items()),
    )


_CHOICES = {
    "named": (4, ["token", "secret", "api_key", "apiKey", "password", "auth_token", "access_key", "client_secret", "TOKEN", "SECRET_KEY"]),
    "assigns": (5, [' = "', "=", ": ", '="', ': "', " = '"]),
    "mark": (20, ["!", "$", "#", "?", "@", "%", "&", "*", "."]),
    "ending": (21, ["s", "ing", "er", "", "", "al", "able", "ed", ".", "."]),
    "unset": (22, ["required", "optional", "undefined", "None", "null,", "${PASSWORD}", "$TOKEN", "********", "xxxxxxxx", "changeme.", "os.environ", "process.env.KEY", "getenv", "string", "integer", "forgotten", "expired.", "<password>", "example"]),
    "scheme": (23, ["postgres", "mysql", "amqp", "https", "redis", "mongodb"]),
    "commit": (6, [" commit ", " sha ", " see ", " digest ", " rev ", " checksum: "]),
    "uuid": (7, [" uuid ", " id=", " guid: ", " "]),
    "card": (8, [" ", " card ", " order ", " tel ", ": ", "="]),
    "page_end": (9, [" ", "/", ".html"]),
    "path_start": (10, [" ", ' src="/', " /", ' href="']),
    "path_end": (11, [".js", '.png"', " "]),
    "name_end": (12, [" ", " = ", "("]),
}

#: (weight, candidate, before, after, label) of each kind of made-up finding, as SQL over _ingredients().
_NAME = "concat(other, ' ', named, assigns)"
_CLOSED = "CASE WHEN endswith(assigns, '\"') THEN '\" ' WHEN endswith(assigns, '\\'') THEN '\\' ' ELSE ' ' END"
_SHORT = "concat(substr(mixed, 1, 5), mark, substr(mixed, 6, 4))"
KINDS = [
    (10, "substr(h, 1, 40)", _NAME, _CLOSED, 1),
    (5, "substr(h, 1, 32)", _NAME, _CLOSED, 1),
    (4, "h", _NAME, _CLOSED, 1),
    (8, "upper(substr(h, 1, 40))", f"upper({_NAME})", _CLOSED, 1),
    (8, "substr(mixed, 1, 36)", _NAME, _CLOSED, 1),
    (5, "concat('AKIA', upper(substr(h, 1, 16)))", "concat(other, ' ')", "' '", 1),
    (5, "concat('ghp_', substr(mixed, 1, 36))", "concat(other, ' ')", "' '", 1),
    (5, "mixed", "concat(other, ' Authorization: Bearer ')", "'\n'", 1),
    (6, _SHORT, _NAME, _CLOSED, 1),
    (4, "concat(initcap(word), substr(digits, 1, 4), mark)", _NAME, _CLOSED, 1),
    (4, "concat(translate(initcap(word), 'aeios', '43105'), mark, substr(h, 1, 4))", _NAME, _CLOSED, 1),
    (5, f"CASE WHEN roll % 2 = 0 THEN {_SHORT} ELSE substr(mixed, 1, 12) END", "concat(other, ' ', scheme, '://', word, ':')", "'@db.example.com/'", 1),
    (8, "concat(word, ending)", _NAME, _CLOSED, 0),
    (6, "unset", _NAME, _CLOSED, 0),
    (3, "concat(word, '.', word2, '(', other)", _NAME, _CLOSED, 0),
    (6, "substr(h, 1, 40)", "concat(other, commit)", "' '", 0),
    (6, "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "concat(other, uuid)", "' '", 0),
    (8, "substr(digits, 1, 16)", "concat(other, card)", "' '", 0),
    (8, "concat_ws('-', word, word2, other, substr(digits, 1, 4))", "concat('https://', other, '.example.com/')", "page_end", 0),
    (6, "concat(word, '/', word2, '/', other, substr(digits, 1, 2))", "concat(other, path_start)", "path_end", 0),
    (6, "concat(word, '-', substr(h, 1, 16))", "concat('/assets/', other, '/')", "'.js'", 0),
    (5, "concat_ws('_', word, word2, concat(other, substr(digits, 1, 3)))", "concat(other, ' ')", "name_end", 0),
    (5, "concat(initcap(word), initcap(word2), initcap(other), substr(digits, 1, 1))", _NAME, _CLOSED, 0),
]


def _dealt(ingredients: DataFrame) -> DataFrame:
    """One finding for each row of ingredients, its kind drawn by weight; each kind is a projection of its own rows."""
    total, start, parts = sum(k[0] for k in KINDS), 0, []
    for weight, candidate, before, after, label in KINDS:
        low, start = int(1000 * start / total), start + weight
        kind = ingredients.where(f"roll >= {low} AND roll < {int(1000 * start / total)}")
        parts.append(kind.selectExpr("id", f"{candidate} AS candidate", f"{before} AS before", f"{after} AS after", f"{label} AS label"))
    return reduce(DataFrame.unionByName, parts)


def example_findings(spark: SparkSession, examples: int = 6000) -> DataFrame:
    """A made-up table of labelled findings, the same on every call.

    Its parts are written first and the findings next: as one expression they are too much code for one method.
    """
    ingredients = cut(_ingredients(spark, examples), "sr-parts")
    findings = cut(_dealt(ingredients).repartitionByRange(2, "id").sortWithinPartitions("id").select("candidate", "before", "after", "label"), "sr-findings")
    drop(ingredients)
    return findings


def fit(findings: DataFrame, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    """The forest from labelled findings (candidate, before, after, label)."""
    rows = findings.select(*features(F.col("candidate"), F.col("before"), F.col("after")), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, subsamplingRate=0.8).fit(rows)


def _marked(text: Column) -> Column:
    """The text in pieces: what comes before the first candidate, then for each candidate itself, CLOSE, what follows.

    Marks that the text itself holds are escaped; _plain() takes the escapes back.
    """
    escaped = text
    for mark, name in ((ESCAPE, "c"), (OPEN, "a"), (CLOSE, "b")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(ESCAPE + name))
    escaped = F.when(text.rlike(f"[{OPEN}-{ESCAPE}]"), escaped).otherwise(text)
    return F.split(F.regexp_replace(escaped, CANDIDATE, f"$1$4{OPEN}$2$3$5{CLOSE}"), OPEN)


def _plain(piece: Column) -> Column:
    out = piece
    for mark, name in ((OPEN, "a"), (CLOSE, "b"), (ESCAPE, "c")):
        out = F.replace(out, F.lit(ESCAPE + name), F.lit(mark))
    return F.when(F.contains(piece, F.lit(ESCAPE)), out).otherwise(piece)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, uid, pos, start, candidate, before, after) for every candidate; start is a character offset."""
    text = F.col(text_col).cast("string")
    found = docs.where(text.rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), text).alias("uid"), F.monotonically_increasing_id().alias("row"), _marked(text).alias("pieces"))
    rest = F.transform("pieces", lambda p: F.substring_index(p, CLOSE, -1))
    parts = F.transform(
        "pieces",
        lambda p, i: F.struct(
            F.substring_index(p, CLOSE, 1).alias("candidate"),
            F.when(i > 0, F.right(_plain(F.get("rest", i - 1)), F.lit(CONTEXT))).alias("before"),
            F.left(_plain(F.get("rest", i)), F.lit(CONTEXT)).alias("after"),
            (F.length(_plain(p)) - F.when(i > 0, 1).otherwise(0)).alias("size"),
        ),
    )
    flat = found.withColumn("rest", rest).select("doc_id", "uid", "row", F.posexplode(parts).alias("pos", "part")).select("doc_id", "uid", "row", "pos", "part.*")
    before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return flat.where("pos > 0").select("doc_id", "uid", "pos", "start", "candidate", "before", "after")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with its score: doc_id, uid, pos, start, length, secret_sha256, score, is_secret."""
    if findings is None:
        made = example_findings(docs.sparkSession)
        model = fit(made)
        drop(made)
    else:
        model = fit(findings)
    rows = candidates(docs, id_col, text_col)
    described = rows.select("doc_id", "uid", "pos", "start", "candidate", *features(F.col("candidate"), F.col("before"), F.col("after")))
    scored = model.transform(VectorAssembler(inputCols=NAMES, outputCol="features").transform(described))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "uid", "pos", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), F.round(score, 9).alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by [SECRET]; length_col, where there is one, follows the text."""
    text = F.col(text_col).cast("string")
    found = scan(docs, findings, threshold, id_col, text_col).where("is_secret")
    flagged = cut(found.groupBy(F.col("uid").alias("__uid")).agg(F.collect_set("pos").alias("__at")), "sr-flag")
    if flagged.count() <= BROADCAST_KEYS:
        flagged = F.broadcast(flagged)
    keyed = docs.withColumn("__key", row_key(F.col(id_col), text)).join(flagged, F.col("__key") == F.col("__uid"), "left")
    masked = F.array_join(F.transform(_marked(text), lambda p, i: _plain(F.when(F.array_contains("__at", i), F.concat(F.lit(MASK), F.substring_index(p, CLOSE, -1))).otherwise(F.translate(p, CLOSE, "")))), "")
    new = F.when(F.col("__at").isNotNull(), masked).otherwise(F.col(text_col))
    out = {text_col: new}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(F.col("__at").isNotNull(), F.length(masked).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return keyed.withColumns(out).select(*docs.columns)
