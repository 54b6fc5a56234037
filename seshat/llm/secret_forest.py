"""Secret scans with a random forest against false positives. DataFrame functions and Spark's own forest only.

Candidates are values that stand behind a name such as token or password and a sign such as = or :, of any length and
made of any characters, and elsewhere runs of eight or more characters with a digit, a change from small to capital
letters or twenty letters. The forest sees each candidate's length, character transitions, dictionary coverage, path
marks and neighbouring words, and is trained on labelled findings: `labelled_findings` builds them from rules (tokens,
keys and passwords against digests, identifiers, paths, versions, placeholders, number runs and words), or the caller
gives a table of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seshat.llm._io import settle, spare

# Neighbouring words that speak for a secret, and those that speak for something public.
SECRET_WORDS = r"token|secret|passw|passwd|pwd|api.?key|apikey|access.?key|private|credential|auth|bearer|client_secret|signing|aws_|key"
PUBLIC_WORDS = r"sha-?\d|sha|md5|commit|checksum|digest|hash|uuid|guid|version|build|revision|isbn|order|phone|tel|invoice|trace|etag|image|integrity|example|path|file"
# Word parts that make up readable names rather than random strings.
DICTIONARY = "|".join("able access account address admin app archive array audio backup base batch buffer build cache catalog change channel chart class client cloud code column command common config connect content control count country create customer data date default delete design detail device dialog direct docs document domain down download driver dump email engine entry error event example export feature field file filter final first font form format frame function game general global graph group handler header hello help home host hour html http icon image import index info input install instance integration item java join kernel label lang layer layout level lib library light line link linux list load local location lock login long mail main manager map master max media member memory menu message meta method metric min mobile mode model module money month mount name native network news next node note number object office offset open option order output package page panel part pass path pattern phone photo picture plain plan platform play plugin point policy port post power preview price print private process product profile program project proto proxy public query queue random range read record region release remote report request resource result return role room root route rule sample save scan schema score screen script search second secret section select sequence server service session setting setup shell show sign simple site size slot socket sort source space spark start state static status step stop storage store stream string style summary support switch system table target task team template term test text theme thread time title token tool topic total track transfer tree trigger type unit update upload url user util value vector version video view virtual volume web week wide window word work world write year zone".split())
# What stands between a name and its value, and the names whose values are looked at whatever their form.
NAMED = r"(?i)(?:passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer)[A-Za-z0-9_]{0,20}[\"'`]?\s{0,2}(?:=>|:=|[=:]|\sis\s|\s)\s{0,2}[\"'`]?"
#: A value: what quotes hold, or a run without quotes, brackets and separators; closing marks of a sentence stay out.
VALUE = r"(?<=[\"'`])[^\"'`\s]+(?=[\"'`])|[A-Za-z0-9$@!#%&*+/_\-~^](?:[^\s\"'`<>()\[\]{},;:=|]*[^\s\"'`<>()\[\]{},;:=|.?!])?={0,2}"
#: What a value that no name announces must look like.
SHAPE = r"^(?=.*[0-9]|.*[a-z][A-Z]|.{20}).{8,}$"
FEATURES = ["length", "digits", "upper", "symbols", "transitions", "letter_case_changes", "distinct", "hex", "vowels", "longest_word", "dictionary", "slashes", "dots", "dashes", "at_signs", "extension", "grouped", "repeats", "secret_near", "secret_next", "public_near", "assigned", "quoted", "prefix"]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`kept` (a column of docs), at (place of the word), value, before, after of every candidate."""
    named = F.col(text_col).rlike(NAMED)
    d = docs.select("kept", named.alias("named"), F.split(text_col, r"[\x20\x09-\x0D]+").alias("w")).where(F.col("named") | F.exists("w", lambda x: x.rlike(SHAPE)))
    d = d.select("kept", "named", "w", F.posexplode("w").alias("at", "word")).where(F.length("word") > 0)
    # behind two words at most (`token`, `=`) a value may follow a name; its own word may hold both
    tail = F.concat_ws(" ", F.get("w", F.col("at") - 2), F.get("w", F.col("at") - 1), F.col("word"))
    d = d.where(F.col("word").rlike(SHAPE) | (F.col("named") & tail.rlike(NAMED)))
    near = F.concat_ws(" ", F.get("w", F.col("at") - 3), F.get("w", F.col("at") - 2), F.get("w", F.col("at") - 1))
    d = d.select("kept", "at", "word", near.alias("near"), F.coalesce(F.get("w", F.col("at") + 1), F.lit("")).alias("after"))
    d = d.select("kept", "at", "word", "near", "after", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(VALUE), F.lit(0)))).alias("value"))
    glued = F.concat(F.expr("substring_index(word, value, 1)"))
    d = d.select("kept", "at", "value", F.concat_ws(" ", "near", glued).alias("before"), "after")
    announced = F.col("before").rlike(NAMED + "$") & ~F.col("value").rlike(r"^(?:[=:>]+|is)$")
    return d.where(F.col("value").rlike(SHAPE) | announced)


def featured(found: DataFrame) -> DataFrame:
    """found with the column `x`, a struct of FEATURES, from value, before and after."""
    v, n = F.col("value"), F.length("value").cast("double")

    def share(pattern: str) -> F.Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    low = F.lower("before")
    one = lambda c: c.cast("double")
    values = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "letter_case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": one(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "vowels": share("[aeiouyAEIOUYÀ-ÿ]"),
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit(r"\p{L}\p{Ll}*"), F.lit(0)), F.length)), F.lit(0)) / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), F.lit(DICTIONARY), F.lit(""))) / n,
        "slashes": share("/"),
        "dots": share(r"\."),
        "dashes": share("[-_]"),
        "at_signs": share("@"),
        "extension": one(v.rlike(r"\.(?:so|py|js|txt|html?|png|jpe?g|gif|pdf|zip|gz|com|org|net|io|json|xml|csv|md|c|h|java|jar)\b") | F.col("before").rlike(r"(?i)https?:|@$|www\.")),
        "grouped": one(v.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-")),
        "repeats": share(r"(.)\1\1"),
        "secret_near": one(low.rlike(SECRET_WORDS)),
        "secret_next": one(F.col("before").rlike(NAMED + "$")),
        "public_near": one(low.rlike(PUBLIC_WORDS)),
        "assigned": one(low.rlike(r"[=:]>?\s*[\"'`]?$")),
        "quoted": one(F.col("before").rlike("[\"'`]$")),
        "prefix": one(v.rlike("^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abp]-|sk_live_|rk_live_|sk-|AIza|eyJ|glpat-|npm_)")),
    }
    return found.withColumn("x", F.struct(*(values[name].cast("double").alias(name) for name in FEATURES)))


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """value, before, after, label: findings made from rules, the same at every call."""
    i = F.col("id")
    hexed = F.sha2(F.concat(F.lit("a"), i), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i), 512))), "[\r\n]", "")
    plain = F.regexp_replace(mixed, "[+/=]", "")
    digits = F.regexp_replace(F.concat(F.xxhash64(i, F.lit(1)).cast("string"), F.xxhash64(i, F.lit(2)).cast("string")), "-", "")
    word = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(of))) + 1).cast("int"))
    filler = word(3, "of the thing", "and then", "in our", "see", "", "the last", "with a")
    name = word(4, "token", "secret", "api_key", "API_KEY", "password", "access_token", "auth_token", "client_secret", "private_key", "TOKEN", "SECRET_KEY", "aws_secret_access_key", "Bearer", "credentials")
    sign = word(5, " = \"", "=\"", ": \"", " = '", "=", ": ", " := \"", "=>\"")
    public = word(6, "commit", "sha256", "md5", "checksum", "digest", "etag", "revision", "sha1", "hash", "build", "trace")
    part = lambda k: word(k, "data", "user", "report", "index", "service", "client", "server", "archive", "model", "image", "config", "session")
    size = F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (F.pmod(F.xxhash64(i, F.lit(7)), F.lit(3)) + 1).cast("int"))
    upper = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(4)) == 0
    hexes = F.when(upper, F.upper(F.left(hexed, size))).otherwise(F.left(hexed, size))
    glue = lambda *c: F.concat(filler, F.lit(" "), *c)
    letters = F.regexp_replace(plain, "[0-9]", "")
    symbol = word(14, "&", "!", "$", "#", "%", "*", "@", "^", "-", "_")
    access = word(15, "password", "passwd", "pwd", "PASSWORD", "db_password", "passphrase", "secret", "auth_token")
    some = lambda k, low, high: (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(high - low + 1)) + low).cast("int")
    # an invented word, of three to seven syllables
    syllable = lambda k: word(k, "ba", "ten", "or", "schaft", "ver", "li", "cion", "ment", "ung", "tre", "ala", "ish", "con", "eur", "der", "nes", "tion", "que", "ing", "hau", "ré", "ß", "ñar", "ant", "st", "ck")
    spoken = F.array_join(F.slice(F.array(*(syllable(20 + k) for k in range(7))), F.lit(1), some(27, 3, 7)), "")
    said = F.when(some(28, 0, 2) == 0, F.initcap(spoken)).otherwise(spoken)
    camel = F.concat(part(10), F.initcap(part(11)), F.initcap(part(12)))
    number = lambda k: F.left(F.regexp_replace(F.xxhash64(i, F.lit(k)).cast("string"), "-", ""), some(k + 100, 1, 4))
    # what the findings share is written once, so that each kind is a small expression over it
    made = {"hexes": hexes, "hexed": hexed, "mixed": mixed, "plain": plain, "digits": digits, "letters": letters, "spoken": spoken, "said": said, "camel": camel, "filler": filler, "name": name, "sign": sign, "public": public, "symbol": symbol, "access": access}
    ids = settle(spark.range(0, rows, 1, 1).select("id", *(c.alias(n) for n, c in made.items())))
    hexes, hexed, mixed, plain, digits, letters, spoken, said, camel, filler, name, sign, public, symbol, access = map(F.col, made)
    kinds = [
        (hexes, glue(name, sign), 1),
        (F.left(mixed, F.lit(40)), glue(name, sign), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.left(plain, F.lit(16)))), glue(word(8, "key", "id", "access key", "")), 1),
        (F.concat(F.lit("ghp_"), F.left(plain, F.lit(36))), glue(word(8, "use", "token", "with", "export X=")), 1),
        (F.left(plain, F.lit(20)), glue(word(4, "password", "passwd", "pwd", "secret", "PASSWORD"), sign), 1),
        (F.concat(F.lit("eyJ"), F.left(plain, F.lit(60))), glue(word(8, "Authorization: Bearer", "jwt", "token =")), 1),
        (F.left(letters, some(30, 12, 32)), glue(name, sign), 1),
        (F.left(plain, some(31, 6, 16)), glue(access, sign), 1),
        (F.concat(F.initcap(part(10)), number(32), symbol, F.left(letters, some(33, 2, 5))), glue(access, sign), 1),
        (F.concat(F.left(letters, some(34, 3, 7)), symbol, number(35), F.substring(letters, 9, 3)), glue(access, sign), 1),
        (F.concat(part(10), symbol, number(36), F.lit("Z")), glue(access, sign), 1),
        (F.concat(F.left(spoken, some(47, 4, 9)), number(48)), glue(word(49, "password", "passwd", "pwd", "PASSWORD", "passphrase"), sign), 1),
        (hexes, glue(public, word(5, " ", ": ", "=", " = \"", " is ")), 0),
        (F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)), glue(word(8, "id", "uuid:", "request", "", "key =")), 0),
        (F.concat(part(10), F.lit("/"), part(11), F.lit("_"), F.left(digits, F.lit(3)), F.lit("/"), part(12), word(13, ".py", ".txt", ".json", "/v2", ".html")), glue(word(8, "path", "in", "file =", "see /", "key:")), 0),
        (F.concat(part(10), F.lit("-"), part(11), F.lit("-"), F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, 3, 2), F.lit("."), F.substring(digits, 6, 1)), glue(word(8, "version", "install", "package", "")), 0),
        (F.left(digits, F.lit(16)), glue(word(8, "card", "order", "phone", "", "number", "account", "key")), 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.left(digits, F.lit(4)), F.lit("xxxx")), glue(name, sign), 0),
        (F.concat(part(10), F.lit("."), F.left(digits, F.lit(2)), F.lit("."), part(11), F.lit("."), part(12), F.lit(".com")), glue(word(8, "mail", "at", "https://", "user@", "host")), 0),
        (F.concat(part(10), part(11), part(12), F.left(digits, F.lit(2))), glue(word(8, "call", "method", "key", "class", "token")), 0),
        (said, glue(said, word(16, " ", ", ", " ", " ", ": ")), 0),
        (F.concat(said, word(17, "!!", "###", "%%%", "&&&", "***", "!", "2", "15", "")), glue(said, F.lit(" ")), 0),
        (said, glue(word(18, "the secret ", "a token ", "token of ", "auth ", "bearer ", "secret: ", "token: ", "credentials: ", "password is ")), 0),
        (word(19, "string", "required", "null", "None", "true", "false", "changeme", "example", "your_token_here", "<token>", "${TOKEN}", "os.environ", "****", "REDACTED", "null,", "int", "xxx"), glue(access, sign), 0),
        (number(50), glue(word(51, "max_tokens", "tokens", "token_count", "secret_id", "auth_timeout", "access_key_age"), sign), 0),
        (camel, glue(word(8, "call", "token =", "class", "", "secret:", "return")), 0),
        (F.concat(number(40), F.lit("."), number(41), F.lit("."), number(42), F.lit("."), number(43)), glue(word(8, "by", "ip", "", "from", "the", "host:")), 0),
        (F.concat(said, F.lit("."), number(44), F.lit("@"), part(10), number(45), F.lit(".example.com")), glue(said, F.lit(" ")), 0),
        (F.concat(F.lit("20"), F.left(digits, F.lit(2)), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2), word(46, "", "T10:22:31Z", "T08")), glue(word(8, "on", "date =", "", "since", "at:")), 0),
        (F.concat(F.lit("("), F.left(digits, F.lit(3)), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4)), glue(word(8, "call", "phone", "", "tel:", "at")), 0),
    ]
    # one partition in a fixed order, so that the forest draws the same rows on every cluster
    made = [ids.where(i % len(kinds) == k).select(v.alias("value"), b.alias("before"), F.lit("").alias("after"), F.lit(float(y)).alias("label")) for k, (v, b, y) in enumerate(kinds)]
    return reduce(DataFrame.union, made).coalesce(1)


def forest(findings: DataFrame, trees: int = 30, depth: int = 8) -> PipelineModel:
    """A random forest on labelled findings (value, before, after, label); rows with a null among them are left out."""
    known = findings.select("value", "before", "after", F.col("label").cast("double").alias("label")).dropna()
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(settle(featured(known).select("label", "x.*")))
    model = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=6, featureSubsetStrategy="onethird").fit(rows)
    return PipelineModel([assembler, model])


#: The forest of the built-in findings by application: it is the same for all of its scans.
_GROWN: dict[str, PipelineModel] = {}


def grown(spark: SparkSession) -> PipelineModel:
    """The forest of labelled_findings, trained once an application."""
    key = spark.sparkContext.applicationId
    if key not in _GROWN:
        _GROWN.clear()
        _GROWN[key] = forest(labelled_findings(spark))
    return _GROWN[key]


def judged(found: DataFrame, model: PipelineModel) -> DataFrame:
    """found (value, before, after and others) with `score`, the forest's share for a secret."""
    rows = featured(found).select(F.struct(*found.columns).alias("found"), "x.*")
    return model.transform(rows).select("found.*", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """keep (doc_id), at, value, score, secret of every candidate in the texts.

    at counts the words cut at space and \t-\r from 0; score is the forest's share for a secret; secret is
    score >= threshold, so that false positives stay visible with secret = false. Texts and values of any length are
    read whole. Null, empty and blank texts have no candidates. Repeated rows and null ids each give their findings; a
    value found twice in one word is one finding. An empty table gives an empty result. Columns that are not in keep
    are left out, and so is a kept one that bears a name of the result.
    """
    keep = [c for c in keep or ["doc_id"] if c.lower() not in ("at", "value", "score", "secret")]
    model = grown(docs.sparkSession) if findings is None else forest(findings)
    rows = docs.select(F.struct(*keep, F.lit(0).alias("_")).alias("kept"), F.col(text_col).alias("text"))
    found = judged(candidates(rows), model)
    return found.select(*(F.col("kept").getField(c).alias(c) for c in keep), "at", "value", "score", (F.col("score") >= threshold).alias("secret"))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", broadcast_rows: int = 200_000) -> DataFrame:
    """docs with every secret in the texts replaced by `mask`; rows, order of columns and other columns stay.

    A secret is replaced wherever it stands in its text by itself, not inside a longer run of letters and digits.
    Null, empty and blank texts stay as they are; rows are treated by their texts, whatever their ids, repeats and
    other columns. At most `broadcast_rows` texts with secrets are sent to every task, more are joined by shuffle.
    """
    key, marks = spare("seshat_key", docs.columns), spare("seshat_secrets", docs.columns)
    found = scan(docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null"), ["key"]).where("secret")
    values = settle(found.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias(marks)))
    values = F.broadcast(values) if values.count() <= broadcast_rows else values
    joined = docs.withColumn(key, F.xxhash64(text_col)).join(values, key, "left")
    alone = lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    put = mask.replace("\\", "\\\\").replace("$", "\\$")
    clean = F.when(F.col(marks).isNull(), F.col(text_col)).otherwise(F.aggregate(F.col(marks), F.col(text_col), lambda t, s: F.regexp_replace(t, alone(s), F.lit(put))))
    return joined.withColumn(text_col, clean).select(*docs.columns)
