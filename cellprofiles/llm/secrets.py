"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key characters that has a digit, a known prefix or great length, or any
value behind an assignment or a word like ``password``. The forest decides from its length,
the transitions between kinds of characters, how much of it the dictionary covers, its path
and the words around it. It is trained from labelled findings: those a caller has, or the
ones that :func:`made_findings` builds by rule. The dictionary is the corpus itself: words
that at least ``DICTIONARY_SHARE`` of its different texts have outside of candidates. Training
findings are looked up in it as well.

Everything is DataFrame and SQL functions and the JVM's forest. Texts are scanned in place;
only candidates, and word counts after partial sums, are shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: First characters of keys of known kinds.
PREFIX = r"(?:A[KS]IA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k[-_]|AIza|ya29\.|eyJ|SG\.|npm_|pypi-|hf_)"

#: What stands before a value: an assignment, or a word that speaks of a secret.
_LEADS = r"(?<=[=:]\s{0,2}[\"'`]?|(?i:password|passwd|passphrase|pwd|secret|token|bearer|key)(?: is)?\s{1,2}[\"'`]?)"

#: An assigned value of at least six characters: in quotes all up to the closing one, else up to
#: white space or the next assignment, without marks at its end. A run that has a key character
#: among its first five only is none, but is passed over as a whole, so that it is read once.
_UNQUOTED = r"(?:(?![,;&][A-Za-z_.\-]{1,40}[=:])[^\s\"'`<>])"
_VALUE = (
    r"(?<=[=:\s\"'`])(?=[^\s\"'`]{6})(?!//|[=:])" + _LEADS + r"(?:(?<=[\"'`])[^\s\"'`]{6,}+(?=[\"'`])"
    rf"|{_UNQUOTED}{{5,}}[A-Za-z0-9_+/\-]={{0,2}}|(?<![\"'`]){_UNQUOTED}{{6,}}+)"
)
#: Ends of what was passed over: neither behind a quote nor with a key character at its end.
_PASSED = r"(?<![A-Za-z0-9_+/\-])(?<![A-Za-z0-9_+/\-]={1,2})$"

#: A run of at least ten key characters that has a digit, a known prefix or 24 characters.
_RUN = (
    r"(?<![A-Za-z0-9_+/.\-])(?=[A-Za-z_+/.\-]*[0-9]|" + PREFIX + r"|[A-Za-z_+/.\-]{24})"
    r"[A-Za-z0-9_+/.\-]{9,}[A-Za-z0-9_+/\-]={0,2}"
)
CANDIDATE = f"{_VALUE}|{_RUN}"

#: Characters before and after a candidate that count as its neighbours.
NEIGHBOURS = 48

#: Share of the different texts from which on a word of four letters or more is in the dictionary.
DICTIONARY_SHARE = 0.001

#: Words of the dictionary that the made findings use, and those they use without one.
MADE_WORDS = 200
PLAIN_WORDS = "garden window report index readme letter summary picture station market river table"

#: Trees of the forest, their depth, and its seed.
TREES, DEPTH, SEED = 40, 8, 5

#: Rows of the made training findings.
MADE_FINDINGS = 6000

#: Words that speak for and against a secret (fixed values).
SECRET_WORDS = (
    "password passwd passphrase pwd token secret apikey api_key api-key access_key accesskey auth "
    "bearer credential credentials private key login"
).split()
BENIGN_WORDS = (
    "commit sha sha1 sha256 md5 checksum hash digest uuid guid id version release build phone tel "
    "fax card isbn order invoice ip host server example sample test mail email date time file"
).split()
TEST_PATHS = "test tests example examples sample samples mock mocks fixture fixtures doc docs demo"
CONFIG_PATHS = "config conf cfg settings env secret secrets credentials properties yml yaml ini"
#: What stands in place of a secret: fillers, and code that fetches one.
PLACEHOLDERS = r"change_?me|example|placeholder|your|dummy|xxxx|\*\*\*|0000|[({\[]|environ|getenv|redacted"

FEATURES = (
    "length transitions digits upper lower marks distinct_chars hex_only alternating first_run "
    "dictionary path_test path_config near_secret near_benign assigned quoted mail dotted repeats "
    "prefix symbols placeholder"
).split()


def _any_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])").cast("double")


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.length(value)


def with_features(found: DataFrame) -> DataFrame:
    """Add ``FEATURES`` to candidates: ``value``, ``before``, ``after``, ``path``, ``covered``.

    ``covered`` is the number of characters in dictionary words.
    """
    value, size = F.col("value"), F.length("value").cast("double")
    before, after = (F.lower(F.coalesce(c, F.lit(""))) for c in ("before", "after"))
    path = F.lower(F.coalesce("path", F.lit("")))
    kinds = value
    for pattern, kind in (("[0-9]", "9"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[^9Aa]", "-")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    sounds = F.regexp_replace(F.lower("value"), "[aeiouy]", "0")
    sounds = F.regexp_replace(sounds, "[a-z]", "1")
    vowels = F.length(F.regexp_replace(sounds, "0(?=1)|1(?=0)", "")).cast("double")
    words = {
        "length": size,
        "transitions": F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) / size,
        "digits": _share(value, "0-9"),
        "upper": _share(value, "A-Z"),
        "lower": _share(value, "a-z"),
        "marks": _share(value, r"_+/.=\-"),
        "distinct_chars": F.size(F.array_distinct(F.split("value", ""))) / size,
        "hex_only": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "alternating": (size - vowels) / size,
        "first_run": F.length(F.regexp_extract("value", "^[A-Za-z]*", 0)) / size,
        "dictionary": F.coalesce("covered", F.lit(0)) / size,
        "path_test": _any_word(path, TEST_PATHS.split()),
        "path_config": _any_word(path, CONFIG_PATHS.split()),
        "near_secret": _any_word(before, SECRET_WORDS),
        "near_benign": _any_word(F.concat_ws(" ", before, F.substring(after, 1, 12)), BENIGN_WORDS),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": before.rlike(r"[\"']$").cast("double"),
        "mail": (before.rlike("@$") | after.rlike("^@") | value.rlike(r"^[\w.+-]+@[\w-]+\.[\w.]+$")).cast("double"),
        "dotted": value.rlike(r"^[0-9.\-/]+$").cast("double"),
        "repeats": value.rlike(r"(.)\1\1\1").cast("double"),
        "prefix": value.rlike("^" + PREFIX).cast("double"),
        "symbols": F.length(F.regexp_replace("value", r"[\w+/.=\-]", "")) / size,
        "placeholder": F.lower("value").rlike(PLACEHOLDERS).cast("double"),
    }
    return found.withColumns({name: words[name].cast("double") for name in FEATURES})


def made_findings(
    spark: SparkSession, rows: int = MADE_FINDINGS, words: DataFrame | None = None
) -> DataFrame:
    """Labelled findings by rule: ``value``, ``before``, ``after``, ``path``, ``label``.

    Half are keys of well-known shapes, and random strings and phrases behind a telling name; half
    are addresses, numbers, dates, digests, versions, names, paths, words and placeholders. Ordinary words are a bounded
    draw from ``words``, the dictionary, if it is given.
    """
    known = PLAIN_WORDS.split()
    if words is not None:
        drawn = words.filter(F.length("word") <= 12).orderBy(F.xxhash64("word"), "word").limit(MADE_WORDS)
        known = [row.word for row in drawn.collect()] or known
    numbers = spark.range(0, rows, 1, 1)
    md5, long = F.md5(F.concat(F.lit("made:"), F.col("id"))), F.sha2(F.concat(F.lit("m:"), F.col("id")), 256)

    def draw(salt: str, count: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(count)).cast("int")

    def pick(salt: str, *items: str) -> Column:
        return F.element_at(F.array(*map(F.lit, items)), draw(salt, len(items)) + 1)

    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "[+/=]", "")
    upper = F.translate(F.upper(F.substring(long, 1, 16)), "01", "QZ")
    word = pick("word", *known)
    ip = F.concat_ws(".", *[draw(f"ip{i}", 254) + 1 for i in range(4)])
    letters = F.translate(F.substring(mixed, 1, 24), "0123456789", "gHkMpRtVxZ")
    part = ("cor", "rect", "horse", "bat", "ter", "stap", "moon", "ri", "ver", "lan", "dog", "blue", "sum", "gar", "ten")
    phrase = F.concat(*[pick(f"ph{i}", *part) for i in range(4)], F.substring(letters, 1, 2))
    lower = F.concat(*[pick(f"lo{i}", *part) for i in range(3)])
    lower = F.when(draw("lo", 2) == 0, lower).otherwise(F.rpad(pick("lo9", *known), 6, "s"))
    sign = pick("sign", "!", "#", "@", "$", "%", "^", "&", "*", "?")
    card = F.rpad(F.concat(F.lit("4"), F.abs(F.xxhash64("id")).cast("string")), 16, "7")
    secrets = {
        0: (F.concat(F.lit("AKIA"), upper), pick("b0", "", "key ", "aws_access_key_id = ", "and the ")),
        1: (F.substring(md5, 1, 18), pick("b1", "password=", "pwd: ", "passwd=\"", "password=", "password = ")),
        2: (F.substring(long, 1, 40), pick("b2", 'token = "', "token=", 'auth_token: "', 'secret = "')),
        3: (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 34)), pick("b3", "", "token ", "auth: ")),
        4: (F.substring(mixed, 1, 32), pick("b4", "api_key = ", 'secret: "', "Bearer ", "private key ")),
        5: (F.substring(mixed, 1, 14), pick("b5", "password=", "passwd: ", 'login password "', "pwd=")),
        6: (phrase, pick("b6", "password=", "passwd: ", 'password = "', "pwd=", "passphrase: ", "password is ")),
        7: (F.concat(F.substring(mixed, 1, 5), sign, F.substring(mixed, 6, 4), sign, F.substring(letters, 3, 3)), pick("b7", "password=", "pwd=", 'passwd: "', 'password: "', "secret = ")),
        8: (F.concat(F.lit("AKIA"), F.translate(upper, "23456789", "GHJKLMNP")), pick("b8", "", "key ", "aws_access_key_id=", "id ")),
        9: (F.concat(pick("pre", "xoxb-", "ghp_", "glpat-", "sk_live_"), F.substring(letters, 1, 20)), pick("b9", "", "token ", "auth: ", "slack=")),
    }
    benign = {
        0: (ip, pick("n0", "", "from ", "ip ", "host=", "the ")),
        1: (F.substring(card, 1, 16), pick("n1", "", "card ", "order ", "paid ", "id: ")),
        2: (F.concat(F.lit("mail"), draw("h", 90), F.lit(".example."), pick("t", "com", "org", "net")), pick("n2", "jo.12@", "a@", "host ")),
        3: (F.substring(long, 1, 40), pick("n3", "commit ", "sha1: ", "checksum=", 'hash = "', "version ")),
        4: (F.concat(word, draw("w", 99), F.lit("."), word, pick("x", ".txt", ".html", "")), pick("n4", "", "see ", "file ", "in ")),
        5: (F.concat(F.lit("20"), draw("y", 90) + 10, F.lit("-0"), draw("m", 9) + 1, F.lit("-1"), draw("d", 9), F.lit("T10")), pick("n5", "", "date: ", "on ")),
        6: (F.rpad(pick("p", "changeme1", "xxxxxxx1", "example123", "00000000"), 12, pick("q", "1", "x", "0")), pick("n6", "password=", "token: ", "")),
        7: (F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 12)), pick("n7", "uuid ", "id=", "guid: ")),
        8: (F.concat(F.lit("+49-"), draw("f", 900) + 100, F.lit("-"), draw("g", 900000) + 100000), pick("n8", "", "phone ", "tel: ")),
        9: (F.concat(word, word, draw("w", 999)), pick("n9", "", "the ", "of ")),
        10: (lower, pick("n10", "name=", "title: ", 'class="', "user: ", "type = ", "mode=")),
        11: (F.concat_ws("/", F.lit(""), pick("d0", "usr", "var", "home", "opt"), word, lower, word), pick("n11", "", "path=", "dir: ", "in ")),
        12: (F.concat_ws("-", lower, word, lower), pick("n12", "", "slug: ", 'id="', "the ")),
        13: (pick("p2", "changeme", "yourpassword", "your_token_here", "examplepassword", "xxxxxxxx", "********", "os.environ", "getenv(KEY", "${PASSWORD}", "placeholder"), pick("n13", "password=", "token: ", 'secret = "', "api_key=", "pwd: ")),
        14: (F.concat(lower, F.lit("@"), word, F.lit(".org")), pick("n14", "mail: ", "user=", "to: ", "login: ")),
        15: (F.concat(lower, lower), pick("n15", "the ", "", "note: ", "of ")),
    }

    def chosen(kinds: dict, salt: str, part: int) -> Column:
        found = F.lit(None).cast("string")
        for number, pair in kinds.items():
            found = F.when(draw(salt, len(kinds)) == number, pair[part]).otherwise(found)
        return found

    secret = draw("label", 2) == 1
    context = pick("context", "and ", "then it was ", "de la ", "und der ", "")
    both = [
        F.when(secret, chosen(secrets, "kind", i)).otherwise(chosen(benign, "kind", i)) for i in (0, 1)
    ]
    return numbers.select(
        both[0].alias("value"),
        F.concat(context, both[1]).alias("before"),
        pick("after", " and", ".", '" in', " le", "", ", of").alias("after"),
        F.when(secret, pick("path1", "lib/core", "service", "app/config", "app")).otherwise(
            pick("path0", "lib/core", "service", "tests/data", "docs", "app")
        ).alias("path"),
        secret.cast("double").alias("label"),
    )


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``covered``, the characters of ``value`` in dictionary words; NULL if there are none."""
    parts = found.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), 0)).alias("word"))
    known = parts.distinct().join(words, "word")
    covered = known.groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    values = found.select("value").distinct().join(covered, "value", "left")
    return found.join(values, "value")


def train(labelled: DataFrame, words: DataFrame | None = None) -> RandomForestClassificationModel:
    """Forest on labelled findings (``value``, ``before``, ``after``, ``path``, ``label`` 0 or 1, and
    ``covered`` if known; else ``words``, the dictionary, gives it, and without one it is 0).

    The findings are a bounded table that people or rules have labelled; it is put in one
    order in one partition so that the forest is the same on every run. Findings and features
    are stored, so that the jobs of the forest run small plans.
    """
    labelled = materialize(labelled, "secret-labels")
    if "covered" not in labelled.columns:
        labelled = labelled.withColumn("covered", F.lit(0)) if words is None else with_coverage(labelled, words)
    rows = with_features(labelled).select(*FEATURES, F.col("label").cast("double"))
    rows = materialize(rows, "secret-features")
    rows = rows.coalesce(1).sortWithinPartitions(*FEATURES, "label")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return forest.fit(assembled)


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """Candidates in ``docs`` (``doc_id``, ``text``): ``doc_id``, ``start``, ``value``, ``before``,
    ``after`` and ``path``; ``start`` counts characters from 0."""
    texts = docs.select(
        "doc_id", "text", (F.lit("") if path is None else path).cast("string").alias("path")
    ).filter(F.col("text").rlike(CANDIDATE))
    texts = texts.withColumn("_row", F.monotonically_increasing_id())
    pieces = F.split("text", CANDIDATE, -1)
    values = F.regexp_extract_all("text", F.lit(CANDIDATE), 0)
    edges = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).alias("size"), F.right(p, F.lit(NEIGHBOURS)).alias("tail"), F.left(p, F.lit(NEIGHBOURS)).alias("head")
        ),
    )
    texts = texts.select("_row", "doc_id", "path", edges.alias("edges"), values.alias("values"))
    texts = materialize(texts, "secret-texts")
    follows = F.slice("edges", F.lit(2), F.size("values"))
    zipped = F.arrays_zip("values", F.col("edges").alias("edges"), follows.alias("follows"))
    rows = texts.select("_row", "doc_id", "path", F.posexplode(zipped).alias("place", "one"))
    rows = rows.filter(F.col("one.values").isNotNull())
    upto = Window.partitionBy("_row").orderBy("place")
    length = F.length("one.values")
    start = F.sum(F.col("one.edges.size") + length).over(upto) - length
    rows = rows.withColumn("start", start.cast("long"))
    passed = F.col("one.values").rlike(_PASSED) & ~F.col("one.edges.tail").rlike("[\"'`]$")
    return rows.filter(~passed).select(
        "doc_id",
        "start",
        F.col("one.values").alias("value"),
        F.col("one.edges.tail").alias("before"),
        F.col("one.follows.head").alias("after"),
        "path",
    )


def dictionary(docs: DataFrame) -> DataFrame:
    """``word``: those of four letters or more that a large enough share of the different values of
    ``text`` has outside of candidates. Copies of texts and keys in them change nothing."""
    texts = docs.select("text").filter(F.col("text").isNotNull()).distinct()
    plain = F.lower(F.regexp_replace("text", CANDIDATE, " "))
    own = F.filter(F.split(plain, "[^a-z]+"), lambda w: F.length(w) >= 4)
    words = texts.select(F.explode(F.array_union(F.array(F.lit("")), own)).alias("word"))
    counts = materialize(words.groupBy("word").count(), "secret-words")
    texts = counts.filter("word = ''").head()  # every text counts as one without letters
    least = DICTIONARY_SHARE * (texts["count"] if texts else 0)
    words = counts.filter((F.col("word") != "") & (F.col("count") >= least)).select("word")
    return materialize(words, "secret-dictionary")


def scan_secrets(
    docs: DataFrame, path: Column | None = None, labelled: DataFrame | None = None
) -> DataFrame:
    """All candidates with their verdict: ``doc_id``, ``start``, ``n_chars``, ``value``, ``score`` and
    ``secret``.

    ``score`` is the share of the forest's votes for a secret, ``secret`` whether it is above one
    half. ``path`` is an expression on ``docs``; ``labelled`` replaces the made findings.
    NULL and empty texts have no candidates; repeated rows have theirs each; other columns do
    not matter. An empty table gives no rows.
    """
    found = materialize(candidates(docs, path), "secret-candidates")
    words = dictionary(docs)
    model = train(made_findings(docs.sparkSession, words=words) if labelled is None else labelled, words)
    rows = with_features(with_coverage(found, words))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    scored = model.transform(rows)
    score = vector_to_array("probability")[1]
    return scored.select(
        "doc_id",
        "start",
        F.length("value").alias("n_chars"),
        "value",
        score.alias("score"),
        (score > 0.5).alias("secret"),
    )
