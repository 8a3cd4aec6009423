"""Operator 10, secret scans: proposed strings and a random forest that removes false positives.

A pattern proposes long unbroken strings. The forest judges each by its length, the transitions
between its characters, how much of it dictionary words cover, the path of the document and the
words before it. It is trained here, by Spark's own implementation, on labelled findings, and turned
into one SQL expression: scanning is a projection without shuffles or Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.scratch import Scratch, read

#: Runs of 16 and more; a run starts where no letter, digit or joining sign stands before it. Up to two
#: signs = at its end are padding and its own, unless a value follows them: then it is a key.
CANDIDATE = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{16,}+(?![\p{L}\p{N}])(?:={1,2}+(?![\p{L}\p{N}]))?+"
BEFORE = 40
SECRET_WORDS = "token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer"
PLAIN_WORDS = "sha[0-9]|md5|checksum|digest|commit|integrity|hash|uuid|version|revision|build|order|invoice|etag"
SAMPLE_PATHS = "test|example|sample|fixture|mock|demo|docs?/"
DICTIONARY = (
    "access account action address admin agent array asset auth author banner base batch board body boot border bottom break buffer build button "
    "cache call case change channel check child class clear client close code color column command comment commit common config connect "
    "content context control cookie copy count create current custom data date default delete detail device dialog direct disable display document "
    "domain down edit element empty enable entry error event example exit export false field file filter find first flag float folder font footer "
    "force form format from frame function general global group handler hash head header height hello help here hidden history host icon image "
    "import index info init inner input insert instance item join json just keep kind label large last layout left length level library light line link "
    "list load local lock logo main manager map mark mask master match menu message method middle mode model module mouse move name native "
    "next node none note null number object offset open option order other output outer owner package page panel parent parse part pass password path "
    "payload peer phone pixel place player point policy pool port post prefix print private process product profile project prompt property public query "
    "queue quick random range read record region release remote remove render replace report request reset resource response result return right role "
    "root route row rule save scale schema screen script scroll search secret section select send server service session share shared show side "
    "signal simple single size small sort source space stack stage start state static status step stop storage store stream string style submit "
    "success suffix switch symbol sync system table target task template test text theme thread time title token tool total track tree true type "
    "undo unit unknown update upload user utils valid value vector version view visible warning watch width window word worker write your zone"
).split()
FEATURES = (
    "length", "class_changes", "distinct", "vowel_changes", "dictionary", "digits", "upper", "lower", "hex", "joins", "repeats", "assigned", "secret_word", "plain_word", "sample_path",
)


def features(match: Column, before: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of one candidate; before: the text that precedes it."""
    n = F.length(match).cast("double")
    share = lambda pattern: F.regexp_count(match, F.lit(pattern)) / n
    low = F.lower(match)
    classes = reduce(lambda c, p: F.regexp_replace(c, *p), (("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "9"), ("[^aB9]", "_")), match)
    vowels = F.regexp_replace(F.regexp_replace(low, "[aeiouy]", "A"), "[a-z]", "B")
    words = "(?:" + "|".join(sorted((w for w in DICTIONARY if len(w) >= 4), key=len, reverse=True)) + ")"
    left = n - F.length(F.regexp_replace(low, words, ""))
    near = F.lower(before)
    flag = lambda column, pattern: column.rlike(pattern).cast("double")
    return {
        "length": F.least(n, F.lit(200.0)),
        "class_changes": F.regexp_count(classes, F.lit(r"(.)(?!\1)(?=.)")) / n,
        "distinct": F.size(F.array_distinct(F.regexp_extract_all(match, F.lit("."), F.lit(0)))) / F.least(n, F.lit(64.0)),
        "vowel_changes": F.regexp_count(vowels, F.lit("A(?=B)|B(?=A)")) / n,
        "dictionary": left / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hex": flag(match, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "joins": share("[/_-]"),
        "repeats": F.regexp_count(match, F.lit(r"(.)(?=\1)")) / n,
        "assigned": flag(before, r"""[=:]\s*["'`]?\s*$"""),
        "secret_word": flag(near, f"(?:{SECRET_WORDS})[^\n]{{0,24}}$"),
        "plain_word": flag(near, f"(?:{PLAIN_WORDS})[^\n]{{0,16}}$"),
        "sample_path": flag(F.lower(F.coalesce(path, F.lit(""))), SAMPLE_PATHS),
    }


def labelled_findings(spark: SparkSession, rows: int = 3600, first: int = 0, part: tuple[int, ...] | None = None) -> DataFrame:
    """match, before, path, secret: findings made by rule, in the forms that scans meet.

    ``part`` takes only the forms whose number modulo 4 is in it, so that a forest can be tried on forms that it was not fitted on.
    """
    i = F.col("id")
    sha = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 256)
    other = F.sha2(F.concat(F.lit("second"), i.cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(F.concat(sha, other))), "+/=", "aZ9")
    word = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.conv(F.substring(sha, 1 + 3 * k, 3), 16, 10).cast("int") % len(DICTIONARY) + 1).cast("int"))
    syllable = lambda k: F.element_at(F.array(*map(F.lit, "th er on an re he in ed nd ha at en es of or nt ea ti to it st ar ou is ent sch ung che ver los cion ment".split())), (F.conv(F.substring(other, 1 + 2 * k, 2), 16, 10).cast("int") % 32 + 1).cast("int"))
    pseudo = F.substring(F.concat(*[syllable(k) for k in range(16)]), F.lit(1), (F.lit(16) + i % 14).cast("int"))
    uuid = F.regexp_replace(F.substring(sha, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    upper = F.when(i % 2 == 0, F.lit("")).otherwise(F.lit("the "))
    src, fixture = F.lit("src7"), F.lit("tests/fixtures/data")
    forms = [
        (F.substring(sha, 1, 40), F.concat(upper, F.lit('token = "')), src, 1),
        (F.upper(F.substring(sha, 1, 40)), F.lit('!! TOKEN = "'), src, 1),
        (F.substring(sha, 1, 32), F.lit("api_key: "), src, 1),
        (F.substring(b64, F.lit(1), (F.lit(20) + i % 30).cast("int")), F.lit('secret = "'), src, 1),
        (F.substring(b64, F.lit(3), (F.lit(16) + i % 9).cast("int")), F.lit("password='"), src, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(b64, 2, 16), "0189", "2345"))), F.lit("aws access key id "), src, 1),
        (F.concat(F.lit("ghp_"), F.substring(b64, 5, 36)), F.lit("see "), src, 1),
        (F.substring(sha, 1, 64), F.lit("bearer credential "), src, 1),
        (F.substring(b64, F.lit(1), (F.lit(32) + i % 20).cast("int")), F.lit("of the "), src, 1),
        (F.substring(sha, 1, 40), F.lit("fixed in commit "), src, 0),
        (F.substring(sha, 1, 64), F.lit("sha256 checksum: "), src, 0),
        (uuid, F.lit("request uuid = "), src, 0),
        (F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3))), F.lit("calls "), src, 0),
        (F.concat_ws("_", F.lit("your"), word(0), word(1), word(2), F.lit("here")), F.lit('token = "'), src, 0),
        (F.concat(F.lit("1"), F.conv(F.substring(sha, 1, 14), 16, 10)), F.lit("order number: "), src, 0),
        (F.repeat(F.substring(F.lit("xX0*a"), (i % 5 + 1).cast("int"), F.lit(1)), (F.lit(16) + i % 20).cast("int")), F.lit('api_key = "'), src, 0),
        (F.concat_ws("/", word(0), word(1), word(2), F.concat(word(3), F.lit("_2"))), F.lit("path: "), src, 0),
        (pseudo, F.lit("the auth of "), src, 0),
        (F.initcap(pseudo), F.lit("and "), src, 0),
        (F.upper(pseudo), F.lit("!! AND!! "), src, 0),
        (F.upper(pseudo), F.lit("KEIN TOKEN "), src, 0),
        (F.substring(sha, 1, 40), F.lit('token = "'), fixture, 0),
        (F.concat(F.lit("sha512-"), F.substring(b64, 1, 60)), F.lit('integrity="'), src, 0),
        (F.conv(F.substring(sha, 1, 15), 16, 10), F.lit("card "), src, 0),
        (F.concat(F.lit("4"), F.lpad(F.conv(F.substring(sha, 1, 12), 16, 10), 15, "7")), F.lit("token of "), src, 0),
        (F.concat(F.lit("ghp_"), F.substring(b64, 5, 36)), F.lit("API_TOKEN="), src, 1),
        (F.substring(sha, 1, 32), F.lit("/v1/items?access_token="), src, 1),
        (F.substring(b64, 1, 40), F.lit("export AWS_SECRET_ACCESS_KEY="), src, 1),
        (F.substring(b64, F.lit(7), (F.lit(16) + i % 20).cast("int")), F.lit(";User=app;Password="), src, 1),
        (F.concat_ws("_", word(0), F.lit("secret"), word(1), F.lit("key")), F.lit("export "), src, 0),
        (F.upper(F.concat_ws("_", word(0), word(1), F.lit("api_token"))), F.lit("\n"), src, 0),
        (F.substring(sha, 1, 40), F.lit("GIT_COMMIT="), src, 0),
        (uuid, F.lit("/cart?order="), src, 0),
        (F.concat_ws("-", word(0), word(1), word(2), word(3)), F.lit("/list?next_token_page="), src, 0),
    ]
    forms = [f for n, f in enumerate(forms) if part is None or n % 4 in part]
    one = F.element_at(
        F.array(*[F.struct(m.alias("match"), b.alias("before"), p.alias("path"), F.lit(s).cast("double").alias("secret")) for m, b, p, s in forms]),
        (i % len(forms) + 1).cast("int"),
    )
    return spark.range(first, first + rows, 1, 2).select(one.alias("x")).select("x.*")


def trees_of(debug: str) -> list:
    """Nested (feature, threshold, left, right) or class, from the text a fitted forest prints."""
    out = []
    for block in re.split(r"\n\s*Tree \d+[^\n]*\n", debug)[1:]:
        lines = iter(x.strip() for x in block.strip().splitlines())

        def grow(lines=lines):
            line = next(lines)
            if line.startswith("Predict"):
                return float(line.split(":")[1])
            f, t = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            low = grow()
            next(lines)  # Else
            return int(f), float(t), low, grow()

        out.append(grow())
    return out


def training_table(findings: DataFrame) -> DataFrame:
    """secret, FEATURES, features (a vector of them); rows with nulls in match, before or secret are left out."""
    seen = findings.dropna(subset=["match", "before", "secret"])
    table = seen.select("secret", *[c.alias(n) for n, c in features(F.col("match"), F.col("before"), F.col("path")).items()])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)


def fit_model(findings: DataFrame, *, trees: int = 25, depth: int = 7, seed: int = 7):
    """The training table is the caller's and should be of bounded size; it stays distributed."""
    forest = RandomForestClassifier(labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, cacheNodeIds=False)
    return forest.fit(training_table(findings).select("secret", "features"))


def fit_forest(findings: DataFrame, *, trees: int = 25, depth: int = 7, seed: int = 7) -> list:
    """Trees for (match, before, path, secret), as ``vote`` takes them."""
    return trees_of(fit_model(findings, trees=trees, depth=depth, seed=seed).toDebugString)


def vote(trees: list, values: Column) -> Column:
    """Share of the trees that call it a secret; values: a struct of FEATURES."""

    def walk(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, t, low, high = node
        return F.when(values[FEATURES[f]] <= t, walk(low)).otherwise(walk(high))

    return reduce(lambda a, b: a + b, map(walk, trees)) / len(trees)


SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string>>"


def candidates(text: Column) -> Column:
    """array<struct<start, end, match, before>> in code points, end exclusive; before: the BEFORE characters of the text."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        before = F.substring(F.concat(state["tail"], x["gap"]), -BEFORE, BEFORE)
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["match"].alias("match"), before.alias("before"))
        tail = F.substring(F.concat(before, x["match"]), -BEFORE, BEFORE)
        return F.struct(end.cast("long").alias("at"), tail.alias("tail"), F.concat(state["found"], F.array(one)).alias("found"))

    matches = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.slice(F.split(text, CANDIDATE, -1), 1, F.size(matches))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), zero, step, lambda s: s["found"])
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, trees: list, *, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_candidates, secrets array<struct<start, end, score>>.

    ``path`` names the column that says where a document comes from. Null and empty texts have no
    candidates; a null path is no sample's. Repeated rows give repeated results. Texts and candidates
    of any length are seen whole; other columns are not read.
    """
    found = docs.select("doc_id", F.col(path).alias("path"), candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found"))
    seen = F.transform(
        "found",
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.struct(*[v.alias(n) for n, v in features(c["match"], c["before"], F.col("path")).items()]).alias("x")),
    )
    scored = found.select("doc_id", F.size("found").cast("long").alias("n_candidates"), seen.alias("seen"))
    scores = F.transform("seen", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), vote(trees, s["x"]).alias("score")))
    return scored.select("doc_id", "n_candidates", F.filter(scores, lambda s: s["score"] > threshold).alias("secrets"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end, comma-joined)."""
    trees = fit_forest(Scratch(spark, "secrets").table(labelled_findings(spark), "findings"))
    found = scan(read(spark, sf_dir, "documents"), trees)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))
