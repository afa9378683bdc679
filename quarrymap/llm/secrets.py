"""Secret scans with a random forest against false positives; DataFrame functions and JVM models only.

Candidates are private keys from their header to their footer, signed tokens with their dots, passwords in URLs, values of any
characters that are assigned to telling names, and long runs of token characters. A random forest trained on labelled findings
then tells secrets from placeholders, identifiers, hashes and prose, by the candidate's length, the shares of its transitions
between kinds of characters, the share of it that dictionary words cover, the words of its path and its neighbouring words.
The dictionary is the words of a fixed list and those that ``COMMON`` documents or more hold, counted over all documents.

Null and empty texts have no findings. Repeated rows have the same findings; of matches that overlap, the one that begins
first counts, assigned values before long runs. Whole texts are searched, however long, in time in proportion to them. An
empty table has no findings. Other columns pass through, those of the result's names are replaced; helper columns begin with
``_qm_``, names that a table must not have. Every finding is returned with its probability; ``is_secret`` drops the false
positives. A path that is missing has no words.
"""

from __future__ import annotations

import random
import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.llm.spans import matches
from quarrymap.session import bounded, checkpointed, table

NAME = r"(?i:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|pwd)"
#: An assignment: a name, then a quoted value of any characters, or one up to a space or a separator.
ASSIGNED = r"(?<![\w.-])[\w.-]++[\"']?+[ \t]*+(?::=|=>|[:=])[ \t]*+(?:\"[^\"\s]{8,}+(?=\")|'[^'\s]{8,}+(?=')|[^\s\"'`,;<>(){}\[\]]{8,}+)"
#: What stands before the value in one.
BEFORE = r"^[\w.-]++[\"']?+[ \t]*+(?::=|=>|[:=])[ \t]*+[\"']?"
#: A private key; the few hyphens inside are those of header fields.
KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:(?<=[A-Za-z0-9])-(?!-)[^-]*+){0,8}+-----END [A-Z ]*PRIVATE KEY-----"
IN_URL = r"(?<![a-zA-Z0-9+.-])[a-zA-Z][a-zA-Z0-9+.-]*+://[^\s:/@\"']*+:[^\s/@\"']{3,}+(?=@)"
IN_URL_BEFORE = r"^[a-zA-Z][a-zA-Z0-9+.-]*+://[^\s:/@\"']*+:(?=[^/])"
SIGNED = r"(?<![A-Za-z0-9+/_=.-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
OTHERS = f"{KEY}|{IN_URL}|{SIGNED}|{RUN}"
#: Common words of code and of placeholders; the corpus adds its own.
WORDS = (
    "about access account action address after again alert also amount another answer application array available back base before begin below between button cache call change check class client code column command common component config connect "
    "content context control count create current custom data database date default delete description detail device different down each element email empty enable entry error event every example export false field file filter find first follow "
    "format found from function general group handle have header help here high host image import index info input insert instance item keep label last layout length level line link list load local location long look make match member message method "
    "model module more name need never next node note null number object only open option order other output page param parent part pass password path place plugin point position prefix project public query record region release remove render report "
    "request reset resource response result return root route rule sample"
).split()
#: Documents that make a word one of the dictionary, and letters that it has at least.
COMMON, LETTERS = 5, 4
#: Characters on either side from which neighbouring words are taken, and how many words.
NEAR, NEAR_WORDS = 200, 6
NEAR_BUCKETS, PATH_BUCKETS = 64, 32
#: Distinct parts of candidates that are broadcast at most.
PARTS = 500_000
KINDS = "aB1-"
FEATURES = ["named", "in_url", "length", "distinct", "digits", "covered", "runs", *(f"from_{i}_to_{j}" for i in range(4) for j in range(4))]
THRESHOLD = 0.5


def kinds(value: Column) -> Column:
    """A value with a for each lower-case letter, B for upper-case, 1 for digits and - for all else."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")


def parts_of(value: Column) -> Column:
    """The words that a value is made of, at changes of case."""
    return F.transform(F.regexp_extract_all(value, F.lit(rf"[A-Z]?[a-z]{{{LETTERS - 1},}}|[A-Z]{{{LETTERS},}}"), F.lit(0)), F.lower)


def _features(value: Column, known: Column, before: Column, after: Column) -> dict[str, Column]:
    """The numbers of a value; ``known``: those of its parts that the dictionary has."""
    length = F.length(value)
    kind = kinds(value)
    listed = length - F.length(F.regexp_replace(F.lower(value), "|".join(sorted((w for w in WORDS if len(w) >= LETTERS), key=lambda w: (-len(w), w))), ""))
    found = F.aggregate(F.filter(parts_of(value), lambda p: F.array_contains(known, p)), F.lit(0), lambda n, p: n + F.length(p))
    # A transition is counted by taking its second character out wherever the first stands before it.
    moves = {f"from_{i}_to_{j}": (length - F.length(F.regexp_replace(kind, f"(?<={a}){b}", ""))) / F.greatest(length - 1, F.lit(1)) for i, a in enumerate(KINDS) for j, b in enumerate(KINDS)}
    return {
        "named": before.rlike(NAME + r"[\w.-]*[\"']?\s*(?::=|=>|[:=])\s*[\"']?$").cast("double"),
        "in_url": (before.rlike(r"://[^\s/@]*:$") & after.startswith("@")).cast("double"),
        "length": F.log1p(length).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(length, F.lit(40)),
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / length,
        "covered": F.greatest(listed, found) / length,
        "runs": (length - F.length(F.regexp_replace(value, r"(.)\1+", "$1"))) / length,
    } | moves


def _words(text: Column) -> Column:
    """Lower-case words, and the parts of those that are names."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+(?=[ :])|[^\\sa-z0-9]"), F.lit(0))


def _near(before: Column, after: Column) -> Column:
    """The neighbouring words, marked with their side."""
    left, right = _words(before), _words(after)
    left = F.slice(left, F.greatest(F.size(left) - NEAR_WORDS + 1, F.lit(1)), F.lit(NEAR_WORDS))
    right = F.slice(right, 1, NEAR_WORDS)
    return F.concat(F.transform(left, lambda w: F.concat(F.lit("<"), w)), F.transform(right, lambda w: F.concat(F.lit(">"), w)))


def _path_words(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(path, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def labelled_findings(count: int = 6000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(value, text before it, text after it, path, 1 for a secret): made-up findings of many kinds."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    base62, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    names = ["token", "api_key", "API_KEY", "secret", "password", "access_key", "auth_token", "client_secret", "db.password", "PASSWD", "github_token", "privateKey", "credential"]
    word = lambda: rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 7)))
    assign = lambda: rng.choice(names) + rng.choice([" = ", "=", ": ", " := "])
    good = ["src/app/main.py", "config/prod.env", "deploy/values.yaml", "src3", "notes/2021.txt", "lib/client.js", "server/settings.ini", ""]
    poor = ["tests/test_api.py", "docs/setup.md", "examples/demo.js", "fixtures/data.json", "test/sample.env", "README.md"]
    camel = lambda: "".join(w.capitalize() for w in (word() for _ in range(rng.randint(3, 6))))
    leet = str.maketrans({"a": "@", "o": "0", "e": "3", "i": "1", "s": "$"})
    password = lambda: (word().translate(leet) if rng.random() < 0.6 else word()) + rng.choice("!#@_-.") * rng.randint(0, 1) + pick(string.digits, 1, 4) + word() + pick("!#$%&*?", 0, 2)
    out = []
    for _ in range(count):
        path = rng.choice(good if rng.random() < 0.7 else poor)
        quote = rng.choice(["", "", '"', "'"])
        lead, tail = prose() + " " + assign() + quote, quote + rng.choice(["", " ", "\n", ";"]) + prose()
        bare, kind = prose() + " ", rng.randrange(18)
        if kind < 4:
            out.append((pick(hexes, 32, 64), lead, tail, path, 1))
        elif kind == 4:
            out.append((pick(base62, 16, 48), lead, tail, path, 1))
        elif kind == 5:
            out.append((pick(base62 + "+/", 40, 64) + "==", lead, tail, path, 1))
        elif kind == 6:
            out.append((rng.choice(["AKIA", "ghp_", "xoxb-", "sk_live_", "glpat-"]) + pick(base62, 16, 40), rng.choice([bare, lead]), tail, path, 1))
        elif kind == 7:
            out.append((pick(base62 + "!@#$%^&*", 9, 24) if rng.random() < 0.5 else password(), lead, tail, path, 1))
        elif kind == 8:
            out.append((pick(base62, 6, 20) if rng.random() < 0.5 else password(), bare + rng.choice(["postgres", "https", "redis", "amqp", "mysql"]) + "://" + word() + ":", "@" + word() + "/" + word(), path, 1))
        elif kind == 9:
            out.append((".".join(["eyJ" + pick(base62, 15, 40), pick(base62, 30, 90), pick(base62 + "_-", 40, 44)]), rng.choice([bare, lead]), tail, path, 1))
        elif kind == 10:
            out.append(("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(base62 + "+/", 64, 64) for _ in range(rng.randint(3, 12))) + "\n-----END RSA PRIVATE KEY-----", bare, "\n" + prose(), path, 1))
        elif kind == 11:
            out.append((rng.choice(["_", "-", "", "/"]).join(word() for _ in range(rng.randint(3, 8)))[:70].ljust(20, "e"), rng.choice([bare, lead]), tail, path, 0))
        elif kind == 12:
            out.append((pick(hexes, 32, 64), bare + rng.choice(["commit ", "sha256: ", "md5 = ", "checksum: ", "etag: ", "revision ", "digest=sha256:", "integrity "]), tail, path, 0))
        elif kind == 13:
            value = rng.choice(["your_token_here", "changeme12345678", "xxxxxxxxxxxxxxxxxxxxxxxx", "example_secret_value", "test1234567890abcdef", "00000000000000000000", "insert-your-key-here", "<password>", "$DB_PASSWORD", "${API_TOKEN}", "placeholder", "getenv('TOKEN')", "os.environ['KEY']"])
            out.append((value + pick("x0", 0, 6), lead, tail, rng.choice(poor + good), 0))
        elif kind == 14:
            out.append(("-".join(pick(hexes, n, n) for n in (8, 4, 4, 4, 12)), bare + rng.choice(["uuid: ", "id = ", "", "request "]), tail, path, 0))
        elif kind == 15:
            out.append((pick(string.digits, 20, 30), bare, " " + prose(), path, 0))
        elif kind == 16:
            out.append((camel()[:60].ljust(20, "e"), rng.choice([bare, lead]), rng.choice(["(", ".", " "]) + prose(), path, 0))
        else:
            out.append((rng.choice("=-_*") * rng.randint(20, 80), rng.choice(["", bare]), "\n" + prose(), path, 0))
    return out


def train(spark: SparkSession, count: int = 6000, seed: int = 5) -> PipelineModel:
    """The forest of the labelled findings."""
    rows = spark.createDataFrame(labelled_findings(count, seed), "value string, before string, after string, path string, label int").repartition(4)
    listed = F.array(*map(F.lit, WORDS))
    made = rows.withColumns({"_qm_" + n: c for n, c in _features(F.col("value"), listed, F.col("before"), F.col("after")).items()} | {"_qm_near": _near(F.col("before"), F.col("after")), "_qm_path": _path_words(F.col("path"))})
    hashed = [HashingTF(inputCol="_qm_near", outputCol="_qm_near_v", numFeatures=NEAR_BUCKETS, binary=True), HashingTF(inputCol="_qm_path", outputCol="_qm_path_v", numFeatures=PATH_BUCKETS, binary=True)]
    gathered = VectorAssembler(inputCols=["_qm_" + n for n in FEATURES] + ["_qm_near_v", "_qm_path_v"], outputCol="_qm_features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="_qm_features", probabilityCol="_qm_probability", rawPredictionCol="_qm_raw", predictionCol="_qm_prediction", numTrees=30, maxDepth=10, featureSubsetStrategy="onethird", seed=seed)
    return Pipeline(stages=[*hashed, gathered, forest]).fit(made)


def candidates(text: Column) -> Column:
    """array<struct<start, end, value>> of a text's candidates, in code points, end exclusive."""
    whole = lambda m, skip: F.struct((m["start"] + skip).cast("int").alias("start"), m["end"].alias("end"), F.substring(m["value"], skip + 1, F.length(m["value"])).alias("value"))
    skipped = lambda m, pattern: F.length(F.regexp_extract(m["value"], pattern, 0))
    assigned = F.filter(matches(text, ASSIGNED, text.rlike(NAME)), lambda m: F.regexp_extract(m["value"], BEFORE, 0).rlike(NAME))
    assigned = F.transform(assigned, lambda m: whole(m, skipped(m, BEFORE)))
    # A URL's scheme and user may look like a name with a value; its password is what counts.
    assigned = F.filter(assigned, lambda m: ~m["value"].rlike(r"^//|://[^\s:/@]*:[^\s/@]+@|^eyJ|^-----BEGIN"))
    others = F.transform(matches(text, OTHERS), lambda m: whole(m, F.when(m["value"].startswith("-----BEGIN"), F.lit(0)).otherwise(skipped(m, IN_URL_BEFORE))))
    free = F.filter(others, lambda o: ~F.exists(assigned, lambda a: (a["start"] < o["end"]) & (o["start"] < a["end"])))
    return F.array_sort(F.concat(assigned, free))


def dictionary(docs: DataFrame, parts: DataFrame, text: str = "text") -> DataFrame:
    """Those of ``parts`` (part) that ``COMMON`` of the documents or more hold as words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(rf"[a-z]{{{LETTERS},}}"), F.lit(0)))
    each = docs.select(F.explode(words).alias("part")).join(bounded(parts, PARTS), "part", "left_semi")
    return each.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("part")


def scan(docs: DataFrame, model: PipelineModel, text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each finding: the columns of ``docs`` but the text, start, end, probability, is_secret, value_sha256.

    start and end are code points of the value, end exclusive. Values themselves are not returned.
    """
    names = {"start", "end", "probability", "is_secret", "value_sha256"}
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in names | {text}]
    full, at = F.col("_qm_text"), F.col("_qm_m")
    placed = docs.select(*columns, (F.col(f"`{path}`") if path else F.lit("")).alias("_qm_at"), F.col(f"`{text}`").alias("_qm_text"))
    found = F.transform(
        candidates(full),
        lambda m: F.struct(
            *(m[x].alias(x) for x in ("start", "end", "value")),
            F.substring(full, F.greatest(m["start"] - NEAR, F.lit(0)) + 1, F.least(m["start"], F.lit(NEAR))).alias("before"),
            F.substring(full, m["end"] + 1, F.lit(NEAR)).alias("after"),
        ),
    )
    each = placed.select(*columns, "_qm_at", F.explode(found).alias("_qm_m")).withColumn("_qm_id", F.uuid())
    each = checkpointed(each)  # the ids are written out with the rows and so stay what they are
    parts = each.select("_qm_id", F.explode(F.array_distinct(parts_of(at["value"]))).alias("part"))
    common = checkpointed(dictionary(docs, checkpointed(parts.select("part").distinct()), text))
    known = parts.join(bounded(common, PARTS), "part").groupBy("_qm_id").agg(F.collect_set("part").alias("_qm_known"))
    each = each.join(known, "_qm_id", "left")
    listed = F.array(*map(F.lit, WORDS))
    numbers = _features(at["value"], F.coalesce(F.concat("_qm_known", listed), listed), at["before"], at["after"])
    made = each.select(
        *columns, at["start"].alias("start"), at["end"].alias("end"), F.sha2(at["value"], 256).alias("value_sha256"),
        *(c.alias("_qm_" + n) for n, c in numbers.items()), _near(at["before"], at["after"]).alias("_qm_near"), _path_words(F.col("_qm_at")).alias("_qm_path"),
    )
    scored = model.transform(made).withColumn("_qm_p", F.round(vector_to_array("_qm_probability")[1], 6))
    return scored.select(*columns, "start", "end", "value_sha256", F.col("_qm_p").alias("probability"), (F.col("_qm_p") >= THRESHOLD).alias("is_secret"))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """The findings in every document. The table has no paths: the source and the id stand for one, and have no telling words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return scan(docs, train(spark), path="path").drop("path")
