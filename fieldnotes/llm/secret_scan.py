"""Secret scan on native expressions: wide candidate rules, and a random forest that removes false positives.

Candidates are known key formats, values assigned to telling names, and long tokens that mix letters with digits.
Their places come from split() and regexp_extract_all(). A forest is trained on labelled findings, with features of
the value (length, shares and changes of character classes, distinct characters), of how far a dictionary of word
parts covers it, of its path and of the words around it; only candidates that it takes for secrets are reported as
such. Everything runs as DataFrame expressions and Spark's own forest.

Null and empty texts have no candidates. Repeated rows are scanned each for itself; equal values in a text are
separate findings. Clashing column names are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats of issued keys, in the order in which they are tried. Runs have no upper bound and don't backtrack; formats
#: of a fixed length leave longer runs to the rule for long tokens.
FORMATS = (
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?![\s\S]{0,15}-----END )(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    ("aws_key", r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("github_token", r"(?:gh[pousr]_[0-9A-Za-z]{36,}+|github_pat_[0-9A-Za-z_]{22,}+)"),
    ("slack_token", r"xox[abeoprs]-[0-9A-Za-z-]{10,}+"),
    ("google_key", r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    ("stripe_key", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+"),
    ("sk_key", r"sk-[0-9A-Za-z_-]{20,}+"),
    ("web_token", r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"),
    ("url_password", r"[a-z][a-z+]{1,12}://[^\s:/@]++:[^\s:/@]{3,}+@"),
)
NAMES = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)"
NAMED = rf"(?i:{NAMES})[\"']?[ \t]{{0,4}}(?::=|=>|[:=])[ \t]{{0,4}}[\"']?"
#: An assigned value is a key in lines, or an issued key with what follows it, or any run.
RUN = r"[^\s\"',;]"
ASSIGNED = rf"{NAMED}(?:{FORMATS[0][1]}|(?:{'|'.join(f for _, f in FORMATS[1:])}){RUN}*+|{RUN}{{6,}}+)"
#: A long token begins where no other goes on, or right behind the last hit.
LONG = r"(?:\G|(?<![0-9A-Za-z+/_-]))(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[0-9A-Za-z+/_-]{16,}+={0,2}"
CANDIDATE = "|".join(["(?:" + f + ")" for _, f in FORMATS] + [ASSIGNED, LONG])
#: Parts of words that make up most ordinary text and identifiers.
DICTIONARY = r"(?:tion|ment|ing|ent|the|and|ion|ter|con|pro|com|ver|per|user|name|file|test|data|key|value|index|html|http|www|path|home|example|sample|config|class|list|page|item|null|true|false|version|image|size|type|number|date|time|[aeiou][bcdfghjklmnpqrstvwxz]e|[bcdfghjklmnpqrstvwxz][aeiou][nrstl])"
FEATURES = ("length", "digits", "upper", "lower", "signs", "changes", "clusters", "distinct", "hexadecimal", "covered", "issued", "assigned", "near", "against", "path", "placeholder", "quoted")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, nth, start, hit, before, after, path) of all candidates; start counts characters from 0."""
    rx = CANDIDATE.replace("'", "\\u0027")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_t"), (F.col(path).cast("string") if path else F.lit("")).alias("path"))
    rows = rows.filter(F.col("_t").rlike(CANDIDATE))
    hits, gaps = F.regexp_extract_all("_t", F.lit(rx), F.lit(0)), F.split("_t", rx, -1)
    rows = rows.withColumn("_hits", hits).withColumn("_gaps", gaps)
    starts = F.expr(
        "aggregate(sequence(0, size(_hits) - 1), named_struct('at', 0, 'all', cast(array() as array<int>)), (s, i) -> "
        "named_struct('at', s.at + length(_gaps[i]) + length(_hits[i]), 'all', concat(s.all, array(s.at + length(_gaps[i])))), s -> s.all)"
    )
    rows = rows.filter(F.size("_hits") > 0).withColumn("_starts", starts)
    each = F.expr(
        "transform(_hits, (h, i) -> struct(i as nth, _starts[i] as start, h as hit, right(_gaps[i], 64) as before, left(_gaps[i + 1], 32) as after))"
    )
    return rows.select("doc_id", "path", F.explode(each).alias("c")).select("doc_id", "c.nth", "c.start", "c.hit", "c.before", "c.after", "path")


def _share(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(kind)) / F.greatest(F.length(c), F.lit(1))


def featured(found: DataFrame) -> DataFrame:
    """Candidates with `kind`, `value` (the part that is secret) and the features."""
    hit = F.col("hit")
    issued = lambda c, rest: reduce(lambda rest, f: F.when(c.rlike("^(?:" + f[1] + ")$"), f[0]).otherwise(rest), reversed(FORMATS), rest)
    assigned = F.regexp_extract("hit", rf"(?s)^{NAMED}(.*)$", 1)
    # an assigned value that is an issued key as a whole has that key's kind
    frame = found.withColumn("kind", issued(hit, F.when(hit.rlike("^" + ASSIGNED), "assigned").otherwise("token")))
    frame = frame.withColumn("value", F.when(F.col("kind") == "assigned", assigned).otherwise(hit))
    frame = frame.withColumn("_named", F.col("kind") == "assigned")
    frame = frame.withColumn("kind", F.when(F.col("_named"), issued(F.col("value"), F.lit("assigned"))).otherwise(F.col("kind")))
    frame = frame.withColumn("value", F.when(F.col("kind") == "url_password", F.regexp_extract("value", r"://[^:]*:([^@]*)@$", 1)).otherwise(F.col("value")))
    v, low, before = F.col("value"), F.lower("value"), F.lower("before")
    changes = r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"
    flag = lambda c: c.cast("double")
    return frame.withColumns({
        "length": F.log1p(F.length(v)),
        "digits": _share(v, "[0-9]"),
        "upper": _share(v, "[A-Z]"),
        "lower": _share(v, "[a-z]"),
        "signs": _share(v, "[^0-9A-Za-z]"),
        "changes": _share(v, changes),
        "clusters": _share(low, "[bcdfghjklmnpqrstvwxz]{3}"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.length(v), F.lit(1)),
        "hexadecimal": flag(low.rlike("^[0-9a-f]+$")),
        "covered": (F.length(v) - F.length(F.regexp_replace(low, DICTIONARY, ""))) / F.greatest(F.length(v), F.lit(1)),
        "issued": flag(~F.col("kind").isin("assigned", "token")),
        "assigned": flag(F.col("_named") | before.rlike(rf"{NAMES}[^\n]{{0,12}}$")),
        "near": flag(before.rlike(rf"{NAMES}|bearer|login|key")),
        "against": flag(before.rlike(r"commit|revision|sha-?[0-9]|md5|checksum|digest|hash|uuid|guid|isbn|order|invoice|serial|version|https?://|www\.")),
        "path": flag(F.lower(F.coalesce("path", F.lit(""))).rlike("test|example|sample|mock|fixture|docs?/")),
        "placeholder": flag(low.rlike(r"example|changeme|placeholder|dummy|your[_-]|xxxx|0000000|1234567|abcdef|<|\$\{|redacted|process\.env|none|null")),
        "quoted": flag(before.rlike("[\"'`]$")),
    }).drop("_named")


def labelled_findings(spark: SparkSession, each: int = 160) -> DataFrame:
    """Labelled findings to train on, made from rules: per template `each` values drawn by hashes. Columns hit,
    before, after, path, label."""
    h = "sha2(concat('s', id, '-', {n}), 512)"
    hexa, b64 = h.format(n=1), f"regexp_replace(base64(unhex({h.format(n=2)})), '[=]', '')"
    letters = f"upper(translate(base64(unhex({h.format(n=3)})), '+/=', 'QZ7'))"
    word = f"element_at(array('internationalisation2', 'configuration_file_v2', 'the_quick_brown_fox_9', 'user-profile-image-01', 'responsibilities42', 'chapter-12-conclusion', 'release-notes-2024-05'), cast(pmod(hash(id), 7) as int) + 1)"
    pad = "element_at(array('', 'on the ', 'set ', 'config: ', 'und die ', 'avec '), cast(pmod(hash(id, 5), 6) as int) + 1)"
    path = "element_at(array('src/app.py', 'conf/prod.yml', 'src3', 'blog/post', ''), cast(pmod(hash(id, 9), 5) as int) + 1)"
    aside = "element_at(array('tests/mock.py', 'docs/example.md', 'src1', 'src/app.py'), cast(pmod(hash(id, 9), 4) as int) + 1)"
    n = lambda low, span: f"{low} + cast(pmod(hash(id, 3), {span}) as int)"
    yes = [
        (f"concat('AKIA', left({letters}, 16))", pad), (f"concat('ghp_', left(regexp_replace({b64}, '[+/]', 'x'), 36))", pad),
        (f"concat('sk-', left(regexp_replace({b64}, '[+/]', 'k'), {n(24, 20)}))", pad), (f"concat('xoxb-', left({hexa}, {n(20, 20)}))", pad),
        (f"concat('eyJ', left(regexp_replace({b64}, '[+/]', 'a'), 20), '.', left({hexa}, 30), '.', right({hexa}, 40))", pad),
        (f"concat('password=', left({hexa}, {n(10, 14)}))", pad), (f"concat('token = \"', left({hexa}, {n(24, 17)}))", pad),
        (f"concat('api_key: ', left({b64}, {n(20, 20)}))", pad), (f"concat('secret=', left({b64}, {n(12, 24)}))", pad),
        (f"concat('passwd: ', left(regexp_replace({b64}, '[+]', '!'), {n(8, 8)}))", pad),
        (f"left({b64}, {n(32, 12)})", f"concat({pad}, 'key ')"), (f"concat('postgres://app:', left({b64}, 12), '@')", pad),
        (f"concat('AKIA', left({letters}, 16))", "''"), (f"concat('pwd=', left({hexa}, {n(8, 12)}))", "''"),
    ]
    no = [
        (f"left({hexa}, 40)", "concat('commit ', '')"), (f"left({hexa}, 32)", "'md5: '"), (f"left({hexa}, 64)", "'sha256 checksum '"),
        (f"concat(left({hexa}, 8), '-', substr({hexa}, 9, 4), '-', substr({hexa}, 13, 4), '-', substr({hexa}, 17, 4), '-', substr({hexa}, 21, 12))", pad),
        (word, pad), (f"concat({word}, '/', {word})", "'https://www.site.example/'"), ("concat('password=', 'changeme', pmod(id, 100))", pad),
        ("concat('token: <your-token-', pmod(id, 50), '>')", pad), ("concat('api_key=YOUR_API_KEY_', pmod(id, 9))", pad),
        ("concat('password: ${DB_PASSWORD', pmod(id, 9), '}')", pad), ("concat('AKIAIOSFODNN', '7EXAMPLE')", "'for example '"),
        ("concat('order-', 100000000000 + id, '-eu')", "'your order '"), ("concat('2024-05-', 10 + pmod(id, 20), 'T12-', 10 + pmod(id, 50), '-00Z')", pad),
        (f"concat('secret: ', element_at(array('ingredient', 'garden', 'service', 'society', 'admirer'), cast(pmod(id, 5) as int) + 1))", "'the '"),
        (f"concat('token: ', element_at(array('economy', 'gesture', 'classification', 'embedding', 'sequence'), cast(pmod(id, 5) as int) + 1))", "'a '"),
        (f"concat('img_', left({hexa}, 12), '_large')", "'https://cdn.example/'"),
    ]
    base = spark.range(each)
    parts = [
        base.selectExpr(f"{hit} as hit", f"{before} as before", "' and more' as after", f"{aside if not label else path} as path", f"{label}.0 as label")
        for label, templates in ((1, yes), (0, no)) for hit, before in templates
    ]
    return reduce(DataFrame.unionByName, parts).coalesce(1)


def train(labelled: DataFrame, trees: int = 24, depth: int = 6) -> PipelineModel:
    """A forest over the features of labelled findings (hit, before, after, path, label)."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="_features"),
        RandomForestClassifier(labelCol="label", featuresCol="_features", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", numTrees=trees, maxDepth=depth, seed=11),
    ]
    return Pipeline(stages=stages).fit(featured(labelled))


def scan(docs: DataFrame, path: str | None = None, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, nth, start, n_chars, kind, value, score, is_secret) of all candidates. labelled: findings to train
    on instead of the built-in ones."""
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    scored = model.transform(featured(candidates(docs, path)))
    score = vector_to_array("_p")[1]
    return scored.select(
        "doc_id", "nth", (F.col("start") + F.instr("hit", F.col("value")) - 1).alias("start"), F.length("value").alias("n_chars"), "kind", "value", score.alias("score"), (score >= threshold).alias("is_secret")
    )


#: Rows and characters of secrets that may go to every task; more are joined by a shuffle.
ROWS, CHARACTERS = 20_000, 2_000_000


def redact(docs: DataFrame, path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in `text` replaced by a mark and n_chars brought up to date."""
    from fieldnotes.llm.base import row_key, saved

    # findings belong to their row, also where ids are null or repeated
    keyed = docs.withColumn("_row", row_key())
    # the longest go first, so that none is broken up by another that it holds
    found = scan(keyed.withColumn("doc_id", F.col("_row")), path).filter("is_secret").groupBy(F.col("doc_id").alias("_row")).agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False)["value"].alias("_values"))
    found = saved(found, "secrets")
    size = found.agg(F.count("*").alias("rows"), F.sum(F.expr("aggregate(_values, 0, (n, v) -> n + length(v))")).alias("characters")).first()
    small = size["rows"] <= ROWS and (size["characters"] or 0) <= CHARACTERS
    text = F.expr(f"aggregate(coalesce(_values, array()), text, (t, v) -> replace(t, v, '{mark}'))")
    joined = keyed.join(F.broadcast(found) if small else found, "_row", "left")
    changed = joined.withColumn("text", F.when(F.col("_values").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_values").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)
