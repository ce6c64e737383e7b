"""Secret scanning: candidates by a pattern, false positives removed by a random forest.

All of it is DataFrame expressions and pyspark.ml: candidates (long runs of key
characters with a digit or of capitals, and whatever is assigned to a credential
word), their length, the shares of transitions between character classes, the
share covered by dictionary words, and hashed path and neighbouring words. The
forest learns from labelled findings, a table that the caller gives;
``rule_labels`` makes one from formats that leave no doubt, for a corpus that has
no reviewed findings. The forest learns every finding twice, with its
neighbours and without, so that it judges what the rules leave open by the
characters too: a key that no credential word announces, capitals that are words.
``held_out`` measures it on findings that it has not seen.

The dictionary is the ``most`` words that stand in most distinct texts of the
whole corpus. Labels are given to the candidates of every text; the forest learns
from at most ``max_findings`` of them, distinct by candidate and neighbourhood
and drawn per label in proportion, but for a tenth at least where a label has
that many. Scanning covers every whole text.

Defined results: null and empty texts have no findings; texts of any length are
scanned whole; equal candidates of a text are one, judged by the first place;
repeated rows give the same result each; a null path is the empty path; a score
equal to the threshold (ties) is a finding; where the labels are all alike every
candidate gets that label, and without labels none is a finding; an empty table
gives no rows; further columns stay as they are, but for columns named like the
result's own, which the result replaces.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import stored, table

SIGNS = "_+/.@!$%#~^*-"
KEY = "A-Za-z0-9" + SIGNS
CANDIDATE = rf"(?<![{KEY}])(?=[A-Za-z{SIGNS}]*+[0-9]|[A-Z]{{12}})[{KEY}]{{12,}}+={{0,2}}"
CREDENTIAL = "password|passwd|passphrase|secret|token|api_?key"
ASSIGNED = rf"(?i)(?:{CREDENTIAL})[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]{{8,}})"
AROUND = 48
RESULT = ("n_candidates", "secrets", "redacted")
CLASSES = "LUDS"
MARK = "[SECRET]"


def _strings(text: Column) -> Column:
    """The distinct candidates of a text."""
    long_ = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda c: F.regexp_replace(c, "[.@/+!-]+$", ""))
    assigned = F.transform(F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1)), lambda c: F.regexp_replace(c, "[.!)]+$", ""))
    return F.array_union(F.filter(long_, lambda c: F.length(c) >= 12), F.filter(assigned, lambda c: F.length(c) >= 8))


def candidates(documents: DataFrame, path: Column) -> DataFrame:
    """One row per distinct candidate of a text: h (a hash of the row), candidate, before, after, path."""
    rows = documents.select(F.xxhash64("doc_id", "text", path).alias("h"), "text", F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("c", F.explode(_strings(F.col("text"))))
    at = F.instr(F.col("text"), F.col("c"))
    before = F.substring("text", F.greatest(at - AROUND, F.lit(1)), F.least(at - 1, F.lit(AROUND)))
    after = F.substring("text", at + F.length("c"), F.lit(AROUND))
    return rows.select("h", F.col("c").alias("candidate"), before.alias("before"), after.alias("after"), "path")


def featured(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds the number columns f_* and the array `around` of marked path and neighbouring words."""
    c = F.col("candidate")
    size = F.length(c).cast("double")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "\u0001"), "[A-Z]", "\u0002"), "[0-9]", "\u0003"), "\u0001\u0002\u0003", "LUD")
    kinds = F.regexp_replace(kinds, "[^LUD]", "S")
    found = found.withColumn("kinds", kinds)
    out = found.withColumns({"f_length": size} | {f"f_{a}{b}": F.regexp_count("kinds", F.lit(f"(?={a}{b})")) / size for a in CLASSES for b in CLASSES})
    pieces = F.split(F.lower(c), "[^a-z]+")
    known = F.filter(pieces, lambda w: (F.length(w) >= 3) & w.isin(words)) if words else F.array().cast("array<string>")
    covered = F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w)) / size
    left = F.lower(F.regexp_extract("before", r"([\p{L}_]+)[^\p{L}_]*$", 1))
    right = F.lower(F.regexp_extract("after", r"^[^\p{L}_]*([\p{L}_]+)", 1))
    sign = F.regexp_extract("before", r"([=:])[\s\"']*$", 1)
    return out.withColumns({"f_dictionary": covered, "around": F.array(F.concat(F.lit("left "), left), F.concat(F.lit("right "), right), F.concat(F.lit("sign "), sign), F.concat(F.lit("path "), "path"))})


def rule_labels(found: DataFrame) -> DataFrame:
    """Adds label: 1 and 0 where the format leaves no doubt; other candidates are left out."""
    c, left = F.col("candidate"), F.lower("before")
    assigned = left.rlike(rf"({CREDENTIAL})[\"']?\s*[=:]\s*[\"']?$") & c.rlike(r"^(?=.*[0-9])\S{16,}$")
    yes = c.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|eyJ[\w-]+\.eyJ[\w.-]+)$") | assigned
    words = c.rlike(r"^[A-Za-z.!-]+$") & ~left.rlike(r"[=:]\s*[\"']?$")
    no = c.rlike(r"^[0-9./-]+$") | c.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z.]+$") | c.rlike(r"^[A-Za-z]+[0-9]{1,3}$") | words
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")


class Scanner:
    """A fitted forest and the dictionary that its features use."""

    def __init__(self, words: list[str], model: PipelineModel | None, constant: float = 0.0) -> None:
        self.words, self.model, self.constant = words, model, constant

    def scored(self, found: DataFrame) -> DataFrame:
        if self.model is None:
            return found.withColumn("score", F.lit(self.constant))
        return self.model.transform(featured(found, self.words)).withColumn("score", vector_to_array("probability")[1])


def common_words(documents: DataFrame, most: int = 2000) -> list[str]:
    """The words that stand in most distinct texts."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: F.length(w) >= 3)
    texts = documents.where("text is not null").select(F.xxhash64("text").alias("t"), words.alias("words"))
    texts = texts.groupBy("t").agg(F.any_value("words").alias("words")).select(F.explode("words").alias("w"))
    return [r.w for r in texts.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def drawn(findings: DataFrame, max_findings: int) -> DataFrame:
    """At most max_findings of the distinct labelled findings, by label: in proportion, but for a tenth at least where a label has that many."""
    rows = stored(findings.groupBy("candidate", "before", "after", "label").agg(F.min("path").alias("path")), "labelled")
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    yes, no = (total.get(v, 0) for v in (1.0, 0.0))
    least = [min(n, max_findings // 10) for n in (yes, no)]
    share = min(max(round(max_findings * yes / max(1, yes + no)), least[0]), max_findings - least[1])
    key = F.xxhash64("candidate", "before", "after")

    def lowest(label: float, n: int) -> DataFrame:
        # about 1.5 n rows by their hash alone, so that the sort gets no more, however many there are
        most = min(1.0, 1.5 * n / max(1, total.get(label, 0)) + 1e-5)
        return rows.where((F.col("label") == label) & (F.pmod(key, F.lit(1_000_000)) < int(most * 1_000_000))).orderBy(key).limit(n)

    return lowest(1.0, share).union(lowest(0.0, max_findings - share))


def fit(findings: DataFrame, words: list[str], max_findings: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 1) -> Scanner:
    """Learns from findings with a label (1 a secret, 0 a false positive): columns candidate, before, after, path, label."""
    rows = drawn(findings, max_findings)
    alone = rows.withColumns({"before": F.lit(""), "after": F.lit("")})
    rows = stored(featured(rows.unionByName(alone), words), "findings")
    labels = [r.label for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return Scanner(words, None, labels[0] if labels else 0.0)
    numbers = sorted(c for c in rows.columns if c.startswith("f_"))
    words_in = HashingTF(inputCol="around", outputCol="words_in", numFeatures=64, binary=True)
    joined = VectorAssembler(inputCols=[*numbers, "words_in"], outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    vectors = joined.transform(words_in.transform(rows))
    return Scanner(words, PipelineModel([words_in, joined, forest.fit(vectors)]))


def scan(documents: DataFrame, scanner: Scanner, path: Column, threshold: float = 0.5, found: DataFrame | None = None) -> DataFrame:
    """The documents with n_candidates, secrets (the strings found, in order) and redacted (the text with each of them replaced).

    `found`: their candidates, where the caller has them already.
    """
    scored = scanner.scored(candidates(documents, path) if found is None else found)
    finding = F.when(F.col("score") >= threshold, F.col("candidate"))
    by_row = scored.select("h", "candidate", "score").distinct().groupBy("h").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(finding)).alias("strings"))
    rows = documents.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text", path).alias("h"), (F.size(_strings(F.col("text"))) > 0).alias("any"))
    # only documents with candidates are joined, and shuffled
    with_ = rows.where("any").drop("any").join(by_row, "h", "left")
    without = rows.where("not coalesce(any, false)").select("h", "doc", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("strings"))
    rows = with_.unionByName(without)
    strings = F.coalesce("strings", F.array().cast("array<string>"))
    longest = F.reverse(F.array_sort(F.transform(strings, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    redacted = F.aggregate(longest, F.col("doc.text"), lambda t, s: F.replace(t, s["s"], F.lit(MARK)))
    kept = [F.col("doc")[c].alias(c) for c in documents.columns if c not in RESULT]
    return rows.select(*kept, F.coalesce("n", F.lit(0)).alias("n_candidates"), strings.alias("secrets"), redacted.alias("redacted"))


def fitted(documents: DataFrame, path: Column) -> Scanner:
    """A scanner for a corpus without reviewed findings: rule labels on the candidates of all texts."""
    return fit(rule_labels(candidates(documents, path)), common_words(documents))


def fit_and_scan(documents: DataFrame, path: Column) -> DataFrame:
    """The documents scanned by a scanner fitted on their own candidates, which are found once."""
    found = stored(candidates(documents, path), "candidates")
    return scan(documents, fit(rule_labels(found), common_words(documents)), path, found=found)


def held_out(findings: DataFrame, words: list[str], threshold: float = 0.5, blind: bool = True) -> dict[str, float]:
    """precision and recall on a quarter of the labelled findings (by the candidate's checksum) of a forest that learnt
    from the rest; `blind` takes their neighbouring words away first."""
    fold = F.pmod(F.crc32(F.col("candidate").cast("binary")), F.lit(4)) == 0
    unseen = findings.where(fold).select("candidate", "before", "after", "path", "label").distinct()
    if blind:
        unseen = unseen.withColumns({"before": F.lit(""), "after": F.lit("")})
    scored = fit(findings.where(~fold), words).scored(unseen)
    hit, true = (F.sum(x.cast("long")) for x in ((F.col("score") >= threshold) & (F.col("label") == 1), F.col("label") == 1))
    n = scored.agg(hit.alias("hit"), true.alias("true"), F.sum((F.col("score") >= threshold).cast("long")).alias("said")).first()
    return {"precision": (n.hit or 0) / max(1, n.said or 0), "recall": (n.hit or 0) / max(1, n.true or 0)}


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = fit_and_scan(documents, F.col("source"))
    return rows.select("doc_id", F.col("n_candidates").cast("long").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"), "secrets", F.sha2("redacted", 256).alias("redacted_sha256"))
