"""Failures of jobs: classes by weighted patterns, what to do, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class, confidence, risk, advice and patterns, in order.
PATTERNS = (
    ("ManifestFailure", 95, "high", "retry_with_backoff", (
        "(?i)ManifestVerificationError", "(?i)manifest_verification", r"(?i)_manifest\.json", "(?i)RestorabilityEnforcementError", "(?i)manifest.*missing", "(?i)restorab",
    )),
    ("OOM", 97, "critical", "retry_with_backoff", (
        "(?i)ENOMEM", "(?i)out of memory", "(?i)allocation failed", "(?i)Cannot allocate memory", "(?i)heap.*out", "(?i)JavaScript heap", "(?i)Reached heap limit",
        "(?i)process out of memory",
    )),
    ("429RateLimit", 95, "medium", "retry_with_backoff", (
        "429", "(?i)rate.?limit", "(?i)too many requests", "(?i)throttl", "(?i)request.*quota", "(?i)retry.?after",
    )),
    ("5xxServerError", 90, "medium", "retry_with_backoff", (
        r"\b5[0-9]{2}\b", "(?i)Internal Server Error", "(?i)Bad Gateway", "(?i)Service Unavailable", "(?i)Gateway Timeout", "(?i)HTTP.*5[0-9][0-9]",
        "(?i)status.*5[0-9][0-9]", "(?i)response.*5[0-9][0-9]",
    )),
    ("BrowserCrash", 93, "high", "retry_with_backoff", (
        "(?i)puppeteer", "(?i)chromium", "(?i)Protocol error", "(?i)Target closed", "(?i)Session closed", "(?i)Browser.*crash", "(?i)chrome.*exit",
        "(?i)browser.*disconnect", "(?i)Page.*crash", "(?i)detached frame", "(?i)Execution context was destroyed",
    )),
    ("DNSFailure", 96, "high", "retry_after_fix", (
        "(?i)ENOTFOUND", "(?i)ENODATA", "(?i)getaddrinfo", "(?i)DNS.*fail", "(?i)dns.*lookup", "(?i)hostname.*not.*found", "(?i)name.*resolution",
    )),
    ("NetworkTimeout", 92, "medium", "retry_with_backoff", (
        "(?i)ETIMEDOUT", "(?i)ECONNRESET", "(?i)ECONNREFUSED", "(?i)EHOSTUNREACH", "(?i)socket hang up", "(?i)network.*timeout", "(?i)connection.*timeout",
        "(?i)read.*timeout", "(?i)request.*timeout", "(?i)navigation.*timeout", "(?i)net::ERR_",
    )),
    ("StorageFailure", 88, "high", "retry_after_fix", (
        "(?i)ENOENT", "(?i)EACCES", "(?i)ENOSPC", "(?i)R2.*fail", "(?i)S3.*fail", "(?i)upload.*fail", "(?i)storage.*error", "(?i)disk.*full", "(?i)write.*fail",
        "(?i)cloud.*upload", "(?i)NoSuchBucket", "(?i)AccessDenied",
    )),
    ("CheckpointFailure", 85, "medium", "retry_with_backoff", (
        "(?i)checkpoint", r"(?i)pipeline\.json", "(?i)manifest checkpoint", "(?i)loadManifest.*fail", "(?i)saveManifest.*fail", "(?i)execution manifest",
    )),
    ("ParserFailure", 87, "medium", "retry_with_backoff", (
        "(?i)SyntaxError", r"(?i)JSON\.parse", "(?i)Unexpected token", "(?i)unexpected.*end.*json", "(?i)parse.*error", "(?i)cheerio", "(?i)dom.*parse",
        "(?i)invalid.*json", "(?i)malformed",
    )),
    ("HTTPFailure", 82, "medium", "retry_after_fix", (
        "(?i)HTTP.*4[0-9]{2}", "(?i)status.*4[0-9]{2}", "(?i)response.*4[0-9]{2}", r"(?i)\b4[0-9]{2}\b.*error", "(?i)fetch.*failed", "(?i)request.*failed",
    )),
    ("UnexpectedException", 75, "high", "retry_with_backoff", (
        "(?i)TypeError", "(?i)ReferenceError", "(?i)Cannot read propert", "(?i)Cannot set propert", "(?i)is not a function", "(?i)is not defined",
        "(?i)undefined is not", "(?i)null is not",
    )),
)
UNKNOWN = ("Unknown", 30, "medium", "retry_with_backoff")


def classify(message: Column, retries: Column, most: Column, rules: tuple = PATTERNS, stack: Column | None = None) -> Column:
    """(failure, confidence, risk, retry): the class whose patterns that occur, in the message
    or in the ``stack`` behind it, times its
    confidence is highest, the first of equals. Without retries left: do not retry. A null
    message is unknown. ``rules`` may be another table of the same form."""
    if stack is not None:
        message = F.concat_ws(" ", F.coalesce(message, F.lit("")), F.coalesce(stack, F.lit("")))
    options = []
    for i, (name, confidence, risk, retry, patterns) in enumerate(rules):
        hits = sum((F.when(F.coalesce(message.rlike(p), F.lit(False)), 1).otherwise(0) for p in patterns), F.lit(0))
        options.append(F.struct((hits * confidence).alias("score"), F.lit(-i).alias("order"), *_told(name, confidence, risk, retry)))
    best = F.array_max(F.array(*options))

    def advised(b: Column) -> Column:
        found = F.when(b["score"] > 0, F.struct(*(b[c] for c in ("failure", "confidence", "risk", "retry")))).otherwise(F.struct(*_told(*UNKNOWN)))
        return found.withField("retry", F.when(retries >= most, "do_not_retry").otherwise(found["retry"]))

    return F.get(F.transform(F.array(best), advised), 0)


def _told(name: str, confidence: int, risk: str, retry: str) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in (("failure", name), ("confidence", confidence), ("risk", risk), ("retry", retry))]


def report(classified: DataFrame) -> DataFrame:
    """(kind, value, n): how many failures of each class and of each risk, in one pass."""
    g = classified.groupingSets([["failure"], ["risk"]], "failure", "risk").agg(F.count(F.lit(1)).alias("n"), F.grouping("failure").alias("by_risk"))
    return g.select(F.when(F.col("by_risk") == 1, "risk").otherwise("class").alias("kind"), F.coalesce("failure", "risk").alias("value"), "n")


def retry_report(classified: DataFrame) -> DataFrame:
    """One row: how many failures call for each advice."""
    kinds = ("retry_immediately", "retry_with_backoff", "retry_after_fix", "do_not_retry")
    return classified.agg(F.count(F.lit(1)).alias("jobs"), *(F.count_if(F.col("retry") == k).alias(k) for k in kinds))
