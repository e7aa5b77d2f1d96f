"""Audits: one item per file, page or text, rolled up into a summary or SARIF results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provscan.functions import cadence, formats
from provscan.functions import unicode as U

FINDINGS = "array<struct<message:string,confidence:string>>"
MAX_BYTES = 256 << 20
ACTIONABLE = ("confirmed", "probable")


def hit_findings(hits: Column, dashes_weak: bool = False) -> Column:
    """Findings of a text report. Dashes count as probable unless ``dashes_weak``: the inspector itself calls them informational."""
    weak = ["space", "em_dash"] if dashes_weak else ["space"]
    return F.transform(
        hits,
        lambda h: F.struct(
            F.format_string("layer-a [%s] %s x%d", h["kind"], h["label"], h["count"]).alias("message"),
            F.when(h["kind"].isin(weak), "informational").otherwise("probable").alias("confidence"),
        ),
    )


def with_confidence(findings: Column) -> Column:
    return F.transform(findings, lambda f: F.struct(f.alias("message"), formats.finding_confidence(f).alias("confidence")))


def _cadence_findings(df: DataFrame, text: str) -> DataFrame:
    """``df`` with __cadence: a finding where the cadence score reaches its threshold."""
    scored = cadence.report(df, text, "__report")
    said = F.format_string("stylometry [high_probability] score %.2f (%s)", F.col("__report.score"), F.col("__report.confidence_level"))
    high = F.col("__report.score") >= cadence.THRESHOLD
    found = F.when(high, F.array(F.struct(said.alias("message"), F.lit("probable").alias("confidence")))).otherwise(F.array().cast(FINDINGS))
    return scored.withColumn("__cadence", F.coalesce(found, F.array().cast(FINDINGS))).drop("__report")


def audit_texts(df: DataFrame, path: str = "path", text: str = "text", check_cadence: bool = False, dashes_weak: bool = False) -> DataFrame:
    """Items of rows of plain text."""
    rows = df.select(F.col(path).cast("string").alias("path"), F.col(text).alias("__text"))
    rows = _cadence_findings(rows, "__text") if check_cadence else rows.withColumn("__cadence", F.array().cast(FINDINGS))
    rows = rows.withColumn("__hits", U.inspect(F.col("__text")))
    return rows.select(
        "path",
        F.lit("text").alias("kind"),
        F.lit(False).alias("has_c2pa"),
        F.lit(False).alias("has_ai_metadata"),
        (F.coalesce("__hits.suspicious_total", F.lit(0)) + F.size("__cadence")).alias("suspicious_total"),
        F.concat(F.coalesce(hit_findings(F.col("__hits.hits"), dashes_weak), F.array().cast(FINDINGS)), F.col("__cadence")).alias("findings"),
        F.when(F.col("__text").isNull(), "unreadable").alias("skip_reason"),
    )


def audit_files(files: DataFrame, path: str = "path", content: str = "content", check_cadence: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Items of raw files: (path, kind, has_c2pa, has_ai_metadata, suspicious_total, findings, skip_reason).

    Too large or unreadable files are skipped with a reason and no findings.
    """
    size = F.octet_length(F.col(content))
    skip = F.when(F.col(content).isNull(), "unreadable").when(size > max_bytes, "too large")
    rows = files.select(F.col(path).alias("path"), skip.alias("skip_reason"), F.when(skip.isNull(), F.col(content)).alias("__content"))
    rows = rows.withColumn("__kind", formats.classify(F.col("path"), F.col("__content")))
    rows = rows.withColumn("__report", formats.inspect_file(F.col("__kind"), formats.suffix(F.col("path")), F.when(F.col("__kind") != "text", F.col("__content"))))
    body = F.col("__report.format").isin("html", "markdown")
    rows = rows.withColumn("__text", F.when((F.col("__kind") == "text") | body, F.make_valid_utf8(F.col("__content").cast("string"))))
    rows = rows.withColumn("__hits", U.inspect(F.when(F.col("__kind") == "text", F.col("__text"))))
    rows = _cadence_findings(rows, "__text") if check_cadence else rows.withColumn("__cadence", F.array().cast(FINDINGS))
    none = F.array().cast(FINDINGS)
    found = F.concat(F.coalesce(hit_findings(F.col("__hits.hits")), none), F.coalesce(with_confidence(F.col("__report.findings")), none), F.col("__cadence"))
    return rows.select(
        "path",
        F.coalesce("__report.format", "__kind").alias("kind"),
        F.coalesce("__report.has_c2pa", F.lit(False)).alias("has_c2pa"),
        F.coalesce("__report.has_ai_metadata", F.lit(False)).alias("has_ai_metadata"),
        (F.coalesce("__hits.suspicious_total", F.lit(0)) + F.coalesce("__report.suspicious_total", F.lit(0)) + F.size("__cadence")).alias("suspicious_total"),
        F.when(F.col("skip_reason").isNull(), found).otherwise(none).alias("findings"),
        "skip_reason",
    )


def audit_pages(pages: DataFrame, url: str = "url", html: str = "html", check_cadence: bool = False) -> DataFrame:
    """Items of fetched pages: files whose kind is guessed as for a download."""
    rows = pages.select(F.concat(F.lit("page.html")).alias("path"), F.col(url).alias("__url"), F.col(html).cast("binary").alias("content"))
    marked = rows.select(F.struct("__url", "content").alias("__row"), formats.guess_kind(F.col("__url"), F.col("content")).alias("kind"))
    report = formats.inspect_file(F.lit("container"), F.lit("html"), F.col("__row.content"))
    found = with_confidence(F.col("__report.findings"))
    items = marked.withColumn("__report", report)
    return items.select(
        F.col("__row.__url").alias("path"),
        F.when(F.col("kind") == "text", "html").otherwise(F.col("kind")).alias("kind"),
        F.coalesce("__report.has_c2pa", F.lit(False)).alias("has_c2pa"),
        F.coalesce("__report.has_ai_metadata", F.lit(False)).alias("has_ai_metadata"),
        F.coalesce("__report.suspicious_total", F.lit(0)).alias("suspicious_total"),
        F.coalesce(found, F.array().cast(FINDINGS)).alias("findings"),
        F.when(F.col("__row.content").isNull(), "unreadable").alias("skip_reason"),
    )


def is_actionable(has_c2pa: Column, findings: Column) -> Column:
    return has_c2pa | F.exists(findings, lambda f: f["confidence"].isin(*ACTIONABLE))


def summary(items: DataFrame) -> DataFrame:
    """One row: totals, by_kind and findings_by_confidence (all four levels, zero where none). Skipped items are only counted as such."""
    read = F.col("skip_reason").isNull()
    flags = {
        "with_c2pa": F.col("has_c2pa"),
        "with_ai_metadata": F.col("has_ai_metadata"),
        "with_suspicious_text": F.col("suspicious_total") > 0,
        "actionable_files": is_actionable(F.col("has_c2pa"), F.col("findings")),
    }

    def held(level: str) -> Column:
        return F.coalesce(F.sum(F.when(read, F.size(F.filter("findings", lambda f: f["confidence"] == level)))), F.lit(0))

    levels = [held(c) for c in formats.CONFIDENCES]
    totals = items.agg(
        F.count_if(read).alias("total"),
        F.count_if(~read).alias("skipped"),
        *(F.count_if(read & test).alias(name) for name, test in flags.items()),
        F.create_map(*(x for c, n in zip(formats.CONFIDENCES, levels) for x in (F.lit(c), n))).alias("findings_by_confidence"),
    )
    kinds = items.where(read).groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))  # a handful of kinds
    return totals.withColumn("by_kind", kinds.scalar())


RULES = {
    "AI-WATERMARK-C2PA": ("C2PAManifestDetected", "error", "A C2PA or JUMBF provenance manifest is in the asset."),
    "AI-WATERMARK-METADATA": ("AIMetadataMarkerDetected", "warning", "Metadata names an AI generator or carries provenance markers."),
    "AI-WATERMARK-UNICODE-LAYER-A": ("InvisibleUnicodeWatermarkCarrier", "warning", "The text holds invisible characters or space lookalikes."),
    "AI-STYLES-HIGH-PROBABILITY": ("HighProbabilityAITextCadence", "note", "The cadence of the text is formulaic."),
}


def sarif_results(items: DataFrame) -> DataFrame:
    """(path, rule_id, level, message): one row per finding; the first rule that applies gives rule and level."""
    rows = items.select("path", "has_c2pa", F.explode("findings").alias("f"))
    low, sure = F.lower("f.message"), F.col("f.confidence")
    manifest = low.contains("c2pa") | low.contains("jumbf") | F.col("has_c2pa")
    rule = F.when(manifest, "AI-WATERMARK-C2PA").when(low.contains("layer-a"), "AI-WATERMARK-UNICODE-LAYER-A").when(low.contains("stylometry"), "AI-STYLES-HIGH-PROBABILITY").otherwise("AI-WATERMARK-METADATA")
    level = (
        F.when(manifest, "error")
        .when(low.contains("layer-a"), F.when(sure.isin(*ACTIONABLE), "warning").otherwise("note"))
        .when(low.contains("stylometry"), "note")
        .when(sure == "confirmed", "error")
        .when(sure == "informational", "note")
        .otherwise("warning")
    )
    return rows.select(F.translate("path", "\\", "/").alias("path"), rule.alias("rule_id"), level.alias("level"), F.col("f.message").alias("message"))


def exit_status(items: DataFrame) -> DataFrame:
    """(status): 3 if files were skipped, else 1 if any is actionable, else 0."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return items.agg(F.when(any_of(F.col("skip_reason").isNotNull()), 3).when(any_of(is_actionable(F.col("has_c2pa"), F.col("findings"))), 1).otherwise(0).alias("status"))


def suspicious(total: Column, has_c2pa: Column, has_ai: Column, cadence_score: Column | None = None, *detected: Column) -> Column:
    """Whether anything speaks for a closer look: carriers, provenance, a high cadence score, or a detector that fired."""
    out = (F.coalesce(total, F.lit(0)) > 0) | F.coalesce(has_c2pa, F.lit(False)) | F.coalesce(has_ai, F.lit(False))
    if cadence_score is not None:
        out = out | F.coalesce(cadence_score >= cadence.THRESHOLD, F.lit(False))
    for d in detected:
        out = out | F.coalesce(d, F.lit(False))
    return out


def report_lines(items: DataFrame) -> DataFrame:
    """(line): findings as plain text, one a line."""
    return items.select("path", F.explode("findings").alias("f")).select(F.format_string("[%s] %s: %s", "f.confidence", "path", "f.message").alias("line"))
