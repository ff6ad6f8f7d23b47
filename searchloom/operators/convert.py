"""Remote pages to Markdown, with an outcome for each page and job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import JOB_BYTES
from searchloom.functions.html import markdown
from searchloom.operators.generations import job_batches

CONVERTED = "struct<outcome:string,error_code:string,title:string,text:string>"


def one(html: str | None, limit: int) -> tuple[str, str | None, str | None, str | None]:
    """(outcome, error_code, title, text) of a page."""
    if html is None:
        return "failed", "no_content", None, None
    if len(html) > limit or len(html.encode("utf-8", "replace")) > limit:
        return "failed", "too_large", None, None
    try:
        title, text = markdown(html)
    except Exception:  # a page that can't be parsed is an outcome, not a failure of the job
        return "failed", "unparsable", None, None
    return ("ok", None, title, text) if text else ("failed", "empty", title, None)


def convert(pages: DataFrame, html: str = "html", limit: int = JOB_BYTES) -> DataFrame:
    """pages without their html, with outcome (ok or failed), error_code, title and
    text (Markdown). A page without html has no_content, one whose UTF-8 is over
    `limit` bytes is too_large, one without any shown text is empty. Repeated rows
    are converted each; other columns stay, but those of the four names, which are
    replaced. Empty tables give empty tables. Nothing is shuffled."""

    @F.pandas_udf(CONVERTED)
    def run(column):
        import pandas as pd

        return pd.DataFrame([one(x if isinstance(x, str) else None, limit) for x in column], columns=["outcome", "error_code", "title", "text"], dtype=object)

    rows = pages.withColumn("__converted", run(F.col(f"`{html}`"))).drop(html)
    return rows.withColumns({c: F.col(f"__converted.{c}") for c in ("outcome", "error_code", "title", "text")}).drop("__converted")


def job_report(pages: DataFrame, converted: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """(group, batch, pages, ok, failed, first_error): what became of each planned
    job. pages (group, key, size) have what the plan needs, converted (key, outcome,
    error_code) one row a key. Pages over the limit are in no job (batch null).
    Only keys and outcomes move, no text."""
    jobs = job_batches(pages, group, key, size)
    rows = jobs.join(converted.select(key, "outcome", "error_code"), key, "left")
    ok = F.count_if(F.col("outcome") == "ok")
    return rows.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("pages"), ok.alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.min("error_code").alias("first_error"))


def attempt(converted: DataFrame, key: str = "source_uid") -> DataFrame:
    """(source_uid, outcome, seen, content_hash, text) of converted pages, as a
    generation's step takes them."""
    return converted.select(F.col(key).alias("source_uid"), "outcome", F.lit(True).alias("seen"), F.when(F.col("outcome") == "ok", F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"), "text")
