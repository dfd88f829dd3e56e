"""Document evidence: flags over per-page and per-file measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import known

FLAG_ORDER = ["DISCREPANCY", "PARTIAL_RENDER", "DAMAGED", "NO_TEXT_LAYER", "TOOL_UNAVAILABLE"]


def _is_scan(image: Column) -> Column:
    return (
        (image["type"] == "image")
        & (image["width"] >= C.SCAN_IMAGE_MIN_PIXELS)
        & (image["height"] >= C.SCAN_IMAGE_MIN_PIXELS)
    )


def scan_ink_fractions(images: Column) -> Column:
    """Measured ink of the scan-sized images; mask rows encode no ink."""
    scans = F.filter(images, lambda i: known(_is_scan(i)) & i["nonwhite_fraction"].isNotNull())
    return F.transform(scans, lambda i: i["nonwhite_fraction"])


def has_unmeasured_scan(images: Column) -> Column:
    return known(F.exists(images, lambda i: known(_is_scan(i)) & i["nonwhite_fraction"].isNull()))


def is_low_ink(ink: Column, render_exists: Column, renderer_ran: Column) -> Column:
    """Nearly blank, or not rendered although the renderer ran; unknown ink is neither."""
    return F.when(~render_exists, renderer_ran).otherwise(known(ink < C.LOW_INK_FRACTION))


def has_substance(
    content_bytes: Column, images: Column, drawable_bytes: Column, accounting_ran: Column
) -> Column:
    """The file plausibly holds content for the page."""
    inked = F.exists(images, lambda i: known(i["nonwhite_fraction"] >= C.SUBSTANTIAL_IMAGE_INK))
    fallback = (
        accounting_ran & content_bytes.isNull() & (drawable_bytes >= C.SUBSTANTIAL_CONTENT_BYTES)
    )
    return (
        known(content_bytes >= C.SUBSTANTIAL_CONTENT_BYTES)
        | known(inked)
        | has_unmeasured_scan(images)
        | known(fallback)
    )


def is_partial_render(ink: Column, images: Column) -> Column:
    """Real ink, yet far less than a scan on the page holds."""
    much_less = F.exists(
        scan_ink_fractions(images),
        lambda f: (f >= C.SUBSTANTIAL_IMAGE_INK) & (ink * C.PARTIAL_RENDER_RATIO < f),
    )
    return known((ink >= C.LOW_INK_FRACTION) & much_less)


def with_page_flags(pages: DataFrame) -> DataFrame:
    """Pages with their low-ink, substance and partial-render tests and one flag."""
    ink, images = F.col("ink_fraction"), F.col("images")
    return (
        pages.withColumn("low_ink", is_low_ink(ink, F.col("render_exists"), F.col("renderer_ran")))
        .withColumn(
            "substance",
            has_substance(
                F.col("content_stream_bytes"), images, F.col("drawable_stream_bytes"),
                F.col("content_accounting_ran"),
            ),
        )
        .withColumn("partial_render", is_partial_render(ink, images))
        .withColumn(
            "flag",
            F.when(F.col("low_ink") & F.col("substance"), "DISCREPANCY").when(
                F.col("partial_render"), "PARTIAL_RENDER"
            ),
        )
    )


def file_flags(files: DataFrame, flagged_pages: DataFrame) -> DataFrame:
    """Files with their flags in fixed order.

    ``files``: path, kind, qpdf_check, parse_error, render_error,
    text_chars_total and tools_unavailable; an unknown total asserts nothing.
    """
    rolled = flagged_pages.groupBy("path").agg(
        F.bool_or(known(F.col("flag") == "DISCREPANCY")).alias("discrepancy"),
        F.bool_or(known(F.col("flag") == "PARTIAL_RENDER")).alias("partial"),
    )
    tests = [
        F.col("discrepancy"),
        F.col("partial"),
        (F.col("qpdf_check") == "errors")
        | F.col("parse_error").isNotNull()
        | F.col("render_error").isNotNull(),
        F.col("text_chars_total") < C.NO_TEXT_LAYER_CHARS,
        F.size("tools_unavailable") > 0,
    ]
    flags = F.array_compact(
        F.array(*[F.when(known(t), F.lit(f)) for t, f in zip(tests, FLAG_ORDER, strict=True)])
    )
    return files.join(rolled, "path", "left").withColumn("flags", flags).drop("discrepancy", "partial")


def evidence_summary(flagged_files: DataFrame) -> DataFrame:
    """File counts by kind and flag, as one row."""
    office = known(F.col("converted"))
    return flagged_files.agg(
        F.count_if(F.col("kind") == "pdf").alias("pdf_files"),
        F.count_if(office).alias("office_files"),
        F.count_if((F.col("kind") != "pdf") & ~office).alias("other_files"),
        F.count_if(F.size("flags") > 0).alias("flagged_files"),
    )


def readability_gaps(flagged_files: DataFrame) -> DataFrame:
    """Files graders may misread, and each missing tool once."""
    problems = F.filter("flags", lambda f: f.isin(*C.UNREADABLE_FLAGS))
    unreadable = flagged_files.where(F.size(problems) > 0).select(
        F.lit("unreadable").alias("gap"), F.col("path").alias("subject"),
        F.array_join(problems, ", ").alias("detail"),
    )
    tools = (
        flagged_files.select(F.explode("tools_unavailable").alias("subject"))
        .distinct()
        .select(
            F.lit("tool_unavailable").alias("gap"), "subject", F.lit("").alias("detail")
        )
    )
    return unreadable.unionByName(tools)
