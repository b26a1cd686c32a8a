"""Whole job: source rows and templates to the link table of a package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import link_in_package, relative_path
from pathloom.functions.tokens import fill_tokens
from pathloom.operators import dedup, frames, templates


def provision_links(
    rows: DataFrame, template: DataFrame, mapping: DataFrame, log: DataFrame, day: str,
    order_by: Sequence[str] = ("FILE",), padding_style: str = "standard", ext_case: str = "default",
    mapping_order: Column | None = None,
) -> DataFrame:
    """Requested links with every placeholder filled and one row per link and source.

    Templates are expanded per row, then the session placeholders (item version, date,
    package version) and the mapping table fill what is left. Later steps read the result more
    than once, so store it before the review.
    """
    requested = templates.expand_templates(rows, template, padding_style=padding_style, ext_case=ext_case)
    dated = templates.add_virtual_columns(requested, log, day)
    extra = {c: F.col(c) for c in ("VERSION", "YYYYMMDD", "PKGVERSION3PADDED")}
    values = templates.row_fill(dated.columns, (), padding_style, ext_case, extra)
    filled = dated.withColumn("PROVISIONEDLINK", fill_tokens(F.col("PROVISIONEDLINK"), values))
    mapped = templates.resolve_variables(filled, "PROVISIONEDLINK", mapping, mapping_order).drop(*extra)
    return dedup.drop_double_dupes(mapped, "PROVISIONEDLINK", "FILE", order_by)


def reviewed_links(links: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Links with a review state: several sources for one link need a decision."""
    if "STATUS" not in links.columns:
        links = links.withColumn("STATUS", F.lit(None).cast("string"))
    states = dedup.review_status(links, "PROVISIONEDLINK")
    return states if decisions is None else dedup.choose_valid(states, decisions, "PROVISIONEDLINK", "FILE")


def package_links(reviewed: DataFrame, root: str) -> DataFrame:
    """One row per file and link: valid rows, frames expanded, links in normal form.

    ``TARGET`` is the source as seen from the link. The links themselves are not created.
    """
    valid = reviewed.where("STATUS = 'valid'")
    rows = frames.expand_ranges(valid).withColumn("__link", link_in_package(F.col("PROVISIONEDLINK"), root))
    placed = F.concat(F.lit(root.rstrip("/") + "/"), "__link")
    return rows.select(
        "FILE", F.col("__link").alias("PROVISIONEDLINK"), relative_path(F.col("FILE"), placed).alias("TARGET"), "FRAME"
    )
