"""Whole job: regional instance dumps to one enriched inventory."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import nested
from pathloom.operators import columns, filters, joins

# Named groups of derived columns; callers may pass a table of their own with more entries.
DETAILS: dict[str, Callable[[DataFrame], Mapping[str, Column]]] = {
    "status_check": lambda df: {
        "StatusCheckSummary": nested.passed_checks(
            *[F.col(f"`{c}`") for c in ("InstanceStatus.Details", "SystemStatus.Details") if c in df.columns]
        )
    },
    "name": lambda df: {"Name": nested.tag_value(F.col("Tags"), "Name") if "Tags" in df.columns else F.lit("")},
    "render_group": lambda df: {
        "RenderGroup": nested.tag_value(F.col("Tags"), "renderGroup") if "Tags" in df.columns else F.lit("")
    },
    "region": lambda df: {
        "Region": nested.region_of_zone(F.col("`Placement.AvailabilityZone`"))
        if "Placement.AvailabilityZone" in df.columns else F.lit("")
    },
    "state": lambda df: {
        "State": F.col("`InstanceState.Name`") if "InstanceState.Name" in df.columns else F.lit("")
    },
    "family": lambda df: nested.family_and_size(F.col("InstanceType"))
    if "InstanceType" in df.columns else {"InstanceFamily": F.lit(""), "InstanceXlarge": F.lit("")},
}


def instance_inventory(
    instances: DataFrame, statuses: DataFrame, details: Sequence[str] = tuple(DETAILS),
    registry: Mapping[str, Callable[[DataFrame], Mapping[str, Column]]] = DETAILS, keep_terminated: bool = False,
) -> DataFrame:
    """Nested instance and status records joined, flattened and enriched."""
    joined = joins.join_status(
        columns.flatten_one_level(instances), columns.flatten_one_level(statuses), "InstanceId"
    )
    full = columns.combine_details(joined, details, registry)
    return full if keep_terminated else filters.drop_state(full)


def group_configs(groups: DataFrame) -> DataFrame:
    """Scaling groups flattened: sizes, launch template and allowed types."""
    policy = F.col("MixedInstancesPolicy.LaunchTemplate.Overrides")
    types = F.coalesce(F.transform(policy, lambda o: o["InstanceType"]), F.array().cast("array<string>"))
    return groups.select(
        F.col("AutoScalingGroupName").alias("ASGName"), "MinSize", "MaxSize",
        F.col("DesiredCapacity"), F.coalesce("LaunchTemplate.LaunchTemplateId", F.lit("")).alias("LaunchTemplateId"),
        types.alias("InstanceTypes"),
    )
