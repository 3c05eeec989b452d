"""Effective server settings from layers of configuration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import ipv4_number
from ..operators.latest import first_per_key

# Order of the layers and the prefix that removes a setting.
LAYERS = ("default", "version", "hardware", "role")
REMOVE_PREFIX = "remove_"


def read_only(replica_role: Column, writable_outside: Column) -> Column:
    """OFF on a master, ON on a replica; outside the topology ON unless writing there is allowed."""
    outside = F.when(F.coalesce(writable_outside, F.lit(False)), "OFF").otherwise("ON")
    return F.when(replica_role == "master", "OFF").when(replica_role.isNotNull(), "ON").otherwise(outside)


def effective_settings(hosts: DataFrame, layers: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """(hostname, setting, value) of every host.

    ``hosts`` has hostname, version, hardware, role, replica_role, address and the columns
    named in ``tags`` (tag text to column); ``layers`` has layer, name, setting, value. A later
    layer overrides an earlier one, ``remove_x`` deletes x. Settings are worked out once per
    distinct combination of layers, then given to its hosts.
    """
    combination = ["version", "hardware", "role"]
    kinds = hosts.select(*combination).distinct()
    named = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("layer"), (F.lit("") if kind == "default" else F.col(kind)).alias("name"))
                for i, kind in enumerate(LAYERS)
            ]
        )
    )
    chain = kinds.select(*combination, named.alias("l")).select(*combination, "l.*")
    all_values = chain.join(layers, ["layer", "name"])
    won = first_per_key(all_values, [*combination, "setting"], [F.col("rank").desc()])
    removed = won.where(F.col("setting").startswith(REMOVE_PREFIX)).select(
        *combination, F.substring(F.col("setting"), F.lit(len(REMOVE_PREFIX) + 1), F.length("setting")).alias("setting")
    )
    kept = won.where(~F.col("setting").startswith(REMOVE_PREFIX)).join(removed, [*combination, "setting"], "left_anti")
    value = F.col("value")
    for tag, column in tags.items():
        value = F.replace(value, F.lit(tag), F.col(column))
    # Computed settings replace what the layers say.
    computed = ["server_id", "read_only"]
    from_layers = hosts.join(kept.where(~F.col("setting").isin(*computed)), combination)
    from_layers = from_layers.select("hostname", "setting", value.alias("value"))
    allowed = F.col("writable_outside") if "writable_outside" in hosts.columns else F.lit(False)
    own = F.explode(
        F.array(
            F.struct(F.lit("server_id").alias("setting"), ipv4_number(F.col("address")).cast("string").alias("value")),
            F.struct(F.lit("read_only").alias("setting"), read_only(F.col("replica_role"), allowed).alias("value")),
        )
    )
    return from_layers.unionByName(hosts.select("hostname", own.alias("s")).select("hostname", "s.*"))
