"""Names of hosts, schemas, backup files and shards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORT = 3306
INNODB_EXTENSION = "ibd"

# Formats and patterns of names already in use.
INITIAL_BUILD = "initial_build"
BACKUP_STAMP = "yyyy-MM-dd-HH:mm:ss"
BACKUP_FILE = r"^([a-z0-9-]+)-(330[0-9])-(\d{4}-\d{2}-\d{2}).*"
TABLE_FILE = r"^([^#.]+)(#P#)?(.+)?\." + INNODB_EXTENSION
GRANT = r"^GRANT (.+) ON (?:.+) TO '(.+)'@'([^']+)'"
GRANT_PASSWORD = r".+PASSWORD '([^']+)'"
BACKUP_EXTENSIONS = {"xtrabackup": "xbstream", "mysqldump": "sql.gz"}


def _matched(text: Column, pattern: str, group: int) -> Column:
    """The group of a match, or null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def host_parts(instance: Column) -> Column:
    """``prefix-set-id[.domain][:port]`` as a struct; ``valid`` is false unless there are three parts."""
    hostname = F.substring_index(F.substring_index(instance, ":", 1), ".", 1)
    pieces = F.split(hostname, "-")
    valid = F.size(pieces) == 3
    port = F.coalesce(F.try_element_at(F.split(instance, ":"), F.lit(2)).cast("int"), F.lit(DEFAULT_PORT))
    return F.struct(
        hostname.alias("hostname"),
        F.when(valid, pieces[0]).alias("prefix"),
        F.when(valid, pieces[1]).alias("set_num"),
        F.when(valid, pieces[2]).alias("host_id"),
        port.alias("port"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def standardized_replica_set(instance: Column) -> Column:
    """``prefix-set``, null for an invalid name."""
    parts = host_parts(instance)
    return F.when(parts["valid"], F.concat_ws("-", parts["prefix"], parts["set_num"]))


def host_prefix(hostname: Column) -> Column:
    """Everything through the last ``db``, else the leading letters, else null."""
    return F.coalesce(
        F.nullif(F.regexp_extract(hostname, r"^(.+db)", 1), F.lit("")),
        F.nullif(F.regexp_extract(hostname, r"^([a-z]+)", 1), F.lit("")),
    )


def backup_file_parts(path: Column) -> Column:
    """Host, port and day of a backup, from its file name; nulls when it is not one."""
    name = F.substring_index(path, "/", -1)
    return F.struct(
        _matched(name, BACKUP_FILE, 1).alias("host"),
        _matched(name, BACKUP_FILE, 2).cast("int").alias("port"),
        F.try_to_timestamp(_matched(name, BACKUP_FILE, 3), F.lit("yyyy-MM-dd"))
        .cast("date")
        .alias("created"),
    )


def backup_key(
    backup_type: str,
    retention: Column,
    replica_set: Column,
    hostname: Column,
    port: Column,
    taken_at: Column,
) -> Column:
    """Object key of a backup; a host in no replica set goes under ``initial_build``."""
    stamp = F.date_format(taken_at, BACKUP_STAMP)
    name = F.concat(F.concat_ws("-", hostname, port.cast("string"), stamp), F.lit("." + BACKUP_EXTENSIONS[backup_type]))
    regular = F.concat_ws("/", F.lit(backup_type), retention, replica_set, name)
    initial = F.concat_ws("/", F.lit(backup_type), F.lit(INITIAL_BUILD), name)
    return F.when(replica_set.isNull(), initial).otherwise(regular)


def table_file_parts(path: Column) -> Column:
    """Table and partition of a tablespace file; the partition is empty for a plain table."""
    name = F.substring_index(path, "/", -1)
    return F.struct(
        _matched(name, TABLE_FILE, 1).alias("table"),
        _matched(name, TABLE_FILE, 3).alias("partition"),
    )


def namespace_of_schema(schema: Column, hostname: Column) -> Column:
    """``<host prefix>_<second part>`` or ``<host prefix>_default``; null unless it ends in a digit."""
    first = F.substring_index(hostname, "-", 1)
    second = F.try_element_at(F.split(schema, "_"), F.lit(2))
    tail = F.when(F.instr(schema, "_") > 0, second).otherwise(F.lit("default"))
    return F.when(schema.rlike(r"^.+[0-9]+$"), F.concat_ws("_", first, tail))


def ipv4_number(address: Column) -> Column:
    """Dotted address as an unsigned 32-bit number."""
    part = F.split(address, r"\.")

    def octet(i: int) -> Column:
        return F.try_element_at(part, F.lit(i)).try_cast("long")

    number = octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * (1 << 8) + octet(4)
    return F.when(F.size(part) == 4, number)


def shard_type_parts(shard_type: Column) -> Column:
    """``service_namespace`` as a struct; the namespace is empty without an underscore."""
    pieces = F.split(shard_type, "_")
    return F.struct(
        pieces[0].alias("service"),
        F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit("")).alias("namespace"),
    )


def shard_type_of(service: Column, namespace: Column) -> Column:
    """``service``, or ``service_namespace`` when there is a namespace."""
    return F.when(namespace == "", service).otherwise(F.concat_ws("_", service, namespace))


def pair_identity(first: Column, second: Column) -> Column:
    """md5 of two names put together; tells one pair of inputs from another."""
    return F.md5(F.concat(first, second))


def parse_grant(grant: Column) -> Column:
    """A GRANT statement as (privileges, user, host, hash, option)."""
    return F.struct(
        _matched(grant, GRANT, 1).alias("privileges"),
        _matched(grant, GRANT, 2).alias("username"),
        _matched(grant, GRANT, 3).alias("source_host"),
        F.coalesce(_matched(grant, GRANT_PASSWORD, 1), F.lit("NONE")).alias("hashed_password"),
        grant.rlike(r"WITH GRANT OPTION").alias("grant_option"),
    )
