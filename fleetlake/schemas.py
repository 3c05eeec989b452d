"""Shapes of the fleet's JSON documents, as DDL text."""

# Documents shared with the existing tools.
_ENDPOINT = "struct<host: string, port: int>"
REPLICA_CONFIG_JSON = (
    f"map<string, struct<db: string, user: string, passwd: string, master: {_ENDPOINT}, "
    f"slave: {_ENDPOINT}, dr_slave: {_ENDPOINT}>>"
)
SHARD_MAP_JSON = (
    "struct<services: map<string, struct<namespaces: map<string, "
    "struct<shards: map<string, struct<mysqldb: string, replica_set: string>>>>>>>"
)
AUTH_ROLES_JSON = (
    "map<string, struct<privileges: string, source_hosts: array<string>, grant_option: boolean, "
    "users: array<struct<username: string, password: string, enabled: boolean>>>>"
)
CHANGE_EVENT_JSON = (
    "struct<database: string, `table`: string, type: string, ts: bigint, position: string, "
    "gtid: string, data: map<string, string>>"
)
