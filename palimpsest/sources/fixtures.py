"""Drives derived from the TPC-H-like test tables, in SQL that Spark and DuckDB both run.

Each view is written once; {sha}, {len} and the like stand for what the two dialects spell differently.
"""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import send_package, shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()

#: What the dialects spell differently, Spark first.
DIALECTS = {
    "spark": {"sha": "sha2(", "sha_end": ", 256)", "len": "octet_length(", "len_end": ")", "idiv": "div", "int_list": "sequence("},
    "duckdb": {"sha": "sha256(", "sha_end": ")", "len": "strlen(", "len_end": ")", "idiv": "//", "int_list": "generate_series("},
}

VIEWS = {
    # one version of one object for each event
    "fx_history": """select event_id + 1 as seq, 0 as idx, ts as time, concat('u-', cast(user_id as varchar(20))) as oid,
        case event_type when 'signup' then 'put' when 'purchase' then 'write' when 'click' then 'copy' when 'view' then 'attrs' else 'delete' end as op,
        cast(round(value * 100) as bigint) as size, {sha}cast(event_id as varchar(20)){sha_end} as etag from events""",
    "fx_removed": """select concat('users/', oid) as key, oid, seq, time, size from (
        select *, row_number() over (partition by oid order by seq desc, idx desc) as rn from fx_history) where rn = 1 and op = 'delete'""",
    # the log, four transactions to a commit
    "fx_txns": """select event_id {idiv} 4 + 1 as seq, cast(event_id % 4 as int) as idx, ts as time, concat('u-', cast(user_id as varchar(20))) as target, event_type as op from events""",
    # changes of a drive: first a create, then what the events say
    "fx_changes": """select seq, idx, 0 as chg, time, oid, case when rn = 1 then 'create' when op = 'write' then 'set' when op = 'copy' then 'move' when op = 'delete' then 'remove' when op = 'put' then 'create' else 'set' end as what,
        case when rn = 1 or op in ('copy', 'put') then concat('f-', cast(seq % 7 as varchar(20))) end as parent, case when rn = 1 or op in ('copy', 'put') then concat('user-', oid) end as name,
        case when op = 'write' then size end as size, case when op in ('write', 'attrs') then etag end as etag
        from (select *, row_number() over (partition by oid order by seq, idx) as rn from fx_history)""",
    "fx_entries": """select 'root' as parent, r_name as name, concat('r-', cast(r_regionkey as varchar(20))) as oid, 'folder' as kind from region
        union all select concat('r-', cast(n_regionkey as varchar(20))), n_name, concat('n-', cast(n_nationkey as varchar(20))), 'folder' from nation
        union all select concat('n-', cast(c_nationkey as varchar(20))), c_name, concat('c-', cast(c_custkey as varchar(20))), 'folder' from customer
        union all select concat('n-', cast(s_nationkey as varchar(20))), s_name, concat('s-', cast(s_suppkey as varchar(20))), 'folder' from supplier
        union all select concat('c-', cast(o_custkey as varchar(20))), concat('order-', lpad(cast(o_orderkey as varchar(20)), 8, '0')), concat('o-', cast(o_orderkey as varchar(20))), 'file' from orders""",
    "fx_objects": """select e.oid, e.kind, case when o.o_orderkey is null then cast(0 as bigint) else cast(round(o.o_totalprice * 100) as bigint) end as size, {sha}e.oid{sha_end} as etag,
        coalesce(o.o_orderdate, timestamp_ntz '2020-01-01 00:00:00') as time from fx_entries e left join orders o on e.oid = concat('o-', cast(o.o_orderkey as varchar(20)))""",
    # the same drive later: some customers moved to the next nation
    "fx_moves": """select case when c_custkey % 10 = 0 then concat('n-', cast((c_nationkey + 1) % 25 as varchar(20))) else concat('n-', cast(c_nationkey as varchar(20))) end as parent, c_name as name, concat('c-', cast(c_custkey as varchar(20))) as oid, 'folder' as kind from customer
        union all select parent, name, oid, kind from fx_entries where oid not like 'c-%'""",
    "fx_shards": """select doc_id, pos, substr(text, cast(pos * 512 + 1 as int), 512) as bytes, {sha}substr(text, cast(pos * 512 + 1 as int), 512){sha_end} as hash,
        cast({len}substr(text, cast(pos * 512 + 1 as int), 512){len_end} as bigint) as n from (
        select doc_id, text, unnest({int_list}0, cast((greatest(n_chars, 1) - 1) {idiv} 512 as int))) as pos from documents where text is not null)""",
    # extents of each document: its shards, with a run of zeros after every seventh
    "fx_extents": """select doc_id as oid, pos * 2 as pos, hash as s, n, cast(null as bigint) as z from fx_shards
        union all select doc_id, pos * 2 + 1, cast(null as varchar(64)), cast(null as bigint), cast(4096 as bigint) from fx_shards where pos % 7 = 6""",
    "fx_edits": """select d.doc_id, b.item_id as ord, (b.item_id * 37) % d.n_chars as off, substr(b.text, 1, 16) as data, cast({len}substr(b.text, 1, 16){len_end} as bigint) as len
        from documents d join benchmark b on b.item_id % 5 = d.doc_id % 5 where d.n_chars > 0""",
    "fx_drives": """select drive, cast(substr(drive, 4) as int) % 2 = 1 as deleted, concat('src', cast(cast(substr(drive, 4) as int) - 1 as varchar(20))) as fork_of from (select distinct source as drive from documents)""",
    "fx_refs": """select distinct d.source as drive, s.hash, s.n from fx_shards s join documents d on s.doc_id = d.doc_id""",
    "fx_stored": """select hash, max(n) as size, min(doc_id) as first_doc, timestamp_ntz '2024-01-01 00:00:00' + (min(doc_id) % 240) * interval '1' hour as modified from fx_shards group by hash""",
    "fx_parts": """select l_orderkey as upload, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as part, cast(l_quantity as bigint) * 1048576 as size, l_returnflag as flag from lineitem""",
    "fx_queue": """select o_orderkey as id, o_custkey as batch, case o_orderstatus when 'O' then 'queued' when 'F' then 'done' else 'failed' end as state, cast(round(o_totalprice * 100) as bigint) as size,
        case o_orderstatus when 'F' then cast(round(o_totalprice * 100) as bigint) when 'O' then cast(round(o_totalprice * 100) as bigint) {idiv} 2 else cast(0 as bigint) end as sent,
        case when o_orderkey % 3 = 0 then cast(null as bigint) else o_orderkey - 1 end as base, concat('drive-', cast(o_custkey % 5 as varchar(20))) as drive, concat('k/', cast(o_custkey as varchar(20)), case when o_orderkey % 4 = 0 then '/' else concat('/f', cast(o_orderkey % 3 as varchar(20))) end) as key from orders""",
    "fx_local": """select concat('n-', cast(c_nationkey as varchar(20))) as parent, c_name as name, case when c_custkey % 7 = 0 then cast(null as bigint) else c_custkey + 1000000 end as ino from customer where c_custkey % 7 = 0 or c_custkey % 11 = 0""",
    "fx_remote": """select concat('n-', cast(c_nationkey as varchar(20))) as parent, c_name as name, c_custkey as ino from customer""",
    "fx_inodes": """select ino, case when ino % 5 = 0 then 'saved' when ino % 5 = 1 then 'saving' when ino % 5 = 2 then 'waiting' when ino % 5 = 3 then 'failed' else 'conflicted' end as sync from (select c_custkey as ino from customer union all select c_custkey + 1000000 from customer)""",
    "fx_bench": """select event_type as scenario, cast(user_id % 2 as int) as target, cast(event_id % 2 as int) as round, value as latency from events""",
    "fx_keys": """select page_id, regexp_replace(url, '^[a-z]+://', '') as key from pages""",
}


class Fixtures:
    """The views as DataFrames; each is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._views = spark, sf_dir, {}
        send_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._views:
            sql = VIEWS[name].format(**DIALECTS["spark"]).replace("unnest(", "explode(").replace("varchar(20)", "string").replace("varchar(64)", "string")
            self._views[name] = self.sql(sql)
        return self._views[name]

    def folder(self) -> str:
        """A folder of this query's own in the folder that all executors share."""
        return f"{shared_dir(self.spark)}/query-{uuid.uuid4().hex}"

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Spark SQL in which names of tables and views stand for themselves."""
        used = {n: getattr(self, n) for n in [*TABLES, *VIEWS] if re.search(rf"\b(from|join)\s+{n}\b", text)} | more
        for n in used:
            text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **used)

    @cached_property
    def keys(self) -> DataFrame:
        from palimpsest.operators.tree import keys

        return keys(self.fx_entries)

    @cached_property
    def state(self) -> DataFrame:
        """The drive as a state: its entries with what the objects hold."""
        return self.fx_entries.join(self.fx_objects.select("oid", "size", "etag"), "oid").select("oid", "parent", "name", "kind", "size", "etag")

    @cached_property
    def listed(self) -> DataFrame:
        from palimpsest.operators.transactions import keyed

        return keyed(self.state)


def oracle(text: str) -> str:
    """DuckDB SQL in front of which the views that it names are defined."""
    found: dict[str, str] = {}

    def need(sql: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", sql):
                body = VIEWS[name].format(**DIALECTS["duckdb"]).replace("timestamp_ntz", "timestamp")
                need(body)
                found[name] = body

    need(text)
    views = ", ".join(f"{n} as ({body})" for n, body in found.items())
    text = text.strip()
    if not views:
        return text
    if text.lower().startswith("with recursive"):
        return f"with recursive {views}, {text[len('with recursive'):]}"
    return f"with {views}, {text[4:]}" if text.lower().startswith("with") else f"with {views} {text}"
