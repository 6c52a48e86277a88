"""Queries for the operators that act on a store, on drives as wholes, and on what clients receive."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import patch
from palimpsest.operators import content, planners, state
from palimpsest.plans.reads import R
from palimpsest.plans.registry import query
from palimpsest.streaming import feed

text_bytes = lambda c: F.encode(c, "UTF-8")

query("src_client_storage", "select e.oid, e.parent, o.size from fx_entries e join fx_objects o using (oid) where e.kind = 'file'")(lambda fx: fx.fx_entries.where("kind = 'file'").join(fx.fx_objects.select("oid", "size"), "oid").select("oid", "parent", "size"))
query("st_with_spilled", "select oid, case when oid like 'o-%' and substr(oid, 3)::bigint % 2 = 0 then 'shard' when oid like 'o-%' then 'inline' else 'none' end as content from fx_objects")(
    lambda fx: state.with_spilled(fx.fx_objects.select("oid", F.expr("case when oid like 'o-%' then 'inline' else 'none' end").alias("content")), fx.fx_objects.where("oid like 'o-%'").select("oid", F.expr("if(cast(substr(oid, 3) as bigint) % 2 = 0, 'inline', 'older')").alias("was"), F.lit("shard").alias("content"))))
query("ct_spill", "select item_id as oid, sha256(text) as s, cast(strlen(text) as bigint) as n from benchmark")(lambda fx: state.spill(fx.benchmark.select(F.col("item_id").alias("oid"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("n"), text_bytes("text").alias("d"))))
query("ct_patch_encode", "select doc_id, cast(12 + sum(16 + len) as bigint) as n from fx_edits group by doc_id")(
    lambda fx: fx.fx_edits.groupBy("doc_id").agg(patch.encode_patch(F.transform(F.sort_array(F.collect_list(F.struct("ord", "off", text_bytes("data").alias("data")))), lambda e: F.struct(e["off"].alias("off"), e["data"].alias("data")))).alias("body")).select("doc_id", F.octet_length("body").cast("long").alias("n")))
query("op_edit_target", R + "select key, case kind when 'folder' then 'refused' else 'write' end as outcome from keyed union all select key || '.new', 'create' from keyed where kind = 'file'")(
    lambda fx: planners.edit_target(fx.keys.select("key").unionAll(fx.keys.where("kind = 'file'").select(F.concat("key", F.lit(".new")))), fx.keys))
query("op_delete_many", "select batch as request, id as ord, key, count(*) over (partition by batch) <= 12 as accepted from fx_queue")(lambda fx: planners.delete_many(fx.fx_queue.selectExpr("batch as request", "id as ord", "key"), 12))
query("op_direct_commit", "select doc_id as upload, case when bool_or(first_doc % 5 = 0) then 'missing' else 'ok' end as verdict from fx_shards join fx_stored using (hash) group by doc_id")(
    lambda fx: planners.commit_upload(fx.fx_shards.selectExpr("doc_id as upload", "hash", "n"), fx.fx_stored.where("first_doc % 5 <> 0")))
query("op_enable_feature", "select r_regionkey, case when r_regionkey % 2 = 0 then 'inline-data,multi-object-versions' else 'multi-object-versions' end as features from region")(
    lambda fx: planners.enable_feature(fx.region.select("r_regionkey", F.expr("if(r_regionkey % 2 = 0, array('inline-data'), cast(array() as array<string>))").alias("features")), "multi-object-versions").select("r_regionkey", F.array_join("features", ",").alias("features")))
query("sx_sse", """select seq, concat('id: ', seq, chr(10), string_agg(concat('data: {"op":"', op, '","key":"', target, '"}'), chr(10) order by idx), chr(10), chr(10)) as event from fx_txns group by seq""")(lambda fx: feed.format_sse(fx.fx_txns.selectExpr("seq", "idx as place", "op", "target as key")))
query("ct_edit_sizes", "select doc_id, cast(sum(len) as bigint) as written from fx_edits group by doc_id")(lambda fx: fx.fx_edits.groupBy("doc_id").agg(F.sum("len").alias("written")))
query("ct_extent_kinds", "select oid, count(s) as shards, count(z) as zeros, cast(coalesce(sum(z), 0) as bigint) as zero_bytes from fx_extents group by oid")(lambda fx: content.bounds(fx.fx_extents).groupBy("oid").agg(F.count("s").alias("shards"), F.count("z").alias("zeros"), F.coalesce(F.sum("z"), F.lit(0)).alias("zero_bytes")))
