"""Sources, point reads, listings and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import http
from palimpsest.operators import content, gc, journal, listing, planners, state, temporal, tree
from palimpsest.plans.registry import KEYED, query
from palimpsest.sources import store

R = f"with recursive {KEYED} "
AT = "2024-01-15 00:00:00"

# sources

query("src_drives", "select distinct source as drive from documents")(lambda fx: fx.documents.select(F.col("source").alias("drive")).distinct())
query("src_log", """with g as (select distinct seq from fx_txns where seq > 5 and seq <> 120), n as (select seq, seq - 5 - row_number() over (order by seq) as d from g)
  select t.seq, t.idx, t.target from fx_txns t join n on t.seq = n.seq where d = 0""")(lambda fx: state.contiguous(fx.fx_txns.where("seq <> 120"), 5).select("seq", "idx", "target"))
query("src_latest_checkpoint", "select drive, max(seq) as seq from (select source as drive, doc_id // 100 as seq from documents) group by drive")(
    lambda fx: store.latest_checkpoint(fx.documents.select(F.col("source").alias("drive"), F.expr("doc_id div 100").alias("seq"))))
query("src_rows", "select (select count(*) from fx_entries where parent <> 'root' and parent not in (select oid from fx_entries where kind = 'folder')) as orphans, (select count(*) from (select 1 from fx_entries group by parent, name having count(*) > 1)) as clashes")(
    lambda fx: tree.orphans(fx.fx_entries).agg(F.count("*").alias("orphans")).crossJoin(tree.clashes(fx.fx_entries).agg(F.count("*").alias("clashes"))))
query("src_shard", "select hash, sha256(bytes) = hash as good from fx_shards")(lambda fx: store.verify(fx.fx_shards))
query("src_extents", "select oid, pos, coalesce(s, 'zeros') as s, coalesce(n, z) as n from fx_extents")(lambda fx: fx.fx_extents.select("oid", "pos", F.coalesce("s", F.lit("zeros")).alias("s"), content.length().alias("n")))
# point reads and predicates

query("q_lookup", R + "select oid, kind, depth from keyed where key = (select min(key) from keyed where kind = 'file')")(
    lambda fx: fx.keys.join(F.broadcast(fx.keys.where("kind = 'file'").agg(F.min("key").alias("key"))), "key", "left_semi").select("oid", "kind", "depth"))
query("q_key_of", R + "select oid, key, depth from keyed")(lambda fx: fx.keys.select("oid", "key", "depth"))
query("q_child_named", "select oid, kind from fx_entries where parent = 'root' and name = 'ASIA' order by case kind when 'file' then 0 else 1 end limit 1")(lambda fx: tree.child_named(fx.fx_entries, "root", "ASIA").select("oid", "kind"))
query("q_children", "select oid, name || case kind when 'folder' then '/' else '' end as segment from fx_entries where parent = 'n-3'")(lambda fx: tree.children(fx.fx_entries, "n-3").select("oid", "segment"))
query("q_has_children", "select distinct parent as oid from fx_entries")(lambda fx: tree.has_children(fx.fx_entries))
query("q_kind", "select kind, count(*) as n from fx_entries group by kind")(lambda fx: fx.fx_entries.groupBy("kind").agg(F.count("*").alias("n")))
query("q_location", "select oid, parent, name from fx_entries where oid = 'c-7'")(lambda fx: fx.fx_entries.where("oid = 'c-7'").select("oid", "parent", "name"))
query("q_is_ancestor", "with recursive up as (select parent as oid, 1 as distance from fx_entries where oid = 'o-7' union all select e.parent, u.distance + 1 from up u join fx_entries e on e.oid = u.oid) select * from up")(
    lambda fx: tree.ancestors_of(fx.fx_entries, "o-7"))
query("q_contains", R + "select count(*) as n from keyed where starts_with(key, 'ASIA/')")(lambda fx: fx.keys.where(F.col("key").startswith("ASIA/")).agg(F.count("*").alias("n")))
query("q_subtree", R + "select oid, depth from keyed where starts_with(key, 'EUROPE/') and key <> 'EUROPE/'")(lambda fx: tree.subtree(fx.keys, "EUROPE/").select("oid", "depth"))
query("q_live_bytes", "select cast(sum(size) as bigint) as bytes from fx_objects where kind = 'file'")(lambda fx: tree.live_bytes(fx.fx_entries, fx.fx_objects))
query("q_describe", "select d.drive, coalesce(d.fork_of, '') as fork_of, count(f.drive) as forks from fx_drives d left join fx_drives f on f.fork_of = d.drive and not f.deleted group by 1, 2")(
    lambda fx: fx.fx_drives.select("drive", F.coalesce("fork_of", F.lit("")).alias("fork_of")).join(state.live_forks(fx.fx_drives).groupBy("drive").agg(F.count("*").alias("forks")), "drive", "left").fillna({"forks": 0}))
query("q_list_drives", "select drive from fx_drives where not deleted")(lambda fx: planners.live_drives(fx.fx_drives).select("drive"))
query("q_precondition", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when (l_partkey % 5 <> 0 and l_suppkey % 2 = 0) or (l_partkey % 5 = 0 and l_linenumber = 1) or (l_partkey % 5 = 0 and l_suppkey % 3 = 0) then 412 else 200 end as status from lineitem""")(
    lambda fx: fx.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", http.precondition(
        F.expr("l_partkey % 5 = 0"), F.lit("1.0"), F.lit("e"), F.expr("case when l_suppkey % 3 = 0 and l_partkey % 5 = 0 then '2.0' end"),
        F.expr("case when l_partkey % 5 <> 0 and l_suppkey % 2 = 0 then 'x' else if(l_partkey % 5 = 0, 'y, W/e', null) end"), F.expr("l_linenumber = 1 and l_partkey % 5 = 0")).alias("status")))
query("q_conditional_get", """select event_id, case when event_id % 7 = 0 then 412 when event_id % 7 <> 1 and event_id % 3 = 0 and epoch_s > 1705276800 then 412 when event_id % 5 = 0 then 304 when event_id % 5 <> 0 and event_id % 2 = 0 and epoch_s <= 1705276800 then 304 else 200 end as status
  from (select event_id, cast(floor(epoch(ts)) as bigint) as epoch_s from events)""")(
    lambda fx: fx.events.select("event_id", http.conditional_get(F.lit("e"), F.unix_timestamp(F.col("ts").cast("timestamp")), F.expr("case when event_id % 7 = 0 then 'x' when event_id % 7 = 1 then 'a, e' end"),
        F.expr("case when event_id % 3 = 0 then 1705276800L end"), F.expr("case when event_id % 5 = 0 then '*' end"), F.expr("case when event_id % 2 = 0 then 1705276800L end")).alias("status")))
query("q_range", """select doc_id, case when n_chars = 0 then 416 when doc_id % 6 = 4 or doc_id % 6 = 3 then 200 when doc_id % 6 in (0, 1) and doc_id % 6 * 400 >= n_chars then 416 when doc_id % 6 = 5 then 416 else 206 end as status,
  case when n_chars = 0 or doc_id % 6 in (3, 4, 5) then 0 when doc_id % 6 = 0 then 0 when doc_id % 6 = 1 then case when 400 < n_chars then 400 else 0 end else greatest(n_chars - 100, 0) end as start from documents""")(
    lambda fx: fx.documents.select("doc_id", http.byte_range(F.expr("case doc_id % 6 when 0 then 'bytes=0-99' when 1 then 'bytes=400-' when 2 then 'bytes=-100' when 3 then 'bytes=9-5' when 4 then 'bytes=0-1,5-6' else 'bytes=x-' end"), F.col("n_chars")).alias("r")).select("doc_id", "r.status", "r.start"))
query("q_headers", "select oid, case kind when 'folder' then '0755' else '0644' end as mode, case kind when 'folder' then 'application/x-directory' else 'binary/octet-stream' end as content_type from fx_objects")(
    lambda fx: fx.fx_objects.select("oid", http.octal_mode(F.lit(None).cast("int"), F.col("kind")).alias("mode"), http.content_type(F.lit(None).cast("string"), F.col("kind")).alias("content_type")))
query("q_validate_name", """select item_id, k, case when k = 0 then 'empty' when k = 1 then 'bad character' when k = 2 then 'dot' when k = 3 and strlen(text) > 255 then 'too long' else case when k = 3 and contains(text, '/') then 'bad character' else 'ok' end end as verdict
  from (select item_id, text, item_id % 5 as k from benchmark)""")(
    lambda fx: fx.benchmark.select("item_id", F.expr("item_id % 5").alias("k"), "text").select("item_id", "k", http.name_error(F.expr("case k when 0 then '' when 1 then 'a/b' when 2 then '..' when 3 then text else 'fine' end")).alias("verdict")))
query("q_validate_key", "select page_id, case page_id % 4 when 0 then case when contains(key, '/') then 'empty segment' else 'ok' end when 1 then 'dot' when 2 then 'ok' else case when strlen(key) * 60 + 60 > 1024 then 'key too long' else 'ok' end end as verdict from fx_keys")(
    lambda fx: fx.fx_keys.select("page_id", http.key_error(F.expr("case page_id % 4 when 0 then replace(key, '/', '//') when 1 then concat('./', key) when 2 then key else repeat(concat(key, '/'), 60) end")).alias("verdict")))
query("q_follows_content", "select seq, oid from fx_history where op not in ('attrs', 'delete')")(lambda fx: fx.fx_history.where("op not in ('attrs', 'delete')").select("seq", "oid"))
# listings

FLAT = "kind <> 'folder' or oid not in (select parent from fx_entries)"
query("ls_list", R + f"select 'object' as kind, key, oid, false as truncated from keyed where {FLAT}")(lambda fx: _whole_listing(fx))
query("ls_delimited", R + "select case when kind = 'folder' then 'prefix' else 'object' end as kind, key, oid, (select count(*) from keyed where depth = 3 and starts_with(key, 'ASIA/NATION_2/')) > 20 as truncated from keyed where depth = 3 and starts_with(key, 'ASIA/NATION_2/') order by key limit 20")(
    lambda fx: listing.list_keys(fx.keys, fx.fx_entries, "ASIA/NATION_2/", delimited=True, limit=20))
query("ls_page", R + f"select 'object' as kind, key, oid, true as truncated from keyed where ({FLAT}) and starts_with(key, 'ASIA/') and key > 'ASIA/NATION_12/' order by key limit 15")(lambda fx: listing.list_keys(fx.keys, fx.fx_entries, "ASIA/", after="ASIA/NATION_12/", limit=15))
query("ls_rollup", R + "select distinct 'ASIA/' || split_part(substr(key, 6), '/', 1) || '/' as prefix from keyed where starts_with(key, 'ASIA/') and contains(substr(key, 6), '/')")(lambda fx: listing.common_prefixes(fx.keys, "ASIA/"))
query("ls_self", R + "select key, oid from keyed where kind = 'folder' and oid not in (select parent from fx_entries)")(lambda fx: fx.keys.where("kind = 'folder'").join(tree.has_children(fx.fx_entries), "oid", "left_anti").select("key", "oid"))
query("ls_v1", R + "select key, oid from keyed where kind = 'file' and key > 'EUROPE/' order by key limit 50")(lambda fx: listing.page(fx.keys.where("kind = 'file'"), ["key"], 50, key="EUROPE/").select("key", "oid"))
query("ls_v2", R + "select key, rtrim(replace(replace(to_base64(encode(key)), '+', '-'), '/', '_'), '=') as token, key as back from keyed")(lambda fx: fx.keys.select("key", listing.token_of(F.col("key")).alias("token")).withColumn("back", listing.key_of_token(F.col("token"))))
query("ls_versions", "select concat('users/', oid) as key, seq, idx, op, size, row_number() over (partition by oid order by seq desc, idx desc) = 1 as is_latest from fx_history where op in ('put', 'write', 'copy')")(
    lambda fx: listing.versions(fx.fx_history.select("oid", F.concat(F.lit("users/"), "oid").alias("key")).distinct(), fx.fx_history, ["put", "write", "copy"]))
query("ls_versions_page", "select oid as key, seq, idx from fx_history where oid > 'u-5' or (oid = 'u-5' and seq < 500)")(lambda fx: listing.after_version(fx.fx_history.withColumnRenamed("oid", "key"), "u-5", 500, 0).select("key", "seq", "idx"))
query("ls_history", "select oid, seq, n, n = last_n as is_latest from (select *, max(n) over (partition by oid) as last_n from (select oid, seq, row_number() over (partition by oid order by seq, idx) - 1 as n from fx_history) where n >= 2 and n < 12)")(
    lambda fx: listing.history(fx.fx_history, 2, 10).select("oid", "seq", F.col("n").cast("long").alias("n"), "is_latest"))
query("ls_deleted", "select key, oid, seq from fx_removed where key > 'users/u-2' order by key, oid limit 20")(lambda fx: listing.deleted(fx.fx_removed, "users/", "users/u-2", 20).select("key", "oid", "seq"))
query("ls_folder_history", "select oid, time, seq, op from fx_history")(lambda fx: fx.fx_history.orderBy("time", "oid").select("oid", "time", "seq", "op"))
query("ls_parts", "select upload, part, size from fx_parts")(lambda fx: fx.fx_parts.orderBy("upload", "part").select("upload", F.col("part").cast("long").alias("part"), "size"))
query("ls_uploads", "select upload, count(*) as parts, cast(sum(size) as bigint) as bytes from fx_parts group by upload")(lambda fx: fx.fx_parts.groupBy("upload").agg(F.count("*").alias("parts"), F.sum("size").alias("bytes")))
query("ls_names_page", "select parent, name, ino from (select * from fx_local union all select r.* from fx_remote r where not exists (select 1 from fx_local l where l.parent = r.parent and l.name = r.name)) where ino is not null and parent = 'n-3' order by name limit 25")(
    lambda fx: listing.page(journal.merged_names(fx.fx_local, fx.fx_remote).where("parent = 'n-3'"), ["name"], 25))
query("ls_first_blocked", "select ino, sync from fx_inodes where sync in ('failed', 'conflicted') order by sync <> 'conflicted', ino limit 1")(lambda fx: fx.fx_inodes.where("sync in ('failed', 'conflicted')").orderBy(F.col("sync") != "conflicted", "ino").limit(1))
query("ls_max_keys", "select item_id, least(coalesce(case when item_id % 3 > 0 then item_id * 100 end, 1000), 1000) as n from benchmark")(lambda fx: fx.benchmark.select("item_id", listing.max_keys(F.expr("case when item_id % 3 > 0 then item_id * 100 end")).alias("n")))


def _whole_listing(fx):
    """Every key of the drive, unpaged: the flat listing without a limit."""
    full = tree.has_children(fx.fx_entries).withColumn("full", F.lit(True))
    rows = fx.keys.join(full, "oid", "left").where("kind <> 'folder' or full is null")
    return rows.select(F.lit("object").alias("kind"), "key", "oid", F.lit(False).alias("truncated"))


# joins

query("j_listing_record", R + "select k.key, o.size, o.etag from keyed k join fx_objects o on k.oid = o.oid where k.kind = 'file'")(lambda fx: fx.keys.where("kind = 'file'").join(fx.fx_objects.select("oid", "size", "etag"), "oid").select("key", "size", "etag"))
query("j_key_history", "select concat('users/', oid) as key, seq, op, size from fx_history")(lambda fx: fx.fx_history.select("oid", F.concat(F.lit("users/"), "oid").alias("key")).distinct().join(fx.fx_history, "oid").select("key", "seq", "op", "size"))
query("j_removed_history", "select r.oid, max(h.seq) as seq from fx_removed r join fx_history h on h.oid = r.oid and h.op <> 'delete' group by r.oid")(
    lambda fx: fx.fx_removed.select("oid").join(fx.fx_history.where("op <> 'delete'"), "oid").groupBy("oid").agg(F.max("seq").alias("seq")))
query("j_as_of", f"select oid, time, seq, idx, op, size from (select *, row_number() over (partition by oid order by time desc, seq desc, idx desc) as rn from fx_history where time <= timestamp '{AT}') where rn = 1")(lambda fx: temporal.as_of(fx.fx_history, AT))
query("j_as_of_many", "select a.oid, a.at, max(h.seq) as seq from (select distinct oid, date_trunc('day', time) as at from fx_history) a join fx_history h on h.oid = a.oid and h.time <= a.at group by 1, 2")(
    lambda fx: temporal.as_of_many(fx.fx_history, fx.sql("select distinct oid, cast(date_trunc('day', cast(time as timestamp)) as timestamp_ntz) as at from fx_history")).where("seq is not null").select("oid", "at", "seq"))
query("j_range_extent", """with b as (select oid, pos, coalesce(s, 'zeros') as source, sum(coalesce(n, z)) over (partition by oid order by pos) as stop, coalesce(n, z) as len from fx_extents), t as (select oid, max(stop) as total from b group by oid)
  select b.oid, 300 as want, b.pos, b.source, cast(greatest(300, stop - len) - (stop - len) as bigint) as "offset", cast(least(1300, stop) - greatest(300, stop - len) as bigint) as len from b join t using (oid) where total >= 1300 and stop > 300 and stop - len < 1300""")(
    lambda fx: content.read_plan(fx.fx_extents, fx.documents.select(F.col("doc_id").alias("oid"), F.lit(300).cast("long").alias("start"), F.lit(1000).cast("long").alias("len"))).withColumns({"want": F.col("want").cast("int"), "pos": F.col("pos").cast("long")}))
query("j_depends", """with k as (select id, drive, key, rtrim(key, '/') as plain from fx_queue), f as (select i.id, f.key as folder, f.id as whole from k i join k f on i.drive = f.drive and f.key like '%/' and starts_with(i.plain, f.key))
  select max(a.id) as earlier, b.id as later from k a join k b on a.drive = b.drive and a.plain = b.plain and a.id < b.id group by b.id
  union select max(whole), id from f where whole < id group by id, folder union select id, min(whole) from f where whole > id group by id, folder""")(lambda fx: journal.depends(fx.fx_queue))
query("j_gc_anti", "select hash from fx_stored where hash not in (select r.hash from fx_refs r join fx_drives d on r.drive = d.drive where not d.deleted)")(
    lambda fx: fx.fx_stored.select("hash").join(gc.mark(_live_refs(fx)), "hash", "left_anti"))
query("j_gc_confirm", "select hash, size from fx_stored where hash not in (select r.hash from fx_refs r join fx_drives d on r.drive = d.drive where not d.deleted) and first_doc % 4 = 1 and modified < timestamp '2024-01-05 00:00:00'")(
    lambda fx: gc.confirm(fx.fx_stored, fx.fx_stored.where("first_doc % 4 = 1"), gc.mark(_live_refs(fx)), "2024-01-05 00:00:00.5").select("hash", "size"))
OVERLAY = "(select * from fx_local union all select r.* from fx_remote r where not exists (select 1 from fx_local l where l.parent = r.parent and l.name = r.name))"
query("j_overlay_anti", f"select parent, name, ino from {OVERLAY} where ino is not null")(lambda fx: journal.merged_names(fx.fx_local, fx.fx_remote))
query("j_unsaved_children", f"select parent, name, ino, sync from {OVERLAY} join fx_inodes using (ino) where sync <> 'saved'")(lambda fx: journal.unsaved(fx.fx_local, fx.fx_remote, fx.fx_inodes))
query("j_staged", "select ino, sync, name from fx_local join fx_inodes using (ino)")(lambda fx: fx.fx_local.where("ino is not null").join(fx.fx_inodes, "ino").select("ino", "sync", "name"))
query("j_plan_held", "select w.hash, case when s.size is null then 'missing' when s.size <> w.n then 'length' else 'held' end as verdict from (select hash, n + first_doc % 2 as n from (select hash, max(n) as n, min(doc_id) as first_doc from fx_shards group by hash)) w left join (select hash, size from fx_stored where first_doc % 3 <> 0) s using (hash)")(
    lambda fx: planners.upload_plan(fx.fx_stored.select("hash", F.expr("size + first_doc % 2").alias("n")), fx.fx_stored.where("first_doc % 3 <> 0").select("hash", "size")))
query("j_multipart", """with a as (select upload, part from fx_parts union all select distinct upload, 99 from fx_parts where upload % 3 = 0), m as (select upload, max(part) as last from a group by upload)
  select a.upload, a.part, case when p.size is null then 'InvalidPart' when p.size < 5242880 and a.part < m.last then 'EntityTooSmall' else 'ok' end as verdict, coalesce(p.size, 0) as size from a join m using (upload) left join fx_parts p on p.upload = a.upload and p.part = a.part""")(
    lambda fx: planners.complete_upload(fx.fx_parts.select("upload", F.col("part").cast("long").alias("part")).unionByName(fx.fx_parts.where("upload % 3 = 0").select("upload", F.lit(99).cast("long").alias("part")).distinct()), fx.fx_parts, 5 << 20))
query("j_state_diff", "select a.oid, case when a.parent <> b.parent then 'moved back' else 'untouched' end as action from fx_entries a join fx_moves b on a.oid = b.oid")(
    lambda fx: planners.restore_subtree(*[d.join(fx.fx_objects.select("oid", "etag"), "oid").select("oid", "parent", "name", "etag") for d in (fx.fx_entries, fx.fx_moves)]))
query("j_copy_source", "select d.doc_id % 20 as target, h.etag, count(*) as n from documents d join fx_history h on d.doc_id + 1 = h.seq group by 1, 2")(
    lambda fx: planners.copy(fx.documents.select(F.lit("d").alias("drive"), (F.col("doc_id") + 1).alias("key"), F.expr("doc_id % 20").alias("target")), fx.fx_history.select(F.lit("d").alias("drive"), F.col("seq").alias("key"), "etag", "size")).where("etag <> 'missing'").groupBy("target", "etag").agg(F.count("*").alias("n")))
query("j_feed_before_after", "select oid, seq, coalesce(lag(op) over (partition by oid order by seq, idx), 'none') as was, op as now from fx_history")(
    lambda fx: fx.sql("select oid, seq, coalesce(lag(op) over (partition by oid order by seq, idx), 'none') as was, op as now from fx_history"))


def _live_refs(fx):
    return fx.fx_refs.join(fx.fx_drives.where("not deleted").select("drive"), "drive", "left_semi")
