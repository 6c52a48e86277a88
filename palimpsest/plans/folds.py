"""Sinks, folds of the log, aggregations, windows, content, graphs, planners, feed and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import chunking, http, patch
from palimpsest.operators import content, gc, journal, latency, log, planners, state, temporal, tree
from palimpsest.plans.reads import R, _live_refs
from palimpsest.plans.registry import query
from palimpsest.streaming import feed

MEMBERS = ["parent", "name", "size", "etag"]
text_bytes = lambda c: F.encode(c, "UTF-8")

# sinks

query("snk_cadence", """with c as (select oid, seq, row_number() over (partition by oid order by seq) as n, cast(sum(size) over (partition by oid order by seq) as bigint) as total, size from fx_history)
  select oid, seq from c where n % 10 = 0 or total // 1000000 > (total - size) // 1000000""")(lambda fx: log.cadence(fx.fx_history.select("oid", "seq", F.col("size").alias("bytes")), "oid", 10, 1_000_000))
query("snk_reuse", "select distinct hash from fx_shards where hash not in (select hash from fx_shards where doc_id % 2 = 0)")(lambda fx: log.not_held(fx.fx_shards.select("hash"), fx.fx_shards.where("doc_id % 2 = 0")))
query("snk_write_shards", "select hash, max(n) as n from fx_shards where hash not in (select hash from fx_stored where first_doc < 100) group by hash")(lambda fx: log.not_held(fx.fx_shards.select("hash", "n"), fx.fx_stored.where("first_doc < 100")))
# folds

FOLDED = """f as (select oid, arg_max(parent, row(seq, idx, chg)) filter (parent is not null) as parent, arg_max(size, row(seq, idx, chg)) filter (size is not null) as size, arg_max(etag, row(seq, idx, chg)) filter (etag is not null) as etag,
  max(seq) as head, arg_max(what, row(seq, idx, chg)) filter (what in ('create', 'remove')) as linked from fx_changes group by oid)"""
folded = lambda fx, at=None: state.fold(fx.fx_changes, MEMBERS, at)
query("st_explode", "select seq, idx, time, target, op from (select seq, idx, first_value(time) over (partition by seq order by idx) as time, target, op from fx_txns)")(lambda fx: state.explode_log(state.pack_log(fx.fx_txns, ["target", "op"])))
query("st_apply", f"with {FOLDED} select oid, parent, coalesce(size, -1) as size, coalesce(etag, '') as etag, head, linked from f")(lambda fx: folded(fx).select("oid", "parent", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("etag", F.lit("")).alias("etag"), F.col("head.seq").alias("head"), "linked"))
query("st_apply_txn_of", f"with {FOLDED.replace('from fx_changes group', 'from fx_changes where seq <= 400 group')} select oid, parent, coalesce(size, -1) as size, head, linked from f")(
    lambda fx: folded(fx, F.col("seq") <= 400).select("oid", "parent", F.coalesce("size", F.lit(-1)).alias("size"), F.col("head.seq").alias("head"), "linked"))
query("st_create", f"with {FOLDED} select oid, parent from f where linked = 'create'")(lambda fx: state.linked(folded(fx)).select("oid", "parent"))
query("st_set", "select oid, seq, coalesce(last_value(size ignore nulls) over w, -1) as size, coalesce(last_value(etag ignore nulls) over w, '') as etag from fx_changes window w as (partition by oid order by seq, idx, chg)")(
    lambda fx: state.history_of(fx.fx_changes, ["size", "etag"]).select("oid", "seq", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("etag", F.lit("")).alias("etag")))
query("st_move", f"with {FOLDED} select oid, parent from f")(lambda fx: folded(fx).select("oid", "parent"))
query("st_heads", "select oid, max(seq) as seq from fx_changes group by oid")(lambda fx: folded(fx).select("oid", "head.seq"))
query("st_version_multi", "select b.oid, 'write' as op from fx_entries b join fx_moves a on a.oid = b.oid where a.parent <> b.parent or a.name <> b.name")(lambda fx: state.changed_shape(fx.fx_entries, fx.fx_moves, ["parent", "name"]))
query("st_fork", "select seq, idx, target, op from (select seq, idx, target, op from fx_txns where seq <= 150 union all select seq, idx, target, 'fork' from fx_txns where seq > 150 and seq % 2 = 0)")(
    lambda fx: state.fork(fx.fx_txns.select("seq", "idx", "target", "op"), fx.fx_txns.where("seq % 2 = 0").select("seq", "idx", "target", F.lit("fork").alias("op")), 150))
query("st_lineage", "select fork_of as drive, drive as fork from fx_drives where not deleted and fork_of is not null")(lambda fx: state.live_forks(fx.fx_drives))
query("st_invariants", "select seq, 'gap' as fault from fx_history where seq in (8, 51)")(lambda fx: state.violations(fx.fx_history.where("seq not in (7, 50)").select("seq", "time")))

# aggregations

query("ag_live_bytes", "select cast(sum(size) as bigint) as bytes from fx_objects where kind = 'file'")(lambda fx: tree.live_bytes(fx.fx_moves, fx.fx_objects))
query("ag_ckpt_stats", "select count(*) as objects, cast(sum(size) as bigint) as bytes from fx_objects")(lambda fx: fx.fx_objects.agg(F.count("*").alias("objects"), F.sum("size").alias("bytes")))
query("ag_content_size", "select oid, cast(sum(coalesce(n, z)) as bigint) as size from fx_extents group by oid")(lambda fx: fx.fx_extents.groupBy("oid").agg(F.sum(content.length()).alias("size")))
query("ag_default_size", "select d.doc_id, greatest(cast(strlen(d.text) as bigint), max(e.off + e.len)) as size from documents d left join fx_edits e using (doc_id) group by d.doc_id, d.text")(lambda fx: content.default_size(fx.documents.select("doc_id", F.octet_length("text").cast("long").alias("size")), fx.fx_edits))
query("ag_batch_status", "select batch, state, count(*) as items, cast(sum(size) as bigint) as size, cast(sum(sent) as bigint) as sent from fx_queue group by 1, 2")(lambda fx: journal.batch_status(fx.fx_queue))
query("ag_queue_summary", "select batch, count(*) as items, count(*) filter (where state = 'done') as done, count(*) filter (where state = 'failed') as failed, 0 as cancelled, cast(sum(size) as bigint) as bytes, cast(sum(case when state = 'done' then size else sent end) as bigint) as sent from fx_queue group by batch")(lambda fx: journal.summary(fx.fx_queue))
query("ag_unpublished", "select count(*) as items, cast(sum(greatest(size - sent, 0)) as bigint) as bytes from fx_queue where state <> 'done'")(lambda fx: journal.unpublished(fx.fx_queue))
query("ag_kept_distinct", "select count(*) as keys from (select distinct drive, key from fx_queue where state = 'queued')")(lambda fx: journal.distinct_keys(fx.fx_queue, "queued"))
query("ag_worst_state", R + """, s as (select k.key, (oid_n % 5) as rank from (select key, cast(substr(oid, 3) as bigint) as oid_n from keyed where kind = 'file') k)
  select folder, case max(rank) when 0 then 'saved' when 1 then 'saving' when 2 then 'waiting' when 3 then 'failed' else 'conflicted' end as worst from (
  select split_part(key, '/', 1) || '/' as folder, rank from s union all select split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/', rank from s union all select split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' || split_part(key, '/', 3) || '/', rank from s) group by folder""")(
    lambda fx: tree.worst_below(fx.keys, fx.fx_objects.where("kind = 'file'").select("oid", F.expr("case cast(substr(oid, 3) as bigint) % 5 when 0 then 'saved' when 1 then 'saving' when 2 then 'waiting' when 3 then 'failed' else 'conflicted' end").alias("sync")), {"saved": 0, "saving": 1, "waiting": 2, "failed": 3, "conflicted": 4}))
query("ag_gc_bytes", "select count(*) as objects, cast(sum(size) as bigint) as bytes from (select hash, min(n) as size from (select hash, max(n) as n from fx_shards group by hash) group by hash)")(
    lambda fx: gc.report(fx.fx_stored.select("hash", "size", F.lit("a").alias("place")).unionByName(fx.fx_stored.where("first_doc % 2 = 0").select("hash", (F.col("size") + 7).alias("size"), F.lit("b").alias("place")))))
query("ag_dedup", "with c as (select hash, count(*) as drives from fx_refs group by hash) select drive, cast(sum(n) as bigint) as bytes, count(*) as shards, cast(sum(case when drives = 1 then n else 0 end) as bigint) as own_bytes from fx_refs join c using (hash) group by drive")(lambda fx: content.dedup(fx.fx_refs))
query("ag_round_stats", 'select scenario, target, "round", count(*) as ops, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.9), 6) as p90, round(quantile_cont(latency, 0.99), 6) as p99, round(avg(latency), 6) as mean, min(latency) as least, max(latency) as most, round(count(*) / (sum(latency) / 1000), 6) as mib_s from fx_bench group by 1, 2, 3')(lambda fx: latency.round_stats(fx.fx_bench))
for p in (50, 90, 99):
    query(f"ag_p{p}", f"select scenario, round(quantile_cont(latency, {p / 100}), 6) as p{p} from fx_bench group by scenario")(lambda fx, p=p: latency.quantile(fx.fx_bench, p / 100, f"p{p}"))
query("ag_median_rounds", 'select scenario, target, round(quantile_cont(p50, 0.5), 6) as p50 from (select scenario, target, "round", quantile_cont(latency, 0.5) as p50 from fx_bench group by 1, 2, 3) group by 1, 2')(lambda fx: latency.median_of_rounds(fx.fx_bench))
query("ag_speedup", 'with m as (select scenario, target, round(quantile_cont(p50, 0.5), 6) as p50 from (select scenario, target, "round", quantile_cont(latency, 0.5) as p50 from fx_bench group by 1, 2, 3) group by 1, 2) select a.scenario, round(a.p50 / b.p50, 6) as speedup from m a join m b using (scenario) where a.target = 0 and b.target = 1')(lambda fx: latency.speedup(fx.fx_bench))
query("ag_geomean", "select scenario, round(exp(avg(ln(latency))), 6) as geomean from fx_bench group by scenario")(lambda fx: latency.geometric_mean(fx.fx_bench))
query("ag_histograms", "select scenario, bound, count(*) filter (where latency <= bound) as n from fx_bench, (select unnest([1.0::double, 5.0, 25.0, 100.0, 500.0, 1e300]) as bound) group by 1, 2")(lambda fx: latency.histogram(fx.fx_bench))
query("ag_op_class", "select op, count(*) as n from (select case when event_type = 'signup' then 'multipart' when event_type = 'purchase' and event_id % 2 = 0 then 'copy' when event_type = 'purchase' then 'put' when event_type = 'click' then 'list' when event_type = 'view' then 'get' else 'delete' end as op from events) group by op")(
    lambda fx: fx.events.select(http.operation(F.expr("case event_type when 'signup' then 'POST' when 'purchase' then 'PUT' when 'click' then 'GET' when 'view' then 'GET' else 'DELETE' end"), F.expr("if(event_type = 'click', '', 'a/b')"),
        F.expr("if(event_type = 'signup', array('uploads'), cast(array() as array<string>))"), F.expr("event_id % 2 = 0")).alias("op")).groupBy("op").agg(F.count("*").alias("n")))
query("ag_returns_decay", "select key, round(list_reduce(list_prepend(0.0::double, list(x::double order by ord)), lambda a, b: a * 0.875 + b), 6) as tally from (select oid as key, seq as ord, size % 10 as x from fx_history) group by key")(lambda fx: latency.decayed(fx.fx_history.select(F.col("oid").alias("key"), F.col("seq").alias("ord"), F.expr("size % 10").alias("x"))))

# windows

query("w_version_order", "select oid, seq, row_number() over (partition by oid order by seq, idx) as n from fx_history")(lambda fx: temporal.numbered(fx.fx_history).select("oid", "seq", F.col("n").cast("long").alias("n")))
query("w_is_latest", "select oid, seq, seq = max(seq) over (partition by oid) as is_latest from fx_history")(lambda fx: temporal.latest_flag(fx.fx_history).select("oid", "seq", "is_latest"))
query("w_prev_size", "select oid, seq, size - coalesce(lag(size) over (partition by oid order by seq, idx), 0) as delta from fx_history")(lambda fx: temporal.size_deltas(fx.fx_history).select("oid", "seq", "delta"))
query("w_validity", "select oid, seq, time, coalesce(lead(time) over (partition by oid order by seq, idx), timestamp '2099-01-01') as until from fx_history")(lambda fx: temporal.validity(fx.fx_history).select("oid", "seq", "time", F.coalesce("until", F.lit("2099-01-01").cast("timestamp_ntz")).alias("until")))
query("w_carry", "select oid, seq, last_value(parent ignore nulls) over w as parent, coalesce(last_value(size ignore nulls) over w, -1) as size from fx_changes window w as (partition by oid order by seq, idx, chg)")(lambda fx: state.history_of(fx.fx_changes, ["parent", "size"]).select("oid", "seq", "parent", F.coalesce("size", F.lit(-1)).alias("size")))
query("w_extent_bounds", "select oid, pos, cast(sum(coalesce(n, z)) over w - coalesce(n, z) as bigint) as start, cast(sum(coalesce(n, z)) over w as bigint) as stop from fx_extents window w as (partition by oid order by pos)")(lambda fx: content.bounds(fx.fx_extents).select("oid", F.col("pos").cast("long").alias("pos"), "start", "stop"))
query("w_gap_stop", "select seq from (select distinct seq, seq - dense_rank() over (order by seq) as d from fx_txns where seq not in (33, 200)) where d = 0")(lambda fx: state.contiguous(fx.fx_txns.where("seq not in (33, 200)"), 0).select("seq").distinct())
query("w_monotone_time", "select oid, seq, max(time) over (partition by oid order by seq, idx) as clamped from (select oid, seq, idx, time - (seq % 3) * interval '1' day as time from fx_history)")(
    lambda fx: temporal.monotone(fx.sql("select oid, seq, idx, time - (seq % 3) * interval '1' day as time from fx_history"), "oid").select("oid", "seq", "clamped"))
ISLANDS = """select doc_id, min(start) as start, max(stop) as stop from (select *, sum(new) over (partition by doc_id order by start, stop) as island from (
  select *, case when start >= coalesce(max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from (select doc_id, off as start, off + len as stop from fx_edits))) group by doc_id, island"""
ranges = lambda fx: fx.fx_edits.select("doc_id", F.col("off").alias("start"), (F.col("off") + F.col("len")).alias("stop"))
query("w_islands", ISLANDS)(lambda fx: temporal.islands(ranges(fx), "doc_id"))
query("j_reach_interval", ISLANDS)(lambda fx: temporal.islands(ranges(fx).distinct(), "doc_id"))
query("w_cadence", "select oid, seq from (select oid, seq, row_number() over (partition by oid order by seq) as n from fx_history) where n % 7 = 0")(lambda fx: log.cadence(fx.fx_history.select("oid", "seq", F.lit(0).cast("long").alias("bytes")), "oid", 7))
query("w_feed_limit", "select drive, seq, n from (select *, coalesce(sum(n) over (partition by drive order by seq rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (partition by drive order by seq) as place from (select source as drive, doc_id as seq, n_chars as n from documents)) where place = 1 or before + n <= 20000")(
    lambda fx: temporal.whole_batches(fx.documents.select(F.col("source").alias("drive"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("n")), "drive", 20000))
query("w_feed_keep", "select seq, oid from fx_history order by seq desc limit 300")(lambda fx: temporal.newest(fx.fx_history, 300).select("seq", "oid"))
query("w_feed_floor", "select max(seq) as floor from (select seq from fx_history order by seq desc offset 300)")(lambda fx: temporal.floor_of(fx.fx_history, 300))
query("w_lru", "select drive, id from (select *, sum(len) over (partition by drive order by last_used desc, id) as s from (select source as drive, doc_id as id, n_chars as len, doc_id * 7 % 1000 as last_used, doc_id % 13 = 0 as pinned from documents) where not pinned) where s <= 50000 union all select source, doc_id from documents where doc_id % 13 = 0")(
    lambda fx: temporal.within_budget(fx.documents.select(F.col("source").alias("drive"), F.col("doc_id").alias("id"), F.col("n_chars").alias("len"), F.expr("doc_id * 7 % 1000").alias("last_used"), F.expr("doc_id % 13 = 0").alias("pinned")), "drive", 50000).select("drive", "id"))
query("w_coverage", "with r as (select doc_id, pos * 512 as start, pos * 512 + 512 as stop from fx_shards where doc_id % 3 <> 0 or pos <> 1) select d.doc_id, (d.doc_id % 3 <> 0 or d.n_chars <= 512) as covered from documents d")(
    lambda fx: temporal.covered(fx.fx_shards.where("doc_id % 3 <> 0 or pos <> 1").selectExpr("doc_id", "pos * 512 as start", "pos * 512 + 512 as stop"), fx.documents.select("doc_id", F.col("n_chars").alias("size")), "doc_id"))

# content

query("ct_normalize", """with e as (select *, case when z is null or lag(z) over (partition by oid order by pos) is null then 1 else 0 end as new from (select oid, pos, case when pos % 3 = 0 and pos > 0 then null else s end as s, case when pos % 3 = 0 and pos > 0 then null else n end as n, case when pos % 3 = 0 and pos > 0 then n else z end as z from fx_extents) where coalesce(n, z) > 0), g as (select *, sum(new) over (partition by oid order by pos) as run from e)
  select oid, cast(run - 1 as bigint) as pos, coalesce(max(s), 'zeros') as s, cast(coalesce(max(n), sum(z)) as bigint) as n from g group by oid, run""")(
    lambda fx: content.normalize(fx.sql("select oid, pos, case when pos % 3 = 0 and pos > 0 then null else s end as s, case when pos % 3 = 0 and pos > 0 then null else n end as n, case when pos % 3 = 0 and pos > 0 then n else z end as z from fx_extents")).select("oid", "pos", F.coalesce("s", F.lit("zeros")).alias("s"), F.coalesce("n", "z").alias("n")))
query("ct_inline", "select doc_id, case when strlen(text) <= 4096 then 'inline' else sha256(text) end as place from documents")(lambda fx: fx.documents.select("doc_id", F.when(F.octet_length("text") <= content.INLINE_BYTES, "inline").otherwise(F.sha2("text", 256)).alias("place")))
query("ct_materialize", "select doc_id, sha256(text) as digest from documents")(lambda fx: content.materialize(fx.fx_shards).select("doc_id", F.sha2("text", 256).alias("digest")))
query("ct_read_plan", """with b as (select oid, pos, coalesce(s, 'zeros') as source, sum(coalesce(n, z)) over (partition by oid order by pos) as stop, coalesce(n, z) as len from fx_extents), t as (select oid, max(stop) as total from b group by oid)
  select b.oid, b.pos, b.source, cast(least(100 + total // 2, stop) - greatest(100, stop - len) as bigint) as len from b join t using (oid) where 100 + total // 2 <= total and stop > 100 and stop - len < 100 + total // 2""")(
    lambda fx: content.read_plan(fx.fx_extents, content.bounds(fx.fx_extents).groupBy("oid").agg(F.max("stop").alias("t")).selectExpr("oid", "100L as start", "t div 2 as len")).select("oid", F.col("pos").cast("long").alias("pos"), "source", "len"))
query("ct_needed_shards", """with b as (select oid, row_number() over (partition by oid order by pos) - 1 as i, s, sum(coalesce(n, z)) over (partition by oid order by pos) as stop, coalesce(n, z) as len, count(*) over (partition by oid) as c from fx_extents), r as (select oid, coalesce(min(i) filter (where stop > 600), max(c)) as lo, coalesce(max(i + 1) filter (where stop - len < 1200), 0) as hi from b group by oid)
  select distinct b.oid, s as hash from b join r using (oid) where i >= greatest(lo - 1, 0) and i < greatest(hi, lo) + 2 and s is not null""")(
    lambda fx: content.needed_shards(fx.fx_extents, fx.documents.selectExpr("doc_id as oid", "600L as start", "1200L as end")).select("oid", "hash"))
HEX = "(select item_id, hex(encode(text)) as h, strlen(text) as n from benchmark)"
query("ct_splice", f"select item_id, sha256(unhex(concat(substr(h, 1, 10), hex(encode('inserted')), substr(h, 17)))) as digest from {HEX}")(lambda fx: fx.benchmark.select("item_id", F.sha2(content.splice(text_bytes("text"), F.lit(5), F.lit(3), text_bytes(F.lit("inserted"))), 256).alias("digest")))
query("ct_write_at", "select item_id, sha256(concat(text, repeat(chr(0), 10), 'tail')) as digest from benchmark")(lambda fx: fx.benchmark.select("item_id", F.sha2(content.write_at(text_bytes("text"), F.octet_length("text") + 10, text_bytes(F.lit("tail"))), 256).alias("digest")))
query("ct_set_size", f"select item_id, sha256(unhex(case when n >= 200 then substr(h, 1, 400) else concat(h, repeat('00', cast(200 - n as int))) end)) as digest from {HEX}")(lambda fx: fx.benchmark.select("item_id", F.sha2(content.set_size(text_bytes("text"), F.lit(200)), 256).alias("digest")))
query("ct_apply_edits", """with recursive e as (select doc_id, hex(encode(data)) as data, off, row_number() over (partition by doc_id order by ord) as n from fx_edits), w as (select doc_id, hex(encode(text)) as h, 0 as n from documents
  union all select w.doc_id, concat(substr(w.h, 1, cast(2 * e.off as int)), e.data, substr(w.h, cast(2 * e.off as int) + length(e.data) + 1)), w.n + 1 from w join e on e.doc_id = w.doc_id and e.n = w.n + 1)
  select doc_id, sha256(unhex(arg_max(h, n))) as digest from w group by doc_id""")(
    lambda fx: content.apply_edits(fx.documents.select("doc_id", text_bytes("text").alias("bytes")), fx.fx_edits.select("doc_id", "ord", "off", text_bytes("data").alias("data"))).select("doc_id", F.sha2("bytes", 256).alias("digest")))
query("ct_patch_decode", "select doc_id, cast(item as bigint) as ord, off, data from (select doc_id, row_number() over (partition by doc_id order by ord) - 1 as item, off, data from fx_edits)")(
    lambda fx: fx.fx_edits.groupBy("doc_id").agg(patch.encode_patch(F.transform(F.sort_array(F.collect_list(F.struct("ord", "off", text_bytes("data").alias("data")))), lambda e: F.struct(e["off"].alias("off"), e["data"].alias("data")))).alias("body"))
    .select("doc_id", F.explode(patch.decode_patch("body")["edits"]).alias("e")).select("doc_id", F.col("e.ord").cast("long").alias("ord"), "e.off", F.decode("e.data", "UTF-8").alias("data")))
query("ct_edit_pipeline", f"select item_id, sha256(unhex(concat(hex(encode('head')), substr(h, 9), hex(encode('tail'))))) as etag, case when n + 4 <= 4096 then 'inline' else 'shards' end as place from {HEX}")(
    lambda fx: content.apply_edits(fx.benchmark.select(F.col("item_id").alias("doc_id"), text_bytes("text").alias("bytes")), fx.benchmark.select(F.col("item_id").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).cast("long").alias("off"), text_bytes(F.lit("head")).alias("data")), F.struct(F.lit(1).alias("ord"), F.octet_length("text").cast("long").alias("off"), text_bytes(F.lit("tail")).alias("data")))).alias("e")).select("doc_id", "e.*"))
    .select(F.col("doc_id").alias("item_id"), F.sha2("bytes", 256).alias("etag"), F.when(F.octet_length("bytes") <= content.INLINE_BYTES, "inline").otherwise("shards").alias("place")))
query("ct_stream_chunk", "select doc_id, cast(strlen(text) as bigint) as n from documents where n_chars > 0")(lambda fx: chunking.shards(fx.documents.where("n_chars > 0").select("doc_id", text_bytes("text").alias("bytes")), "doc_id", "bytes", 64, 256, 1024).groupBy("doc_id").agg(F.sum("n").alias("n")))
query("ct_shards", "select doc_id, pos, hash, n from fx_shards")(lambda fx: fx.documents.where("text is not null").select("doc_id", F.posexplode(content.cut_fixed(F.col("text"), 512)).alias("pos", "bytes")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2("bytes", 256).alias("hash"), F.octet_length("bytes").cast("long").alias("n")))
query("ct_dedup", "select hash, max(n) as n from fx_shards group by hash")(lambda fx: fx.fx_shards.dropDuplicates(["hash"]).select("hash", "n"))
PAGES = "select concat('p', cast(doc_id as varchar(20))) as page, pos * 1 as pos, cast(null as varchar(20)) as child, hash as s, n from fx_shards union all select 'root', doc_id, concat('p', cast(doc_id as varchar(20))), null, null from documents"
query("ct_flatten", "select doc_id, pos, hash as s, n from fx_shards")(
    lambda fx: content.flatten(fx.sql(PAGES.replace("varchar(20)", "string")), "root").select(F.col("path")[0].cast("long").alias("doc_id"), F.col("path")[1].cast("long").alias("pos"), "s", "n"))
query("ct_etag", "select oid, sha256(unhex(concat('696e6c696e6500', string_agg(case when s is not null then concat('73', s, lpad(printf('%X', n), 16, '0')) else concat('7A', lpad(printf('%X', z), 16, '0')) end, '' order by pos)))) as etag from fx_extents group by oid")(lambda fx: content.etag(fx.fx_extents))
query("ct_object_path", "select hash, concat(substr(hash, 1, 2), '/', substr(hash, 3, 2), '/', hash) as path from fx_stored")(lambda fx: fx.fx_stored.select("hash", content.object_path().alias("path")))
query("ct_block_read", "select d.doc_id as oid, b as block, greatest(300 - b * 1024, 0) as \"offset\", least(300 + n_chars, (b + 1) * 1024) - greatest(300, b * 1024) as len from (select doc_id, n_chars, unnest(generate_series(0, (300 + n_chars - 1) // 1024)) as b from documents where n_chars > 0) d")(
    lambda fx: content.blocks_of(fx.documents.selectExpr("doc_id as oid", "300L as start", "n_chars as len"), 1024).select("oid", "block", "offset", "len"))
query("ct_overlay_extents", """with x as (select doc_id as key, ord, off as start, off + len as stop from fx_edits), p as (select key, edge, lead(edge) over (partition by key order by edge) as nxt from (select key, start as edge from x union select key, stop from x)), s as (select p.key, p.edge, p.nxt, max(x.ord) as ord from p join x on x.key = p.key and x.start <= p.edge and x.stop >= p.nxt where nxt is not null group by 1, 2, 3)
  select key, min(edge) as start, max(nxt) as stop, max(ord) as ord from (select *, sum(new) over (partition by key order by edge) as run from (select *, case when lag(nxt) over (partition by key order by edge) = edge and lag(ord) over (partition by key order by edge) = ord then 0 else 1 end as new from s)) group by key, run""")(
    lambda fx: content.overlay_extents(fx.fx_edits.selectExpr("doc_id as key", "ord", "off as start", "off + len as stop")))
query("ct_checksums", "select item_id, sha1(text) as sha1, sha256(text) as sha256 from benchmark")(lambda fx: fx.benchmark.select("item_id", F.sha1(text_bytes("text")).alias("sha1"), F.sha2("text", 256).alias("sha256")))

# sets and graphs

query("so_union_distinct", "select ino from fx_local where ino is not null union select ino from fx_inodes where sync = 'conflicted'")(lambda fx: fx.fx_local.where("ino is not null").select("ino").union(fx.fx_inodes.where("sync = 'conflicted'").select("ino")).distinct())
query("so_difference", "select distinct r.hash from fx_refs r where r.hash not in (select hash from fx_stored where first_doc % 3 > 0)")(lambda fx: gc.dangling(fx.fx_refs, fx.fx_stored.where("first_doc % 3 > 0")))
query("so_hash_union", "select distinct hash from fx_refs where drive in ('src0', 'src2', 'src4')")(lambda fx: fx.fx_refs.where("drive = 'src0'").select("hash").union(fx.fx_refs.where("drive in ('src2', 'src4')").select("hash")).distinct())
query("gr_descendants", "with recursive w as (select 'n-3' as oid, 0 as depth union all select e.oid, w.depth + 1 from w join fx_entries e on e.parent = w.oid) select * from w")(lambda fx: tree.descendants(fx.fx_entries, "n-3"))
CHAIN = "with recursive up as (select id as node, id as ancestor, base as nxt, 0 as d from fx_queue union all select u.node, q.id, q.base, u.d + 1 from up u join fx_queue q on q.id = u.nxt) "
query("gr_lineage", CHAIN + "select node, arg_min(ancestor, d) as blocked_by from up where ancestor in (select id from fx_queue where state = 'failed') group by node")(lambda fx: journal.first_blocked(fx.fx_queue))
query("gr_needed", CHAIN + "select id from fx_queue where id not in (select ancestor from up where node in (select id from fx_queue where state <> 'done'))")(lambda fx: journal.unneeded(fx.fx_queue))
query("gr_ancestors", R + "select key, split_part(key, '/', 1) || '/' as folder from keyed where kind = 'file' union all select key, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' from keyed where kind = 'file' union all select key, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' || split_part(key, '/', 3) || '/' from keyed where kind = 'file'")(lambda fx: tree.ancestor_keys(fx.keys.where("kind = 'file'")))
query("gr_reachability", "select distinct s.hash from fx_shards s")(lambda fx: content.flatten(fx.sql(PAGES.replace("varchar(20)", "string")), "root").select(F.col("s").alias("hash")).distinct())
query("gr_affected", R + "select oid from keyed where starts_with(key, 'ASIA/NATION_2/')")(lambda fx: feed.affected(fx.keys, fx.spark.createDataFrame([("object", "ASIA/NATION_2/"), ("subtree", "ASIA/NATION_2/")], "what string, key string")))

# planners

some_keys = lambda fx: fx.keys.where("kind = 'file'").select(F.regexp_replace("key", "order-0", "order-9").alias("key"))
query("op_mkparents", R + "select distinct 'new/' || split_part(key, '/', 1) || '/' as folder from keyed union select 'new/'")(lambda fx: planners.make_parents(fx.keys.select(F.concat(F.lit("new/"), F.substring_index("key", "/", 1), F.lit("/f")).alias("key")), fx.keys).select("folder"))
query("op_restore_file_as_of", "select oid, seq, idx, 'restored' as outcome, size from (select *, row_number() over (partition by oid order by time desc, seq desc) as rn from fx_history where time <= timestamp '2024-01-15 00:00:00') where rn = 1")(
    lambda fx: planners.restore(temporal.as_of(fx.fx_history, "2024-01-15 00:00:00").select("oid", "seq", "idx"), fx.fx_history, fx.fx_history.limit(0)))
query("op_set_attrs", "select event_id, case when event_id % 2 = 0 then 'b=2,c=' || event_id else 'c=' || event_id end as attrs from events")(
    lambda fx: fx.events.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(planners.merge_attrs(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")), F.expr("if(event_id % 2 = 0, array('a'), array('a', 'b'))"), F.create_map(F.lit("c"), F.col("event_id").cast("string")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("attrs")))
query("op_copy", "select seq, etag, size from fx_history")(lambda fx: planners.copy(fx.fx_history.select(F.lit("d").alias("drive"), F.col("seq").alias("key"), F.col("seq").alias("target")), fx.fx_history.select(F.lit("d").alias("drive"), F.col("seq").alias("key"), "etag", "size")).select(F.col("target").alias("seq"), "etag", "size"))
query("op_multipart", "select upload, cast(sum(size) as bigint) as size, string_agg(cast(size as varchar), ',' order by part) as sizes from fx_parts group by upload")(lambda fx: fx.fx_parts.groupBy("upload").agg(F.sum("size").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "size"))), lambda p: p["size"].cast("string")), ",").alias("sizes")))
query("op_direct_plan", "select hash, case when first_doc % 2 = 0 then 'held' else 'missing' end as verdict from fx_stored")(lambda fx: planners.upload_plan(fx.fx_stored.select("hash", F.col("size").alias("n")), fx.fx_stored.where("first_doc % 2 = 0").select("hash", "size")))
query("op_expire", "select hash from fx_stored where timestamp '2024-01-12 00:00:00' - modified > interval '7' day")(lambda fx: gc.expire(fx.fx_stored, "modified", "2024-01-12 00:00:00", 7).select("hash"))
LIVE = "(select r.hash from fx_refs r join fx_drives d on r.drive = d.drive where not d.deleted)"
query("gc_mark", f"select distinct hash from {LIVE}")(lambda fx: gc.mark(_live_refs(fx)))
query("gc_propose", f"select hash, size from fx_stored where hash not in {LIVE} and modified < timestamp '2024-01-06 00:00:00'")(lambda fx: gc.candidates(fx.fx_stored, gc.mark(_live_refs(fx)), "2024-01-06 00:00:00").select("hash", "size"))
query("gc_sweep", f"select hash, size from fx_stored where hash not in {LIVE} and modified < timestamp '2024-01-06 00:00:00'")(lambda fx: gc.confirm(fx.fx_stored, gc.candidates(fx.fx_stored, gc.mark(_live_refs(fx)), "2024-01-08 00:00:00"), gc.mark(_live_refs(fx)), "2024-01-06 00:00:00.7").select("hash", "size"))
query("gc_dry_run", f"select count(*) as objects, cast(coalesce(sum(size), 0) as bigint) as bytes from fx_stored where hash not in {LIVE}")(lambda fx: gc.report(fx.fx_stored.join(gc.mark(_live_refs(fx)), "hash", "left_anti").withColumn("place", F.lit("shards/"))))
query("gc_phase", "select seq, case seq % 4 when 0 then 'mark' when 1 then case when time < timestamp '2024-01-14 00:00:00' then 'mark again' else 'busy' end when 2 then case when time <= timestamp '2024-01-14 00:00:00' then 'sweep' else 'waiting' end else 'sweep' end as next from (select seq, date_trunc('hour', time) as time from fx_history)")(
    lambda fx: fx.sql("select seq, cast(date_trunc('hour', cast(time as timestamp)) as timestamp_ntz) as time from fx_history").select("seq", gc.phase(F.expr("case seq % 4 when 1 then 'marking' when 2 then 'waiting' when 3 then 'deleting' end"), F.col("time"), F.col("time"), F.lit(86400), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("next")))
query("gc_guard", "select hash, case when first_doc % 4 = 0 and first_doc % 3 = 0 then 'rescued' when first_doc % 4 = 0 then 'rescue' when first_doc % 2 = 0 then 'reuse' else 'upload' end as action from fx_stored")(
    lambda fx: gc.admission(fx.fx_stored, fx.fx_stored.where("first_doc % 4 = 0"), fx.fx_stored.where("first_doc % 3 = 0"), fx.fx_stored.where("first_doc % 2 = 0"), "waiting"))
query("jr_fold", "select drive, key, min(id) as id, coalesce(arg_max(size, id) filter (where id % 2 = 0), -1) as mode, arg_max(state, id) as source, count(*) as folded from fx_queue group by drive, key")(
    lambda fx: journal.fold(fx.fx_queue.selectExpr("drive", "key", "id", "if(id % 2 = 0, size, null) as mode", "size as mtime", "state as source")).select("drive", "key", "id", F.coalesce("mode", F.lit(-1)).alias("mode"), "source", "folded"))

# feed

FEED = "select seq, op, key, from_key, kind from (select seq, case op when 'copy' then 'rename' else op end as op, concat('users/', oid, case when seq % 5 = 0 then '/' else '' end) as key, case when op = 'copy' then concat('old/', oid, case when seq % 5 = 0 then '/' else '' end) end as from_key, case when seq % 5 = 0 then 'folder' else 'file' end as kind from fx_history)"
the_feed = lambda fx: fx.sql(FEED)


def _feed_of(fx):
    txns = fx.fx_history.select("seq", "idx", "oid", F.expr("case op when 'copy' then 'rename' else op end").alias("op"), F.lit("target").alias("what"))
    kinds = F.expr("case when seq % 5 = 0 then 'folder' else 'file' end").alias("kind")
    before = fx.fx_history.select("seq", "idx", "oid", F.concat(F.lit("old/"), "oid").alias("key"), kinds)
    after = fx.fx_history.where("op <> 'delete'").select("seq", "idx", "oid", F.concat(F.lit("users/"), "oid").alias("key"), kinds)
    return feed.feed_of(txns, before, after).select("seq", "place", "op", "key", F.coalesce("from_key", F.lit("")).alias("from_key"), "kind")


query("sx_feed_of", "select seq, 0 as place, case op when 'copy' then 'rename' else op end as op, case when op = 'delete' then 'old/' else 'users/' end || oid as key, case when op = 'copy' then 'old/' || oid else '' end as from_key, case when op <> 'delete' and seq % 5 = 0 then 'folder' when op = 'delete' and seq % 5 = 0 then 'folder' else 'file' end as kind from fx_history")(_feed_of)
query("sx_changes_since", f"select seq, op, key, false as expired from ({FEED}) where seq > 700")(lambda fx: feed.changes_since(the_feed(fx), 700, 100).select("seq", "op", "key", "expired"))
query("sx_invalidate", f"""with f as ({FEED}), k as (select from_key as key, kind = 'folder' as folder, true as whole from f where from_key is not null union all select key, kind = 'folder', op in ('rename', 'delete', 'restore') from f)
  select distinct 'object' as what, key from k union select distinct 'subtree', rtrim(key, '/') || '/' from k where folder and whole""")(lambda fx: feed.invalidations(the_feed(fx)))
query("sx_backoff", "select item_id, cast(least(250 * pow(2, least(item_id, 10)), 30000) as bigint) as ms from benchmark")(lambda fx: fx.benchmark.select("item_id", http.backoff_ms(F.col("item_id")).alias("ms")))
query("sx_parse_sse", "select event_id as stream, cast(event_id as varchar) as id, event_type || chr(10) || 'more' as data from events")(
    lambda fx: feed.parse_sse(fx.events.select(F.col("event_id").alias("stream"), F.posexplode(F.array(F.lit(": hello"), F.concat(F.lit("id: "), F.col("event_id").cast("string")), F.concat(F.lit("data: "), "event_type"), F.lit("data:more"), F.lit(""))).alias("n", "line"))).select("stream", "id", "data"))
# functions

query("fn_keys", "select page_id, split_part(key, '/', 1) as first, key like '%/' as folder from fx_keys")(lambda fx: fx.fx_keys.select("page_id", F.split_part("key", F.lit("/"), F.lit(1)).alias("first"), F.col("key").endswith("/").alias("folder")))
query("fn_percent", "select page_id, url || '+x' as decoded from pages")(lambda fx: fx.pages.select("page_id", http.percent_decoded(F.concat(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("+x"))).alias("decoded")))
query("fn_xml", "select page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as digest from pages")(lambda fx: fx.pages.select("page_id", F.sha2(http.xml_escaped(F.col("html")), 256).alias("digest")))
query("fn_human", "select oid, case when size >= 1048576 then printf('%.1f MiB', size / 1048576.0) when size >= 1024 then printf('%.1f KiB', size / 1024.0) else size || ' B' end as size from fx_objects")(lambda fx: fx.fx_objects.select("oid", http.human_bytes(F.col("size")).alias("size")))
query("fn_time", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as rfc3339, date_trunc('second', ts) as floored from events")(lambda fx: fx.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("rfc3339"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("floored")))
query("fn_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")(lambda fx: fx.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
