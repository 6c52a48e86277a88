"""Queries that write a drive and read it back, plan transactions and look at the state after, and follow its feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import chunking
from palimpsest.operators import log, order, planners, state, transactions, tree
from palimpsest.plans.folds import FOLDED, MEMBERS, folded
from palimpsest.plans.reads import R
from palimpsest.plans.registry import query
from palimpsest.sources import store
from palimpsest.streaming import feed

text_bytes = lambda c: F.encode(c, "UTF-8")

# sources: what is read here was written in the same way a pool is


def _pool(fx):
    path = f"{fx.folder()}/pool.json"
    store.write_descriptor(fx.spark.createDataFrame([(1, "sha256", ["multi-object-versions", "inline-data"])], store.POOL), path)
    return store.read_pool(fx.spark, path).select("format", "hash", F.array_join(F.array_sort("features"), ",").alias("features"))


def _drive(fx):
    path = fx.folder()
    fx.fx_drives.select("drive", "fork_of", F.col("drive").alias("of")).write.partitionBy("of").json(path)
    assert store.read_drive(fx.spark, f"{path}/of=none") is None
    return store.read_drive(fx.spark, f"{path}/of=src3").select("drive", "fork_of")


def _checkpoint(fx):
    tables = {"entries": (fx.fx_entries, ["parent", "name"]), "objects": (fx.fx_objects, ["oid"]), "history": (fx.fx_history, ["oid", "seq"]), "removed": (fx.fx_removed, ["key"])}
    path = fx.folder()
    log.write_checkpoint(tables, path)
    return path, list(tables)


def _read_checkpoint(fx):
    path, _ = _checkpoint(fx)
    read = lambda name, detail: store.read_checkpoint(fx.spark, path, name).select(F.lit(name).alias("part"), "oid", F.col(detail).cast("string").alias("detail"))
    return read("entries", "parent").unionByName(read("objects", "kind")).unionByName(read("history", "seq")).unionByName(read("removed", "key"))


def _written_checkpoint(fx):
    """The index, and for each table whether its files hold its rows in ranges that do not overlap."""
    path, _ = _checkpoint(fx)
    return fx.spark.read.schema("name string, rows long").json(f"{path}/index")


def _files(fx):
    """A folder of a file for each region, names that begin with an underscore, and a folder for each nation."""
    path = fx.folder()
    fx.nation.select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.partitionBy("n_regionkey", "n_nationkey").json(path)
    return path


query("src_pool", "select 1 as format, 'sha256' as hash, 'inline-data,multi-object-versions' as features")(_pool)
query("src_drive", "select drive, fork_of from fx_drives where drive = 'src3'")(_drive)
query("src_checkpoint", "select 'entries' as part, oid, parent as detail from fx_entries union all select 'objects', oid, kind from fx_objects union all select 'history', oid, cast(seq as varchar) from fx_history union all select 'removed', oid, key from fx_removed")(_read_checkpoint)
query("src_page", "select page_id, page_id % 5 <> 0 as good from pages")(
    lambda fx: store.verify(fx.pages.select(F.col("page_id").alias("of"), F.sha2("html", 256).alias("hash"), F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("bytes")), "of").select(F.col("of").alias("page_id"), "good"))
query("src_list_files", "select '_SUCCESS' as path")(lambda fx: store.list_files(fx.spark, _files(fx)).select("path"))
query("src_list_dirs", "select distinct 'n_regionkey=' || n_regionkey as name from nation")(lambda fx: store.list_dirs(fx.spark, _files(fx)))
query("src_list_recursive", "select 'n_regionkey=' || n_regionkey || '/n_nationkey=' || n_nationkey as folder, cast(strlen(n_name) + 14 as bigint) as length from nation union all select '', 0")(
    lambda fx: store.list_recursive(fx.spark, _files(fx)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "length"))
query("src_walk", "select split_part(key, '/', 1) as top, count(*) as files, cast(sum(length) as bigint) as bytes from (select 'n_regionkey=' || n_regionkey || '/' || n_nationkey as key, strlen(n_name) + 14 as length from nation union all select '_SUCCESS', 0) group by 1")(
    lambda fx: store.walk(fx.spark, _files(fx)).groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("top")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))
query("src_state", "select oid, 'f-0' as parent, oid || '.txt' as name, size from (select oid, max(size) as size, max(seq) as seq from fx_history where seq <= 600 group by oid) ")(lambda fx: _logged(fx))


def _logged(fx):
    """A log of nested commits written as JSON, its objects read back as of a version: a create and a set of the largest size so far."""
    largest = fx.sql("select seq, time, oid, size, max(size) over (partition by oid order by seq) as most, row_number() over (partition by oid order by seq) as n from fx_history")
    folder = F.when(F.col("seq") == 1, F.struct(F.struct(F.lit("f-0").alias("oid"), F.lit("root").alias("parent"), F.lit("f").alias("name"), F.lit("folder").alias("kind")).alias("create")))
    create = F.when(F.col("n") == 1, F.struct(F.struct("oid", F.lit("f-0").alias("parent"), F.concat("oid", F.lit(".txt")).alias("name"), F.lit("file").alias("kind")).alias("create")))
    change = "struct<create: struct<oid: string, parent: string, name: string, kind: string>, set: struct<oid: string, size: bigint>>"
    fill = F.struct(F.lit(None).cast("struct<oid: string, parent: string, name: string, kind: string>").alias("create"), F.struct("oid", F.col("most").alias("size")).alias("set"))
    pad = lambda c: F.when(c.isNotNull(), F.struct(c["create"].alias("create"), F.lit(None).cast("struct<oid: string, size: bigint>").alias("set")))
    changes = F.array_compact(F.array(pad(folder).cast(change), pad(create).cast(change), fill.cast(change)))
    commits = largest.select(F.lit(1).alias("format"), "seq", "time", F.array(F.struct(F.col("oid").alias("target"), F.lit("put").alias("op"), changes.alias("changes"))).alias("txns"))
    path = fx.folder()
    commits.write.json(path)
    return store.state_at(fx.spark, path, F.col("seq") <= 600).where("kind = 'file'").select("oid", "parent", "name", "size")


# sinks


def _put_new(fx):
    """Commits written twice over, the first hundred numbers before: what is there already is not written again."""
    path, commits = fx.folder(), state.pack_log(fx.fx_txns, ["target", "op"])
    first = log.append_commits(commits.where("seq <= 100"), path)
    rest = log.append_commits(commits, path)
    assert log.append_commits(commits, path) == 0
    return state.explode_log(fx.spark.read.parquet(path)).select("seq", "idx", "target", F.lit(first + rest).alias("commits"))


def _deleted_prefix(fx):
    path = _files(fx)
    log.delete_prefix(fx.spark, f"{path}/n_regionkey=2")
    return store.list_dirs(fx.spark, path)


#: DuckDB: commits of a drive's transactions, cut where the bytes would pass {limit} or the count {most}; one row a step.
BYTES = """with recursive t as (select oid, seq, idx, size, row_number() over (partition by oid order by seq, idx) as rn from fx_history),
  w as (select oid, rn, 1 as "commit", size as held, 1 as n from t where rn = 1
  union all select t.oid, t.rn, case when w.held + t.size > {limit} or w.n = {most} then w."commit" + 1 else w."commit" end, case when w.held + t.size > {limit} or w.n = {most} then t.size else w.held + t.size end, case when w.held + t.size > {limit} or w.n = {most} then 1 else w.n + 1 end
  from w join t on t.oid = w.oid and t.rn = w.rn + 1) select oid, seq, idx, cast("commit" as bigint) as "commit" from w join t using (oid, rn)"""
query("snk_put_new", "select seq, idx, target, (select count(distinct seq) from fx_txns) as commits from fx_txns")(_put_new)
query("snk_batch_bytes", BYTES.format(limit=100_000, most=256))(lambda fx: log.group_by_bytes(fx.fx_history, "oid", "size", 100_000))
query("snk_commit", BYTES.format(limit=200_000, most=7))(lambda fx: log.group_by_bytes(fx.fx_history, "oid", "size", 200_000, 7))
query("snk_commit_all", 'select target, seq, idx, cast((row_number() over (partition by target order by seq, idx) - 1) // 256 + 1 as bigint) as "commit", (row_number() over (partition by target order by seq, idx) - 1) % 256 as place from fx_txns')(
    lambda fx: log.group_commits(fx.fx_txns, "target").select("target", "seq", "idx", "commit", F.col("place").cast("long").alias("place")))
query("snk_checkpoint", "select 'entries' as name, count(*) as rows from fx_entries union all select 'objects', count(*) from fx_objects union all select 'history', count(*) from fx_history union all select 'removed', count(*) from fx_removed")(_written_checkpoint)
query("snk_write_pages", "select distinct hash from fx_shards where hash not in (select hash from fx_stored where first_doc % 3 = 0)")(lambda fx: log.not_held(fx.fx_shards.select("hash"), fx.fx_stored.where("first_doc % 3 = 0")))
query("snk_delete_prefix", "select distinct 'n_regionkey=' || n_regionkey as name from nation where n_regionkey <> 2")(_deleted_prefix)
query("snk_show", "select row_number() over (order by doc_id, pos) as place, bytes from fx_shards")(lambda fx: order.number_all(fx.fx_shards.select("doc_id", "pos", "bytes"), ["doc_id", "pos"]).select(F.col("place"), "bytes"))

#: DuckDB: rows with the low zero bits of their key's hash, and the cuts, one after the other.
SEGMENTS = """with recursive k as (select kind, oid, row_number() over (partition by kind order by oid) as place, cast('0x' || substr(sha256(oid), 61, 4) as integer) as tail from fx_entries),
  m as (select kind, place, case when tail = 0 then 16 else cast(log2(tail & -tail) as integer) end as zeros from k), ends as (select kind, max(place) as last from k group by kind),
  c as (select kind, 0 as low, 0 as number, false as done from ends
  union all select x.kind, x.high, x.number + 1, x.high = x.last from (select c.kind, c.number, e.last, coalesce((select min(place) from m where m.kind = c.kind and zeros >= 12 and place between c.low + 256 and c.low + 8192),
    case when e.last >= c.low + 8192 then coalesce((select max(place) from m where m.kind = c.kind and zeros >= 10 and place between c.low + 256 and c.low + 8192), c.low + 8192) end, e.last) as high from c join ends e on e.kind = c.kind where not c.done) x)
  select k.kind, k.oid, cast(max(c.number) as bigint) as segment from k join c on c.kind = k.kind and c.low < k.place group by k.kind, k.oid"""
query("snk_segments", SEGMENTS)(lambda fx: log.segments(fx.fx_entries, "kind", "oid"))

# the state

#: DuckDB: the last link of each object before a change.
LINKS = "l as (select *, last_value(case when what in ('create', 'remove') then what end ignore nulls) over (partition by oid order by seq, idx, chg rows between unbounded preceding and 1 preceding) as was from fx_changes)"
query("st_check_txn", f"with {LINKS} select seq, oid, case when was is null then 'unknown object' when what = 'create' then 'already linked' else 'not linked' end as fault from l where (was is null and what <> 'create') or (was = 'create' and what = 'create') or (was = 'remove' and what in ('move', 'remove'))")(
    lambda fx: transactions.faults(fx.fx_changes.select("*", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("recursive")), fx.sql("select concat('f-', cast(id as string)) as oid, 'root' as parent, concat('f', cast(id as string)) as name, 'folder' as kind, 0L as size, '' as etag from range(7)")).select("seq", "oid", "fault"))
query("st_remove", f"with {FOLDED}, r as (select oid, max(seq) as seq from fx_changes where what in ('create', 'remove') group by oid) select f.oid, r.seq, max(c.seq) as last_seq from f join r on r.oid = f.oid left join fx_changes c on c.oid = f.oid and c.seq < r.seq where f.linked = 'remove' group by 1, 2")(
    lambda fx: state.removed_rows(fx.fx_changes).select("oid", "seq", "last_seq"))
query("st_version_single", "select oid, max(seq) as head, sum(own) as versions from (select oid, seq, 1 as own from fx_changes union all select parent, seq, 0 from fx_changes where parent is not null) group by oid")(
    lambda fx: state.single_versions(fx.fx_changes.select("seq", "idx", "oid").unionByName(fx.fx_changes.where("parent is not null").select("seq", "idx", F.col("parent").alias("oid"))), fx.fx_changes.select("seq", "idx", F.col("oid").alias("target"))).select("oid", F.col("head.seq").alias("head"), "versions"))
query("st_rows", "select row_number() over (order by oid) as place, oid, kind, size from fx_objects")(lambda fx: order.number_all(fx.fx_objects.select("oid", "kind", "size"), ["oid"]).select("place", "oid", "kind", "size"))
query("st_spill", "select doc_id as oid, coalesce(sha256(text), repeat('0', 64)) as s, cast(coalesce(strlen(text), 7) as bigint) as n from (select doc_id, case when strlen(text) <= 4096 then text end as text from documents)")(
    lambda fx: state.spill(fx.documents.select(F.col("doc_id").alias("oid"), F.when(F.octet_length("text") <= 4096, None).otherwise(F.repeat(F.lit("0"), F.lit(64))).alias("s"), F.when(F.octet_length("text") <= 4096, None).otherwise(F.lit(7)).cast("long").alias("n"), F.when(F.octet_length("text") <= 4096, text_bytes("text")).alias("d"))))
query("q_record", "select oid, kind, size, etag from fx_objects where oid in (select parent from fx_entries)")(lambda fx: fx.fx_objects.join(tree.has_children(fx.fx_entries), "oid", "left_semi").select("oid", "kind", "size", "etag"))
query("q_attrs", "select oid, last_value(etag ignore nulls) over (partition by oid order by seq rows between unbounded preceding and unbounded following) as etag, seq from fx_changes")(
    lambda fx: fx.fx_changes.select("oid", "seq").join(state.fold(fx.fx_changes, ["etag"]).select("oid", "etag"), "oid").select("oid", "etag", "seq"))
query("ls_folder", "select e.parent, e.oid, e.name || case e.kind when 'folder' then '/' else '' end as segment, o.size, o.etag, row_number() over (partition by e.parent order by e.name || case e.kind when 'folder' then '/' else '' end) as place from fx_entries e join fx_objects o using (oid)")(
    lambda fx: order.running(fx.fx_entries.withColumn("segment", tree.segment()).join(fx.fx_objects.select("oid", "size", "etag"), "oid").select("parent", "oid", "segment", "size", "etag"), ["parent"], ["segment"], {"place": F.lit(1)}))
query("j_json_each", "select e.event_id, cast(json_extract_string(props, '$.k') as bigint) as k, x.item from events e, (select unnest([1, 5, 9]) as item) x")(
    lambda fx: fx.events.select("event_id", "props", F.explode(F.from_json(F.lit("[1, 5, 9]"), "array<int>")).alias("item")).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "item"))
query("so_union_all", "select parent, name, count(*) as layers from (select parent, name from fx_local union all select parent, name from fx_remote) group by 1, 2")(lambda fx: fx.fx_local.select("parent", "name").unionAll(fx.fx_remote.select("parent", "name")).groupBy("parent", "name").agg(F.count("*").alias("layers")))

# planners: the drive's listing after the transactions

after = lambda fx, changes: transactions.keyed(transactions.apply(fx.state, changes)).select("key", "kind", "etag")
KEYED_STATE = R + ", s as (select k.key, k.kind, k.oid, o.etag from keyed k join fx_objects o using (oid)) "
numbered = lambda rows: rows.withColumn("req", F.xxhash64("key") % 1_000_000 + 1_000_001)


def _put(fx):
    files = fx.listed.where("kind = 'file'").select("key")
    asked = files.select(F.concat(F.lit("x/"), "key").alias("key")).unionAll(files).unionAll(files.select(F.concat("key", F.lit("/below")))).unionAll(fx.listed.where("kind = 'folder'").select(F.regexp_replace("key", "/$", "")))
    return after(fx, transactions.put(numbered(asked).select("req", "key", F.lit(1).alias("size"), F.lit("new").alias("etag")), fx.listed)[1])


def _write(fx):
    asked = fx.listed.select("key").unionAll(fx.listed.where("kind = 'file'").select(F.concat(F.lit("w/"), "key", F.lit(".new"))))
    return after(fx, transactions.write(numbered(asked).select("req", "key", F.lit(1).alias("size"), F.lit("edit").alias("etag")), fx.listed)[1])


def _delete(fx):
    asked = fx.listed.select("key").unionAll(fx.spark.createDataFrame([("missing",), ("",)], "key string"))
    return after(fx, transactions.delete(numbered(asked).select("req", "key"), fx.listed)[1])


def _rename(fx):
    moved = fx.listed.where("depth = 3").select("key", F.concat(F.lit("moved/to/"), F.regexp_replace("key", "/", "-"), F.when(F.col("kind") == "folder", "/").otherwise("")).alias("target"))
    inside = fx.listed.where("depth = 2").select("key", F.concat("key", F.lit("in/")).alias("target"))
    return after(fx, transactions.rename(numbered(moved.unionAll(inside)).select("req", F.col("key").alias("source"), "target"), fx.listed)[1])


def _restored(fx):
    """The folder r-2 brought back from the later drive to what it was."""
    now = fx.fx_moves.join(fx.fx_objects.select("oid", "size", "etag"), "oid").select("oid", "parent", "name", "kind", "size", "etag")
    return transactions.apply(now, transactions.restore_subtree(fx.state, now, "r-2")).select("oid", "parent", "name")


FOLDERS = "(select key from s where kind = 'folder' and oid in (select parent from fx_entries) and exists (select 1 from s f where f.kind = 'file' and starts_with(f.key, s.key)))"
query("op_put", KEYED_STATE + f"select key, kind, case kind when 'file' then 'new' else etag end as etag from s union all select 'x/' || key, 'file', 'new' from s where kind = 'file' union all select 'x/' || key, 'folder', null from {FOLDERS} union all select 'x/', 'folder', null")(_put)
query("op_write", KEYED_STATE + f"select key, kind, case kind when 'file' then 'edit' else etag end as etag from s union all select 'w/' || key || '.new', 'file', 'edit' from s where kind = 'file' union all select 'w/' || key, 'folder', null from {FOLDERS} union all select 'w/', 'folder', null")(_write)
query("op_delete", KEYED_STATE + "select key, kind, etag from s where kind = 'folder' and oid in (select parent from fx_entries)")(_delete)
query("op_rename", KEYED_STATE + """, t as (select k.key, k.kind, s.etag, k.depth, split_part(k.key, '/', 1) || '/' || split_part(k.key, '/', 2) || '/' || split_part(k.key, '/', 3) as head from keyed k join s using (oid))
  select case when depth < 3 then key else 'moved/to/' || replace(head || case when depth = 3 and kind = 'file' then '' else '/' end, '/', '-') || case when depth = 3 and kind = 'file' then '' else '/' end || substr(key, length(head) + 2) end as key, kind, etag from t union all select 'moved/', 'folder', null union all select 'moved/to/', 'folder', null""")(_rename)
query("op_restore_subtree", """with recursive a as (select oid from fx_entries where parent = 'r-2' union all select e.oid from a join fx_entries e on e.parent = a.oid), b as (select oid from fx_moves where parent = 'r-2' union all select e.oid from b join fx_moves e on e.parent = b.oid)
  select oid, parent, name from fx_entries where oid in (select oid from a) union all select oid, parent, name from fx_moves where oid not in (select oid from a) and oid not in (select oid from b)""")(_restored)
query("op_restore", "select oid, seq, idx, case when oid in (select oid from fx_history where seq < 20) then 'key taken' else 'restored' end as outcome, size from fx_history union all select 'u-1', -5, 0, 'no such version', 0")(
    lambda fx: planners.restore(fx.fx_history.select("oid", "seq", "idx").unionAll(fx.spark.createDataFrame([("u-1", -5, 0)], "oid string, seq long, idx int")), fx.fx_history, fx.fx_history.where("seq < 20")))

#: Requests of drives: an object of the fixture stands for an alias.
REQUESTS = "select oid as alias, seq, case op when 'delete' then 'soft_delete' when 'write' then 'undelete' when 'copy' then case when seq % 4 = 0 then 'hard_delete' else 'create' end else 'create' end as op from fx_history"
DRIVES = f"""with recursive q as (select alias, seq, op, row_number() over (partition by alias order by seq) as rn from ({REQUESTS})),
  w as (select alias, cast(0 as bigint) as rn, false as live, false as gone, '' as op, cast(0 as bigint) as seq, '' as outcome from q where rn = 1
  union all select q.alias, q.rn, case q.op when 'create' then true when 'soft_delete' then false when 'undelete' then w.live or w.gone else false end,
    case q.op when 'soft_delete' then w.gone or w.live when 'undelete' then w.gone and w.live when 'hard_delete' then w.gone and w.live else w.gone end, q.op, q.seq,
    case q.op when 'create' then case when w.live then 'exists' else 'done' end when 'soft_delete' then case when w.live then 'done' else 'missing' end
      when 'undelete' then case when not w.gone then 'missing' when w.live then 'exists' else 'done' end else case when w.live or w.gone then 'done' else 'missing' end end
  from w join q on q.alias = w.alias and q.rn = w.rn + 1) """
for op in ("create", "soft_delete", "undelete", "hard_delete"):
    query("op_drive_create" if op == "create" else f"op_{op}", DRIVES + f"select alias, seq, outcome from w where op = '{op}'")(lambda fx, op=op: planners.drive_requests(fx.sql(REQUESTS)).where(F.col("op") == op).select("alias", "seq", "outcome"))

# the feed

query("sx_poll", "select seq, idx, target from fx_txns where seq > 100 and seq <= 112")(lambda fx: feed.poll(fx.fx_txns, 100, 50).select("seq", "idx", "target"))
UP_TO_DATE = f"with {FOLDED} select oid, parent, coalesce(size, -1) as size, coalesce(etag, '') as etag, head, linked from f"
shown = lambda objects: objects.select("oid", "parent", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("etag", F.lit("")).alias("etag"), F.col("head.seq").alias("head"), "linked")
query("sx_relist", UP_TO_DATE)(lambda fx: shown(feed.relist(100, 300, folded(fx, F.col("seq") <= 600), 600, folded(fx, F.col("seq") <= 100), fx.fx_changes, MEMBERS)))
query("sx_catch_up", UP_TO_DATE)(lambda fx: shown(feed.relist(500, 300, folded(fx, F.col("seq") <= 600), 600, folded(fx, F.col("seq") <= 500), fx.fx_changes, MEMBERS)))


def _streamed(fx):
    """Files of changes, in no order, read as a stream of three files a batch; the objects after the last batch."""
    path = fx.folder()
    changes = fx.fx_changes.select("seq", "idx", "chg", "time", "oid", "what", *MEMBERS)
    changes.repartition(6).write.parquet(f"{path}/changes")
    stream = fx.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", "3").parquet(f"{path}/changes")
    feed.fold_stream(stream, MEMBERS, f"{path}/checkpoint").awaitTermination()
    return shown(feed.folded(fx.spark, f"{path}/checkpoint"))


def _watched(fx):
    """Commits in files of no order, watched from commit 40 on; what is delivered is kept with the batch it came in."""
    path = fx.folder()
    commits = state.pack_log(fx.fx_txns, ["target", "op"]).select("seq", F.size("txns").alias("txns"))
    commits.repartition(6).write.parquet(f"{path}/log")
    stream = fx.spark.readStream.schema(commits.schema).option("maxFilesPerTrigger", "2").parquet(f"{path}/log")
    deliver = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
    feed.watch(stream, deliver, f"{path}/checkpoint", after=40).awaitTermination()
    return fx.spark.read.parquet(f"{path}/out").select("seq", F.col("txns").cast("long").alias("txns"))


query("sx_fold_stream", UP_TO_DATE)(_streamed)
query("sx_watch", "select seq, count(*) as txns from fx_txns where seq > 40 group by seq")(_watched)

# content

query("ct_params", "select l_orderkey, l_linenumber, coalesce(a % 2 = 0 and b % 2 = 0 and c % 2 = 0 and a between 64 and 1048576 and b between 256 and 4194304 and c between 1024 and 16777216 and a <= b and b <= c, false) as good from (select l_orderkey, l_linenumber, l_partkey * 7 as a, l_suppkey * 311 as b, cast(l_extendedprice * 10 as bigint) as c from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice) as l_extendedprice from lineitem))")(
    lambda fx: fx.lineitem.select("l_orderkey", "l_linenumber", chunking.sizes_fit(F.col("l_partkey") * 7, F.col("l_suppkey") * 311, F.floor("l_extendedprice") * 10).alias("good")))
#: Extents of five objects, those of every fifth document one after the other, and DuckDB's cut of them into leaves.
FIVE = """e as (select oid % 5 as o, row_number() over (partition by oid % 5 order by oid, pos) as rn, coalesce(cast('0x' || substr(s, 61, 4) as integer), 1) as tail, s, n, z from fx_extents),
  w as (select o, rn, cast(0 as integer) as leaf, 1 as n, tail from e where rn = 1
  union all select e.o, e.rn, case when w.n >= 1024 or (w.tail % 512 = 0 and w.n >= 256) then w.leaf + 1 else w.leaf end, case when w.n >= 1024 or (w.tail % 512 = 0 and w.n >= 256) then 1 else w.n + 1 end, e.tail from w join e on e.o = w.o and e.rn = w.rn + 1)"""
five = lambda fx: order.running(fx.fx_extents.select((F.col("oid") % 5).alias("o"), "oid", "pos", "s", "n", "z"), ["o"], ["oid", "pos"], {"rn": F.lit(1)}).select(F.col("o").alias("oid"), F.col("rn").alias("pos"), "s", "n", "z")
query("ct_manifest", f"with recursive {FIVE} select e.o as oid, e.rn as pos, w.leaf from w join e using (o, rn)")(lambda fx: log.leaves(five(fx)))
query("ct_manifest_tree", f"""with recursive {FIVE}, p as (select o, leaf, cast(sum(coalesce(e.n, e.z)) as bigint) as size, sha256('{{"kind":"leaf","extents":[' || string_agg(case when s is not null then '{{"s":"' || s || '","n":' || e.n || '}}' else '{{"z":' || e.z || '}}' end, ',' order by rn) || ']}}') as hash from w join e using (o, rn) group by 1, 2)
  select o as oid, cast(sum(size) as bigint) as size, sha256('{{"kind":"node","children":[' || string_agg('{{"page":"' || hash || '","size":' || size || '}}', ',' order by leaf) || ']}}') as root from p where o in (select o from e group by o having count(*) > 1024) group by o""")(lambda fx: log.manifests(five(fx))[0].select("oid", "size", "root"))
