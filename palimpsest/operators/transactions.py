"""Requests planned as transactions, rows of changes, and what those do to a state: checked, applied, listed.

A state is rows (oid, parent, name, kind, size, etag) of the objects in the namespace. A change is a row (seq, idx, chg,
time, oid, what, parent, name, kind, size, etag, recursive), where what is create, set, move or remove, and null members
stay as they are. Requests of one call are planned on the state given, each as one transaction with its number as seq;
what two of them both need, such as a missing folder, the first one makes. An object made here is named after its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators import planners, tree
from palimpsest.operators.order import running
from palimpsest.operators.state import CHANGE, fold
from palimpsest.session import kept

ROOT = "root"
MEMBERS = ["parent", "name", "kind", "size", "etag"]
COLUMNS = {"seq": "bigint", "idx": "int", "chg": "int", "time": "timestamp", "oid": "string", "what": "string", "parent": "string", "name": "string", "kind": "string", "size": "bigint", "etag": "string", "recursive": "boolean"}


def changes_of(txns: DataFrame) -> DataFrame:
    """The changes of transactions (seq, idx, time, target, op, changes: array), as the log's files nest them, in their order.

    A change that names none of the four kinds, or two, has a null `what`.
    """
    rows = txns.select("seq", "idx", "time", "target", "op", F.posexplode("changes").alias("chg", "c"))
    given = [F.when(F.col(f"c.{k}").isNotNull(), F.lit(k)) for k in ("create", "set", "move", "remove")]
    one = F.size(F.array_compact(F.array(*given))) == 1
    pick = lambda name, *kinds: F.coalesce(*[F.col(f"c.{k}.{name}") for k in kinds])
    return rows.select(
        "seq", F.col("idx").cast("int").alias("idx"), F.col("chg").cast("int").alias("chg"), "time", pick("oid", "create", "set", "move", "remove").alias("oid"), F.when(one, F.coalesce(*given)).alias("what"),
        pick("parent", "create", "move").alias("parent"), pick("name", "create", "move").alias("name"), pick("kind", "create").alias("kind"), pick("size", "set").alias("size"), pick("etag", "set").alias("etag"), pick("recursive", "remove").alias("recursive"), "target", "op")


def _change(rows: DataFrame, what: str, chg: Column, **members: Column | str) -> DataFrame:
    """Changes of one kind from rows with req and what the members say."""
    given = {"seq": F.col("req"), "idx": F.lit(0), "chg": chg, "time": F.lit(None), "what": F.lit(what)} | {k: F.col(v) if isinstance(v, str) else v for k, v in members.items()}
    return rows.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in COLUMNS.items()])


def as_changes(state: DataFrame, seq: int = 0) -> DataFrame:
    """A state as the changes that make it."""
    return _change(state.withColumn("req", F.lit(seq)), "create", F.lit(0), **{m: m for m in ["oid", *MEMBERS]})


def apply(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes: who is in the namespace, where, and with what; removed objects are not in it."""
    objects = fold(as_changes(state).unionByName(changes.select(*COLUMNS)), MEMBERS)
    return objects.where("linked = 'create'").select("oid", *MEMBERS)


def state_of(changes: DataFrame, at: Column | None = None) -> DataFrame:
    """The state that a drive's changes lead to, or those of them up to a version or instant."""
    return fold(changes, MEMBERS, at).where("linked = 'create'").select("oid", *MEMBERS)


def merge(objects: DataFrame, changes: DataFrame, members: list[str]) -> DataFrame:
    """Objects as fold() gives them, brought up to date with later changes: what a reader does with new commits.

    The objects count as changes at their own heads, so changes they hold already alter nothing.
    """
    names = [*CHANGE, "time", "oid", "what", *members]
    held = objects.select(F.col("head.seq").alias("seq"), F.col("head.idx").alias("idx"), F.lit(-1).alias("chg"), "time", "oid", F.col("linked").alias("what"), *members)
    return fold(held.unionByName(changes.select(*names)), members)


def keyed(state: DataFrame) -> DataFrame:
    """The state's listing: key, depth and members of every object the root reaches."""
    state = kept(state)
    found = tree.keys(state.select("parent", "name", "oid", "kind"), ROOT)
    return kept(found.join(state.select("oid", "size", "etag"), "oid"))


def made(key: Column) -> Column:
    """The name of an object that a request makes at a key."""
    return F.concat(F.lit("made:"), key)


def _parent_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, "/$", ""), "[^/]*$", "")


def _folders(wanted: DataFrame, listed: DataFrame) -> tuple[DataFrame, Column]:
    """Creations of the folders that wanted (req, key) lack, each by the first request, and the parent's oid as a column
    over rows joined to `listed` as (at, at_oid) by their parent's key."""
    first = tree.ancestor_keys(wanted, "key", "req").groupBy("folder").agg(F.min("req").alias("req"))
    missing = first.join(listed.select(F.col("key").alias("folder")), "folder", "left_anti")
    rows = missing.withColumn("above", _parent_key(F.col("folder"))).join(listed.select(F.col("key").alias("above"), F.col("oid").alias("above_oid")), "above", "left")
    parent = F.when(F.col("above") == "", F.lit(ROOT)).otherwise(F.coalesce("above_oid", made(F.col("above"))))
    name = F.regexp_extract("folder", "([^/]*)/$", 1)
    made_ = _change(rows, "create", F.size(F.split("folder", "/")), oid=made(F.col("folder")), parent=parent, name=name, kind=F.lit("folder"), size=F.lit(0))
    return kept(made_), F.when(F.col("at") == "", F.lit(ROOT)).otherwise(F.coalesce("at_oid", made(F.col("at"))))


def _placed(rows: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """Rows with at, the key of the folder their key is in, and at_oid where it exists."""
    return rows.withColumn("at", _parent_key(F.col(key))).join(listed.select(F.col("key").alias("at"), F.col("oid").alias("at_oid")), "at", "left")


def put(asked: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes (req, key, outcome) and changes of puts (req, key, size, etag): missing folders, the object, its content.

    Conflicts change nothing. Of several puts of one new key the first creates it.
    """
    outcomes = kept(asked.join(planners.put(asked.select("key").distinct(), listed), "key").select("req", "key", "outcome", "size", "etag"))
    good = outcomes.where("outcome <> 'conflict'")
    inside = F.when(F.col("key").endswith("/"), F.concat("key", F.lit("-"))).otherwise(F.col("key"))  # a folder asked for is one to make
    folders, parent = _folders(good.select("req", inside.alias("key")), listed)
    rows = kept(_placed(good, listed).join(listed.select("key", F.col("oid").alias("there")), "key", "left"))
    folder = F.col("key").endswith("/")
    oid = F.coalesce("there", made(F.col("key")))
    name = F.regexp_extract("key", "([^/]+)/?$", 1)
    first = F.row_number().over(Window.partitionBy("key").orderBy("req")) == 1
    new = rows.where("there is null").withColumn("first", first).where("first").join(folders.select(F.col("oid").alias("made")), made(F.col("key")) == F.col("made"), "left_anti")
    created = _change(new, "create", F.lit(1 << 20), oid=oid, parent=parent, name=name, kind=F.when(folder, "folder").otherwise("file"))
    filled = _change(rows, "set", F.lit((1 << 20) + 1), oid=oid, size="size", etag="etag")
    return outcomes.select("req", "key", "outcome"), folders.unionByName(created).unionByName(filled)


def write(asked: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes and changes of in-place edits (req, key, size, etag): one set on a file, a put where nothing is."""
    outcomes = kept(asked.join(planners.edit_target(asked.select("key").distinct(), listed), "key").select("req", "key", "outcome", "size", "etag"))
    there = outcomes.where("outcome = 'write'").join(listed.select("key", "oid"), "key")
    made_ = put(outcomes.where("outcome = 'create'").select("req", "key", "size", "etag"), listed)[1]
    return outcomes.select("req", "key", "outcome"), _change(there, "set", F.lit(0), oid="oid", size="size", etag="etag").unionByName(made_)


def delete(asked: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes and changes of deletes (req, key): a missing key, the root and a folder with children stay as they are."""
    entries = listed.select("parent", "name", "oid", "kind")
    outcomes = asked.join(planners.delete(asked.select("key").distinct(), listed, entries), "key").select("req", "key", "outcome")
    first = outcomes.where("outcome = 'removed'").groupBy("key").agg(F.min("req").alias("req"))
    return outcomes, _change(first.join(listed.select("key", "oid"), "key"), "remove", F.lit(0), oid="oid", recursive=F.lit(False))


def rename(asked: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes and changes of renames (req, source, target); what is below a folder follows it without a change."""
    outcomes = kept(asked.join(planners.rename(asked.select("source", "target").distinct(), listed), ["source", "target"]).select("req", "source", "target", "outcome"))
    good = outcomes.where("outcome in ('moved', 'replaced')")
    folders, parent = _folders(good.select("req", F.col("target").alias("key")), listed)
    rows = _placed(good, listed, "target").join(listed.select(F.col("key").alias("source"), F.col("oid").alias("oid")), "source").join(listed.select(F.col("key").alias("target"), F.col("oid").alias("there")), "target", "left")
    gone = _change(rows.where("there is not null"), "remove", F.lit(1 << 20), oid="there", recursive=F.lit(False))
    moved = _change(rows, "move", F.lit((1 << 20) + 1), oid="oid", parent=parent, name=F.regexp_extract("target", "([^/]+)/?$", 1))
    return outcomes, folders.unionByName(gone).unionByName(moved)


def restore_subtree(then: DataFrame, now: DataFrame, folder: str, req: int = 1) -> DataFrame:
    """The changes that bring all below a folder's oid back to what it was; then, now: states.

    What is in the folder now is taken out, children first; what was in it is put back, parents first: moved if it is
    elsewhere now, else created anew. Content that differs is set.
    """
    entries = lambda state: state.select("parent", "name", "oid", "kind")
    inside_now = tree.descendants(entries(now), folder).where("depth > 0").select("oid", "depth")
    inside_then = tree.descendants(entries(then), folder).where("depth > 0").select("oid", "depth").join(then, "oid")
    elsewhere = now.select("oid", F.col("size").alias("size_now"), F.col("etag").alias("etag_now")).join(inside_now.select("oid", F.lit(True).alias("taken")), "oid", "left")
    rows = inside_then.join(elsewhere, "oid", "left").withColumn("req", F.lit(req))
    out = _change(inside_now.withColumn("req", F.lit(req)), "remove", F.lit(1 << 20) - F.col("depth"), oid="oid", recursive=F.lit(True))
    back = F.lit(1 << 20) + 2 * F.col("depth")
    place = {"oid": "oid", "parent": "parent", "name": "name"}
    there = F.col("etag_now").isNotNull() & F.col("taken").isNull()
    moved, created = _change(rows.where(there), "move", back, **place), _change(rows.where(~there), "create", back, kind="kind", **place)
    content = _change(rows.where(~F.col("etag").eqNullSafe(F.col("etag_now"))), "set", back + 1, oid="oid", size="size", etag="etag")
    return out.unionByName(moved).unionByName(created).unionByName(content)


def faults(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """seq, idx, chg, oid, fault: changes that do not apply to what is there by then, and why; state: what was there first.

    unknown change, root, unknown object, unknown folder, not a folder, already linked, not linked, kind, name taken,
    folder not empty, inside itself (its own parent); the first that holds. Each change is looked at in the light of all before it, as if
    those had applied. Each kind of fault is found by one sort by object, folder or name; what is in a folder is summed
    up by ranges, so a folder with very many changes is not one task. A folder moved
    below itself is found by loops(), on the state that the changes lead to.
    """
    rows = changes.select(*COLUMNS)
    if state is not None:
        rows = as_changes(state, -1).unionByName(rows)
    order = list(CHANGE)
    by_object = Window.partitionBy("oid").orderBy(*order)
    before = by_object.rowsBetween(Window.unboundedPreceding, -1)
    link = F.when(F.col("what").isin("create", "remove"), F.col("what"))
    rows = rows.withColumns({
        "was": F.last(link, ignorenulls=True).over(before), "kind_was": F.first("kind", ignorenulls=True).over(before),
        "parent_was": F.last("parent", ignorenulls=True).over(before), "name_was": F.last("name", ignorenulls=True).over(before),
    })
    is_link = F.col("what").isin("create", "move")

    # folders that parents name: the first creation of each object, and its kind
    first = rows.where("what = 'create'").groupBy(F.col("oid").alias("parent")).agg(F.min(F.struct(*order)).alias("made"), F.min_by("kind", F.struct(*order)).alias("parent_kind"))
    rows = rows.join(first, "parent", "left")
    later = F.col("made").isNull() | (F.col("made") > F.struct(*order))

    # names: who holds a name of a folder just before
    takes = rows.where(is_link).select("parent", "name", *order, "oid", F.lit(True).alias("takes"))
    leaves = rows.where(F.col("what").isin("move", "remove") & (F.col("was") == "create")).select(F.col("parent_was").alias("parent"), F.col("name_was").alias("name"), *order, "oid", F.lit(False).alias("takes"))
    w = Window.partitionBy("parent", "name").orderBy(*order, "takes").rowsBetween(Window.unboundedPreceding, -1)
    events = takes.unionByName(leaves).withColumn("holder", F.last(F.struct("oid", "takes")).over(w))
    taken = events.where(F.col("takes") & F.col("holder.takes") & (F.col("holder.oid") != F.col("oid"))).select(*order, "oid", F.lit(True).alias("taken"))

    # children: how many a folder has when it is removed
    steps = takes.select("parent", *order, F.lit(1).alias("step")).unionByName(leaves.select("parent", *order, F.lit(-1).alias("step")))
    asks = rows.where("what = 'remove' and not coalesce(recursive, false)").select(F.col("oid").alias("parent"), *order, F.lit(0).alias("step"))
    counted = running(steps.unionByName(asks), ["parent"], [*order, "step"], {"children": F.col("step")})
    full = counted.where("step = 0 and children > 0").select(F.col("parent").alias("oid"), *order, F.lit(True).alias("full"))

    rows = rows.join(taken, [*order, "oid"], "left").join(full, [*order, "oid"], "left").where(F.col("seq") >= 0)
    fault = (
        F.when(F.col("what").isNull(), "unknown change").when(F.col("oid") == ROOT, "root")
        .when((F.col("what") != "create") & F.col("was").isNull(), "unknown object")
        .when((F.col("what") == "create") & (F.col("was") == "create"), "already linked")
        .when(F.col("what").isin("move", "remove") & (F.col("was") == "remove"), "not linked")
        .when((F.col("what") == "create") & F.col("kind_was").isNotNull() & F.col("kind").isNotNull() & (F.col("kind") != F.col("kind_was")), "kind")
        .when(is_link & (F.col("parent") != ROOT) & later, "unknown folder").when(is_link & (F.col("parent") != ROOT) & (F.col("parent_kind") != "folder"), "not a folder")
        .when(is_link & (F.col("parent") == F.col("oid")), "inside itself").when(F.col("taken"), "name taken").when(F.col("full"), "folder not empty")
    )
    return rows.select(*order, "oid", fault.alias("fault")).where("fault is not null")


def loops(state: DataFrame) -> DataFrame:
    """oid of objects in the namespace that the root does not reach, for a folder above them was moved into itself or is gone."""
    return state.join(tree.keys(state.select("parent", "name", "oid", "kind"), ROOT).select("oid"), "oid", "left_anti").select("oid")
