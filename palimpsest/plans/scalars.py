"""Scalar functions, each with the SQL that says the same, and sums whose SQL goes byte by byte."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import checksums, chunking, text
from palimpsest.plans.registry import query

text_bytes = lambda c: F.encode(c, "UTF-8")

DOC = """concat('{"a": [', cast(event_id as string), ', ', cast(event_id * 2 as string), '], "s": "', event_type, '", "props": ', props, '}')"""
query("fn_json_path", "select event_id, cast(event_id * 2 as varchar) as last, '2' as n, cast(length(event_type) as varchar) as chars, json_extract_string(props, '$.k') as k, 'nowhere' as beyond from events")(
    lambda fx: fx.events.select("event_id", F.expr(DOC).alias("doc")).select(
        "event_id", text.json_path("$.a[-1]")("doc").alias("last"), text.json_path("$.a.length")("doc").alias("n"), text.json_path("$.s.length")("doc").alias("chars"), text.json_path("$['props'].k")("doc").alias("k"),
        F.coalesce(text.json_path("$.a[-3]")("doc"), F.lit("nowhere")).alias("beyond")))
query("fn_xml_path", "select event_id, event_type || ' ' || event_id || '|' || user_id as found from events")(
    lambda fx: fx.events.select("event_id", F.array_join(text.xml_path("r/i")(F.expr("concat('<r xmlns=\"urn:x\"><i><b>', event_type, '</b> ', cast(event_id as string), '</i><j>no</j><i>', cast(user_id as string), '</i></r>')")), "|").alias("found")))
query("fn_http_date", "select event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') as http, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso from events")(lambda fx: fx.events.select("event_id", text.http_date(F.col("ts")).alias("http"), text.iso_millis(F.col("ts")).alias("iso")))
query("fn_at", "select event_id, case event_id % 4 when 0 then strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%fZ') when 1 then strftime(date_trunc('second', ts) - interval '2' hour, '%Y-%m-%dT%H:%M:%S.%fZ') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') else 'invalid' end as at from events")(
    lambda fx: fx.events.select("event_id", F.expr("""case event_id % 4 when 0 then cast(unix_timestamp(to_timestamp(concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'Z'), "yyyy-MM-dd HH:mm:ssX")) as string) when 1 then concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
        when 2 then concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z') else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") end""").alias("given")).select("event_id", F.coalesce(text.instant(F.col("given")), F.lit("invalid")).alias("at")))
query("fn_math", "select o_orderkey, coalesce(cast(case when o_orderkey <= 700 then 18446744073709550915 + o_orderkey end as varchar), 'overflow') as total, greatest(5242880, (o_orderkey * 1000000007 + 9999) // 10000) as part, format('{:,}', o_orderkey * 1234567) as shown from orders")(
    lambda fx: fx.orders.select("o_orderkey", F.coalesce(text.checked_add(F.lit(str(text.LARGEST - 700)).cast("decimal(20, 0)"), F.col("o_orderkey")).cast("string"), F.lit("overflow")).alias("total"),
                                text.part_size(F.col("o_orderkey") * 1_000_000_007, 5 << 20).alias("part"), text.thousands(F.col("o_orderkey") * 1_234_567).alias("shown")))
query("fn_seeded", "select item_id, substr(sha256(unhex(concat(hex(encode('seeded')), lpad(to_hex(item_id), 16, '0'), lpad('0', 16, '0')))) || sha256(unhex(concat(hex(encode('seeded')), lpad(to_hex(item_id), 16, '0'), lpad('1', 16, '0')))) || sha256(unhex(concat(hex(encode('seeded')), lpad(to_hex(item_id), 16, '0'), lpad('2', 16, '0')))), 1, cast(2 * (item_id % 96) as int)) as bytes from benchmark")(
    lambda fx: fx.benchmark.select("item_id", text.seeded_hex("seeded", F.col("item_id"), F.col("item_id") % 96).alias("bytes")))
query("fn_nfc", "select item_id, nfc_normalize(concat(text, 'e', chr(769), 'A', chr(778))) as text from benchmark")(lambda fx: fx.benchmark.select("item_id", checksums.nfc(F.concat("text", F.lit("e\u0301A\u030a"))).alias("text")))


def _crc_sql(kind: str, polynomial: int, bits: int) -> str:
    """DuckDB: the sum over each item's bytes, one more byte of all items a step, by a table that SQL builds from the polynomial."""
    inner = f"(select i, i::{kind} as x0 from (select unnest(generate_series(0, 255)) as i))"
    for k in range(8):
        inner = f"(select i, case when x{k} & 1 = 1 then xor(x{k} >> 1, {polynomial}::{kind}) else x{k} >> 1 end as x{k + 1} from {inner})"
    last = (1 << bits) - 1
    return f"""with recursive tbl as (select list(x8 order by i) as entries from {inner}), b as (select item_id, hex(encode(text)) as h, strlen(text) as n from benchmark),
      w as (select item_id, h, n, 0 as i, {last}::{kind} as value from b
      union all select item_id, h, n, i + 1, xor(entries[cast(xor(value & 255, cast(('0x' || substr(h, 2 * i + 1, 2)) as {kind})) as int) + 1], value >> 8) from w, tbl where i < n)
      select item_id, xor(value, {last}::{kind}) as total from w where i = n"""


query("ct_crc_pieces", f"select item_id, [total] as sums from ({_crc_sql('bigint', checksums.CRC32C, 32)})")(lambda fx: fx.benchmark.select("item_id", checksums.crc32c_pieces(text_bytes("text")).alias("sums")))
query("ct_crc64", f"select item_id, lpad(lower(to_hex(total)), 16, '0') as total from ({_crc_sql('ubigint', checksums.CRC64, 64)})")(lambda fx: fx.benchmark.select("item_id", checksums.crc64nvme(text_bytes("text")).alias("total")))
query("ct_checksums_udf", f"select c.item_id, total as crc32c, sha1(text) as sha1, sha256(text) as sha256 from ({_crc_sql('bigint', checksums.CRC32C, 32)}) c join benchmark using (item_id)")(
    lambda fx: fx.benchmark.select("item_id", *[c.alias(n) for n, c in checksums.checksums(text_bytes("text")).items() if n in ("crc32c", "sha1", "sha256")]))


def _fastcdc_sql(least: int, normal: int, most: int) -> str:
    """DuckDB: the chunks of every benchmark text, two bytes of each a step; a row with a length ends a chunk."""
    strict, loose = chunking._masks(normal)
    byte = "entries[coalesce(try_cast('0x' || substr(h, 2 * (start + 2 * i + {k}) + 1, 2) as int), 0) + 1]::hugeint"
    wrap = "18446744073709551616::hugeint"
    return f"""with recursive gear as (select list(('0x' || substr(md5(unhex(repeat(printf('%02x', i), 64))), 1, 16))::ubigint order by i) as entries from (select unnest(generate_series(0, 255)) as i)),
      b as (select item_id, hex(encode(text)) as h, strlen(text) as n from benchmark where strlen(text) > 0),
      w as (select item_id, h, n, 0 as start, {least // 2} as i, 0::hugeint as value, cast(null as int) as size from b
      union all select item_id, h, n, case when size is null then start else start + size end, case when size is null then i + 1 else {least // 2} end, case when size is null then v2 else 0 end,
          case when size is not null then null when room <= {least} or i >= room // 2 then room when v1 & (mask * 2) = 0 then 2 * i when v2 & mask = 0 then 2 * i + 1 end
        from (select *, (v1 + {byte.format(k=1)}) % {wrap} as v2 from (
          select *, least(n - start, {most}) as room, case when i < least({normal}, n - start) // 2 then {strict}::hugeint else {loose}::hugeint end as mask, (value * 4 + 2 * {byte.format(k=0)}) % {wrap} as v1
          from w, gear where size is null or start + size < n)))
      select item_id, row_number() over (partition by item_id order by start) - 1 as pos, cast(size as bigint) as n, sha256(unhex(substr(h, 2 * start + 1, 2 * size))) as hash from w where size is not null"""


query("ct_fastcdc", _fastcdc_sql(64, 256, 1024))(lambda fx: chunking.shards(fx.benchmark.select("item_id", text_bytes("text").alias("bytes")), "item_id", "bytes", 64, 256, 1024).select("item_id", F.col("pos").cast("long").alias("pos"), "n", "hash"))
