"""The subpackage's queries by name, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from palimpsest.llm import bpe, decontamination, langid, quality, secrets, sharding, simhash, substrings, tokencounts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_bpe": bpe.op2_bpe,
        "op3_secrets": secrets.op3_secrets,
        "op4_substrings": substrings.op4_substrings,
        "op5_token_counts": tokencounts.op5_token_counts,
        "op6_quality": quality.op6_quality,
        "op7_simhash": simhash.op7_simhash,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language": langid.op9_language,
        "op10_sharding": sharding.op10_sharding,
        "pipeline": corpus_pipeline.run,
    }


#: Words of every document, and every window of n of them that occurs more than once (where: in the corpus or the text).
_WORDS = r"""w as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents)"""
_STARTS = "select r, i, array_to_string(words[i : i + {n} - 1], ' ') as win from (select r, words, unnest(generate_series(1, len(words) - {n} + 1)) as i from w)"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substrings": f"""with {_WORDS}, s as ({_STARTS.format(n=substrings.WINDOW)}), again as (select win from s group by win having count(*) > 1),
            gone as (select distinct r, i + k as i from s join again using (win), (select unnest(generate_series(0, {substrings.WINDOW} - 1)) as k)),
            each_word as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from w),
            kept as (select r, string_agg(word, ' ' order by i) as kept, count(*) as n from each_word anti join gone using (r, i) group by r)
            select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (r)""",
        "op6_quality": f"""with {_WORDS}, s as ({_STARTS.format(n=quality.REPEAT_WORDS)}), again as (select r, win from s group by r, win having count(*) > 1),
            repeated as (select r, count(*) as n from (select distinct r, i + k as i from s join again using (r, win), (select unnest(generate_series(0, {quality.REPEAT_WORDS} - 1)) as k)) group by r),
            long as (select distinct r from ({_STARTS.format(n=quality.MOST_IN_ONE + 1)}) group by r, win having count(*) > 1),
            lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
            m as (select w.r, doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words, long.r is null as short
              from w left join lines on lines.r = w.r left join repeated on repeated.r = w.r left join long on long.r = w.r)
            select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_COVERED} * n_words as base_failed,
              not (n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_COVERED} * n_words) and short as kept from m""",
    }
