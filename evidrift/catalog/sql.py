"""Pieces of DuckDB SQL that state the text rules of the queries."""

from __future__ import annotations

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
TOKEN_SET = f"list_distinct({TOKENS})"
NUMBERS = "list_distinct(regexp_extract_all({0}, '\\b\\d+(?:[.,]\\d+)?%?\\b'))"
NEGATED = "regexp_matches(lower({0}), '\\b(?:not|no|never|without|cannot|can''t)\\b')"
SENTENCES = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
CLAIM_TYPE = (
    "CASE WHEN regexp_matches({0}, '\\b\\d+(?:[.,]\\d+)?%?\\b') OR regexp_matches(lower({0}), 'amount|price|cost|months|years') THEN 'numeric' WHEN regexp_matches(lower({0}), 'before|after|during|effective|date') THEN 'temporal' "
    "WHEN regexp_matches(lower({0}), 'more than|less than|compared|versus') THEN 'comparative' WHEN regexp_matches(lower({0}), 'should|recommend|must consider') THEN 'recommendation' "
    "WHEN regexp_matches(lower({0}), 'uncertain|not enough|limitation|cannot verify') THEN 'limitation' ELSE 'factual' END"
)
LEDGER_TYPE = (
    "CASE WHEN regexp_matches(lower({0}), '%|amount|price|cost|months|years') THEN 'numeric' WHEN regexp_matches(lower({0}), 'before|after|during|date|effective') THEN 'temporal' "
    "WHEN regexp_matches(lower({0}), 'more than|less than|compared|versus') THEN 'comparative' ELSE 'factual' END"
)
MATERIAL = "(regexp_matches({0}, '\\b\\d+(?:[.,]\\d+)?%?\\b') OR regexp_matches(lower({0}), 'not|no |shall|liable|term|date'))"
SHARE = "coalesce(len(list_intersect({whole}, {part})) / nullif(len({whole}), 0), 0)"
LIST = "list_filter(list_transform({0}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
NORMAL = "array_to_string(" + LIST.format("string_split(replace({0}, chr(0), ''), chr(10))") + ", chr(10) || chr(10))"
UUID = "(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (CAST(('0x'||substr(h,17,1)) AS INTEGER) % 4) + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})) AS h))"


def truncated(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN regexp_replace(substr({text}, 1, {most - 3}), '\\s+$', '') || '...' ELSE {text} END"
