"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .encode import p6_ids
from .formatting_duplicates import PART_NAMES, p1_found, p1_records
from .language_id import p4_found, p4_segments
from .leakage import WORDS, p3_found
from .mixture import p7_exact_mixed, p7_exact_shares, p7_mixed, p7_shares
from .sentences import p8_found
from .source_files import p5_files, p5_found
from .token_budget import p2_snippet_tokens, p2_token_budget


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_records, p2_token_budget, p2_snippet_tokens, p3_found, p4_found, p4_segments, p5_found, p5_files, p6_ids, p7_mixed, p7_shares, p7_exact_mixed, p7_exact_shares, p8_found)}


_SQUASHED = r"lower(upper(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g')))"
_NAME = r"(?i)(^|[;|,\n{])[^\p{L}\p{N}]*(" + "|".join(PART_NAMES) + r")[^\p{L}\p{N}:=;|\n]*[:=]"
#: One row for each row_id with its record, as the rows are compared by p1_found.
_RECORDS = f"""
    v AS (SELECT row_id, unnest([sentence, text]) AS v FROM download_twi WHERE row_id IS NOT NULL),
    m AS (SELECT row_id, v, regexp_replace(v, '{_NAME}', chr(1) || '\\2' || chr(2), 'g') AS m FROM v WHERE regexp_matches(v, '[\\p{{L}}\\p{{N}}]')),
    c AS (SELECT row_id, CASE WHEN m LIKE chr(1) || '%' THEN chr(1) || array_to_string(list_sort(list_transform(list_filter(string_split(m, chr(1)), lambda p: p <> ''),
        lambda p: {_SQUASHED.format("split_part(p, chr(2), 1)")} || chr(2) || {_SQUASHED.format("split_part(p, chr(2), -1)")})), chr(1)) ELSE {_SQUASHED.format("v")} END AS c FROM m),
    r AS (SELECT row_id, array_to_string(list_sort(list_distinct(list(c))), chr(3)) AS record FROM c GROUP BY row_id)"""


def _runs(table: str, key: str, text: str) -> str:
    """The runs of ten words of each text, with their ids, as p3_found compares them."""
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i:i + {WORDS - 1}], ' ') AS run FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM
        (SELECT DISTINCT {key}, regexp_extract_all(lower(replace(replace({text}, '\\n', ' '), '\\t', ' ')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL)))"""


def oracle_sql() -> dict[str, str]:
    """The rest needs a tokenizer, a model or a lexer and is tested against brute force and marked cases."""
    return {
        "p1_found": f"WITH {_RECORDS}, g AS (SELECT record, min(row_id) AS first_id FROM r GROUP BY record) SELECT first_id, row_id AS copy_id FROM r JOIN g USING (record) WHERE row_id <> first_id",
        "p1_records": f"WITH {_RECORDS} SELECT min(row_id) AS first_id, count(*)::BIGINT AS copies FROM r GROUP BY record",
        "p3_found": f"SELECT DISTINCT file_id, sample_id FROM {_runs('download_code', 'file_id', 'content')} JOIN {_runs('generation_sample', 'sample_id', 'prompt')} USING (run)",
    }
