"""The engine's functions under SQL names: SQL-defined, so that a query that calls them is planned like any other expression and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .answers import ASSIGNED, LEADING
from .registers import SCRATCHPAD
from .text import OPERATORS

_INTENT = r"(?i)<reg:intent>\s*(?:∴\s*(?:ans\s*=\s*)?)?([^<]+?)\s*</reg:intent>"
_NUMBER_BEHIND = r"(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)?(-?\d+(?:\.\d+)?)"
_SAME = r"verify\(\s*(-?\d+(?:\.\d+)?)\s*==\s*\1\s*\)\s*→\s*✓"


def _raw(pattern: str) -> str:
    """A pattern as a raw literal; patterns here hold one kind of quotes at most."""
    return f'r"{pattern}"' if "'" in pattern else f"r'{pattern}'"


#: Name, parameters, result and body of each function; later ones may call earlier ones.
FUNCTIONS = (
    ("strip_blanks", "t STRING", "STRING", r"regexp_replace(t, r'^\s+|\s+$', '')"),
    ("first_match", "t STRING, pattern STRING, part INT", "STRING", "nullif(regexp_extract(t, pattern, part), '')"),
    ("behind_last", "t STRING, mark STRING", "STRING", "CASE WHEN contains(t, mark) THEN substring_index(t, mark, -1) ELSE t END"),
    (
        "estimate_tokens", "t STRING", "INT",
        rf"""aggregate(filter(split(t, r'\s+'), w -> w <> ''), 0,
          (s, w) -> s + length(w) - length(translate(w, '{OPERATORS}', '')) + greatest(1, cast(floor(length(translate(w, '{OPERATORS}', '')) / 4) as int)))""",
    ),
    ("compression_ratio", "english BIGINT, symbolic BIGINT", "DOUBLE", "CASE WHEN english = 0 THEN 0.0D ELSE greatest(0.0D, 1.0D - symbolic / cast(english as double)) END"),
    ("register_body", "t STRING, name STRING", "STRING", "nullif(strip_blanks(regexp_extract(t, concat('(?s)<reg:', name, '>(.*?)</reg:', name, '>'), 1)), '')"),
    ("scratchpad_body", "t STRING", "STRING", f"nullif(strip_blanks(regexp_extract(t, {_raw(SCRATCHPAD)}, 3)), '')"),
    ("tag_body", "t STRING, tag STRING", "STRING", r"strip_blanks(first_match(t, concat('(?i)<', tag, r'>\s*([^<]+?)\s*</', tag, '>'), 1))"),
    (
        "parse_registers", "t STRING", "STRUCT<register_type: STRING, plan: STRING, deduction: STRING, verification: STRING, scratchpad: STRING, bypass: STRING, intent: STRING>",
        """named_struct(
          'register_type', CASE WHEN scratchpad_body(t) IS NOT NULL THEN 'scratchpad' WHEN register_body(t, 'bypass') IS NOT NULL THEN 'bypass'
            WHEN register_body(t, 'intent') IS NOT NULL AND register_body(t, 'deduce') IS NULL THEN 'intent'
            WHEN coalesce(register_body(t, 'plan'), register_body(t, 'deduce'), register_body(t, 'verify')) IS NOT NULL THEN 'deduce' ELSE 'standard' END,
          'plan', register_body(t, 'plan'), 'deduction', register_body(t, 'deduce'), 'verification', register_body(t, 'verify'), 'scratchpad', scratchpad_body(t),
          'bypass', register_body(t, 'bypass'), 'intent', register_body(t, 'intent'))""",
    ),
    (
        "answer_by_grammar", "t STRING", "STRING",
        rf"""CASE WHEN rlike(t, '(?s)<ans>(.*?)</ans>') THEN strip_blanks(regexp_extract(t, '(?s)<ans>(.*?)</ans>', 1))
          WHEN rlike(t, '(?s)<reg:bypass>(.*?)</reg:bypass>') THEN strip_blanks(regexp_extract(t, '(?s)<reg:bypass>(.*?)</reg:bypass>', 1))
          ELSE coalesce(first_match(t, {_raw(ASSIGNED)}, 1), first_match(behind_last(strip_blanks(behind_last(strip_blanks(t), '</think>')), '</reg:deduce>'), {_raw(ASSIGNED)}, 1),
            first_match(strip_blanks(behind_last(strip_blanks(t), '</think>')), {_raw(LEADING)}, 1)) END""",
    ),
    (
        "answer_by_any", "t STRING", "STRING",
        rf"""coalesce(tag_body(t, 'ans'), tag_body(t, 'reg:bypass'), strip_blanks(first_match(t, {_raw(_INTENT)}, 1)), first_match(t, {_raw(_NUMBER_BEHIND)}, 1), first_match(t, {_raw(_SAME)}, 1),
          get(reverse(regexp_extract_all(behind_last(t, '</think>'), r'[-+]?\d+', 0)), 0))""",
    ),
    (
        "extract_answer", "t STRING, policy STRING", "STRING",
        "CASE policy WHEN 'grammar' THEN answer_by_grammar(t) WHEN 'lenient' THEN answer_by_any(t) WHEN 'tags' THEN coalesce(tag_body(t, 'ans'), tag_body(t, 'reg:bypass')) ELSE raise_error(concat('no such policy: ', policy)) END",
    ),
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define all functions in the session; returns their names.  Defining them again changes nothing."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
