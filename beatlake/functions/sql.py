"""For SQL users: P1-P9 and pitch as temporary functions, which Catalyst inlines, and the questions of a take as a table function.
All are SQL bodies; no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from beatlake.constants import SCALES
from beatlake.functions.keys import NOTE_SPELLINGS

_SPELLINGS = "map(" + ", ".join(f"'{k}', {v}" for k, v in NOTE_SPELLINGS.items()) + ")"
_STEPS = "map(" + ", ".join(f"'{k}', array({', '.join(map(str, v))})" for k, v in SCALES.items()) + ")"
_APART = "'^([a-g][#b]?) (\\\\S+)( .*)?$'"
_TOGETHER = "'^([a-g][#b]?)(m|min\\\\S*|minor|maj\\\\S*|major)?$'"
# Inside of a lambda no function of ours can be called, so these parts are put in as text.
_RELATIVE = "CASE WHEN {m} = 'minor' THEN 3 ELSE 0 END"
_LETTER, _OTHER = "CASE WHEN mode = 'minor' THEN 'A' ELSE 'B' END", "CASE WHEN mode = 'minor' THEN 'B' ELSE 'A' END"
_FIFTHS = f"abs(pmod(7 * (v_pc + {_RELATIVE.format(m='v_mode')}), 12) - pmod(7 * (b_pc + s + {_RELATIVE.format(m='b_mode')}), 12))"
_QUALITY = f"1 - least({_FIFTHS}, 12 - {_FIFTHS}) / 6D + CASE WHEN v_mode = b_mode THEN 0.08D ELSE 0D END - 0.11D * abs(s)"

# name(parameters) -> body; later ones use earlier ones
FUNCTIONS = {
    "transpose_pc(pc INT, n INT) RETURNS INT": "CAST(pmod(pc + n, 12) AS INT)",
    "family_root(pc INT, mode STRING) RETURNS INT": "CASE WHEN mode = 'minor' THEN CAST(pmod(pc + 3, 12) AS INT) ELSE CAST(pmod(pc, 12) AS INT) END",
    "camelot(pc INT, mode STRING) RETURNS STRING": "concat(CAST(pmod(7 * CASE WHEN mode = 'minor' THEN pmod(pc + 3, 12) ELSE pmod(pc, 12) END + 7, 12) + 1 AS STRING), CASE WHEN mode = 'minor' THEN 'A' ELSE 'B' END)",
    "circle_distance(a INT, b INT) RETURNS INT": "least(abs(pmod(7 * a, 12) - pmod(7 * b, 12)), 12 - abs(pmod(7 * a, 12) - pmod(7 * b, 12)))",
    "pitch_class(midi DOUBLE) RETURNS INT": "CAST(pmod(CAST(bround(midi) AS INT), 12) AS INT)",
    "midi_to_hz(midi DOUBLE) RETURNS DOUBLE": "440 * pow(2, (midi - 69) / 12)",
    "key_from_camelot(code STRING) RETURNS STRUCT<pc: INT, mode: STRING>": """CASE WHEN regexp_extract(code, '^(1[0-2]|[1-9])[AB]$', 1) <> '' THEN named_struct('pc', CAST(pmod((CAST(regexp_extract(code, '^(1[0-2]|[1-9])[AB]$', 1) AS INT) - 8) * 7
        + CASE WHEN right(code, 1) = 'A' THEN 9 ELSE 0 END, 12) AS INT), 'mode', CASE WHEN right(code, 1) = 'A' THEN 'minor' ELSE 'major' END) END""",
    "key_tag(tag STRING) RETURNS STRING": "trim(regexp_replace(replace(replace(lower(trim(tag)), '♯', '#'), '♭', 'b'), '[-_/\\\\s]+', ' '))",
    "normalise_key(tag STRING) RETURNS STRUCT<pc: INT, mode: STRING>": f"""coalesce(key_from_camelot(upper(replace(replace(replace(lower(trim(tag)), '♯', '#'), '♭', 'b'), ' ', ''))),
        CASE WHEN key_tag(tag) RLIKE {_APART} AND {_SPELLINGS}[regexp_extract(key_tag(tag), {_APART}, 1)] IS NOT NULL THEN named_struct('pc', {_SPELLINGS}[regexp_extract(key_tag(tag), {_APART}, 1)], 'mode', CASE WHEN regexp_extract(key_tag(tag), {_APART}, 2) = 'm' OR startswith(regexp_extract(key_tag(tag), {_APART}, 2), 'min') THEN 'minor' ELSE 'major' END)
        WHEN key_tag(tag) RLIKE {_TOGETHER} AND NOT key_tag(tag) RLIKE {_APART} AND {_SPELLINGS}[regexp_extract(key_tag(tag), {_TOGETHER}, 1)] IS NOT NULL THEN named_struct('pc', {_SPELLINGS}[regexp_extract(key_tag(tag), {_TOGETHER}, 1)], 'mode', CASE WHEN regexp_extract(key_tag(tag), {_TOGETHER}, 2) = 'm' OR startswith(regexp_extract(key_tag(tag), {_TOGETHER}, 2), 'min') THEN 'minor' ELSE 'major' END) END)""",
    "scale_pcs(pc INT, mode STRING) RETURNS ARRAY<INT>": f"transform(coalesce({_STEPS}[mode], {_STEPS}['major']), s -> CAST(pmod(s + pc, 12) AS INT))",
    "in_key(note INT, pc INT, mode STRING) RETURNS BOOLEAN": "array_contains(scale_pcs(pc, mode), CAST(pmod(note, 12) AS INT))",
    "best_shift(v_pc INT, v_mode STRING, b_pc INT, b_mode STRING, most INT) RETURNS STRUCT<shift: INT, quality: DOUBLE>": f"""transform(array(array_max(transform(sequence(-most, most), s -> named_struct('q', {_QUALITY}, 'n', -s)))),
        x -> named_struct('shift', -x.n, 'quality', least(greatest(x.q, 0D), 1D)))[0]""",
    "camelot_neighbours(code STRING) RETURNS ARRAY<STRING>": """array(code, concat(regexp_extract(code, '^[0-9]+', 0), CASE WHEN right(code, 1) = 'A' THEN 'B' ELSE 'A' END), concat(CAST(pmod(CAST(regexp_extract(code, '^[0-9]+', 0) AS INT), 12) + 1 AS STRING), right(code, 1)),
        concat(CAST(pmod(CAST(regexp_extract(code, '^[0-9]+', 0) AS INT) - 2, 12) + 1 AS STRING), right(code, 1)))""",
    "compatible_set(pc INT, mode STRING, most INT) RETURNS ARRAY<STRING>": f"array_distinct(flatten(transform(transform(sequence(-most, most), s -> CAST(pmod(7 * (pc + s + {_RELATIVE.format(m='mode')}) + 7, 12) + 1 AS INT)), n -> array(concat(n, {_LETTER}), concat(n, {_OTHER}), concat(CAST(pmod(n, 12) + 1 AS INT), {_LETTER}), concat(CAST(pmod(n - 2, 12) + 1 AS INT), {_LETTER})))))",
}
#: The questions of a take, as a table function.
QUESTIONS = """explode_questions(duration_s DOUBLE, voice STRING, noise STRING) RETURNS TABLE (severity STRING, question STRING)
RETURN SELECT x.severity, x.question FROM (SELECT explode(filter(array(
    CASE WHEN duration_s < 6 THEN named_struct('severity', 'block', 'question', 'length') END, CASE WHEN voice = 'no_voice' THEN named_struct('severity', 'block', 'question', 'voice') END,
    CASE WHEN noise = 'severe' THEN named_struct('severity', 'block', 'question', 'noise') WHEN noise = 'heavy' THEN named_struct('severity', 'warn', 'question', 'noise') END), x -> x IS NOT NULL)) AS x)"""


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql in this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {QUESTIONS}")
