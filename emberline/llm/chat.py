"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

DataFrame functions only. A layout is the set of its nested field paths; the hash of that set
(its fingerprint) selects the mapping that turns a record into ``turns``, an array of
(role, text). Turns are then written with one template whose control strings can't occur
inside a text, since escapes break them up reversibly, and can be read back.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import pick
from ._text import blocks_sql, chunks_sql, cut_sql

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: Control strings that are broken up by a backslash after their first character.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_TURNS = "array<struct<role:string,text:string>>"

#: Layouts: field paths, and the SQL for their turns.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): "transform(messages, m -> struct(m.role as role, m.content as text))",
    ("conversations[].from", "conversations[].value"): "transform(conversations, m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))",
    ("turns[].role", "turns[].text"): "transform(turns, m -> struct(m.role as role, m.text as text))",
    ("prompt", "response"): "array(struct('user' as role, prompt as text), struct('assistant' as role, response as text))",
    ("completion", "prompt"): "array(struct('user' as role, prompt as text), struct('assistant' as role, completion as text))",
    ("answer", "question"): "array(struct('user' as role, question as text), struct('assistant' as role, answer as text))",
    ("instruction", "output"): "array(struct('user' as role, instruction as text), struct('assistant' as role, output as text))",
    ("input", "instruction", "output"): "array(struct('user' as role, if(coalesce(input, '') = '', instruction, concat(instruction, '\\n\\n', input)) as text), struct('assistant' as role, output as text))",
    ("prompt", "response", "system"): "array(struct('system' as role, system as text), struct('user' as role, prompt as text), struct('assistant' as role, response as text))",
}


#: Layouts of a row that is one turn: the fields that are there, and the SQL for its (role, text).
TURN_LAYOUTS: dict[tuple[str, ...], str] = {
    ("role", "text"): "struct(role as role, text as text)",
    ("role",): "struct(role as role, '' as text)",
    ("text",): "struct('' as role, text as text)",
    (): "struct('' as role, '' as text)",
}


def fingerprint(paths: tuple[str, ...] | list[str] | set[str]) -> str:
    """Hash of a set of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


MAPPINGS = {fingerprint(paths): turns for paths, turns in LAYOUTS.items()}
_KNOWN = sorted({p for paths in LAYOUTS for p in paths})


def _fingerprint_of(tests: dict[str, str]) -> str:
    """SQL for the fingerprint of a record: the hash of the paths whose test (SQL) holds."""
    present = ", ".join(f"if({test}, '{path}', null)" for path, test in sorted(tests.items()))
    return f"sha2(array_join(array({present}), '\\n'), 256)"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a schema; ``[]`` marks array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def canonical(records: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``turns`` of records whose schema is one of ``LAYOUTS``.

    The fingerprint is taken over the fields that layouts know, so other columns don't matter.
    An unknown layout is refused.
    """
    known = [p for p in field_paths(records.schema) if p in _KNOWN and p.split("[")[0].split(".")[0] not in keep]
    turns = MAPPINGS.get(fingerprint(known))
    if turns is None:
        raise ValueError(f"no mapping for the layout {known}")
    return records.select(*[records[c] for c in keep], F.expr(f"cast({turns} as {_TURNS})").alias("turns"))


def canonical_json(records: DataFrame, column: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, ``fingerprint`` and ``turns`` of JSON records of mixed layouts.

    Each record's fingerprint is the hash of the known paths that it holds. Records that are
    null, broken or of an unknown layout have null turns.
    """
    nested: dict[str, list[str]] = {}
    for p in _KNOWN:
        head, _, leaf = p.partition("[].")
        nested.setdefault(head, []).extend([leaf] if leaf else [])
    schema = ", ".join(f"`{h}` " + (f"array<struct<{','.join(f'`{x}`:string' for x in leaves)}>>" if leaves else "string") for h, leaves in nested.items())
    d = records.select(*[records[c] for c in keep], F.from_json(records[column], schema).alias("_r"))
    tests = {}
    for p in _KNOWN:
        head, _, leaf = p.partition("[].")
        tests[p] = f"exists(_r.`{head}`, m -> m.`{leaf}` is not null)" if leaf else f"_r.`{head}` is not null"
    d = d.withColumn("fingerprint", F.expr(_fingerprint_of(tests))).select(*keep, "fingerprint", "_r.*")
    case = "case fingerprint " + " ".join(f"when '{f}' then cast({turns} as {_TURNS})" for f, turns in MAPPINGS.items()) + " end"
    return d.select(*keep, "fingerprint", F.expr(case).alias("turns"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escape(sql: str) -> str:
    """SQL: backslashes doubled, then each control string broken up by a backslash."""
    out = f"replace({sql}, {_quoted(chr(92))}, {_quoted(chr(92) * 2)})"
    for c in CONTROLS:
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    return out


def unescape(sql: str) -> str:
    """SQL: the inverse of ``escape``; any character after a backslash stands for itself."""
    return rf"regexp_replace({sql}, '(?s)\\\\(.)', '$1')"


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (start and end, in code points, of each assistant text) from ``turns``.

    Null roles and texts are empty; time grows with the number of turns and the length of their texts.
    """
    d = turns.withColumn(
        "_p", F.expr(f"transform(turns, t -> struct(coalesce(t.role, '') as role, concat('{START}', {escape("coalesce(t.role, '')")}, '{MIDDLE}') as head, {escape("coalesce(t.text, '')")} as body))")
    )
    d = d.withColumn("formatted", F.expr(f"array_join(flatten(transform(_p, t -> array(t.head, t.body, '{END}'))), '')"))
    size = f"length(t.head) + length(t.body) + {len(END)}"
    starts = f"aggregate(bs, array(0), (a, b) -> concat(a, array(a[size(a) - 1] + aggregate(b, 0, (n, t) -> n + {size}))))"
    block = f"""aggregate(b, struct(at as at, cast(array() as array<struct<s:int,e:int>>) as out), (a, t) -> struct(
        a.at + {size} as at,
        if(t.role = 'assistant', concat(a.out, array(struct(a.at + length(t.head) as s, a.at + length(t.head) + length(t.body) as e))), a.out) as out), a -> a.out)"""
    mask = f"transform(array({blocks_sql('_p')}), bs -> flatten(zip_with(bs, slice({starts}, 1, size(bs)), (b, at) -> {block})))[0]"
    return d.withColumn("loss_mask", F.expr(mask)).drop("_p")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_text``, recovered from ``formatted`` and ``loss_mask`` alone."""
    parts = f"filter(split(formatted, {_quoted(END.replace('|', chr(92) + '|'))}), p -> p <> '')"
    d = formatted.withColumn("_s", F.expr(f"transform({parts}, p -> split(substring(p, {len(START) + 1}), {_quoted(MIDDLE.replace('|', chr(92) + '|'))}))"))
    d = d.withColumn("read_turns", F.expr(f"transform(_s, p -> struct({unescape('p[0]')} as role, {unescape('p[1]')} as text))"))
    loss = f"""transform(array(struct({chunks_sql('formatted')} as t, loss_mask as masks)), v ->
        array_join(transform(v.masks, m -> {unescape(cut_sql("v.t", "m.s", "m.e"))}), ''))[0]"""
    return d.withColumn("loss_text", F.expr(loss)).drop("_s")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows by turn (conv_id, turn, role, text).

    Each row's fingerprint, over the fields that it has, selects its mapping in TURN_LAYOUTS. Turns are in order of turn, null first, then role and text, so ties and repeated rows have a
    fixed order; a null role or text is empty; rows with a null conv_id are one conversation.
    """
    d = pick(rows, "conv_id", "turn", "role", "text")
    which = _fingerprint_of({"role": "role is not null", "text": "text is not null"})
    case = f"case {which} " + " ".join(f"when '{fingerprint(paths)}' then {turn}" for paths, turn in TURN_LAYOUTS.items()) + " end"
    d = d.select("conv_id", "turn", F.expr(case).alias("said"))
    listed = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said.role", "said.text"))).alias("turns"))
    return canonical(listed.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.text as text))").alias("turns")), ("conv_id",))


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    d = read_back(formatted)
    body = "array_join(transform(read_turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    return d.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(F.expr(body), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def chat_format(rows: DataFrame) -> DataFrame:
    """``digest`` of all conversations of ``rows`` plus conversation -1, whose two texts hold control strings.

    An empty table gives conversation -1 alone; rows that already have conv_id -1 join it;
    other columns are ignored. conv_id may be of any type that -1 can be cast to, turn of any type
    that 0 and 1 can, strings included.
    """
    spark = rows.sparkSession
    d = pick(rows, "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    probe = probe.select(*[F.col(c).cast(d.schema[c].dataType) for c in d.columns])
    return digest(format_turns(conversations(d.unionByName(probe))))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(START) + len(MIDDLE) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
