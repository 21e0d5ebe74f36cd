"""Chat formatting: schema fingerprints choose declarative mappings that bring any layout into canonical turns.

A record is a JSON object.  Its nested field paths (array elements as `[]`, scalar leaves only) are sorted and hashed;
the hash is the fingerprint of its layout.  A table of mappings, built once from the layouts below, says for each
fingerprint where turns, roles and texts are.  A record with other fields besides falls to the mapping whose required
paths it has; if it has those of several, one of them must hold the paths of all the others (else its layout is
`ambiguous`: a mapping would leave out texts that another one takes), and with none its layout is `unmapped`.  Such
records have no turns and are not rendered.  A text may be a list of parts, each of type text: they are one text.
Preference pairs give the chosen answer to the assistant and keep the rejected one as a turn outside the loss mask.

Canonical turns are rendered with `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end.  Control
strings inside roles and texts are escaped: each backslash is doubled, and a backslash is put after the first
character of a control string, so that none occurs in the result; line ends in roles become backslash n.  Taking a
backslash off with what it guards gives the text back.  The loss mask covers the text of assistant turns.

Edge cases: conversation ids and turns are whole numbers (others are an error); null roles and texts are empty; null turns sort first; equal turn numbers sort by role, then text;
repeated rows are turns of their own; rows with a null conversation id form one conversation of null id; an empty
table gives an empty table; a long conversation is streamed turn by turn, never held as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Control strings of the template and of other common templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Layouts: name -> (example paths, mapping). A mapping has either `turns` (path of a list, with the names of role and
#: text in its elements) or `fields` (role, path) in order.
LAYOUTS = {
    "row": {"paths": ["role", "text"], "row": ("role", "text")},
    "messages": {"paths": ["messages[].content", "messages[].role"], "turns": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value")},
    "dialog": {"paths": ["dialog[].speaker", "dialog[].text"], "turns": ("dialog", "speaker", "text")},
    "prompt_response": {"paths": ["prompt", "response"], "fields": (("user", "prompt"), ("assistant", "response"))},
    "prompt_completion": {"paths": ["completion", "prompt"], "fields": (("user", "prompt"), ("assistant", "completion"))},
    "question_answer": {"paths": ["answer", "question"], "fields": (("user", "question"), ("assistant", "answer"))},
    "system_question": {"paths": ["question", "response", "system_prompt"], "fields": (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))},
    "instruction": {"paths": ["instruction", "output"], "fields": (("user", "instruction"), ("assistant", "output"))},
    "preference": {"paths": ["chosen", "prompt", "rejected"], "fields": (("user", "prompt"), ("assistant", "chosen"), ("rejected", "rejected"))},
    "instruction_input": {"paths": ["input", "instruction", "output"], "fields": (("user", ("instruction", "input")), ("assistant", "output"))},
}
#: Layouts of records that have no turns.
UNMAPPED, AMBIGUOUS = "unmapped", "ambiguous"
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def is_parts(value) -> bool:
    """Whether a value is a text in parts: a list of objects {"type": "text", "text": string}."""
    return isinstance(value, list) and bool(value) and all(isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str) for p in value)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the scalar leaves; empty objects and lists count as leaves, and so do texts in parts."""
    if is_parts(value):
        return {at}
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


MAPPINGS = {fingerprint(m["paths"]): name for name, m in LAYOUTS.items()}


def select_layout(paths: set[str]) -> str | None:
    """By fingerprint; else the layout all of whose paths are there, and that has those of every other such layout;
    AMBIGUOUS if there is none among several; None if no layout fits."""
    if name := MAPPINGS.get(fingerprint(paths)):
        return name
    fits = [(set(m["paths"]), name) for name, m in LAYOUTS.items() if set(m["paths"]) <= paths]
    whole = [name for own, name in fits if all(other <= own for other, _ in fits)]
    return whole[0] if whole else AMBIGUOUS if fits else None


def _text(value) -> str:
    if is_parts(value):
        return "".join(p["text"] for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def apply_layout(name: str, record: dict) -> list[tuple[str, str]]:
    m = LAYOUTS[name]
    if "row" in m:
        return [(_text(record.get(m["row"][0])), _text(record.get(m["row"][1])))]
    if "turns" in m:
        path, role, text = m["turns"]
        raw = [(_text(t.get(role)), _text(t.get(text))) for t in record.get(path) or [] if isinstance(t, dict)]
        return [(ROLES.get(r.lower(), r), t) for r, t in raw]
    out = []
    for role, path in m["fields"]:
        parts = [_text(record.get(p)) for p in (path if isinstance(path, tuple) else (path,))]
        if any(parts) or role != "system":
            out.append((role, "\n\n".join(p for p in parts if p)))
    return out


def canonical_turns(records: DataFrame, record: str = "record", keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """(keys..., seq, layout, fingerprint, role, text): the turns of each JSON record.

    A record that is null or no JSON object, or whose layout is unknown, gives one row with layout `unmapped`, one that fits
    several layouts a row with layout `ambiguous`; role and text are null."""
    small_batches(records.sparkSession)
    kind = "array<struct<layout: string, fingerprint: string, role: string, text: string>>"

    @F.pandas_udf(kind)
    def parse(column: pd.Series) -> pd.Series:
        rows = []
        for raw in column:
            try:
                value = json.loads(raw) if raw else None
            except ValueError:
                value = None
            paths = field_paths(value) if isinstance(value, dict) else set()
            mark, name = fingerprint(paths), select_layout(paths)
            rows.append([{"layout": name, "fingerprint": mark, "role": r, "text": t} for r, t in apply_layout(name, value)] if name in LAYOUTS else [{"layout": name or UNMAPPED, "fingerprint": mark, "role": None, "text": None}])
        return pd.Series(rows)

    out = records.select(*(F.col(f"`{k}`") for k in keys), F.posexplode(parse(F.col(f"`{record}`"))).alias("seq", "t"))
    return out.select(*keys, "seq", "t.layout", "t.fingerprint", "t.role", "t.text")


_GUARD = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _GUARD, "\\\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL) if "\\" in role else role


def render(turns: DataFrame) -> DataFrame:
    """turns with `formatted` (the turn in the template) and the loss span loss_start, loss_end in it (code points;
    null outside assistant turns). The formatted conversation is the concatenation of its turns in order.

    Records without turns are left out."""
    if "layout" in turns.columns:
        turns = turns.where(~F.col("layout").isin(UNMAPPED, AMBIGUOUS))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = escape(text)
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    assistant = role == "assistant"
    return turns.withColumns({"formatted": F.concat(head, body, F.lit(CLOSE)), "loss_start": F.when(assistant, F.length(head).cast("long")), "loss_end": F.when(assistant, (F.length(head) + F.length(body)).cast("long"))})


_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def read_back(formatted: str):
    """(role, text) of each turn of a formatted conversation, or part of one that holds whole turns."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not in the template")
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(formatted):
        raise ValueError("not in the template")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: counts and hashes of turns and of what the loss mask covers.

    Turns are sorted within the partitions of their conversation and read as a stream; only hashes are kept."""
    spark = rendered.sparkSession
    small_batches(spark)
    order = ("conv_id", "turn", "seq", "role", "text")
    rows = rendered.select(*order, "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "loss_start", "loss_end")

    def stream(batches):
        state = None
        out: list[tuple] = []

        def close():
            if state is not None:
                conv, n, turns, chars, loss, size = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def batch_of(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for conv, formatted, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    text = unescape(formatted[lo:hi])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return rows.mapInArrow(stream, DIGESTS)


def format_table(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered turns of a table with one row a turn."""
    record = F.to_json(F.struct(F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))
    records = rows.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), record.alias("record"))
    return render(canonical_turns(records))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_table(rows.unionByName(extra)))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<|im_start|>' || replace({_sql_escape("role")}, chr(10), '\\n') || chr(10) || {_sql_escape("text")} || '<|im_end|>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
