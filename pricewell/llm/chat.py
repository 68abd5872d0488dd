"""Operator 6: heterogeneous conversation records into one chat template, by schema fingerprint.

The nested field paths of a record are hashed; the hash selects a declarative
mapping that turns the record into canonical turns. Each turn becomes one
segment of the formatted text, so a conversation of any length is never held
whole. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"


class Mapping(NamedTuple):
    """paths: the layout's nested fields. turns: (role, path of the text) in order; or lists: (path, role field, text field)."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    lists: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None  # (turn, role, text): a record is one turn


# The layouts in use, as nested field paths.
MAPPINGS = [
    Mapping(("turn", "role", "text"), row=("turn", "role", "text")),
    Mapping(("messages[].content", "messages[].role"), lists=("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), lists=("conversations", "from", "value")),
    Mapping(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
]
# Role names of other layouts; the flat one's roles stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

KNOWN = {path for m in MAPPINGS for path in m.paths}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the nested field paths that any layout knows; other fields don't matter."""
    return hashlib.sha256("\n".join(sorted(KNOWN & set(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from field_paths(kind.elementType, f"{prefix}[]")
    else:
        yield prefix


def _text(path: str) -> Column:
    parts = [F.col(f"`{p}`").cast("string") for p in path.split("+")]
    return parts[0] if len(parts) == 1 else F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


def canonical_turns(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, turn long, role, text of typed records in any known layout; ValueError where none fits.

    A null text or role is empty; columns that no layout knows are ignored; a
    record with an empty or null list has no turns.
    """
    mapping = BY_FINGERPRINT.get(fingerprint(field_paths(records.schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(KNOWN & set(field_paths(records.schema)))}")
    key = F.col(f"`{id_column}`").alias("conv_id")
    if mapping.row:
        turn, role, text = (F.col(f"`{c}`") for c in mapping.row)
        out = records.select(key, turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    elif mapping.lists:
        path, role, text = mapping.lists
        out = records.select(key, F.posexplode(path).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), F.col("m")[role].alias("role"), F.col("m")[text].alias("text"))
    else:
        turns = F.array(*[F.struct(F.lit(r).alias("role"), _text(p).alias("text")) for r, p in mapping.turns])
        out = records.select(key, F.posexplode(turns).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text").where("role != 'system' or text != ''")
    return _canonical(out, renamed=not mapping.row)


def _canonical(turns: DataFrame, renamed: bool | Column) -> DataFrame:
    """Null roles and texts are empty; where renamed, other layouts' role names become the canonical ones."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    own = role
    for other, name in ROLES.items():
        own = F.when(role == other, name).otherwise(own)
    own = F.when(renamed if isinstance(renamed, Column) else F.lit(renamed), own).otherwise(role)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), own.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _present(path: str) -> Column:
    """Whether the record v has the nested field; a list has it if one of its members does."""
    if "[]." not in path:
        return F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
    outer, inner = path.split("[].")
    members = F.try_variant_get("v", f"$.{outer}", "array<variant>")
    return F.coalesce(F.exists(members, lambda m: F.try_variant_get(m, f"$.{inner}", "variant").isNotNull()), F.lit(False))


def _turns_of(mapping: Mapping) -> Column:
    """The record v's turns by the mapping, as an array of turn, role, text."""
    get = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    if mapping.row:
        turn, role, text = mapping.row
        return F.array(F.struct(F.try_variant_get("v", f"$.{turn}", "long").alias("turn"), get(role).alias("role"), get(text).alias("text")))
    if mapping.lists:
        path, role, text = mapping.lists
        members = F.try_variant_get("v", f"$.{path}", "array<variant>")
        return F.transform(members, lambda m, i: F.struct(i.cast("long").alias("turn"), F.try_variant_get(m, f"$.{role}", "string").alias("role"), F.try_variant_get(m, f"$.{text}", "string").alias("text")))
    value = lambda path: get(path) if "+" not in path else F.concat_ws("\n", *[F.when(get(p) != "", get(p)) for p in path.split("+")])
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), value(path).alias("text")) for i, (role, path) in enumerate(mapping.turns)])
    return F.filter(turns, lambda t: (t["role"] != "system") | (F.coalesce(t["text"], F.lit("")) != ""))


def json_layouts(records: DataFrame, json_column: str, id_column: str = "conv_id") -> DataFrame:
    """conv_id, v (the record), fingerprint (of its known nested fields; null for texts that are no JSON objects), known (whether a mapping has it)."""
    rows = records.select(F.col(f"`{id_column}`").alias("conv_id"), F.try_parse_json(F.col(f"`{json_column}`")).alias("v"))
    paths = F.array_compact(F.array(*[F.when(_present(p), F.lit(p)) for p in sorted(KNOWN)]))
    found = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.sha2(F.array_join(paths, "\n"), 256))
    return rows.withColumn("fingerprint", found).withColumn("known", F.coalesce(F.col("fingerprint").isin(list(BY_FINGERPRINT)), F.lit(False)))


def canonical_json(records: DataFrame, json_column: str, id_column: str = "conv_id", unknown: str = "raise") -> DataFrame:
    """Turns of records that are JSON objects, each by the one mapping that its own fingerprint selects.

    An object whose fields fit no mapping, or several at once, fails the job;
    with unknown="skip" it gives no turns, and ``json_layouts`` reports it. Null
    texts and texts that are no JSON objects give no turns, nor do empty system
    prompts and empty lists. A null text or role of a turn is empty.
    """
    if unknown not in ("raise", "skip"):
        raise ValueError(unknown)
    rows = json_layouts(records, json_column, id_column)
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    if unknown == "raise":
        failed = F.raise_error(F.concat(F.lit("no mapping for the fields of "), F.to_json("v"))).cast("array<struct<turn:bigint,role:string,text:string>>")
        turns = F.when(F.col("fingerprint").isNotNull(), failed).otherwise(turns)
    for own, mapping in BY_FINGERPRINT.items():
        turns = F.when(F.col("fingerprint") == own, _turns_of(mapping)).otherwise(turns)
    flat = [own for own, mapping in BY_FINGERPRINT.items() if mapping.row]
    out = rows.select("conv_id", (~F.col("fingerprint").isin(flat)).alias("renamed"), F.explode(turns).alias("m"))
    return _canonical(out.select("conv_id", "renamed", "m.*"), renamed=F.col("renamed"))


def escaped(text: Column) -> Column:
    """A backslash is doubled, and one is put into each ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return text if "\\" not in text else re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def segments(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, segment, loss_start, loss_end.

    The segments of a conversation, in the order of turn and then segment, are
    its formatted text. Code points loss_start to loss_end of a segment are
    under the loss mask: an assistant's text, nothing of the template. Equal
    rows each stay a turn.
    """
    name = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), name, F.lit("\n"))
    body = escaped(F.col("text"))
    mine = F.col("role") == "assistant"
    return turns.select("conv_id", "turn", F.concat(head, body, F.lit(END + "\n")).alias("segment"), F.when(mine, F.length(head)).otherwise(0).alias("loss_start"), F.when(mine, F.length(head) + F.length(body)).otherwise(0).alias("loss_end"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: whole conversations, for those known to be of bounded length."""
    rows = segments(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "segment"))).alias("s"))
    return rows.select("conv_id", F.array_join("s.segment", "").alias("formatted"))


_SEGMENT = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame) -> DataFrame:
    """What reading the segments back gives, per conversation.

    A digest needs a conversation's turns in order; rows stream through the task
    in that order and only two hash states are kept.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _SEGMENT.findall(segment):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                loss = unescape(segment[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if len(done) > 4096:
                yield _rows(done)
                done = []
        if state is not None:
            done.append((now, state))
        if done:
            yield _rows(done)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(task, DIGESTS)


def _rows(done: list) -> pa.RecordBatch:
    rows = [(conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for conv, s in done]
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)
