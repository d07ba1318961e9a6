"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is JSON of any layout. Its fingerprint is the hash of its sorted nested
field paths (array items as ``[]``), of which those count that some mapping reads,
so further fields change nothing; the registry maps fingerprints to mappings.
A mapping is data: either the path of an array with the names of its role and
text fields, or a list of (role, field) pairs. Optional fields are part of the
layout, so one mapping is registered under the fingerprint of each of its
variants. A text may be a list of parts: if all are texts they are joined, else the
list is kept as JSON.

The template writes a turn as ``<|turn|>role<|says|>text<|done|>``. Control
strings - its own and those of common chat formats - are broken up inside roles
and texts by a backslash after their first character, and a backslash is
doubled; removing one backslash before each character undoes both. So nothing a
user writes can end a turn, and every text comes back as it was.

Each turn is formatted by itself, where its record is, so a conversation of any
length is spread over as many tasks as its records; ``conversations`` puts the
turns of one conversation in a row if that is wanted.

Defined results: null text or role is empty; records that are null, not JSON or
of an unknown layout have a row without a turn in ``canonical_turns``, are listed by
``unmapped`` and counted by ``digests``, where their conversation has a row even if it
has no turn; a record with an empty list of messages is mapped and has no turn.
Equal rows give equal turns, and rows of equal conversation and position are in the
order of their turns' text, so ties change nothing; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: Strings that control this or another chat format.
CONTROL = (
    "<|turn|>", "<|says|>", "<|done|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_FORMATTED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(DONE)}", re.S)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``items`` (array path, role field, text field), or ``fields`` (role, path) in order."""

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))


def paths_of(value, prefix: str = "") -> set[str]:
    """Nested field paths; ``[]`` stands for the items of an array."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{prefix}.{k}" if prefix else k)} or {prefix}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, prefix + "[]")} or {prefix + "[]"}
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _variants(*choices: tuple[tuple[str, ...], ...]) -> tuple[frozenset[str], ...]:
    """Every set of paths with one of each choice."""
    return tuple(frozenset(p for one in combined for p in one) for combined in product(*choices))


def _list_of(at: str, role: str, text: str):
    """The paths of a list of messages: texts plain, in parts or both, empty messages or none at all."""
    plain, parts = f"{at}[].{text}", f"{at}[].{text}[].text"
    said = _variants(((f"{at}[].{role}",),), ((plain,), (parts,), (plain, parts)), ((), (f"{at}[]",)))
    return (*said, frozenset([f"{at}[]"]))


#: The layouts: mapping and the sets of paths that it reads.
LAYOUTS = (
    (Mapping("turn row", items=("", "role", "text"), roles=()), _variants((("role", "text"), ("role", "text[].text")))),
    (Mapping("role and content", items=("messages", "role", "content")), _list_of("messages", "role", "content")),
    (Mapping("from and value", items=("conversations", "from", "value")), _list_of("conversations", "from", "value")),
    (Mapping("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))), _variants((("prompt", "completion"),))),
    (Mapping("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))), _variants((("prompt", "response"),))),
    (
        Mapping("instruction", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
        _variants((("instruction", "output"),), ((), ("input",))),
    ),
    (Mapping("system and pair", fields=(("system", "system"), ("user", "user"), ("assistant", "assistant"))), _variants((("user", "assistant"),), ((), ("system",)))),
)


def registry(layouts=LAYOUTS) -> dict[str, Mapping]:
    return {fingerprint(paths): mapping for mapping, variants in layouts for paths in variants}


def paths_read(layouts=LAYOUTS) -> frozenset[str]:
    """All paths that some mapping reads."""
    return frozenset(p for _, variants in layouts for paths in variants for p in paths)


def _text(value) -> str:
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list) and all(isinstance(p, dict) and p.get("type", "text") == "text" and isinstance(p.get("text"), str) for p in value):
        return "".join(p["text"] for p in value)
    return json.dumps(value, ensure_ascii=False)


def turns_of(record, mapping: Mapping) -> list[tuple[str, str]] | None:
    """(role, text) of a record by its mapping; none if an item of its list is no object."""
    rename = dict(mapping.roles)
    if mapping.items is not None:
        at, role, says = mapping.items
        items = [record] if not at else record.get(at) or []
        if not all(isinstance(i, dict) for i in items):
            return None
        return [(rename.get(_text(i.get(role)), _text(i.get(role))), _text(i.get(says))) for i in items]
    return [(role, _text(record[path])) for role, path in mapping.fields if path in record]


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn by the template, and where its text begins and ends."""
    head = f"{TURN}{escaped(role)}{SAYS}"
    body = escaped(text)
    return head + body + DONE, len(head), len(head) + len(body)


def read_back(whole: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of formatted text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _FORMATTED.finditer(whole)]


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Turns of ``records`` (conv_id, position, record): ``conv_id, position, item, layout, role, text``, formatted.

    ``formatted`` is the turn by the template; ``loss_start`` and ``loss_end``
    are where the loss mask lies in it, which covers what an assistant says. A
    record without a turn has one row without ``item``, and without ``layout`` too
    if it has no mapping.
    """
    known, read = registry(layouts), paths_read(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, position, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mapping = known.get(fingerprint(paths_of(record) & read)) if isinstance(record, dict) else None
                turns = turns_of(record, mapping) if mapping else None
                if not turns:
                    rows.append((conv, position, None, None if turns is None else mapping.name, None, None, None, None, None))
                    continue
                for item, (role, text) in enumerate(turns):
                    whole, a, b = formatted(role, text)
                    if role != "assistant":
                        a = b = 0
                    rows.append((conv, position, item, mapping.name, role, text, whole, a, b))
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return records.select("conv_id", "position", "record").mapInArrow(run, _SCHEMA)


_NAMES = ["conv_id", "position", "item", "layout", "role", "text", "formatted", "loss_start", "loss_end"]
_SCHEMA = (
    "conv_id long, position long, item long, layout string, role string, text string, "
    "formatted string, loss_start long, loss_end long"
)


def unmapped(turns: DataFrame) -> DataFrame:
    """Records without a mapping."""
    return turns.where("layout IS NULL").select("conv_id", "position")


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: the formatted text and the spans of its loss mask; holds a conversation in one row."""
    mapped = turns.where("item IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("position", "item", "formatted", "loss_start", "loss_end")))
    grouped = mapped.groupBy("conv_id").agg(parts.alias("parts"))
    before = F.transform("parts", lambda _, i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, p: n + F.length(p["formatted"])))
    spans = F.zip_with("parts", before, lambda p, n: F.struct((n + p["loss_start"]).alias("start"), (n + p["loss_end"]).alias("end")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"),
        F.filter(spans, lambda s: s["end"] > s["start"]).alias("loss_spans"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted turns, per conversation, and its number of ``unmapped`` records.

    Turns of a conversation stream through one task in order; of each only its
    contribution to the running digests is kept, so memory does not grow with
    the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
             ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("unmapped", pa.int64())]
        )
        state = None

        def closed():
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]]

        for batch in batches:
            done = []
            for conv, lost, whole, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[6] += lost
                for role, text in read_back(whole):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                loss = unescaped(whole[a:b])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(whole)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], names=schema.names)
        if state is not None:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(closed(), schema.types)], names=schema.names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position", "item", "formatted")
    lost = F.col("layout").isNull().cast("int").alias("lost")
    none = {"formatted": "", "loss_start": 0, "loss_end": 0}
    return ordered.select("conv_id", lost, "formatted", "loss_start", "loss_end").na.fill(none).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, unmapped long"
    )
