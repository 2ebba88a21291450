"""Chat formatting: heterogeneous layouts to canonical turns, a reversible template, and a loss mask.

A record is a JSON text. Its nested field paths, without scalar types, are hashed to a schema fingerprint. A registry
maps fingerprints to declarative mappings: each mapping is a list of turns, given as literal role and path of the text,
or a path of an array with role and text fields and a renaming of roles. Records are split by fingerprint with column
expressions only, so that one pass converts every layout.

The template writes `<|role|>`, a line feed, the text, `<|end|>` and a line feed for each turn. Control strings of this
and other common templates are broken up inside roles and texts by a backslash and a letter, and backslashes are escaped
themselves, so that the formatted text holds control strings only where the template put them, and unescaping gives
every text back exactly. The loss mask is a list of spans in code points, one for each assistant text.

Defined results: a null text or role is empty; a record that is null, no JSON, or of an unknown layout keeps its row with
null turns and its fingerprint, so that it can be counted and mapped; an empty list gives no turns, an empty formatted
text and no spans; repeated rows and ties of the turn number keep all turns, ordered by turn, role and text.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"

#: Control strings of common chat templates (fixed values), and what breaks them up. The order of escaping is this one.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKS = "abcdefgh"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\z"))
    for control, mark in zip(CONTROLS, MARKS, strict=True):
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{mark}{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for control, mark in reversed(list(zip(CONTROLS, MARKS, strict=True))):
        out = F.replace(out, F.lit(f"{control[0]}\\{mark}{control[1:]}"), F.lit(control))
    return F.replace(out, F.lit("\\z"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


# layouts ------------------------------------------------------------------------------------------------------------

def path_schema(record: Column) -> Column:
    """The nested field paths of a JSON text as `OBJECT<a, b: ARRAY<OBJECT<...>>>`; null if it is no JSON.

    Keys come sorted and scalar types are left out, so that nulls and numbers do not make new layouts.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?(?=[,>])", "")


def fingerprint(shape: Column) -> Column:
    return F.sha2(shape, 256)


def pairs_layout(shape: str, *turns: tuple[str, str]) -> dict:
    """A layout in which each turn has a field of its own: (role, JSON path)."""
    return {"shape": shape, "turns": turns}


def list_layout(shape: str, path: str, role: str, text: str, names: dict[str, str] | None = None) -> dict:
    """A layout with an array of turns, its role and text fields, and other names of roles."""
    return {"shape": shape, "path": path, "role": role, "text": text, "names": names or {}}


#: Declarative mappings by name. A shape has sorted keys.
LAYOUTS = {
    "prompt_completion": pairs_layout("OBJECT<completion, prompt>", ("user", "$.prompt"), ("assistant", "$.completion")),
    "question_answer": pairs_layout("OBJECT<answer, question>", ("user", "$.question"), ("assistant", "$.answer")),
    "instruction": pairs_layout("OBJECT<input, instruction, output>", ("system", "$.instruction"), ("user", "$.input"),
                                ("assistant", "$.output")),
    "messages": list_layout("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "$.messages", "role", "content"),
    "speakers": list_layout("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "$.conversations", "from", "value",
                            {"human": "user", "gpt": "assistant"}),
}


def _turn_texts(layout: dict, record: Column) -> Column:
    if "turns" in layout:
        return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(
            F.try_variant_get(record, path, "string"), F.lit("")).alias("text")) for role, path in layout["turns"]])
    kind = f"array<struct<{layout['role']}:string,{layout['text']}:string>>"
    listed = F.try_variant_get(record, layout["path"], kind)

    def turn(item):
        role = F.coalesce(item[layout["role"]], F.lit(""))
        named = reduce(lambda out, pair: F.when(role == pair[0], F.lit(pair[1])).otherwise(out),
                       layout["names"].items(), role)
        return F.struct(named.alias("role"), F.coalesce(item[layout["text"]], F.lit("")).alias("text"))

    return F.transform(listed, turn)


def canonical_turns(records: DataFrame, column: str, layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """Add `layout`, `schema_fingerprint` and `turns` (role, text) to every record."""
    mapped = records.withColumn("schema_fingerprint", fingerprint(path_schema(F.col(column))))
    known = {hashlib.sha256(x["shape"].encode()).hexdigest(): name for name, x in layouts.items()}
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    parsed = F.try_parse_json(F.col(column))
    for key, layout in known.items():
        same = F.col("schema_fingerprint") == key
        name = F.when(same, F.lit(layout)).otherwise(name)
        turns = F.when(same, _turn_texts(layouts[layout], parsed).cast(TURNS)).otherwise(turns)
    return mapped.withColumn("layout", name).withColumn("turns", turns)


# template -----------------------------------------------------------------------------------------------------------

def format_turns(turns: Column) -> Column:
    """struct<formatted, loss_spans>: the text of the template and the code point spans (start, end) under the loss."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("text"),
        (t["role"] == "assistant").alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, piece):
        begins = acc["at"] + F.length(piece["head"])
        ends = begins + F.length(piece["text"])
        span = F.array(F.struct(begins.cast("long").alias("start"), ends.cast("long").alias("end")))
        return F.struct((ends + F.lit(len("<|end|>\n"))).cast("long").alias("at"),
                        F.when(piece["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["text"], F.lit("<|end|>\n"))), "")
    return F.struct(text.alias("formatted"), F.aggregate(pieces, start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda block: block != "")

    def turn(block):
        head = F.regexp_extract(block, r"(?s)^<\|(.*?)\|>\n", 1)
        text = F.substring(block, F.length(head) + F.lit(6), F.length(block))
        return F.struct(unescape_role(head).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_records(records: DataFrame, column: str, layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """Canonical turns of every record, formatted; `formatted` and `loss_spans` are null where the layout is unknown."""
    mapped = canonical_turns(records, column, layouts)
    done = mapped.withColumn("_f", F.when(F.col("turns").isNotNull(), format_turns(F.col("turns"))))
    return done.withColumn("formatted", F.col("_f.formatted")).withColumn("loss_spans", F.col("_f.loss_spans")).drop("_f")


# rows of one turn each ------------------------------------------------------------------------------------------------

def records_of_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One JSON record per conversation from (conv_id, turn, role, text) rows.

    A lone question and answer, and an instruction with question and answer, become records with a field for each turn;
    dialogues of users and assistants alone become speaker lists if they have an odd number of turns; the rest are
    message lists. So every layout of the registry but one meets real data.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.col("t.role")
    people = F.forall(roles, lambda r: r.isin("user", "assistant"))
    named = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"),
                                                x["text"].alias("value")))
    listed = F.transform("t", lambda x: F.struct(x["text"].alias("content"), x["role"].alias("role")))
    text = lambda i: F.col("t")[i]["text"]
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")),
               F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
              F.to_json(F.struct(text(1).alias("input"), text(0).alias("instruction"), text(2).alias("output"))))
        .when(people & (F.size("t") % 2 == 1), F.to_json(F.struct(named.alias("conversations"))))
        .otherwise(F.to_json(F.struct(listed.alias("messages")))))
    return grouped.select("conv_id", record.alias("record"))
