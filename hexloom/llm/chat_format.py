"""Chat formatting whose output can be parsed back: conflicting content is escaped until the round trip holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions.arrays import let, running_sums

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = [BEGIN, END, OPEN, CLOSE]
_HEAD, _NECK = f"{BEGIN}{OPEN} ", f" {CLOSE}\n"
#: A turn is  <s>[INST] role [/INST] newline text </s>
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """Each backslash dropped and the character after it kept; a last lone backslash stays."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_HEAD), role, F.lit(_NECK), text, F.lit(END))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered text: role, text, valid, and where the text starts and ends (code points, end exclusive).

    A deterministic parser of the grammar: turns end at ``</s>``, begin with the head,
    and have no control string in role or text.
    """

    def turn(piece: Column, at: Column) -> Column:
        def from_neck(neck: Column) -> Column:
            # neck: 1-based place of the text behind the header, 0 without a header
            role = F.substring(piece, F.lit(len(_HEAD) + 1), neck - len(_HEAD) - 1 - len(_NECK))
            text = F.substring(piece, neck, F.length(piece))
            clean = neck > 0
            for control in CONTROLS:
                clean = clean & ~F.contains(role, F.lit(control)) & ~F.contains(text, F.lit(control))
            return F.struct(
                unescaped(role).alias("role"), unescaped(text).alias("text"), clean.alias("valid"), (at + neck - 1).alias("start"), (at + F.length(piece)).alias("end")
            )

        place = F.locate(_NECK, piece, len(_HEAD) + 1)
        return let(F.when(F.startswith(piece, F.lit(_HEAD)) & (place > 0), place + len(_NECK)).otherwise(0), from_neck)

    def from_pieces(pieces: Column) -> Column:
        turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        lengths = F.transform(turns, lambda p: F.length(p) + len(END))
        return F.zip_with(turns, running_sums(lengths), turn)

    return let(F.split(formatted, END, -1), from_pieces)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text).

    formatted: the rendered turns. A turn is rendered as it is if the parser gives back
    its role and text, and escaped otherwise. turns: what the parser reads back from
    the whole (role, text, valid, start, end). loss_spans: the places of assistant
    texts in ``formatted``. round_trip: the turns read back equal the source's.

    Null roles and texts are empty. Turns go by turn (nulls first), role and text, so
    that ties and repeated rows have one order; repeated rows are turns each. Null
    conv_ids are one conversation. Other columns are not read; no rows give no rows. A
    conversation is one value of the result and so is held by one task.
    """
    source = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    plain = rendered(F.col("role"), F.col("text"))
    same = let(parsed(plain), lambda p: (F.size(p) == 1) & (F.element_at(p, 1)["valid"]) & (F.element_at(p, 1)["role"] == F.col("role")) & (F.element_at(p, 1)["text"] == F.col("text")))
    # only a control string or a backslash can break the round trip; other turns need no trial
    suspect = F.contains(F.col("text"), F.lit("\\")) | F.contains(F.col("role"), F.lit("\\"))
    for control in CONTROLS:
        suspect = suspect | F.contains(F.col("text"), F.lit(control)) | F.contains(F.col("role"), F.lit(control))
    shown = F.when(~suspect, plain).when(same, plain).otherwise(rendered(escaped(F.col("role")), escaped(F.col("text"))))
    grouped = source.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", shown.alias("shown")))).alias("source"))
    formatted = grouped.select("conv_id", "source", F.array_join(F.transform("source", lambda t: t["shown"]), "").alias("formatted"))
    read = formatted.select("conv_id", "source", "formatted", parsed(F.col("formatted")).alias("turns"))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(True).alias("valid")))
    got = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["valid"].alias("valid")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return read.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), (wanted == got).alias("round_trip"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, described from what is read back from their formatted texts."""
    extra = spark.sql(
        r"select -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"
    )
    chats = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    read = chats.select("conv_id", "formatted", "turns", masked.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for control in CONTROLS:
        out = rf"replace({out}, '{control}', '{control[0]}\{control[1:]}')"
    return out


ORACLE_SQL = rf"""
with source as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown as (
  select *, regexp_matches(role, '\\(.|\n)|</?s>|\[/?INST\]') or regexp_matches(text, '\\(.|\n)|</?s>|\[/?INST\]') as conflict from source)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(_HEAD) + len(_NECK) + len(END)} + case when conflict then length({_sql_escaped("role")}) + length({_sql_escaped("text")}) else length(role) + length(text) end) as bigint) as formatted_chars
from shown group by conv_id
"""
