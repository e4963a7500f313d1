"""Chat formatting by a grammar round trip, in DataFrame operations only.

The rendered text is a sequence of turns: ``[INST]`` text ``[/INST]`` for users, ``<s>`` text ``</s>`` for assistants, and
``[ROLE]`` role ``[TEXT]`` text ``[/ROLE]`` for any other role. A deterministic parser takes the first turn that
starts where the last one ended and ends at the first closing mark. Texts are rendered as they are first; if the parse of a conversation
isn't its source, its turns are escaped: a backslash goes in after the first character of each control string, and one more
into those that have backslashes there. No closing mark overlaps itself, so that always parses back; it is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template: opening and closing.
USER, ASSISTANT, OTHER = ("[INST]", "[/INST]"), ("<s>", "</s>"), ("[ROLE]", "[/ROLE]")
ROLE_END = "[TEXT]"
TURN = r"(?s)\G(?:\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[TEXT\].*?\[/ROLE\])"

#: Control strings: a first character, backslashes that escaping put in, and a rest.
_BRACKET, _ANGLE = r"\[(\\*)(/?INST\]|/?ROLE\]|TEXT\])", r"<(\\*)(/?s>)"


def escape(x: Column) -> Column:
    """A backslash more into each control string."""
    x = F.regexp_replace(x, _BRACKET, r"[\\$1$2")
    return F.regexp_replace(x, _ANGLE, r"<\\$1$2")


def unescape(x: Column) -> Column:
    """A backslash less in each control string that has one."""
    x = F.regexp_replace(x, r"\[\\(\\*)(/?INST\]|/?ROLE\]|TEXT\])", r"[$1$2")
    return F.regexp_replace(x, r"<\\(\\*)(/?s>)", r"<$1$2")


def _render(turn: Column, escaped: Column | None) -> Column:
    def body(x: Column) -> Column:
        return x if escaped is None else F.when(escaped, escape(x)).otherwise(x)

    role, text = turn["role"], turn["text"]
    return (
        F.when(role == "user", F.concat(F.lit(USER[0]), body(text), F.lit(USER[1])))
        .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), body(text), F.lit(ASSISTANT[1])))
        .otherwise(F.concat(F.lit(OTHER[0]), body(role), F.lit(ROLE_END), body(text), F.lit(OTHER[1])))
    )


def _inside(x: Column, marks: tuple[str, str]) -> Column:
    return F.substr(x, F.lit(len(marks[0]) + 1), F.length(x) - F.lit(len(marks[0]) + len(marks[1])))


def _parse_turn(x: Column) -> Column:
    both = _inside(x, OTHER)
    cut = F.instr(both, ROLE_END)
    return (
        F.when(F.startswith(x, F.lit(USER[0])), F.struct(F.lit("user").alias("role"), unescape(_inside(x, USER)).alias("text")))
        .when(F.startswith(x, F.lit(ASSISTANT[0])), F.struct(F.lit("assistant").alias("role"), unescape(_inside(x, ASSISTANT)).alias("text")))
        .otherwise(F.struct(unescape(F.substr(both, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(both, cut + len(ROLE_END))).alias("text")))
    )


def parse_parts(formatted: Column) -> Column:
    """The rendered turns, in order."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (start from 0 and length in characters of assistant texts, as escaped), escaped, round_trip.

    Turns go by turn, then role and text (nulls first); repeated rows stay. Null roles and texts are empty. A conversation is one
    text in the end, so its rows meet in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    chats = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    chats = chats.withColumn("source", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    raw = chats.withColumn("raw", F.array_join(F.transform("source", lambda t: _render(t, None)), ""))

    def agrees(formatted: str, source: str = "source") -> Column:
        parts = parse_parts(F.col(formatted))
        whole = F.length(F.array_join(parts, "")) == F.length(formatted)
        return whole & F.coalesce(F.transform(parts, _parse_turn) == F.col(source), F.lit(False))

    tried = raw.withColumn("escaped", ~agrees("raw"))
    done = tried.withColumn("parts", F.transform("source", lambda t: _render(t, F.col("escaped")))).withColumn("formatted", F.array_join("parts", ""))

    def add(state: Column, x: Column) -> Column:
        is_loss = F.startswith(x, F.lit(ASSISTANT[0]))
        span = F.struct((state["at"] + len(ASSISTANT[0])).alias("start"), (F.length(x) - len(ASSISTANT[0]) - len(ASSISTANT[1])).alias("length"))
        return F.struct((state["at"] + F.length(x)).alias("at"), F.when(is_loss, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("parts", empty, add, lambda s: s["spans"])
    return done.select("conv_id", "formatted", spans.alias("loss_spans"), "escaped", (~F.col("escaped") | agrees("formatted")).alias("round_trip"))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted texts and their loss mask."""
    turns = F.transform(parse_parts(F.col("formatted")), _parse_turn)
    read = formatted.withColumn("turns", turns).withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trip",
    )
