r"""Chat formatting with a grammar round trip (DataFrame functions only).

Template, one turn after another::

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Parser (deterministic): the text is cut before every control string; it is a
conversation if segments alternate between ``<|im_start|>`` + role + line end +
text and exactly ``<|im_end|>`` + line end.  Recovered roles and texts are
unescaped.

Round trip: a conversation is rendered as it is and parsed again.  If any
recovered turn differs from its source, the conversation is rendered with its
content escaped, parsed and compared again; escaped content holds no control
string, so this succeeds (``round_trip`` tells).  Escaping puts a backslash after
the ``<`` of every ``<|`` and ``<~`` (and one more where backslashes stand there
already), and writes a line end inside a role as ``<~n|``; unescaping takes one
away again.

The loss mask lists the spans (code points of the formatted text) of the
trained role's texts.

Defined results: a null text or role is an empty one; rows of a conversation are
ordered by (turn, role, text), null turns first, repeated rows are turns of
their own; a null conv_id is a conversation like any other; an empty table gives
only what ``extra`` holds; other columns are ignored.  The contract's digests are
over whole conversations, so a conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"(?=<\|im_(?:start|end)\|>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)([|~])", r"<\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)([|~])", "<$1$2")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<~n|"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<~n|"), F.lit("\n")))


def render(turns: Column) -> Column:
    """array<struct<role, text>> -> formatted text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def parse(text: Column) -> Column:
    """Formatted text -> array<struct<role, text>>, null if it is not of the grammar."""
    segments = F.filter(F.split(text, _CONTROL), lambda s: s != "")
    well = ((F.size(segments) % 2 == 0)
            & F.forall(F.transform(segments, lambda s, i: F.when(
                i % 2 == 1, s == END + "\n").otherwise(s.startswith(START) & s.contains("\n"))), lambda ok: ok))
    opening = F.filter(segments, lambda s, i: i % 2 == 0)
    size = F.lit(len(START) + 1)

    def turn(s):
        line = F.locate("\n", s)
        return F.struct(unescape_role(F.substring(s, size, line - size)).alias("role"),
                        unescape(F.substring(s, line + 1, F.char_length(s))).alias("text"))
    return F.when(well, F.transform(opening, turn))


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Spans (begin, end) of the role's texts in the rendered turns."""
    none = F.array().cast("array<struct<begin:int,end:int>>")

    def step(acc, t):
        begin = acc["at"] + len(START) + 1 + F.char_length(t["role"])
        end = begin + F.char_length(t["text"])
        mark = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"),
                        F.when(t["role"] == role, F.concat(acc["spans"], mark)).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row for each conversation, its turns in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return (rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))


def format_conversations(rows: DataFrame, role: str = "assistant", **columns) -> DataFrame:
    """(conv_id, formatted, loss_mask, round_trip): loss_mask is array<struct<begin, end>>."""
    whole = conversations(rows, **columns)
    escaped = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    plain = render(F.col("turns"))
    shown = F.when(F.coalesce(parse(plain) == F.col("turns"), F.lit(False)), F.col("turns")).otherwise(escaped)
    out = whole.select("conv_id", "turns", shown.alias("shown"))
    out = out.select("conv_id", "turns", render(F.col("shown")).alias("formatted"), loss_spans(F.col("shown"), role).alias("loss_mask"))
    return out.select("conv_id", "formatted", "loss_mask", F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False)).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask hold: the contract's digests."""
    under = F.array_join(F.transform("loss_mask", lambda s: unescape(
        F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"]))), "")
    turns = parse(F.col("formatted"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return (formatted.withColumn("__turns", turns).withColumn("__loss", under).select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"), sha(F.col("__loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "round_trip"))
