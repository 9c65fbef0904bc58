"""Chat formatting: conversations as one text each, with a loss mask, and the way back; Spark expressions only.

Turns are collected per conversation, sorted by (turn, role, text), and adjacent turns of one role are merged into
one message ``<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n``. Control strings inside texts and roles are made
harmless by one backslash after their first character; strings that already have backslashes
there get one more, so removing one always restores the text.

Defined results: null role and null text count as empty; null turns come first; ties are ordered by role, then text;
repeated rows are repeated turns; rows without conv_id form one conversation without id; an
empty table gives no rows; other columns are not read. A conversation is one output value, so its turns
meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings: the template's own, and those of other common templates.
CONTROL = r"(\|im_(?:start|sep|end)\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, UNESCAPE))


def _role_line(role: Column) -> Column:
    """A role on one line: backslash and line feed get names."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted, n_messages, and loss_mask: runs of code points that are learned or not, in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sorted_turns = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text")))).alias("turns")
    )
    starts = F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[i - 2].role)")
    merged = F.expr(
        "transform(starts, (s, k) -> named_struct('role', turns[s - 1].role, 'texts',"
        " transform(slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s), t -> t.text)))"
    )
    escaped = F.transform(
        "merged",
        lambda m: F.struct(
            (m["role"] == learned).alias("learned"),
            F.concat(F.lit(START), _role_line(m["role"]), F.lit("\n")).alias("head"),
            F.transform(m["texts"], escape).alias("texts"),
        ),
    )
    run = lambda n, on: F.struct(n.alias("n"), on.alias("learned"))
    off, sep, end = F.lit(False), F.lit(len(SEP)), F.lit(len(END) + 1)
    mask = F.flatten(
        F.transform(
            "messages",
            lambda m: F.concat(
                F.array(run(F.length(m["head"]), off)),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, i: F.array(
                            run(F.length(t), m["learned"]), run(F.when(i == F.size(m["texts"]) - 1, end).otherwise(sep), off)
                        ),
                    )
                ),
            ),
        )
    )
    whole = F.array_join(
        F.transform("messages", lambda m: F.concat(m["head"], F.array_join(m["texts"], SEP), F.lit(END + "\n"))), ""
    )
    return (
        sorted_turns.select("conv_id", "turns", starts.alias("starts"))
        .select("conv_id", merged.alias("merged"))
        .select("conv_id", escaped.alias("messages"))
        .select("conv_id", whole.alias("formatted"), F.size("messages").cast("long").alias("n_messages"), mask.alias("loss_mask"))
    )


def read_back(formatted: str | Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    messages = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda m: m != "")
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.substr(m, F.length(F.substring_index(m, "\n", 1)) + 2), r"<\|im_sep\|>"),
                lambda t: F.struct(
                    _role(F.substr(F.substring_index(m, "\n", 1), F.lit(len(START) + 1))).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )


def learned_texts(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """The texts under the loss mask, cut out of the formatted text run by run, and unescaped."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, run: Column) -> Column:
        piece = F.substr(F.col(formatted), a["at"] + 1, run["n"])
        return F.struct((a["at"] + run["n"]).alias("at"), F.when(run["learned"], F.array_append(a["out"], piece)).otherwise(a["out"]).alias("out"))

    return F.transform(F.aggregate(mask, start, step, lambda a: a["out"]), unescape)


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: the turns, and the text under the loss mask."""
    turns = conversations.select("conv_id", "formatted", "n_messages", read_back("formatted").alias("turns"), learned_texts().alias("learned"))
    said = turns.select(
        "*",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("learned", "").alias("loss"),
    )
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )
