"""Chat formatting with relational and array expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import let

#: The template: a merged turn is START role \\n text SEP text ... END, and SEP parts the texts that were merged.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """text without any template string, reversibly: a backslash becomes \\\\b, and <| becomes <\\\\p."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(
    turns: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, formatted, loss_runs), one row a conversation.

    Rows are ordered by turn, then role, then text; a null turn comes first. Adjacent rows of one role become one turn of the
    template, its texts parted by SEP. loss_runs has (on, chars) runs that cover formatted in order; on marks each
    text of loss_role, escaped as it stands there, without SEP or marks. A null role or text is empty; a null conversation is one of its own;
    repeated rows stay; other columns are ignored; an empty table gives no rows. Control strings inside texts
    and roles are escaped reversibly.

    One shuffle, by conversation; a conversation is one string in the result, so its turns meet in one row.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.collect_list(row).alias("rows"))

    def merge(rows: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (rows[i]["role"] != rows[F.greatest(i - 1, F.lit(0))]["role"]))
        return let(first, lambda at: F.transform(F.zip_with(at, F.slice(F.concat(at, F.array(F.size(rows))), 2, F.size(at)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: F.struct(_role_out(rows[r["a"]]["role"]).alias("out"), rows[r["a"]]["role"].alias("role"), F.transform(F.slice(rows, r["a"] + 1, r["b"] - r["a"]), lambda t: escaped(t["text"])).alias("texts"))))

    merged = chats.select("conv", let(F.sort_array("rows"), merge).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["out"], F.lit("\n"), F.array_join(t["texts"], SEP), F.lit(END))), "")

    def run(on: bool, chars: Column) -> Column:
        return F.struct(F.lit(on).alias("on"), chars.cast("int").alias("chars"))

    def runs(t: Column) -> Column:
        head = run(False, F.length(t["out"]) + len(START) + 1)
        inside = F.flatten(F.transform(t["texts"], lambda x, i: F.filter(F.array(F.when(i > 0, run(False, F.lit(len(SEP)))), run(True, F.length(x))), lambda r: r.isNotNull())))
        plain = F.array(run(False, F.length(F.array_join(t["texts"], SEP))))
        return F.concat(F.array(head), F.when(t["role"] == loss_role, inside).otherwise(plain), F.array(run(False, F.lit(len(END)))))

    return merged.select(F.col("conv").alias(conv_col), text.alias("formatted"), F.flatten(F.transform("turns", runs)).alias("loss_runs"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text) rows read back from a formatted conversation, in order."""

    def rows(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(_role_in(head).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != ""), rows))


def runs_of(formatted: Column, loss_role: str = "assistant") -> Column:
    """The (on, chars) runs of a formatted conversation, from its marks alone."""

    def run(on: bool, chars: Column) -> Column:
        return F.struct(F.lit(on).alias("on"), chars.cast("int").alias("chars"))

    def texts(body: Column) -> Column:
        return F.flatten(F.transform(F.split(body, r"<\|im_sep\|>"), lambda t, i: F.filter(F.array(F.when(i > 0, run(False, F.lit(len(SEP)))), run(True, F.length(t))), lambda r: r.isNotNull())))

    def runs(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        inside = F.when(_role_in(head) == loss_role, texts(body)).otherwise(F.array(run(False, F.length(body))))
        return F.concat(F.array(run(False, F.length(head) + len(START) + 1)), inside, F.array(run(False, F.lit(len(END)))))

    return F.flatten(F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != ""), runs))


def digests(chats: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id") -> DataFrame:
    """Digest columns of formatted conversations, read back from formatted and checked against loss_runs.

    Where texts of loss_role stand in formatted is read from its marks; where any run of the mask begins or ends elsewhere, the job fails.
    """
    read = chats.select(conv_col, "formatted", "loss_runs", parsed(F.col("formatted")).alias("rows"))
    under = F.filter("rows", lambda r: r["role"] == loss_role)
    read = read.select(conv_col, "formatted", "rows", F.transform(under, lambda r: r["text"]).alias("loss"), "loss_runs", runs_of(F.col("formatted"), loss_role).alias("mask"))
    same = F.coalesce(F.col("loss_runs") == F.col("mask"), F.lit(False))
    loss = F.array_join("loss", "")
    return read.select(
        conv_col,
        F.size("rows").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.when(same, F.length(loss)).otherwise(F.raise_error(F.lit("the loss mask differs from the text"))).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
